"""BPE encoding by dynamic programming over prefixes, and decoding.

A token sequence is what BPE's merges give exactly if each two neighbours would be
left apart when merged by themselves, so every prefix of a word has one last token.
A suffix automaton of the vocabulary, fed with the word, yields the tokens that end
at each place, the longest first; the first that is compatible with the last token
of the prefix before it is stored, and the stored tokens are followed back from
the end. Time is linear in the word, whatever the number of merges.

Words are encoded once while they stay in a bounded cache. A text is handled in one
task, in memory proportional to its length; there is no shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import work

#: Stands for the end of a word, in place of the vocabulary's suffix; no byte is written so.
END = "\n"
#: Words kept encoded, none longer than this; beyond that the cache starts anew.
CACHE_WORDS, CACHE_LENGTH = 250_000, 256
#: Outside the scripts whose letters all Unicode versions in use agree on.
UNUSUAL = re.compile(
    "[^\x00-\u0233\u0300-\u036f\u0391-\u03a1\u03a3-\u03ce\u0400-\u052f\u1e00-\u1eff\u2000-\u2064\u20a0-\u20b9\u2190-\u23f3\u2500-\u27bf\u3000-\u303f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fcc\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f5ff\U0001f600-\U0001f64f]"
)
NOT_LATIN = re.compile("[^\x00-\xff]")


@dataclass(frozen=True)
class Vocabulary:
    """What a vocabulary file says: ids by token, merges in order, the words' pattern and suffix, special tokens."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    pattern: str
    suffix: str
    special: dict[str, int]
    source: str

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            source = f.read()
        found = json.loads(source)
        model = found["model"]
        split = next(x for x in found["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        return cls(
            model["vocab"], merges, split["pattern"]["Regex"], model["end_of_word_suffix"] or "",
            {x["content"]: x["id"] for x in found["added_tokens"]}, source
        )

    @property
    def key(self) -> str:
        return hashlib.sha256(self.source.encode()).hexdigest()


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class SuffixAutomaton:
    """Of several strings: for a text read so far, the longest suffix that occurs in one of them."""

    def __init__(self, strings: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.state_of: list[int] = []
        for s in strings:
            last = 0
            for c in s:
                last = self._extend(last, c)
            self.state_of.append(last)
        self._settle(strings)

    def _extend(self, last: int, c: str) -> int:
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(c)
        if q is not None:  # an earlier string has gone this way
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: str) -> int:
        nxt, link, length = self.next, self.link, self.len
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def _settle(self, strings: list[str]) -> None:
        """Later clones move strings to other states: look each up again."""
        for i, s in enumerate(strings):
            at = 0
            for c in s:
                at = self.next[at][c]
            self.state_of[i] = at


class _Words(dict):
    """Ids of words, encoded when first asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        """A word that starts with END is in byte characters already."""
        piece = word[1:] if word[:1] == END else word.encode().decode("latin-1").translate(self.encoder.table)
        found = self.encoder.word_ids(piece)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


class Encoder:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        ids, suffix = vocabulary.ids, vocabulary.suffix
        self.token_of = {i: t for t, i in ids.items()} | {i: t for t, i in vocabulary.special.items()}
        pair_ids = {
            (ids[a], ids[b]): ids[a + b if not (suffix and a.endswith(suffix) and len(a) > len(suffix)) else a[: -len(suffix)] + b]
            for a, b in vocabulary.merges
        }
        self.rank = {pair: n for n, pair in enumerate(pair_ids)}
        self.made_at = {t: self.rank[pair] for pair, t in pair_ids.items()}
        self.halves = {t: pair for pair, t in pair_ids.items()}
        alphabet = byte_alphabet()
        self.table = {b: c for b, c in alphabet.items() if chr(b) != c}
        symbols: dict[int, str] = {}
        for c in alphabet.values():
            symbols[ids[c]] = c
            if suffix:
                symbols[ids[c + suffix]] = c + END
        for t, (a, b) in self.halves.items():  # in merge order: the halves come first
            symbols[t] = symbols[a] + symbols[b]
        tokens = list(symbols)
        self.automaton = SuffixAutomaton([symbols[t] for t in tokens])
        self.ends: list[list[tuple[int, int]] | None] = [None] * len(self.automaton.next)
        for t, state in zip(tokens, self.automaton.state_of, strict=True):
            self.ends[state] = sorted([*(self.ends[state] or []), (len(symbols[t]), t)], reverse=True)
        self.up = self._nearest()
        self.together: dict[int, bool] = {}
        self.words = regex.compile(vocabulary.pattern)
        self.narrow_words = re.compile(self._for_latin(vocabulary.pattern))
        self.specials = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True)) + ")"
        ) if vocabulary.special else None
        self.special_starts = {x[0] for x in vocabulary.special}
        self._library: Tokenizer | None = None
        # Each token as decoding writes it, with the space that parts it from the next; null where there is no such id.
        self.pieces = pa.array(
            [None if (t := self.token_of.get(i)) is None else t.encode() + b" " for i in range(max(self.token_of) + 1)], pa.large_binary()
        )
        self.ids = _Words(self)

    @property
    def library(self) -> Tokenizer:
        """The library's own tokenizer, made when a text first needs it."""
        if self._library is None:
            self._library = Tokenizer.from_str(self.vocabulary.source)
        return self._library

    def _for_latin(self, pattern: str) -> str:
        """The pattern for texts of Latin-1 characters, with each class written out."""
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            one = regex.compile(name)
            pattern = pattern.replace(name, "".join(re.escape(chr(c)) for c in range(256) if one.match(chr(c))))
        return pattern.replace("[[", "[").replace("]]", "]") if "[[" in pattern else pattern

    def _nearest(self) -> list[int]:
        """For each state, the nearest shorter one at which a token ends (0: none)."""
        link, length = self.automaton.link, self.automaton.len
        up = [0] * len(link)
        for s in sorted(range(1, len(link)), key=length.__getitem__):
            up[s] = link[s] if self.ends[link[s]] else up[link[s]]
        return up

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves two neighbouring tokens apart.

        Undo merges next to the border, the latest first; if two tokens that meet there
        have a merge that comes before the one undone, it would have crossed the border.
        Of equal merges the one further left happens first.
        """
        a, b, limit, fine = left, right, None, True
        rank, made, halves = self.rank, self.made_at, self.halves
        while True:
            crossing = rank.get((a, b))
            if crossing is not None and (limit is None or (crossing, 1) < limit):
                fine = False
                break
            at_a, at_b = made.get(a, -1), made.get(b, -1)
            if at_a < 0 and at_b < 0:
                break
            # Equal merges: the left one happened first, so the right one is undone first.
            if at_a > at_b:
                limit, a = (at_a, 1), halves[a][1]
            else:
                limit, b = (at_b, 2), halves[b][0]
        if len(self.together) > 200_000:
            self.together.clear()
        self.together[left << 32 | right] = fine
        return fine

    def encode_word(self, word: str) -> list[int]:
        """``word`` in byte characters, its end marked where the vocabulary marks it."""
        nxt, link, length, ends, up, together = self.automaton.next, self.automaton.link, self.automaton.len, self.ends, self.up, self.together
        marked = word[-1:] == END
        n = len(word)
        last, came = [-1] * (n + 1), [0] * (n + 1)
        state = matched = 0
        for i, c in enumerate(word, 1):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(c)
            if to is not None:
                state = to
                matched += 1
            if marked and i == n - 1:
                continue  # the last character and the mark are one symbol
            s = state
            while s:
                for size, t in ends[s] or ():
                    if size <= matched:
                        before = i - size
                        if before:
                            left = last[before]
                            fine = left >= 0 and together.get(left << 32 | t)
                            if fine is None:
                                fine = self.compatible(left, t)
                        else:
                            fine = self._whole(t)
                        if fine:
                            last[i], came[i] = t, before
                            s = 0
                            break
                else:
                    s = up[s]
        found = []
        while n:
            found.append(last[n])
            n = came[n]
        found.reverse()
        return found

    def _whole(self, t: int) -> bool:
        """Whether merging a token's own symbols gives the token: its halves must, and must have stayed apart until then."""
        pair = self.halves.get(t)
        if pair is None:
            return True
        key = -1 - t
        if key not in self.together:
            self.together[key] = self._whole(pair[0]) and self._whole(pair[1]) and self._apart_until(*pair, self.made_at[t])
        return self.together[key]

    def _apart_until(self, a: int, b: int, when: int) -> bool:
        rank, made, halves, limit = self.rank, self.made_at, self.halves, (when, 1)
        while True:
            at_a, at_b = made.get(a, -1), made.get(b, -1)
            if at_a < 0 and at_b < 0:
                return True
            if at_a > at_b:
                limit, a = (at_a, 1), halves[a][1]
            else:
                limit, b = (at_b, 2), halves[b][0]
            crossing = rank.get((a, b))
            if crossing is not None and (crossing, 1) < limit:
                return False

    def word_ids(self, piece: str) -> bytes:
        ids = self.encode_word(piece + (END if self.vocabulary.suffix else ""))
        return b"".join([t.to_bytes(4, "little") for t in ids])

    def _split(self, text: str) -> list[str]:
        """The words of a text without special tokens: NFC, lower case by character (no rule for a last sigma), the pattern."""
        if text.isascii():
            return self.narrow_words.findall(text.lower())
        if UNUSUAL.search(text) is None:
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
            return (self.words if NOT_LATIN.search(text) else self.narrow_words).findall(text)
        # Characters that Unicode versions class differently: the library's own front end splits these texts.
        pieces = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
        return [END + p for p in pieces]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        found = self.ids.__getitem__
        if not any(c in text for c in self.special_starts) or self.specials.search(text) is None:
            return b"".join(map(found, self._split(text)))
        parts = enumerate(self.specials.split(text))
        return b"".join(
            self.vocabulary.special[part].to_bytes(4, "little") if i % 2 else b"".join(map(found, self._split(part))) for i, part in parts
        )

    def decode_all(self, ids: list[bytes]) -> list[bytes]:
        """What each of several id sequences decodes to, in UTF-8: the ids' tokens gathered at once, then cut where a sequence ends."""
        taken = self.pieces.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        if taken.null_count:
            raise KeyError("an id that the vocabulary does not have")
        _, offsets, data = taken.buffers()
        if data is None:
            return [b""] * len(ids)
        edges = np.frombuffer(offsets, np.int64)[: len(taken) + 1][np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        view = memoryview(data)
        return [bytes(view[a : max(a, b - 1)]) for a, b in zip(edges, edges[1:])]

    def decode(self, ids: bytes) -> str:
        return self.decode_all([ids])[0].decode()


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder for a process and vocabulary."""
    cache = work.process_cache()
    key = ("bpe", vocabulary.key)
    if key not in cache:
        cache[key] = Encoder(vocabulary)
    return cache[key]


def _texts(part: pa.RecordBatch) -> list[str]:
    return [x or "" for x in part.column(1).to_pylist()]


def encode_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ``ids``, an array of token ids, one row per row of ``docs``.

    Nulls: a null text is empty and has no ids; a null doc_id stays null. Repeated
    rows repeat. An empty table gives no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the size of the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(shared.value)
        for part, _ in work.text_slices(batches):
            ids = [np.frombuffer(one.encode(x), "<u4").astype(np.int32) for x in _texts(part)]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ``text``, the decoding of ``ids``; null ids decode to the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = encoder(shared.value)
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = one.decode_all([np.array(ids or (), "<u4").tobytes() for ids in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "text": pa.array([x.decode() for x in texts], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_check(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of what decoding the ids gives, one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(shared.value)
        for part, _ in work.text_slices(batches):
            ids = [one.encode(x) for x in _texts(part)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.ListArray.from_arrays(
                    offsets, pa.array(np.frombuffer(b"".join(ids), "<i4"))
                ),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in one.decode_all(ids)], pa.string()),
            })

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return work.in_python(texts, run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string", keep=True)


def digest(one: Encoder, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
    """For each text the number of tokens, and the SHA-256 of its ids and of what decoding them gives."""
    ids = [one.encode(x) for x in texts]
    return [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x).hexdigest() for x in one.decode_all(ids)]


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256; nulls as in ``encode_documents``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(shared.value)
        for part, _ in work.text_slices(batches):
            counts, ids, decoded = digest(one, _texts(part))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(decoded)}
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
