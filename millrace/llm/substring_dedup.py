"""Substring deduplication: spans of words that also start earlier in the corpus.

Two operators:

``remove_known`` takes bounded reference texts, cut into shards. Each shard's suffix
automaton over words is broadcast and the documents are streamed past it: matching
statistics give, at each word, the longest match that ends there, and the words of
maximal matches of ``WINDOW`` words or more are removed.

``remove_repeats`` compares the corpus with itself. Automata of the whole corpus have
no size bound to broadcast, and streaming every document past every shard is
quadratic, so windows are matched by content hash instead (see the README):

1. Each window of ``WINDOW`` words has one anchor, the least hash of its ``GRAM``-word
   stretches. Anchors are counted by hash; only windows whose anchor occurs twice can
   repeat.
2. The candidates' windows are hashed to 96 bits and brought together by anchor; of
   equal windows the one with the smallest (doc_id, start) is the first, the others
   are covered. Both exchanges send packed arrays, each anchor or window once per
   chunk of documents, so a passage that many documents share costs a row a chunk.
3. Texts with covered windows are joined with them and cut.

Texts are shuffled only where a filter, sized by the keys, says that they may take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

WINDOW = 20
GRAM = 8
#: Words of a chunk: what one packed row covers before it is split by bucket.
CHUNK_WORDS = 1 << 20
#: Words that one bucket of an exchange is planned to hold.
BUCKET_WORDS = 4 << 20
MIN_BUCKETS = 12
#: Repeated anchors or windows that a task keeps in mind, so that it sends each once and not once a chunk; beyond that it sends more.
KNOWN = 1 << 19
NO_ID = (1 << 63) - 1
#: Seed of the words' second hashes: two windows are equal by 64 bits of the first and 32 bits of these.
SECOND = 1
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes, seed: int = 0) -> np.ndarray:
    """One 64-bit hash for each word of a text; those of different seeds are independent."""
    from xxhash import xxh3_64_intdigest

    words = text.split()
    return np.fromiter(
        map(xxh3_64_intdigest, words, repeat(seed)), np.uint64, len(words)
    ) if seed else np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def _rolling(codes: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A polynomial hash of each stretch of n codes, by doubling: O(log n) passes."""
    m = len(codes) - n + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    out, taken = None, 0
    block, size, power = codes, 1, base
    while n:
        if n & 1:
            part = block[taken : taken + m]
            # What stands to the right is weighted by the length to its left.
            out = part.copy() if out is None else out + part * _power(base, taken)
            taken += size
        n >>= 1
        if n:
            block = block[: len(block) - size] + block[size:] * power
            size *= 2
            power = _power(base, size)
    return _mixed(out)


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct anchor positions, for each window the ordinal of its anchor): the leftmost least gram hash."""
    grams = _rolling(codes, GRAM, ODD)
    reach = WINDOW - GRAM + 1
    m = len(grams) - reach + 1
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, where = grams[:m].copy(), np.arange(m)
    for j in range(1, reach):
        less = grams[j : j + m] < least
        least[less] = grams[j : j + m][less]
        where[less] = np.arange(j, j + m)[less]
    # Leftmost anchors never move back, so equal neighbours are one.
    new = np.r_[True, where[1:] != where[:-1]]
    return where[new], np.cumsum(new) - 1


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed byte planes."""
    n = len(next(iter(arrays.values())))
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(n, a.itemsize).T).tobytes() for a in arrays.values()]
    return zstandard.ZstdCompressor(level=1).compress(n.to_bytes(8, "little") + b"".join(planes))


def unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, found = int.from_bytes(raw[:8], "little"), 8, []
    for t in types:
        size = np.dtype(t).itemsize
        found.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(t).reshape(n))
        at += n * size
    return found


def _split(bucket: np.ndarray, buckets: int, arrays: dict[str, np.ndarray]) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        part = order[edges[b] : edges[b + 1]]
        yield int(b), pack(**{k: a[part] for k, a in arrays.items()})


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``_key``, which rows share only if id and text are equal."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("_key"))


def _bucket_rows(batches: Iterator[pa.RecordBatch], take, flush) -> Iterator[pa.RecordBatch]:
    held = 0
    for part, texts in work.text_slices(batches):
        columns = part.schema.names
        rows = list(zip(*[part.column(i).to_pylist() for i, c in enumerate(columns) if c != "text"], texts, strict=True))
        for row in rows:
            held += take(row)
            if held >= CHUNK_WORDS:
                yield from flush()
                held = 0
    yield from flush()


PACKED = "bucket int, blob binary, _key long, ordinals array<int>"


def _packed(rows: list[tuple[int, bytes]], direct: list[tuple[int, list[int]]], places: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows of blobs, then rows of what is settled already; ``bucket`` is the key that leads to the bucket's own partition."""
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("_key", pa.int64()), ("ordinals", pa.list_(pa.int32()))])
    for i in range(0, len(rows), 256):
        some = rows[i : i + 256]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([places[b] for b, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary()), pa.nulls(len(some), pa.int64()),
                pa.nulls(len(some), pa.list_(pa.int32()))
            ],
            schema=schema
        )
    for i in range(0, len(direct), 4096):
        some = direct[i : i + 4096]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([places[k % len(places)] for k, _ in some], pa.int32()), pa.nulls(len(some), pa.binary()),
                pa.array([k for k, _ in some], pa.int64()), pa.array([x for _, x in some], pa.list_(pa.int32()))
            ],
            schema=schema
        )


def _by_key(keys: np.ndarray, values: np.ndarray) -> list[tuple[int, list[int]]]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
    return [(int(keys[a]), v.tolist()) for a, v in zip(cuts, np.split(values, cuts[1:]) if len(keys) else [], strict=True)]


def _place(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each value is in a sorted array, -1 where it is not."""
    if not len(known):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, at, -1)


def _anchor_rows(batches: Iterator[pa.RecordBatch], places: list[int]) -> Iterator[pa.RecordBatch]:
    """Anchors of a chunk, each once; those that the chunk itself repeats, or that an earlier one did, are known to be shared."""
    hashes, keys, ordinals = [], [], []
    buckets, seen = len(places), np.zeros(0, np.uint64)

    def take(row) -> int:
        _, key, text = row
        codes = word_hashes(text)
        at, _ = anchors(codes)
        if len(at):
            hashes.append(_rolling(codes, GRAM, ODD)[at])
            keys.append(np.full(len(at), key, np.int64))
            ordinals.append(np.arange(len(at), dtype=np.int32))
        return len(codes)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal seen
        if not hashes:
            return
        h, k, o = np.concatenate(hashes), np.concatenate(keys), np.concatenate(ordinals)
        hashes.clear(), keys.clear(), ordinals.clear()
        order = np.argsort(h, kind="stable")
        h, k, o = h[order], k[order], o[order]
        new = np.r_[True, h[1:] != h[:-1]]
        each = h[new]
        count = np.diff(np.r_[np.flatnonzero(new), len(h)])
        known = _place(seen, each) >= 0
        shared = np.repeat((count > 1) | known, count)
        # The bucket must know that the repeated ones occur, too: for other tasks' sake.
        keep = new & ~np.repeat(known, count)
        b = (h[keep] % np.uint64(buckets)).astype(np.int64)
        rows = [(i, blob) for i, blob in _split(b, buckets, {"h": h[keep], "k": k[keep], "o": o[keep]})]
        yield from _packed(rows, _by_key(k[shared], o[shared]), places)
        if len(seen) < KNOWN:
            seen = np.union1d(seen, each[(count > 1) & ~known])

    yield from _bucket_rows(batches, take, flush)


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: anchors that more than one chunk has."""
    held: dict[int, list] = {}
    for batch in batches:
        for bucket, blob, key, ordinals in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if blob is None:
                yield pa.RecordBatch.from_pydict({"_key": pa.array([key], pa.int64()), "ordinals": pa.array([ordinals], pa.list_(pa.int32()))})
            else:
                held.setdefault(bucket, []).append(unpack(blob, np.uint64, np.int64, np.int32))
    for parts in held.values():
        h, k, o = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(h, kind="stable")
        h, k, o = h[order], k[order], o[order]
        same = h[1:] == h[:-1]
        twice = np.r_[False, same] | np.r_[same, False]
        found = _by_key(k[twice], o[twice])
        for i in range(0, len(found), 8192):
            yield pa.RecordBatch.from_pydict(
                {
                    "_key": pa.array([x for x, _ in found[i : i + 8192]], pa.int64()),
                    "ordinals": pa.array([x for _, x in found[i : i + 8192]], pa.list_(pa.int32()))
                }
            )


def _window_rows(batches: Iterator[pa.RecordBatch], places: list[int]) -> Iterator[pa.RecordBatch]:
    """Candidate windows of a chunk: of equal ones only the first, unless an earlier chunk had one before it; the others are known to be covered."""
    a1, a2, ids, keys, starts, homes = [], [], [], [], [], []
    buckets = len(places)
    seen = [np.zeros(0, t) for t in (np.uint64, np.uint32, np.int64, np.int32)]  # hashes, id and start of repeated windows

    def take(row) -> int:
        doc_id, key, flagged, text = row
        codes = word_hashes(text)
        at, anchor_of = anchors(codes)
        if not len(at) or not flagged:
            return len(codes)
        wanted = np.zeros(len(at), bool)
        wanted[np.array([i for i in flagged if i < len(at)], np.int64)] = True
        w = np.flatnonzero(wanted[anchor_of])
        a1.append(_rolling(codes, WINDOW, ODD)[w])
        a2.append(_rolling(word_hashes(text, SECOND), WINDOW, np.uint64(0xD1342543DE82EF95))[w].astype(np.uint32))
        ids.append(np.full(len(w), NO_ID if doc_id is None else doc_id, np.int64))
        keys.append(np.full(len(w), key, np.int64))
        starts.append(w.astype(np.int32))
        homes.append((_rolling(codes, GRAM, ODD)[at] % np.uint64(buckets)).astype(np.int64)[anchor_of[w]])
        return len(codes)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal seen
        if not a1:
            return
        h1, h2, i, k, s, b = (np.concatenate(x) for x in (a1, a2, ids, keys, starts, homes))
        for x in (a1, a2, ids, keys, starts, homes):
            x.clear()
        first, later, order = _first_of_equal(h1, h2, i, s)
        own = [x[order] for x in (h1, h2, i, s)]
        heads = np.flatnonzero(np.r_[True, (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1])])
        count = np.diff(np.r_[heads, len(order)])
        mine = [x[heads] for x in own]
        at = _place(seen[0], mine[0])
        had = [x[at] if len(x) else np.zeros(len(at), x.dtype) for x in seen]
        before = (at >= 0) & (had[1] == mine[1]) & ((had[2] < mine[2]) | ((had[2] == mine[2]) & (had[3] < mine[3])))
        gone = np.repeat(before, count)
        first, later = first & ~gone, later | gone
        if len(seen[0]) < KNOWN:
            more = [np.concatenate([x, y[(count > 1) & ~before]]) for x, y in zip(seen, mine, strict=True)]
            best = np.lexsort((more[3], more[2], more[1], more[0]))
            best = best[np.r_[True, more[0][best][1:] != more[0][best][:-1]]] if len(best) else best
            seen = [x[best] for x in more]
        rows = [
            (n, blob)
            for n, blob in _split(
                b[order][first], buckets,
                {"h1": h1[order][first], "h2": h2[order][first], "i": i[order][first], "k": k[order][first], "s": s[order][first]}
            )
        ]
        yield from _packed(rows, _runs(k[order][later], s[order][later]), places)

    yield from _bucket_rows(batches, take, flush)


def _first_of_equal(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which are first, which are covered, order): sorted by hash, id, start. Of entries at one id and start all are first."""
    order = np.lexsort((starts, ids, h2, h1))
    h1, h2, ids, starts = h1[order], h2[order], ids[order], starts[order]
    new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    first = (ids == ids[head]) & (starts == starts[head])
    return first, ~first, order


def _runs(keys: np.ndarray, starts: np.ndarray) -> list[tuple[int, list[int]]]:
    """Per key, runs of consecutive starts as (start, length, start, length, ...)."""
    if not len(keys):
        return []
    order = np.lexsort((starts, keys))
    k, s = keys[order], starts[order].astype(np.int64)
    new = np.r_[True, (k[1:] != k[:-1]) | (s[1:] > s[:-1] + 1)]
    at = np.flatnonzero(new)
    length = s[np.r_[at[1:] - 1, len(s) - 1]] - s[at] + 1
    return _by_key(np.repeat(k[at], 2), np.stack([s[at], length], axis=1).reshape(-1))


def _covered_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        for bucket, blob, key, ordinals in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if blob is None:
                yield pa.RecordBatch.from_pydict({"_key": pa.array([key], pa.int64()), "ordinals": pa.array([ordinals], pa.list_(pa.int32()))})
            else:
                held.setdefault(bucket, []).append(unpack(blob, np.uint64, np.uint32, np.int64, np.int64, np.int32))
    for parts in held.values():
        h1, h2, i, k, s = (np.concatenate([p[j] for p in parts]) for j in range(5))
        _, later, order = _first_of_equal(h1, h2, i, s)
        found = _runs(k[order][later], s[order][later])
        for n in range(0, len(found), 8192):
            yield pa.RecordBatch.from_pydict(
                {
                    "_key": pa.array([x for x, _ in found[n : n + 8192]], pa.int64()),
                    "ordinals": pa.array([x for _, x in found[n : n + 8192]], pa.list_(pa.int32()))
                }
            )


def _places(docs: DataFrame, buckets: int) -> list[int]:
    """For each of so many partitions an integer that hash partitioning sends there, so that a bucket has one to itself."""
    some = docs.sparkSession.range(20 * buckets + 200).select(F.col("id").cast("int").alias("k"))
    found = some.groupBy(F.expr(f"pmod(hash(k), {buckets})").alias("p")).agg(F.min("k").alias("k")).collect()  # one row per partition
    return [k for _, k in sorted((r["p"], r["k"]) for r in found)]


def _exchange(rows: DataFrame, buckets: int, then) -> DataFrame:
    """Packed rows by bucket through ``then``."""
    found = rows.repartition(buckets, "bucket").mapInArrow(then, "_key long, ordinals array<int>")
    return found.groupBy("_key").agg(F.flatten(F.collect_list("ordinals")).alias("ordinals"))


def _maybe(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key among ``keys``, rows that have none)."""
    passes = work.passes(keys, "_key")(F.col("_key"))
    return docs.filter(passes), docs.filter(~passes)


def _digest(words: list[bytes], runs: list[int] | None) -> tuple[int, int, str]:
    if not runs:
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    gone = removed_words(len(words), runs)
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def removed_words(n: int, runs: list[int]) -> np.ndarray:
    """Which of n words lie in a covered window; ``runs`` are starts and lengths of runs of windows."""
    pairs = np.array(runs, np.int64).reshape(-1, 2)
    depth = np.zeros(n + WINDOW + 1, np.int64)
    np.add.at(depth, pairs[:, 0], 1)
    np.add.at(depth, np.minimum(pairs[:, 0] + pairs[:, 1] - 1 + WINDOW, n), -1)
    return np.cumsum(depth)[:n] > 0


def _digests(batches: Iterator[pa.RecordBatch], cut: bool) -> Iterator[pa.RecordBatch]:
    for part, texts in work.text_slices(batches):
        runs = part.column(2).to_pylist() if cut else [None] * len(texts)
        got = [_digest(x.split(), r) for x, r in zip(texts, runs, strict=True)]
        columns = {
            "doc_id": part.column(0), "n_words": pa.array([g[0] for g in got], pa.int64()), "n_removed": pa.array([g[1] for g in got], pa.int64()),
            "kept_sha256": pa.array([g[2] for g in got], pa.string())
        }
        yield pa.RecordBatch.from_pydict(columns)


def covered_runs(docs: DataFrame) -> DataFrame:
    """(_key, ordinals): runs of covered windows, as starts and lengths, of rows of ``keyed`` documents."""
    words = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"] // 6
    places = _places(docs, max(MIN_BUCKETS, -(-words // BUCKET_WORDS)))
    buckets = len(places)
    shared = work.cut(
        _exchange(docs.select("doc_id", "text", "_key").mapInArrow(lambda it: _anchor_rows(it, places), PACKED), buckets, _shared_anchors)
    )
    may, _ = _maybe(docs, shared)
    candidates = may.join(shared, "_key").select("doc_id", "text", "_key", "ordinals").mapInArrow(lambda it: _window_rows(it, places), PACKED)
    return work.cut(_exchange(candidates, buckets, _covered_windows))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    A window that also starts earlier (smaller doc_id, or same document, earlier
    start) has its words removed. Nulls: a null text has no words; rows without a
    doc_id come after all others, as one document. Rows that repeat id and text are
    one document and get the same result; texts under one id are one document's, by
    start. An empty table gives no rows. Other columns are not read.
    """
    rows = keyed(docs)
    runs = covered_runs(rows)
    may, rest = _maybe(rows, runs)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    touched = may.join(runs, "_key", "left").select("doc_id", "text", "ordinals").mapInArrow(lambda it: _digests(it, True), schema)
    return touched.union(rest.select("doc_id", "text").mapInArrow(lambda it: _digests(it, False), schema))


class WordAutomaton:
    """The suffix automaton of the word sequences of some texts."""

    def __init__(self, texts: list[bytes]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        for t in texts:
            last = 0
            for w in t.split():
                last = self._add(last, w)

    def _add(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        known = nxt[last].get(w)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._copy(last, known, w)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._copy(p, q, w)
        return new

    def _copy(self, p: int, q: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def statistics(self, words: list[bytes]) -> np.ndarray:
        """For each word, the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.len
        state = matched = 0
        out = np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            out[i] = matched
        return out


#: Words of one reference shard: what bounds its automaton, and so the broadcast.
SHARD_WORDS = 200_000


def remove_known(docs: DataFrame, reference: list[str], window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: without the words of maximal matches of ``window`` words with a reference text.

    ``reference`` is a bounded list, such as a benchmark's passages. It is cut into
    shards of ``shard_words`` words at most (a longer text is a shard by itself); each
    shard's automaton is built on the executors from the broadcast texts.
    """
    shards: list[list[bytes]] = []
    room = 0
    for t in reference:
        raw = (t or "").encode()
        n = len(raw.split())
        if n > room or not shards:
            shards.append([])
            room = shard_words
        shards[-1].append(raw)
        room -= n
    sent = docs.sparkSession.sparkContext.broadcast(shards)
    name = hashlib.sha256(repr(shards).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = work.process_cache()
        machines = cache.setdefault(("automata", name), [WordAutomaton(s) for s in sent.value])
        for part, texts in work.text_slices(batches):
            rows = []
            for x in texts:
                words = x.split()
                depth = np.zeros(len(words) + 1, np.int64)
                for machine in machines:
                    found = machine.statistics(words)
                    ends = np.flatnonzero(found >= window)
                    np.add.at(depth, ends - found[ends] + 1, 1)
                    np.add.at(depth, ends + 1, -1)
                gone = np.cumsum(depth[:-1]) > 0
                rows.append((len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column(0), "n_words": pa.array([r[0] for r in rows], pa.int64()),
                    "n_removed": pa.array([r[1] for r in rows], pa.int64()),
                    "kept_text": pa.array([r[2].decode("utf-8", "replace") for r in rows], pa.string())
                }
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
