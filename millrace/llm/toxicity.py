"""Toxicity by compression distance.

Two zstandard dictionaries are composed as raw content, with no zstandard training,
from labelled text: one on ordinary text
(its commonest words), one on toxic text (the same base, and the segments that set
toxic documents apart, chosen greedily so that each toxic document is covered
several times). A window is one word between fixed bytes that both dictionaries
hold, so that its compressed length shows what the word itself costs. Windows that
the toxic dictionary compresses shorter by more bytes than thresholds allow are
counted; a logistic model, fitted to the same labelled rows, calibrates the counts
to a score.

Dictionaries that zstandard's own training gives from the same text tell the classes
apart far worse (figures in the README), so training here chooses the content.

Training reads a bounded sample of labelled rows (``TRAIN_ROWS`` and ``TRAIN_BYTES`` a
class, by hash). Scoring handles each text whole, in one task, without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

#: At most so many labelled rows, of so many bytes together, are learned from in each class.
TRAIN_ROWS, TRAIN_BYTES = 2000, 8 << 20
FOLDS = 5
#: Bytes that come before and after each window's word; the compressor matches the first and leaves the last.
LEAD = b"0123456789abcdefghijklmnopqrstuvwxyz=ABCDEFGHIJKLMNOPQRSTUVWXYZ!"
TAIL = b"........"
BASE_WORDS = 1000
SEGMENT_LENGTHS = (5, 6, 7, 8, 9)
MAX_SEGMENTS = 96
COVER = 6
#: Least twice log-likelihood ratio of a segment over all training documents, and over those not yet covered.
EVIDENCE, LATE_EVIDENCE = 40.0, 20.0
#: Bytes saved from which a window counts, one count for each.
THRESHOLDS = (1, 2, 3, 4, 5, 6)
CACHE_WORDS = 400_000
#: Slots of the table that counts segments by hash.
HASHED = 1 << 22


@dataclass(frozen=True)
class Model:
    """Two dictionaries' contents and the calibration."""

    ordinary: bytes
    toxic: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def segments(text: bytes) -> set[bytes]:
    """Stretches of the text's words, with the spaces around them, of each length."""
    found: set[bytes] = set()
    for w in set(text.lower().split()):
        w = b" " + w + b" "
        for n in SEGMENT_LENGTHS:
            found.update([w[i : i + n] for i in range(len(w) - n + 1)])
    return found


def evidence(a: int, n: int, b: int, m: int) -> float:
    """Twice the log-likelihood ratio that ``a`` of ``n`` documents is more than ``b`` of ``m``; 0 where it is not."""
    if not n or not m or a * m <= b * n:
        return 0.0

    def fit(k: int, total: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((total - k) * math.log(1 - p) if total - k else 0.0)

    return 2 * (fit(a, n, a / n) + fit(b, m, b / m) - fit(a, n, (a + b) / (n + m)) - fit(b, m, (a + b) / (n + m)))


def toxic_segments(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Segments that set toxic texts apart, by greedy cover. Copies count once.

    Segments are first counted by hash in a table of fixed size, so that only those
    that may be frequent enough are held.
    """
    own, plain = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    n, m = len(own), len(plain)
    if not n or not m:
        return []
    least = max(4, math.ceil(EVIDENCE / (2 * math.log((n + m) / n))))
    mask, table = HASHED - 1, np.zeros(HASHED, np.int32)
    for t in own:
        table[np.unique(np.array([zlib.crc32(s) & mask for s in segments(t)], np.int64))] += 1
    frequent = table >= least
    left = [{s for s in segments(t) if frequent[zlib.crc32(s) & mask]} for t in own]
    often = Counter(s for x in left for s in x)
    often = {s: k for s, k in often.items() if k >= least}
    other: Counter[bytes] = Counter()
    for t in plain:
        other.update(segments(t) & often.keys())
    telling = {s for s, k in often.items() if evidence(k, n, other[s], m) >= EVIDENCE}
    left = [x & telling for x in left]
    times, chosen = [0] * len(left), []
    while len(chosen) < MAX_SEGMENTS:
        counts = Counter(s for x in left for s in x)
        open_ = sum(t < COVER for t in times)
        best = max(((evidence(k, open_, other[s], m), len(s), s) for s, k in counts.items()), default=(0.0, 0, b""))
        if best[0] < LATE_EVIDENCE:
            break
        chosen.append(best[2])
        for i, x in enumerate(left):
            if best[2] in x:
                times[i] += 1
                left[i] = set() if times[i] >= COVER else {s for s in x if s not in best[2] and best[2] not in s}
            else:
                left[i] = {s for s in x if s not in best[2] and best[2] not in s}
    return chosen


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.short = [self._compressor(model.ordinary), self._compressor(model.toxic)]
        self.gains: dict[bytes, int] = {}

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        how = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=15, hash_log=13, chain_log=13,
            search_log=6, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY,
        )
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=how)

    def gain(self, word: bytes) -> int:
        """Bytes that the toxic dictionary saves on the window of a word."""
        found = self.gains.get(word)
        if found is None:
            window = LEAD + b" " + word + b" " + TAIL
            found = len(self.short[0].compress(window)) - len(self.short[1].compress(window))
            if len(word) <= 64:
                if len(self.gains) >= CACHE_WORDS:
                    self.gains.clear()
                self.gains[word] = found
        return found

    def features(self, text: bytes) -> list[float]:
        counts = Counter(text.lower().split())
        n = sum(counts.values())
        saved = [(self.gain(w), k) for w, k in counts.items()]
        saved = sorted([x for x in saved if x[0] > 0], reverse=True)
        top = [g for g, k in saved[:12] for _ in range(min(k, 12))][:12] + [0] * 12
        above = [sum(k for g, k in saved if g >= t) for t in THRESHOLDS]
        kinds = [sum(1 for g, _ in saved if g >= t) for t in THRESHOLDS]
        rates = [math.sqrt(x / n) if n else 0.0 for x in above]
        return [top[0], sum(top[:3]) / 3, sum(top[:8]) / 8, *map(math.log1p, above), *map(math.log1p, kinds), *rates]

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        m = self.model
        x = (np.array(rows, float).reshape(len(rows), len(m.centre)) - np.array(m.centre)) / np.array(m.scale)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(m.weights[:-1]) + m.weights[-1], -30, 30)))


def fit(texts: list[bytes], toxic: list[int], ridge: float = 1.0) -> Model:
    """A model from labelled texts. Without both labels, one that gives every text the share of toxic ones (0.0 of none)."""
    yes, no = [t for t, y in zip(texts, toxic, strict=True) if y], [t for t, y in zip(texts, toxic, strict=True) if not y]
    common = Counter(w for t in no for w in t.lower().split())
    words = [w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:BASE_WORDS]]
    base = LEAD + b" " + b" ".join(reversed(words)) + b" "
    own = toxic_segments(yes, no)
    start = Model(base, base + b"\n".join([b"", *reversed(own), b""]), (), (), ())
    maker = Scorer(start)
    x = np.array([maker.features(t) for t in texts] or [maker.features(b"")], float)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    y = np.array(toxic or [0], float)
    z = np.c_[(x - centre) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    hold = np.r_[np.full(z.shape[1] - 1, ridge), 1e-3]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(hold), z.T @ (p - y) + hold * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Model(start.ordinary, start.toxic, tuple(centre.tolist()), tuple(scale.tolist()), tuple(w.tolist()))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fitted to labelled rows outside the held-out fold: at most ``rows`` of each class, of ``most_bytes`` together."""
    known = labels.filter("toxic is not null and doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("toxic")
    ).filter(~_held_out(F.col("doc_id")))
    got = [r for c in ("toxic", "not toxic") for r in work.labelled_sample(docs, known.filter(c), rows, most_bytes).toLocalIterator()]
    got = sorted((r.doc_id, r.toxic, r.text) for r in got)
    return fit([t.encode() for _, _, t in got], [int(y) for _, y, _ in got])


def _held_out(doc_id) -> object:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    cache = work.process_cache()
    key = ("toxicity", zlib.crc32(repr(model).encode()))
    one = cache.get(key) or cache.setdefault(key, Scorer(model))
    for part, texts in work.text_slices(batches):
        yield pa.RecordBatch.from_pydict(
            {"doc_id": part.column(0), "held_out": part.column(2), "score": pa.array(one.scores([one.features(x) for x in texts]))}
        )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Nulls: a null text is empty, and empty texts get the score of a text without
    windows; a null doc_id counts as the empty text in the fold's checksum. Repeated
    rows get equal scores. An empty table gives no rows. Other columns are not read.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _held_out(F.col("doc_id")).alias("held_out")
    )
    found = plain.mapInArrow(lambda it: _score(it, model), "doc_id long, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
