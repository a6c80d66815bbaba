"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Texts are features by hashing: word shares, byte-class shares, and shares of
repeated words, in one weight vector. One score per text is shared by all grades;
ordered thresholds cut it: P(grade <= k) = logistic(threshold_k - score). The
expected grade and the tail probability P(grade >= k) follow; texts are selected by
the tail.

Fitting reads a bounded sample of labelled rows (``TRAIN_ROWS`` and ``TRAIN_BYTES``, by
hash) and sends their features, not their texts, to the driver. Scoring handles
each text whole, in one task, without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import work

BITS = 16
#: At most so many labelled rows, of so many bytes together, are learned from.
TRAIN_ROWS, TRAIN_BYTES = 6000, 64 << 20
#: One labelled row in so many is held out where a model is to be measured.
FOLDS = 5
EPOCHS = 400
RIDGE = 0.1
#: A text is kept if the probability of this grade or a higher one is at least KEEP.
KEEP_GRADE = 1
KEEP = 0.5
#: Byte classes: letters (bytes of longer characters too), digits, spaces, line ends, then each other byte as itself.
CLASSES = bytes(97 if chr(b).isalpha() or b > 127 else 48 if 48 <= b <= 57 else b for b in range(256))


@dataclass(frozen=True)
class Model:
    """Weights of the hashed features and the ordered thresholds of grades 1, 2, ..."""

    weights: np.ndarray
    thresholds: tuple[float, ...]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text; each family of features adds up to 1 before the square root."""
    words = text.lower().split()
    n, mask = len(words), (1 << BITS) - 1
    crc = zlib.crc32
    counts = Counter(words)
    index = [crc(w) & mask for w in counts]
    value = [math.sqrt(k / n) for k in counts.values()]
    if n:
        classes = np.bincount(np.frombuffer(text.translate(CLASSES), np.uint8), minlength=256)
        for c in np.flatnonzero(classes):
            index.append(crc(b"\x00class%d" % c) & mask)
            value.append(math.sqrt(int(classes[c]) / len(text)))
        again = sum(map(eq, words, words[1:])) / n
        for name, v in ((b"\x00same", again), (b"\x00distinct", len(counts) / n), (b"\x00long", min(1.0, math.log1p(n) / 12))):
            index.append(crc(name) & mask)
            value.append(math.sqrt(v))
    return np.array(index, np.int32), np.array(value, np.float32)


def grades(quality: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Graded ratings from two labels: 0 low quality, 1 good and toxic, 2 good.

    The tables have two yes-or-no labels and no grades. Low quality is the worst grade
    whatever else holds; of good texts the toxic ones are the worse. Selection asks for
    grade 1 or more (``KEEP_GRADE``), so it rejects for quality alone; ``expected_grade``
    uses all three, and a caller who wants toxic texts gone selects by grade 2.
    """
    return np.where(quality == 0, 0, np.where(toxic == 1, 1, 2))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grade: list[int], top: int = 2) -> Model:
    """Maximum likelihood with a ridge, by Adam over all rows at once.

    Thresholds are a first one and positive steps, so they stay ordered. Without
    rows, or with one grade only, the weights stay near 0 and all texts score alike.
    """
    weights, steps = np.zeros(1 << BITS), np.concatenate([[-2.0], np.zeros(top - 1)])
    if not rows:
        return Model(weights.astype(np.float32), tuple(float(x) for x in _ordered(steps)))
    size = np.array([len(i) for i, _ in rows])
    at = np.repeat(np.arange(len(rows)), size)
    index, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]).astype(float)
    y = np.array(grade)
    used, index = np.unique(index, return_inverse=True)
    w = np.zeros(len(used))
    m1, m2, s1, s2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(steps), np.zeros_like(steps)
    for t in range(1, EPOCHS + 1):
        score = np.bincount(at, value * w[index], minlength=len(rows))
        cut = _ordered(steps)
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        hi, lo = _logistic(edge[y + 1] - score), _logistic(edge[y] - score)
        p = np.maximum(hi - lo, 1e-12)
        slope_hi, slope_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        by_score = (slope_hi - slope_lo) / len(rows)  # of the loss: minus the log likelihood
        gradient = np.bincount(index, value * by_score[at], minlength=len(w)) + RIDGE / len(rows) * w
        by_cut = np.array([(slope_lo[y == k + 1].sum() - slope_hi[y == k].sum()) / len(rows) for k in range(top)])
        by_step = np.array([by_cut[k:].sum() * (1.0 if k == 0 else math.exp(steps[k])) for k in range(top)])
        for x, g, a, b in ((w, gradient, m1, m2), (steps, by_step, s1, s2)):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            x -= 0.1 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    weights[used] = w
    return Model(weights.astype(np.float32), tuple(float(x) for x in _ordered(steps)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _ordered(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, hold_out: bool = False) -> Model:
    """Fitted to at most ``rows`` labelled rows whose quality is known; a null toxic counts as 0.

    With ``hold_out`` nothing is learned from the fold of ``held_out`` ids.
    """
    known = labels.filter("quality is not null and doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"),
        F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("toxic")
    )
    known = known.filter(~held_out(F.col("doc_id"))) if hold_out else known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in work.text_slices(batches):
            got = [features(x) for x in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column(0), "quality": part.column(2), "toxic": part.column(3),
                    "index": pa.array([i for i, _ in got], pa.list_(pa.int32())), "value": pa.array([v for _, v in got], pa.list_(pa.float32()))
                }
            )

    sample = work.labelled_sample(docs, known, rows, most_bytes).select("doc_id", "text", "quality", "toxic")
    table = sample.mapInArrow(run, "doc_id long, quality int, toxic int, index array<int>, value array<float>").toArrow()
    index, value = table["index"].combine_chunks(), table["value"].combine_chunks()
    rows_ = [(index[i].values.to_numpy(zero_copy_only=False), value[i].values.to_numpy(zero_copy_only=False)) for i in range(len(table))]
    grade = grades(table["quality"].to_numpy(), table["toxic"].to_numpy()).tolist()
    # Sums of floats depend on the order of rows: one that does not depend on partitions.
    ids = table["doc_id"].to_pylist()
    order = sorted(range(len(rows_)), key=lambda k: (ids[k], grade[k], rows_[k][0].tobytes(), rows_[k][1].tobytes()))
    return fit([rows_[k] for k in order], [grade[k] for k in order])


def probabilities(model: Model, score: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ...: one column each."""
    return _logistic(score[:, None] - np.array(model.thresholds)[None, :])


def score(docs: DataFrame, model: Model, keep_grade: int = KEEP_GRADE, keep: float = KEEP) -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_grade, tail_probability, kept.

    Nulls: a null text is empty, and a text without words has score 0, the score of
    no evidence, and is not kept; a null doc_id stays null. Repeated rows get equal
    scores. An empty table gives no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.weights
        for part, texts in work.text_slices(batches):
            got = [features(x) for x in texts]
            s = np.array([float(weights[i] @ v) for i, v in got])
            tails = probabilities(shared.value, s)
            some = np.array([len(i) > 0 for i, _ in got])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column(0), "expected_grade": pa.array(tails.sum(axis=1)), "tail_probability": pa.array(tails[:, keep_grade - 1]),
                    "kept": pa.array((tails[:, keep_grade - 1] >= keep) & some)
                }
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the classifier keeps.

    The verdict is a column of the same pass over the text: no join, no shuffle.
    """
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.weights
        for part, texts in work.text_slices(batches):
            got = [features(x) for x in texts]
            tails = probabilities(shared.value, np.array([float(weights[i] @ v) for i, v in got]))
            good = [bool(t >= KEEP) and len(i) > 0 for t, (i, _) in zip(tails[:, KEEP_GRADE - 1], got, strict=True)]
            yield part.filter(pa.array(good))

    assert names[at] == "text"
    return work.in_python(docs, run, docs.schema)
