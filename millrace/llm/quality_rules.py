"""Quality rules by repetition coverage.

Words are numbered within a text; rolling hashes of word n-grams of several
lengths, in numpy, show which n-grams occur more than once. Coverage is the part
of a text's word characters that lies inside repeated n-grams of one length, or
inside repeated lines. A text is kept if no coverage exceeds its threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

SYMBOLS = re.compile(rb"[#*$%&|<>]")
#: The most of a text's word characters that may lie in repeated n-grams, by n, and in repeated lines.
COVERAGE = {2: 0.60, 3: 0.45, 5: 0.35, 8: 0.30, 10: 0.28}
LINE_COVERAGE = 0.45
MIN_WORDS = 10
BASE_N = 5
BASE_PERCENT = 20
#: Of the polynomial that hashes n-grams: odd.
BASE = np.uint64(0x9E3779B97F4A7C15)


class Rolling:
    """Hashes of the n-grams of a text, of any length n, from one pass: differences of prefix sums of a polynomial in an odd base."""

    def __init__(self, codes: np.ndarray):
        m = len(codes)
        powers = np.cumprod(np.r_[np.uint64(1), np.full(max(m - 1, 0), BASE)])[:m]
        self.sums = np.r_[np.uint64(0), np.cumsum(codes * powers)]
        # An odd base has an inverse: it takes a window's hash back to where the text starts.
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(max(m - 1, 0), np.uint64(pow(int(BASE), -1, 1 << 64)))])[:m]

    def grams(self, n: int) -> np.ndarray:
        m = len(self.sums) - n
        return (self.sums[n:] - self.sums[:m]) * self.back[:m]

    def covered(self, n: int) -> np.ndarray:
        """Which words lie in an n-gram that occurs at least twice in the text."""
        words = len(self.sums) - 1
        if words - n + 1 < 2:
            return np.zeros(words, bool)
        h = self.grams(n)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        depth = np.zeros(words + 1, np.int32)
        depth[: len(h)] += twice
        depth[n : n + len(h)] -= twice
        return np.cumsum(depth[:-1]) > 0


def measures(text: bytes, lengths: tuple[int, ...]) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line coverage, coverage of each length)."""
    words = text.split()
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    codes = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    codes ^= codes >> np.uint64(32)
    if text.isascii():
        chars = np.fromiter(map(len, words), np.int64, len(words))
    else:
        chars = np.fromiter((len(w.decode("utf-8", "replace")) for w in words), np.int64, len(words))
    total = int(chars.sum())
    seen: set[bytes] = set()
    repeated = line_chars = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if inside := line.split():
                if line in seen:
                    repeated += 1
                    line_chars += sum(len(w.decode("utf-8", "replace")) for w in inside)
                seen.add(line)
    rolling = Rolling(codes)
    base = rolling.covered(BASE_N)
    rates = [float(chars[base if n == BASE_N else rolling.covered(n)].sum()) / total if total else 0.0 for n in lengths]
    return len(words), total, len(SYMBOLS.findall(text)), repeated, int(base.sum()), line_chars / total if total else 0.0, rates


def _rules(batches: Iterator[pa.RecordBatch], limits: dict[int, float], line_limit: float) -> Iterator[pa.RecordBatch]:
    lengths = tuple(sorted(limits))
    for part, texts in work.text_slices(batches):
        rows = [measures(x, lengths) for x in texts]
        counts = {k: [r[i] for r in rows] for i, k in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
        failed = [r[0] < MIN_WORDS or 100 * r[4] > BASE_PERCENT * r[0] for r in rows]
        within = [r[5] <= line_limit and all(c <= limits[n] for n, c in zip(lengths, r[6], strict=True)) for r in rows]
        columns = {"doc_id": part.column(0)} | {k: pa.array(v, pa.int64()) for k, v in counts.items()}
        columns |= {"base_failed": pa.array(failed), "kept": pa.array([w and not f for w, f in zip(within, failed, strict=True)])}
        columns |= {"line_coverage": pa.array([r[5] for r in rows], pa.float64()), "coverage": pa.array([r[6] for r in rows], pa.list_(pa.float64()))}
        yield pa.RecordBatch.from_pydict(columns)


def quality_rules(docs: DataFrame, limits: dict[int, float] = COVERAGE, line_limit: float = LINE_COVERAGE) -> DataFrame:
    """One row per row of ``docs``: the counts, base_failed, kept, and the coverages (one per length, ascending).

    A row is judged by itself: no shuffle. Nulls: a null text has no words and fails
    the base rule; a null doc_id is kept as it is. Repeated rows repeat. An empty
    table gives no rows. Other columns are not read.
    """
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_coverage double, coverage array<double>"
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(lambda it: _rules(it, limits, line_limit), schema)
