"""Coverage of reads while they arrive: the same accounting as ``operators.coverage``, over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_reads(reads: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Per window, epoch and rank of ``reads(ts, rank, epoch, sample_index)``: observed and distinct samples (estimated)."""
    found = reads.withWatermark("ts", late).groupBy(F.window("ts", window), "epoch", "rank")
    return found.agg(
        F.count("*").alias("observed"), F.approx_count_distinct("sample_index").alias("approx_unique")
    ).select(F.col("window.start").alias("start"), "epoch", "rank", "observed", "approx_unique")


def first_reads(reads: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (epoch, sample) once, as first seen within the watermark: what remains of ``reads`` are duplicates."""
    return reads.withWatermark("ts", late).dropDuplicatesWithinWatermark(["epoch", "sample_index"])
