"""Was every sample read exactly once, and by whom: accounting over ``reads(rank, epoch, sample_index)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio, spread

#: Rank spread above which the ranks count as imbalanced.
SPREAD_CAUTION = 0.2
#: Wait fraction above which reading dominates.
WAIT_CAUTION = 0.5


def epoch_coverage(reads: DataFrame, expected: DataFrame, allowance: int | Column = 0) -> DataFrame:
    """Per epoch: observed, unique, duplicate and missing samples.

    ``expected`` is one row with ``total``. Exact distinct counts: (epoch, sample) is
    pre-aggregated on the map side, so a popular sample costs one row per task.
    """
    each = reads.groupBy("epoch", "sample_index").agg(F.count("*").alias("n"))
    found = each.groupBy("epoch").agg(F.sum("n").alias("observed"), F.count("*").alias("unique_samples"))
    found = found.crossJoin(F.broadcast(expected.select("total")))
    spare = allowance if isinstance(allowance, Column) else F.lit(allowance)
    return found.select(
        "epoch", "observed", "unique_samples", (F.col("observed") - F.col("unique_samples")).alias("duplicate_samples"),
        F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("unique_samples") - spare).cast("long").alias("missing_samples"),
    )


def distinct_samples(reads: DataFrame) -> DataFrame:
    """All epochs together: how many different samples were seen."""
    return reads.select("sample_index").distinct().agg(F.count("*").alias("distinct_samples"))


def unique_samples(reads: DataFrame) -> DataFrame:
    """(rank, sample_index): which samples each rank saw, each once, as rows and not as lists that grow with the epoch."""
    return reads.select("rank", "sample_index").distinct()


def idle_ranks(reads: DataFrame, world_size: int) -> DataFrame:
    """Ranks that read nothing."""
    ranks = reads.sparkSession.range(world_size).select(F.col("id").cast("int").alias("rank"))
    return ranks.join(reads.select(F.col("rank").cast("int").alias("rank")).distinct(), "rank", "left_anti")


def cross_rank_verdict(reads: DataFrame, total: DataFrame, world_size: int) -> DataFrame:
    """One row: does the union of what the ranks read cover the samples once.

    ``missing`` is judged only where at least as many reads as samples were seen.
    """
    each = reads.groupBy("sample_index").agg(F.count("*").alias("n"))
    found = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("samples_measured"), F.count("*").alias("unique_samples"))
    idle = idle_ranks(reads, world_size).agg(F.sort_array(F.collect_list("rank")).alias("idle_ranks"))
    found = found.crossJoin(total.select(F.col("total").alias("total_samples"))).crossJoin(idle)
    missing = F.when(
        F.col("samples_measured") >= F.col("total_samples"), F.greatest(F.lit(0).cast("long"), F.col("total_samples") - F.col("unique_samples"))
    ).otherwise(F.lit(0)).cast("long")
    found = found.withColumn("duplicate_samples", F.col("samples_measured") - F.col("unique_samples")).withColumn("missing_samples", missing)
    valid = (F.col("duplicate_samples") == 0) & (F.col("missing_samples") == 0) & (F.size("idle_ranks") == 0)
    return found.select(
        F.lit(world_size).alias("world_size"), "total_samples", "samples_measured", "unique_samples", "duplicate_samples", "missing_samples",
        ratio("unique_samples", "total_samples").alias("coverage_fraction"), "idle_ranks", valid.alias("partitioning_valid"),
    )


def rank_balance(ranks: DataFrame) -> DataFrame:
    """One row over ``ranks(rank, samples_per_second, elapsed_seconds, data_wait_fraction)``; rates add up."""
    rate, elapsed, wait = "samples_per_second", "elapsed_seconds", "data_wait_fraction"
    zero = F.lit(0.0)
    return ranks.agg(
        F.count("*").alias("ranks"), F.coalesce(F.sum(rate), zero).alias("total_samples_per_second"), F.coalesce(F.min(rate), zero).alias("min_rank_throughput"), F.coalesce(F.max(rate), zero).alias("max_rank_throughput"), F.coalesce(F.avg(rate), zero).alias("mean_rank_throughput"),
        spread(rate).alias("rank_throughput_spread"), F.coalesce(F.min(elapsed), zero).alias("min_rank_elapsed"), F.coalesce(F.max(elapsed), zero).alias("max_rank_elapsed"), spread(elapsed).alias("rank_elapsed_spread"), F.coalesce(F.max(wait), zero).alias("max_data_wait_fraction"),
    )


def distributed_findings(verdict: DataFrame, balance: DataFrame) -> DataFrame:
    """Rule rows (ordinal, rule_id, severity, metric) for a verdict and the balance of its ranks."""
    both = verdict.crossJoin(balance)
    idle, dup, missing, uneven = F.size("idle_ranks") > 0, F.col("duplicate_samples") > 0, F.col("missing_samples") > 0, F.col("rank_elapsed_spread") > SPREAD_CAUTION
    rules = [
        (1, "idle-ranks", "blocking", idle, F.size("idle_ranks")), (
            2, "duplicate-samples", "blocking", dup, F.col("duplicate_samples")
        ), (3, "missing-samples", "blocking", missing, F.col("missing_samples")),
        (4, "rank-imbalance", "caution", uneven, F.col("rank_elapsed_spread")), (5, "healthy", "info", ~(idle | dup | missing | uneven), F.lit(0)), (
            6, "data-wait", "limitation", F.col("max_data_wait_fraction") > WAIT_CAUTION, F.col("max_data_wait_fraction")
        ),
    ]
    rows = F.array(
        *[
            F.when(
                c,
                F.struct(
                    F.lit(n).alias("ordinal"), F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.round(m.cast("double"), 6).alias("value")
                )
            ) for n,
            r, s, c, m in rules
        ]
    )
    return both.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select("r.*")


def complete_epochs(batches: DataFrame, mode: str = "batch") -> DataFrame:
    """Per epoch of ``batches(ordinal, epoch)``: its batches, and whether it was traversed from its first to its last.

    In batch mode the epoch in progress at the start is never complete, and the last
    one is not known to be; in epoch mode every epoch seen is.
    """
    each = batches.groupBy("epoch").agg(F.count("*").alias("batches"), F.min("ordinal").alias("first_batch"))
    ordered = Window.partitionBy(F.lit(0)).orderBy("first_batch")  # one row per epoch
    if mode == "epoch":
        return each.select("epoch", "batches", F.lit(True).alias("complete"))
    return each.select("epoch", "batches", (F.lag("epoch").over(ordered).isNotNull() & F.lead("epoch").over(ordered).isNotNull()).alias("complete"))


def wait_profile(batches: DataFrame, measured_seconds: Column | None = None) -> DataFrame:
    """Mean, median, 95th percentile and maximum of ``wait``, and its part of the measured time."""
    from ..functions.stats import mean, median, percentile

    seconds = F.sum("seconds") if measured_seconds is None else measured_seconds
    return batches.agg(
        F.count("*").alias("batches"), mean("wait").alias("mean_batch_wait_seconds"), median("wait").alias("median_batch_wait_seconds"),
        percentile("wait", 95.0).alias("p95_batch_wait_seconds"), F.coalesce(F.max("wait"), F.lit(0.0)).alias("max_batch_wait_seconds"),
        ratio(F.sum("wait"), seconds).alias("mean_data_wait_fraction")
    )
