"""Reading a worker ladder: which worker count to use, and what limits it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import coefficient_of_variation, median, number
from .compare import CORRECTNESS, NOISY_CV, _has, rule_rows

PLATEAU_GAIN = 0.05
REGRESSION_LOSS = 0.05
CPU_SATURATED = 0.85
STILL_WAITING = 0.5
SWITCH_FACTOR = 10

# Medians reported for each rung.
RUNG_METRICS = (
    "samples_per_second", "mean_batch_wait_seconds", "p95_batch_wait_seconds", "mean_data_wait_fraction", "cpu_utilization", "peak_memory_bytes", "involuntary_switches_per_second",
    "child_processes", "oversubscription_ratio", "processes_per_physical_core", "allocated_cores", "cpus_available", "startup_seconds",
)


def ladder_rows(runs: DataFrame) -> DataFrame:
    """One row per worker count: runs, medians, and the throughput's cv."""
    workers = F.coalesce(_has(runs, "num_workers").cast("int"), F.lit(0))
    return runs.groupBy(workers.alias("num_workers")).agg(
        F.count("*").alias("runs"), coefficient_of_variation(number(_has(runs, "samples_per_second"))).alias("samples_per_second_cv"),
        *[median(number(_has(runs, m))).alias(m) for m in RUNG_METRICS]
    )


def recommendation(rows: DataFrame) -> DataFrame:
    """One row from the rungs: recommended, best and best affordable workers, pattern, limiting factor, scheduling note.

    Rungs are few (one per worker count), so windows over all of them are small.
    Ties in throughput go to fewer workers.
    """
    every = Window.partitionBy(F.lit(0))
    up = every.orderBy("num_workers")
    sps, w = F.col("samples_per_second"), F.col("num_workers")
    first_max = lambda cond: F.max(F.when(cond, F.struct(sps.alias("v"), (-w).alias("k")))).over(every)
    fits = F.col("oversubscription_ratio") <= 1.0
    r = rows.withColumn("_n", F.count("*").over(every)).withColumn(
        "_prev", F.lag("samples_per_second").over(up)
    ).withColumn("_at", F.row_number().over(up))
    r = r.withColumn("_ok", fits | (F.count_if(fits).over(every) == 0))
    r = r.withColumn("_best", first_max(F.lit(True))).withColumn("_aff", first_max(F.col("_ok")))
    adequate = F.col("_ok") & (F.col("_aff.v") > 0) & (sps >= F.col("_aff.v") * (1.0 - PLATEAU_GAIN))
    r = r.withColumn("_rec", F.coalesce(F.min(F.when(adequate, w)).over(every), -F.col("_aff.k")))
    one = r.agg(
        F.max("_n").alias("n"), F.max(-F.col("_best.k")).alias("best_workers"), F.max("_best.v").alias("best"), F.max(-F.col("_aff.k")).alias("best_affordable_workers"), F.max("_rec").alias("recommended_workers"),
        F.max(
            F.when(F.col("_at") == 1, sps)
        ).alias("first"), F.min_by("num_workers", "_at").alias("first_workers"), F.max_by("_prev", "_at").alias("previous"), F.max_by("samples_per_second", "_at").alias("last"), F.max("num_workers").alias("last_workers"),
        F.min(F.when(w > -F.col("_best.k"), sps)).alias("worst_after"), F.max(
            F.when(w == F.col("_rec"), F.col("cpu_utilization"))
        ).alias("cpu"), F.max(
            F.when(w == F.col("_rec"), F.col("mean_data_wait_fraction"))
        ).alias("waiting"),
        F.max(
            F.when(w == F.col("_rec"), F.col("involuntary_switches_per_second"))
        ).alias("switches"), F.max("involuntary_switches_per_second").alias("worst_switches"),
    )
    best = F.col("best")
    pattern = (
        F.when((F.col("n") < 2) | (F.col("first") <= 0), "inconclusive")
        .when((best > 0) & (F.coalesce(F.col("worst_after"), best) < best * (1.0 - REGRESSION_LOSS)), "regression")
        .when((F.col("best_workers") == F.col("last_workers")) & (F.col("last") > F.col("previous") * (1.0 + PLATEAU_GAIN)), "still-improving")
        .when(best > F.col("first") * (1.0 + PLATEAU_GAIN), "plateau")
        .otherwise("flat")
    )
    one = one.withColumn("pattern", pattern)
    factor = (
        F.when(F.col("n") < 2, "unknown").when(
            F.col("pattern") == "still-improving", "not-yet-saturated"
        ).when(F.col("pattern") == "regression", "oversubscribed").when(F.col("pattern") == "flat", "not-worker-bound")
        .when(F.col("cpu") >= CPU_SATURATED, "cpu-decode").when(F.col("waiting") >= STILL_WAITING, "storage-or-synchronisation").otherwise("balanced")
    )
    single = lambda c: F.when(F.col("n") < 2, F.col("first_workers")).otherwise(F.col(c)).alias(c)
    note = (F.col("n") > 1) & (F.col("switches") > 0) & (F.col("worst_switches") >= F.col("switches") * SWITCH_FACTOR)
    return one.filter("n > 0").select(
        single("recommended_workers"), single("best_workers"), single("best_affordable_workers"), "pattern", factor.alias("limiting_factor"),
        note.alias("scheduling_note")
    )


def ladder_cautions(runs: DataFrame) -> DataFrame:
    """Correctness totals, single runs, noise, workers that did not start, rungs beyond the CPUs, shared cores."""
    rows = ladder_rows(runs)
    totals = runs.agg(*[F.sum(F.coalesce(_has(runs, c).cast("long"), F.lit(0))).alias(c) for c in CORRECTNESS])
    children, w, per_core = F.col("child_processes"), F.col("num_workers"), F.col("processes_per_physical_core")
    every = Window.partitionBy(F.lit(0))  # one row per rung
    rows = rows.withColumn("_cpus", F.max("cpus_available").over(every)).withColumn("_cores", F.max("allocated_cores").over(every))
    rules = [
        (4, "single-run", "caution", F.col("runs") < 2, F.col("runs")), (
            5, "noisy", "caution", F.col("samples_per_second_cv") > NOISY_CV, F.col("samples_per_second_cv")
        ), (6, "workers-not-started", "caution", (children > 0) & (children < w), children),
        (
            7, "oversubscribed", "caution", (F.col("_cpus") > 0) & (F.col("oversubscription_ratio") > 1.0), F.col("oversubscription_ratio")
        ), (8, "smt-saturated", "caution", (F.col("_cores") > 0) & (per_core > 1.0) & (per_core <= 2.0), per_core),
    ]
    wrong = [(1 + i, c.replace("_", "-"), "caution", F.col(c) > 0, F.col(c)) for i, c in enumerate(CORRECTNESS)]
    return reduce(DataFrame.unionByName, [rule_rows(totals, wrong, F.lit("ladder")), rule_rows(rows, rules, w)])
