"""From measurements to a verdict: is the input path ready for training.

Each report is an optional DataFrame. A missing or empty one is a missing input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compare, coverage, ladder, placement

REQUIRED = ("layouts", "distributed")
ADVISORY = ("inspection", "workers", "storage")
PLANNED_EPOCHS = 3


def layout_choice(groups: DataFrame) -> DataFrame:
    """The sound group with the best median throughput; a tie goes to the one seen first. No row where none is sound."""
    return groups.filter(
        " and ".join(f"{c} = 0" for c in compare.CORRECTNESS)
    ).orderBy(F.desc("samples_per_second_median"), "first_seen").limit(1).select(F.col("group").alias("recommended_layout"))


class Evidence:
    """What the given reports come down to, a row for each group, rung or placement: each report is read once for all rules."""

    def __init__(
        self, spark: SparkSession, layouts: DataFrame | None = None, distributed: DataFrame | None = None, inspection: DataFrame | None = None,
        workers: DataFrame | None = None, storage: DataFrame | None = None,
    ):
        def held(make, report: DataFrame | None) -> DataFrame | None:
            return None if report is None else spark.createDataFrame((few := make(report)).collect(), few.schema)

        self.spark = spark
        given = {"layouts": layouts, "distributed": distributed, "inspection": inspection, "workers": workers, "storage": storage}
        self.given = sorted(name for name, report in given.items() if report is not None)
        self.groups, self.comparison = held(compare.group_summaries, layouts), held(compare.verdict, layouts)
        self.ladder = held(lambda runs: ladder.recommendation(ladder.ladder_rows(runs)), workers)
        self.placements = held(placement.placement_rows, storage)
        self.ranks = held(lambda verdict: verdict, distributed)


def findings(spark: SparkSession, evidence: Evidence | None = None, **reports: DataFrame | None) -> DataFrame:
    """Rule rows over all reports. ``layouts``, ``workers`` and ``storage`` are runs; ``distributed`` is a verdict with its balance."""
    e, c = evidence or Evidence(spark, **reports), F.col
    parts = [spark.createDataFrame([], "ordinal int, rule_id string, severity string, subject string, value double")]
    absent = [(0, f"no-{name}", "incomplete" if name in REQUIRED else "caution", name, 0.0) for name in (*REQUIRED, *ADVISORY) if name not in e.given]
    if absent:
        parts.append(spark.createDataFrame(absent, parts[0].schema))

    def add(rows: DataFrame, subject, *rules: tuple) -> None:
        parts.append(compare.rule_rows(rows, list(rules), subject))

    if e.groups is not None:
        able = e.groups.crossJoin(F.broadcast(e.comparison)).filter("comparable")  # one row
        add(able, c("group"), *compare.correctness_rules(1, "blocking"))
        add(
            e.comparison, F.lit("layouts"), (4, "not-comparable", "caution", ~c("comparable"), F.lit(0)),
            (5, "not-controlled", "caution", c("comparable") & ~c("controlled"), F.lit(0)),
        )
        sound = able.filter(" and ".join(f"{x} = 0" for x in compare.CORRECTNESS)).agg(F.min("runs").alias("least"))
        add(sound, F.lit("layouts"), (6, "single-run", "caution", c("least") < 2, c("least")))
    if e.ladder is not None:
        add(
            e.ladder, F.lit("workers"), (7, "still-improving", "caution", c("pattern") == "still-improving", F.lit(0)),
            (8, "inconclusive-ladder", "caution", c("pattern") == "inconclusive", F.lit(0)),
            (9, "limited-input", "limitation", c("limiting_factor").isin("storage-or-synchronisation", "cpu-decode"), F.lit(0)),
        )
    if e.placements is not None:
        even = placement.break_even(e.placements).agg(F.count_if("indistinguishable").alias("n"))
        add(even, F.lit("storage"), (10, "indistinguishable", "caution", c("n") > 0, c("n")))
    if e.ranks is not None:
        add(
            e.ranks, F.lit("distributed"), (11, "duplicate-samples", "blocking", c("duplicate_samples") > 0, c("duplicate_samples")),
            (12, "missing-samples", "blocking", c("missing_samples") > 0, c("missing_samples")),
            (13, "idle-ranks", "blocking", F.size("idle_ranks") > 0, F.size("idle_ranks")),
            (14, "rank-imbalance", "caution", c("rank_elapsed_spread") > coverage.SPREAD_CAUTION, c("rank_elapsed_spread")),
            (15, "data-wait", "limitation", c("max_data_wait_fraction") > coverage.WAIT_CAUTION, c("max_data_wait_fraction")),
        )
    return reduce(DataFrame.unionByName, parts)


def decide(spark: SparkSession, evidence: Evidence | None = None, planned_epochs: int = PLANNED_EPOCHS, **reports: DataFrame | None) -> DataFrame:
    """One row with the verdict and the recommendations, from ``evidence`` or the reports by name.

    A correctness failure outranks missing inputs, and those outrank cautions.
    """
    if planned_epochs < 1:
        raise ValueError("planned_epochs must be at least 1")
    e = evidence or Evidence(spark, **reports)
    count = lambda s: F.count_if(F.col("severity") == s)
    severities = {"blocking_count": "blocking", "caution_count": "caution", "limitation_count": "limitation", "_incomplete": "incomplete"}
    one = findings(spark, e).agg(*[count(s).alias(name) for name, s in severities.items()])
    verdicts = (
        ("blocking_count > 0", "NOT_READY", "fix-blocking-issues-then-revalidate"),
        ("_incomplete > 0", "INCONCLUSIVE", "complete-the-missing-experiments"),
        ("caution_count > 0", "READY_WITH_CAUTION", "scaling-baseline"),
        ("true", "READY", "scaling-baseline"),
    )
    first = lambda place: F.coalesce(*[F.when(F.expr(v[0]), F.lit(v[place])) for v in verdicts])
    one = one.withColumns({"data_readiness": first(1), "next_experiment": first(2)})

    def added(one: DataFrame, rows: DataFrame | None, name: str, missing, column: str) -> DataFrame:
        """``one`` with a column of the only row of ``rows``, or ``missing``."""
        if rows is None:
            return one.withColumn(name, F.lit(missing))
        value = rows.select(F.col(column).alias(name))
        return one.join(F.broadcast(value), F.lit(True), "left").withColumn(name, F.coalesce(F.col(name), F.lit(missing)))

    choice = None if e.groups is None else layout_choice(e.groups.crossJoin(F.broadcast(e.comparison)).filter("comparable"))
    one = added(one, choice, "recommended_layout", "unknown", "recommended_layout")
    one = added(one, e.ladder, "recommended_workers_per_rank", 0, "recommended_workers")
    one = added(one, e.ladder, "main_limiting_factor", "unknown", "limiting_factor")
    near_tie = None if e.placements is None else placement.near_tie_choice(e.placements, planned_epochs)
    one = added(one, near_tie, "recommended_storage", placement.DEFAULT_PLACEMENT, "recommended_storage")
    staged = None if e.placements is None else placement.staging_decision(e.placements, planned_epochs)
    one = added(one, staged, "node_local_staging", "unknown", "node_local_staging")
    whole = F.when(F.expr("duplicate_samples = 0 and missing_samples = 0 and size(idle_ranks) = 0"), "valid").otherwise("invalid")
    one = added(one, None if e.ranks is None else e.ranks.select(whole.alias("state")), "distributed_partitioning", "unverified", "state")
    return one.withColumn("planned_epochs", F.lit(planned_epochs)).withColumn("inputs_provided", F.lit(",".join(e.given))).drop("_incomplete")
