"""Comparing groups of measured runs.

``runs`` has one row per run and ``input_ordinal``, its place among the inputs: the
first group seen is the baseline, and ties go to what was seen first.
Rule rows are (ordinal, rule_id, severity, subject, value); wording is for ``render``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import coefficient_of_variation, median, number, percent_change

# What must match across runs, what should, and what should within one group.
BLOCKING_FIELDS = ("manifest_hash", "schema_version")
CONTROLLED_FIELDS = ("batch_size", "num_workers", "measured_batches", "world_size", "seed", "compute_steps")
WITHIN_GROUP_FIELDS = ("shuffle", "shuffle_buffer")
METRICS = (
    "samples_per_second", "mib_per_second", "mean_batch_wait_seconds", "p95_batch_wait_seconds", "mean_data_wait_fraction", "startup_seconds",
    "files_opened", "filesystem_objects"
)
CORRECTNESS = ("failed_samples", "duplicate_samples", "missing_samples")
NOISY_CV = 0.1


def _has(df: DataFrame, name: str) -> Column:
    """The column, or null where no run records it."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def group_key(runs: DataFrame, key: str) -> Column:
    return F.coalesce(_has(runs, key).cast("string"), F.lit("unknown"))


def group_summaries(runs: DataFrame, key: str = "layout", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Per group: runs, median, min, max and cv of each metric, correctness totals, first_seen. One shuffle."""
    values = [
        f(number(_has(runs, m))).alias(f"{m}_{name}") for m in metrics
        for name, f in (("median", median), ("min", F.min), ("max", F.max), ("cv", coefficient_of_variation))
    ]
    totals = [F.sum(F.coalesce(_has(runs, c).cast("long"), F.lit(0))).alias(c) for c in CORRECTNESS]
    return runs.groupBy(group_key(runs, key).alias("group")).agg(
        F.count("*").alias("runs"), *values, *totals, F.min("input_ordinal").alias("first_seen")
    )


def with_baseline(groups: DataFrame, baseline: str | None = None) -> DataFrame:
    """Groups with ``is_baseline``: the one named, else the first seen. A name that no group has marks none."""
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first_seen")) == 1  # one row per group
    return groups.withColumn("is_baseline", F.col("group") == baseline if baseline is not None else first)


def changes(groups: DataFrame, baseline: str | None = None, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Percent change of each median against the baseline's, for every group."""
    marked = with_baseline(groups, baseline)
    base = marked.filter("is_baseline").select(*[F.col(f"{m}_median").alias(f"_base_{m}") for m in metrics])
    joined = marked.crossJoin(F.broadcast(base))  # the baseline is one row
    return joined.select("group", "is_baseline", "first_seen", *[percent_change(f"_base_{m}", f"{m}_median").alias(f"{m}_percent") for m in metrics])


def layout_comparison(runs: DataFrame, key: str = "layout", baseline: str | None = None) -> DataFrame:
    groups = group_summaries(runs, key)
    return groups.join(changes(groups, baseline).drop("first_seen"), "group")


def _distinct_values(c: Column) -> Column:
    """Different values; null counts as one."""
    return (F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))).cast("long")


def mismatches(runs: DataFrame, blocking: tuple[str, ...] = BLOCKING_FIELDS, controlled: tuple[str, ...] = CONTROLLED_FIELDS) -> DataFrame:
    """(field, distinct_values, blocking) for each field that differs; fewer than two runs differ in nothing.

    Each (field, value) is reduced to one row per task before the shuffle.
    """
    fields = [*blocking, *controlled]
    rows = F.array(*[F.struct(F.lit(f).alias("field"), _has(runs, f).cast("string").alias("v")) for f in fields])
    each = runs.select(F.explode(rows).alias("r")).groupBy("r.field", "r.v").agg(F.count("*").alias("n"))
    found = each.groupBy("field").agg(F.count("*").alias("distinct_values"), F.sum("n").alias("n")).filter("distinct_values > 1 and n > 1")
    return found.select("field", "distinct_values", F.col("field").isin(*blocking).alias("blocking"))


def within_group_mismatches(runs: DataFrame, key: str = "layout", fields: tuple[str, ...] = WITHIN_GROUP_FIELDS) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f).alias("field"), _has(runs, f).cast("string").alias("v")) for f in fields])
    each = runs.select(
        group_key(runs, key).alias("group"), F.explode(rows).alias("r")
    ).groupBy("group", "r.field", "r.v").agg(F.count("*").alias("n"))
    return each.groupBy("group", "field").agg(F.count("*").alias("distinct_values")).filter("distinct_values > 1")


def shuffle_differs(runs: DataFrame, key: str = "layout") -> DataFrame:
    """One row: do groups differ in the set of shuffle settings that their runs used. Null is a setting."""
    each = runs.select(group_key(runs, key).alias("group"), F.coalesce(_has(runs, "shuffle").cast("string"), F.lit("\0null")).alias("v")).distinct()
    sets = each.groupBy("group").agg(F.sort_array(F.collect_set("v")).alias("s"))
    return sets.agg((F.count_distinct("s") > 1).alias("shuffle_differs"))


def verdict(runs: DataFrame) -> DataFrame:
    """One row: controlled (nothing differs) and comparable (nothing that blocks differs)."""
    return mismatches(runs).agg((F.count("*") == 0).alias("controlled"), (F.count_if("blocking") == 0).alias("comparable"))


def rule_rows(df: DataFrame, rules: list[tuple[int, str, str, Column, Column]], subject: Column) -> DataFrame:
    """(ordinal, rule_id, severity, subject, value) for each row of ``df`` and each rule whose condition holds."""
    each = [
        F.when(
            F.coalesce(cond, F.lit(False)),
            F.struct(
                F.lit(n).alias("ordinal"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"),
                F.round(value.cast("double"), 6).alias("value")
            )
        ) for n,
        rule, severity, cond, value in rules
    ]
    return df.select(F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("r")).select("r.*")


def correctness_rules(first: int, severity: str = "caution") -> list[tuple[int, str, str, Column, Column]]:
    return [(first + i, c.replace("_", "-"), severity, F.col(c) > 0, F.col(c)) for i, c in enumerate(CORRECTNESS)]


def comparison_cautions(runs: DataFrame, key: str = "layout") -> DataFrame:
    """Failed, duplicate and missing samples by group; single runs, else noisy groups; then what differs."""
    groups = group_summaries(runs, key, ("samples_per_second",))
    single = F.count_if(F.col("runs") < 2).over(Window.partitionBy(F.lit(0))) > 0  # one row per group
    groups = groups.withColumn("_single", single)
    rules = [
        *correctness_rules(1), (4, "single-run", "caution", F.col("runs") < 2, F.col("runs")),
        (5, "noisy", "caution", ~F.col("_single") & (F.col("samples_per_second_cv") > NOISY_CV), F.col("samples_per_second_cv"))
    ]
    parts = [
        rule_rows(groups, rules, F.col("group")),
        rule_rows(
            mismatches(runs),
            [
                (6, "mismatch", "blocking", F.col("blocking"), F.col("distinct_values")),
                (6, "mismatch", "uncontrolled", ~F.col("blocking"), F.col("distinct_values"))
            ],
            F.col("field")
        ),
        rule_rows(
            within_group_mismatches(runs, key), [(7, "within-group", "uncontrolled", F.lit(True), F.col("distinct_values"))],
            F.concat_ws(":", "group", "field")
        ),
    ]
    return reduce(DataFrame.unionByName, parts)
