"""Where to keep the data: cost by placement, with what staging costs and saves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import coefficient_of_variation, median, number, percent_change
from .compare import CORRECTNESS, NOISY_CV, _has, correctness_rules, group_key, rule_rows

HORIZONS = (1, 3, 10, 50)
DEFAULT_PLACEMENT = "scratch"
STAGED_PLACEMENT = "tmp"

# Medians reported for each placement.
PLACEMENT_METRICS = (
    "samples_per_second", "estimated_epoch_seconds", "staging_seconds", "validation_seconds", "startup_seconds", "measured_seconds", "total_job_seconds", "mean_batch_wait_seconds",
    "peak_tmp_bytes", "peak_memory_bytes", "dataset_fraction_of_memory", "staged_bytes",
)


def placement_rows(runs: DataFrame) -> DataFrame:
    """One row per placement: runs, medians, throughput cv, correctness totals, first_seen."""
    totals = [F.sum(F.coalesce(_has(runs, c).cast("long"), F.lit(0))).alias(c) for c in CORRECTNESS]
    return runs.groupBy(group_key(runs, "storage").alias("storage")).agg(
        F.count("*").alias("runs"), coefficient_of_variation(number(_has(runs, "samples_per_second"))).alias("samples_per_second_cv"),
        *[median(number(_has(runs, m))).alias(m) for m in PLACEMENT_METRICS], *totals, F.min("input_ordinal").alias("first_seen")
    )


def setup_cost() -> Column:
    return F.col("staging_seconds") + F.col("validation_seconds")


def total_cost(epochs: Column | int) -> Column:
    return setup_cost() + F.col("estimated_epoch_seconds") * epochs


def _baseline(rows: DataFrame, baseline: str) -> DataFrame:
    """``rows`` with ``is_baseline``: the named placement, or the first seen where it was not measured."""
    every = Window.partitionBy(F.lit(0))  # one row per placement
    named = F.max(F.col("storage") == baseline).over(every)
    first = F.row_number().over(every.orderBy("first_seen")) == 1
    return rows.withColumn("is_baseline", F.when(named, F.col("storage") == baseline).otherwise(first))


def break_even(rows: DataFrame, baseline: str = DEFAULT_PLACEMENT) -> DataFrame:
    """Each placement against the baseline: seconds saved by epoch, extra setup, epochs until it pays, throughput change, and noise."""
    marked = _baseline(rows, baseline)
    base = marked.filter("is_baseline").select(
        F.col("storage").alias("baseline"), F.col("estimated_epoch_seconds").alias("_epoch"), setup_cost().alias("_setup"),
        F.col("samples_per_second").alias("_sps"), F.col("samples_per_second_cv").alias("_cv")
    )
    each = marked.filter("not is_baseline").crossJoin(F.broadcast(base))  # the baseline is one row
    saved, cost = F.col("_epoch") - F.col("estimated_epoch_seconds"), setup_cost() - F.col("_setup")
    epochs = F.when(saved > 0, F.when(cost > 0, cost / saved).otherwise(F.lit(0.0)))
    noise = F.sqrt(F.pow(F.col("_cv") * 100.0, F.lit(2.0)) + F.pow(F.col("samples_per_second_cv") * 100.0, F.lit(2.0)))
    change = percent_change("_sps", "samples_per_second")
    return each.select(
        "storage", "baseline", saved.alias("per_epoch_time_saved"), cost.alias("setup_cost_seconds"), epochs.alias("break_even_epochs"),
        change.alias("throughput_change_percent"), noise.alias("noise_percent"),
        F.coalesce((noise > 0) & (F.abs(change) < noise), F.lit(False)).alias("indistinguishable")
    )


def cost_by_horizon(rows: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """(epochs, storage, total_cost_seconds, is_cheapest) for each horizon; ties go to the placement seen first."""
    each = rows.withColumn(
        "epochs", F.explode(F.array(*[F.lit(int(h)) for h in horizons]))
    ).withColumn("total_cost_seconds", total_cost(F.col("epochs")))
    place = F.row_number().over(Window.partitionBy("epochs").orderBy("total_cost_seconds", "first_seen"))
    return each.select("epochs", "storage", "total_cost_seconds", (place == 1).alias("is_cheapest"))


def near_tie_choice(rows: DataFrame, planned_epochs: int, preferred: str = DEFAULT_PLACEMENT) -> DataFrame:
    """One row: the cheapest placement at the planned epochs, or the preferred one where the margin is within the noise."""
    costs = rows.withColumn("cost", total_cost(planned_epochs))
    cheapest = costs.orderBy("cost", "first_seen").limit(1).select(
        F.col("storage").alias("cheapest"), F.col("cost").alias("cheapest_cost"), F.col("samples_per_second_cv").alias("_cv")
    )
    other = costs.filter(F.col("storage") == preferred).select(
        F.col("storage").alias("_pref"), F.col("cost").alias("_pref_cost"), F.col("samples_per_second_cv").alias("_pref_cv")
    )
    both = cheapest.join(F.broadcast(other), F.lit(True), "left")  # one row each
    margin = (F.col("_pref_cost") - F.col("cheapest_cost")) / F.greatest(F.col("cheapest_cost"), F.lit(1e-9))
    band = F.sqrt(F.col("_cv") * F.col("_cv") + F.col("_pref_cv") * F.col("_pref_cv"))
    tie = F.coalesce((F.col("cheapest") != preferred) & (margin <= band), F.lit(False))
    return both.select(
        F.when(tie, F.lit(preferred)).otherwise(F.col("cheapest")).alias("recommended_storage"), "cheapest", "cheapest_cost", margin.alias("margin"),
        band.alias("noise_band"), tie.alias("tie_broken")
    )


def staging_decision(rows: DataFrame, planned_epochs: int, baseline: str = DEFAULT_PLACEMENT, staged: str = STAGED_PLACEMENT) -> DataFrame:
    """One row: is staging not measured, not recommended, recommended or viable."""
    choice = near_tie_choice(rows, planned_epochs, baseline)
    there = rows.agg(F.coalesce(F.max(F.col("storage") == staged), F.lit(False)).alias("measured"))
    even = break_even(rows, baseline).filter(F.col("storage") == staged).select("break_even_epochs")
    one = there.join(F.broadcast(even), F.lit(True), "left").join(F.broadcast(choice), F.lit(True), "left")  # one row each
    state = (
        F.when(~F.col("measured"), "not-measured").when(
            F.col("break_even_epochs").isNull() | (F.col("break_even_epochs") > planned_epochs), "not-recommended"
        )
        .when(F.col("recommended_storage") == staged, "recommended").otherwise("viable")
    )
    return one.select(state.alias("node_local_staging"), "break_even_epochs", F.lit(planned_epochs).alias("planned_epochs"))


def placement_cautions(runs: DataFrame, baseline: str = DEFAULT_PLACEMENT) -> DataFrame:
    rows = placement_rows(runs)
    rules = [
        *correctness_rules(1),
        (4, "noisy", "caution", (F.col("runs") >= 2) & (F.col("samples_per_second_cv") > NOISY_CV), F.col("samples_per_second_cv")),
        (5, "single-run", "caution", F.col("runs") < 2, F.col("runs")),
        (6, "staged-memory", "caution", F.col("dataset_fraction_of_memory") > 0, F.col("dataset_fraction_of_memory"))
    ]
    noise = rule_rows(
        break_even(rows, baseline), [(7, "indistinguishable", "caution", F.col("indistinguishable"), F.col("noise_percent"))], F.col("storage")
    )
    return reduce(DataFrame.unionByName, [rule_rows(rows, rules, F.col("storage")), noise])
