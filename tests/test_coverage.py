from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import batching, coverage


def reads(spark, rows):
    return spark.createDataFrame(rows, "rank int, epoch int, sample_index long")


def total(spark, n):
    return spark.createDataFrame([(n,)], "total long")


def ranks(spark, elapsed):
    return spark.createDataFrame(
        [(i, 100.0, float(e), 0.1) for i, e in enumerate(elapsed)],
        "rank int, samples_per_second double, elapsed_seconds double, data_wait_fraction double"
    )


def test_duplicates_are_counted_within_an_epoch(spark):
    rows = [(0, 0, i) for i in (0, 1, 2, 2, 3)] + [(0, 1, i) for i in range(4)]
    found = {r.epoch: r for r in coverage.epoch_coverage(reads(spark, rows), total(spark, 4)).collect()}
    assert (found[0].observed, found[0].unique_samples, found[0].duplicate_samples, found[0].missing_samples) == (5, 4, 1, 0)
    assert (found[1].observed, found[1].duplicate_samples) == (4, 0)


def test_missing_allows_for_dropped_samples(spark):
    rows = reads(spark, [(0, 0, i) for i in range(7)])
    assert coverage.epoch_coverage(rows, total(spark, 10)).first().missing_samples == 3
    assert coverage.epoch_coverage(rows, total(spark, 10), 3).first().missing_samples == 0


def test_verdict_of_disjoint_ranks(spark):
    rows = reads(spark, [(r, 0, r * 100 + i) for r in range(8) for i in range(100)])
    v = coverage.cross_rank_verdict(rows, total(spark, 800), 8).first()
    assert v.partitioning_valid and v.coverage_fraction == 1.0 and v.idle_ranks == []


def test_verdict_of_idle_and_duplicating_ranks(spark):
    idle = reads(spark, [(r, 0, r * 400 + i) for r in range(2) for i in range(400)])
    v = coverage.cross_rank_verdict(idle, total(spark, 800), 8).first()
    assert v.idle_ranks == [2, 3, 4, 5, 6, 7] and not v.partitioning_valid
    same = reads(spark, [(r, 0, i) for r in range(8) for i in range(100)])
    v = coverage.cross_rank_verdict(same, total(spark, 800), 8).first()
    assert (v.samples_measured, v.unique_samples, v.duplicate_samples) == (800, 100, 700)


def test_missing_is_judged_only_after_enough_reads(spark):
    some = reads(spark, [(r, 0, r * 100 + i) for r in range(2) for i in range(100)])
    v = coverage.cross_rank_verdict(some, total(spark, 800), 2).first()
    assert v.missing_samples == 0 and v.coverage_fraction == 0.25
    part = reads(spark, [(0, 0, i) for i in range(400)] + [(1, 0, 300 + i) for i in range(400)])
    assert coverage.cross_rank_verdict(part, total(spark, 800), 2).first().missing_samples == 100


def test_imbalance_is_a_caution(spark):
    rows = reads(spark, [(r, 0, r * 10 + i) for r in range(4) for i in range(10)])
    found = coverage.distributed_findings(
        coverage.cross_rank_verdict(rows, total(spark, 40), 4), coverage.rank_balance(ranks(spark, [10, 10, 40, 10]))
    ).collect()
    assert [(r.rule_id, r.value) for r in found] == [("rank-imbalance", 0.75)]


def test_expectations(spark):
    one = spark.range(1).select(
        scalars.expected_samples(
            F.lit(10), F.lit(4), F.lit(True), F.lit(False)
        ), scalars.missing_allowance(
            F.lit(8), F.lit(4), F.lit(True), F.lit(True)
        ), scalars.missing_allowance(F.lit(8), F.lit(0), F.lit(True), F.lit(True))
    ).first()
    assert list(one) == [8, 28, 7]


def test_batches_windows_and_epochs(spark):
    rows = spark.createDataFrame([(i % 2, i) for i in range(11)], "reader int, position int")
    assert batching.batches(rows, 3, True).count() == 3 and batching.batches(rows, 3, False).count() == 4
    b = spark.createDataFrame([(i, i // 4) for i in range(12)], "ordinal int, epoch int")
    assert {r.epoch: r.complete for r in coverage.complete_epochs(b).collect()} == {0: False, 1: True, 2: False}
    assert all(r.complete for r in coverage.complete_epochs(b, "epoch").collect())
    kinds = batching.measured_window(b, 2, 5).groupBy("window").count().collect()
    assert {r["window"]: r["count"] for r in kinds} == {"startup": 1, "warmup": 2, "measured": 5}
    assert batching.repeat_epochs(rows, 3).count() == 33
    mixed = batching.shuffle_buffer(rows.coalesce(1), 4, 7).collect()
    assert sorted(r.position for r in mixed) == list(range(11)) and [r.position for r in mixed] != list(range(11))
