"""Shard planning: which sample goes to which shard, and which shard to which reader.

``samples``: sample_id, byte_size, estimated_decode_cost. Plans are rows
(sample_id, byte_size, estimated_decode_cost, shard_id, position).
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import tar_bytes, tar_member_bytes
from ..functions.stats import coefficient_of_variation, ratio
from . import ordering
from .batching import round_robin

#: Buckets of the seeded order: ranks are counted within a bucket and added up over them.
BUCKETS = 1 << 14
SPREAD_CAUTION = 0.2


@dataclass(frozen=True)
class ShardPlan:
    """How to deal samples out. An imbalance factor above 1 makes uneven shards, whatever ``balance_by`` says."""

    samples_per_shard: int = 1000
    shuffle: bool = True
    seed: int = 1234
    balance_by: str = "count"
    imbalance_factor: float = 1.0

    def validate(self) -> None:
        if self.samples_per_shard < 1:
            raise ValueError("samples_per_shard must be at least 1")
        if self.balance_by not in ("count", "work"):
            raise ValueError(f"balance_by must be count or work, not {self.balance_by!r}")
        if self.imbalance_factor < 1.0:
            raise ValueError("imbalance_factor must be at least 1.0")


def ordered(samples: DataFrame, plan: ShardPlan) -> DataFrame:
    """``samples`` with their place ``rank`` in the plan's order and the number of rows ``total``.

    Shuffled: by MD5 of id and seed, counted by hash bucket, so that no task sorts
    all samples. Unshuffled: by id, over ranges of ids between cut points.
    """
    if plan.shuffle:
        key = F.md5(F.concat("sample_id", F.lit(f":{plan.seed}")).cast("binary"))
        bucket = F.expr(f"conv(substring(_key, 1, 8), 16, 10) div {2**32 // BUCKETS}").cast("int")
        return ordering.ranked(samples.withColumn("_key", key), [], bucket, ["_key", "sample_id"], total="total").drop("_key")
    return ordering.ranked(samples, [], ordering.range_bucket(samples, "sample_id"), ["sample_id"], total="total")


def plan_shards(samples: DataFrame, plan: ShardPlan = ShardPlan()) -> DataFrame:  # noqa: B008
    """One row per sample with its shard and its position in it; every sample once."""
    plan.validate()
    rows = ordered(samples, plan)
    if plan.imbalance_factor > 1.0:
        return _uneven(rows, plan)
    if plan.balance_by == "work":
        return _by_work(rows, plan)
    per = plan.samples_per_shard
    return rows.withColumn(
        "shard_id", F.expr(f"rank div {per}").cast("int")
    ).withColumn("position", (F.col("rank") % per).cast("int")).drop("rank", "total")


def _by_work(rows: DataFrame, plan: ShardPlan) -> DataFrame:
    """Greedy packing: the costliest sample first, each to the shard with least work so far (ties: the lowest).

    Sequential by definition, so one task runs it over (id, cost) alone; it holds a
    heap of shards and one Arrow batch of samples. Payload columns join afterwards.
    """
    lean = rows.select(
        "sample_id", "estimated_decode_cost", "total"
    ).repartition(1).sortWithinPartitions(F.desc("estimated_decode_cost"), "sample_id")
    per = plan.samples_per_shard

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import heapq

        heap: list[tuple[int, int]] = []
        for pdf in batches:
            if not heap and len(pdf):
                heap = [(0, i) for i in range(max(1, -(-int(pdf.total.iloc[0]) // per)))]
            out = []
            for cost in pdf.estimated_decode_cost.tolist():
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + cost, shard))
                out.append(shard)
            yield pd.DataFrame({"sample_id": pdf.sample_id, "bucket": out})

    dealt = lean.mapInPandas(packed, "sample_id string, bucket int")
    used = dealt.groupBy("bucket").agg(F.count("*").alias("n"))
    ids = used.select("bucket", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("bucket")) - 1).alias("shard_id"))
    found = rows.join(dealt.join(ids, "bucket"), "sample_id").drop("bucket")
    place = Window.partitionBy("shard_id").orderBy(F.desc("estimated_decode_cost"), "sample_id")
    return found.withColumn("position", F.row_number().over(place) - 1).drop("rank", "total")


def uneven_weights(plan: ShardPlan, shards: int) -> list[float]:
    """Random weights between 1 and the imbalance factor; more shards have the same first ones."""
    draw = random.Random(plan.seed + 1)
    return [draw.uniform(1.0, plan.imbalance_factor) for _ in range(shards)]


def _uneven(rows: DataFrame, plan: ShardPlan) -> DataFrame:
    """Consecutive runs whose lengths follow random weights between 1 and the factor."""
    spark = rows.sparkSession
    total = rows.count()
    shards = max(1, -(-total // plan.samples_per_shard))
    weights = uneven_weights(plan, shards)
    bounds, at = [], 0
    for i, w in enumerate(weights):
        n = total - at if i == shards - 1 else min(total - at, max(1, round(total * w / sum(weights))))
        if n > 0:
            bounds.append((len(bounds), at, at + n))
            at += n
    table = spark.createDataFrame(bounds or [(0, 0, 0)], "shard_id int, _from long, _to long")
    found = rows.join(F.broadcast(table), (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to")))  # one row per shard
    return found.withColumn("position", (F.col("rank") - F.col("_from")).cast("int")).drop("rank", "total", "_from", "_to")


def shard_index(members: DataFrame) -> DataFrame:
    """Per shard: samples, sample_bytes, estimated_work, and the size of its tar file."""
    return members.groupBy("shard_id").agg(
        F.count("*").alias("samples"), F.sum("byte_size").alias("sample_bytes"), F.sum("estimated_decode_cost").alias("estimated_work"),
        tar_bytes(F.sum(tar_member_bytes(F.col("byte_size")))).alias("tar_bytes")
    )


def shard_statistics(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count("*").alias("shards"), F.coalesce(
            F.avg("tar_bytes"), F.lit(0.0)
        ).alias("mean_bytes"), F.coalesce(F.min("tar_bytes"), F.lit(0)).alias("min_bytes"), F.coalesce(F.max("tar_bytes"), F.lit(0)).alias("max_bytes"),
        coefficient_of_variation("tar_bytes").alias("bytes_cv"), coefficient_of_variation("estimated_work").alias("work_cv"), F.coalesce(F.min("samples"), F.lit(0)).alias("min_samples"), F.coalesce(F.max("samples"), F.lit(0)).alias("max_samples"),
    )


def assign_shards(index: DataFrame, readers: int) -> DataFrame:
    """``index`` with the reader of each shard, dealt in turn by shard number."""
    if readers < 1:
        raise ValueError("there must be at least one reader")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("shard_id")) - 1  # one row per shard
    return index.withColumn("reader", round_robin(place, readers))


def reader_loads(index: DataFrame, readers: int) -> DataFrame:
    """Per reader, idle ones too: shards, samples, bytes, work."""
    loads = assign_shards(index, readers).groupBy("reader").agg(
        F.count("*").alias("shards"), F.sum("samples").alias("samples"), F.sum("sample_bytes").alias("sample_bytes")
    )
    every = _readers(index.sparkSession, readers)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(loads, "reader", "left").select(
        "reader", zero("shards"), zero("samples"), zero("sample_bytes"), F.col("shards").isNull().alias("is_idle")
    )


def _readers(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("reader"))


def preflight(loads: DataFrame) -> DataFrame:
    """One row: will these shards keep the readers evenly busy. The first finding that applies counts."""
    one = loads.agg(
        F.count("*").alias("readers"), F.sum("shards").alias("shards"), F.min("samples").alias("min_samples"), F.max("samples").alias("max_samples"), F.count_if("is_idle").alias("idle_readers"),
        ratio(F.max("samples") - F.min("samples"), F.max("samples")).alias("load_spread"), F.min("shards").alias("_lo"), F.max("shards").alias("_hi"),
    )
    finding = F.when(F.col("idle_readers") > 0, "idle-readers").when(
        F.col("_lo") != F.col("_hi"), "unequal-shard-counts"
    ).when(F.col("load_spread") > SPREAD_CAUTION, "uneven-load").otherwise("balanced")
    return one.withColumn("finding", finding).drop("_lo", "_hi")
