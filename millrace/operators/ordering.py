"""Ranks over ordered rows without a task that holds them all.

Rows get a bucket that rises with the order, by cut points from a random sample of
all rows; ranks are counted inside a bucket and added up over the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket is planned to hold, and the most buckets.
BUCKET_ROWS = 100_000
MOST_BUCKETS = 4096
#: Sampled rows for each cut point.
OVERSAMPLE = 8


def range_bucket(rows: DataFrame, column: str, bucket_rows: int = BUCKET_ROWS) -> Column:
    """A number that rises with ``column``; nulls come first.

    At most ``OVERSAMPLE * MOST_BUCKETS`` values reach the driver. A row's bucket is
    found in two steps, among every 64th cut point and then between two of them.
    """
    wanted = min(MOST_BUCKETS, -(-rows.count() // bucket_rows))
    if wanted < 2:
        return F.lit(0)
    sample = rows.select(column).filter(F.col(column).isNotNull()).orderBy(F.rand(11)).limit(wanted * OVERSAMPLE)
    found = sorted(r[0] for r in sample.collect())
    cuts = sorted(set(found[OVERSAMPLE::OVERSAMPLE]))
    if not cuts:
        return F.lit(0)
    parts = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
    value = F.col(column)
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= value))
    coarse = below(F.array(*[F.lit(p[0]) for p in parts]))
    fine = below(F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in parts]), F.greatest(coarse, F.lit(1))))
    return F.when(value.isNull(), 0).otherwise(F.greatest(coarse - 1, F.lit(0)) * 64 + fine)


def ranked(rows: DataFrame, group: list[str], bucket: Column, order: list[Column | str], name: str = "rank", total: str | None = None) -> DataFrame:
    """``rows`` with their place from 0 in ``group`` by ``bucket`` then ``order``, and on demand the group's size."""
    rows = rows.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    every = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # one row per bucket
    more = [F.sum("_n").over(every).alias(total)] if total else []
    keys = [*group, "_bucket"]
    starts = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.sum("_n").over(every.orderBy("_bucket")) - F.col("_n")).alias("_start"), *more
    )
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    found = rows.join(starts, same).withColumn(name, F.row_number().over(inside) - 1 + F.col("_start"))
    return found.drop("_bucket", "_start", *[f"_k{i}" for i in range(len(keys))])
