"""Readers, batches and measurement windows as expressions over ordered samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering


def round_robin(ordinal: Column, readers: int) -> Column:
    """The reader of an item by its place: every reader takes each ``readers``-th item."""
    return F.pmod(ordinal, F.lit(readers)).cast("int")


def batches(samples: DataFrame, batch_size: int, drop_last: bool = True, per: str = "reader", order: str = "position") -> DataFrame:
    """(per, batch, samples): consecutive rows of each reader; a short last batch goes if ``drop_last``.

    A reader's rows are ranked by ranges of ``order``, so they need not fit in one task.
    """
    found = ordering.ranked(samples.select(per, order), [per], ordering.range_bucket(samples, order), [order])
    found = found.groupBy(per, F.expr(f"rank div {batch_size}").alias("batch")).agg(F.count("*").alias("samples"))
    return found.filter(F.col("samples") == batch_size) if drop_last else found


def measured_window(rows: DataFrame, warmup: int, measured: int, ordinal: str = "ordinal") -> DataFrame:
    """Rows labelled startup, warm-up or measured by batch ordinal; later ones are dropped. The first batch is start-up."""
    n = F.col(ordinal)
    window = F.when(n == 0, "startup").when(n <= warmup, "warmup").when(n <= warmup + measured, "measured")
    return rows.withColumn("window", window).filter("window is not null")


def repeat_epochs(samples: DataFrame, epochs: int) -> DataFrame:
    """Each sample once per epoch, with column ``epoch``."""
    return samples.withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    ) if epochs else samples.withColumn("epoch", F.lit(0)).limit(0)


def shuffle_buffer(samples: DataFrame, size: int, seed: int) -> DataFrame:
    """Each partition passed through a buffer of ``size`` rows that gives up a random row for each new one.

    Partitions draw from generators of their own, which follow from ``seed`` and the partition's number.
    """

    def passed(found):
        import random

        import pandas as pd
        from pyspark import TaskContext

        draw, held, columns = random.Random(seed + TaskContext.get().partitionId()), [], None
        for pdf in found:
            columns, out = list(pdf.columns), []
            for row in pdf.itertuples(index=False):
                if len(held) < size:
                    held.append(row)
                else:
                    i = draw.randrange(size)
                    out.append(held[i])
                    held[i] = row
            if out:
                yield pd.DataFrame(out, columns=columns)
        draw.shuffle(held)
        if held:
            yield pd.DataFrame(held, columns=columns)

    return samples.mapInPandas(passed, samples.schema) if size > 1 else samples
