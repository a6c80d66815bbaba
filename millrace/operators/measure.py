"""Timing layouts with Spark: every row of a source is read and dropped, repeats interleaved."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def measure(spark: SparkSession, layouts: dict[str, Callable[[], DataFrame]], repeats: int = 3) -> DataFrame:
    """Runs (input_ordinal, layout, samples_per_second, ...), one per layout and repeat, in alternating order.

    ``layouts`` builds a DataFrame with ``payload``. Counts come from the same pass,
    through an observation, so nothing is read twice.
    """
    rows = []
    for n in range(repeats):
        names = list(layouts) if n % 2 == 0 else list(reversed(layouts))
        for name in names:
            from pyspark.sql import Observation

            seen = Observation(f"{name}-{n}")
            df = layouts[name]().observe(
                seen, F.count("*").alias("samples"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("bytes"),
                F.count_if(F.col("payload").isNull()).alias("failed")
            )
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            got = seen.get
            rows.append(
                (
                    len(rows), name, int(got["samples"]), int(got["bytes"]), int(got["failed"]), took, got["samples"] / took if took else 0.0,
                    got["bytes"] / 1048576 / took if took else 0.0
                )
            )
    return spark.createDataFrame(
        rows,
        "input_ordinal long, layout string, samples_measured long, bytes_read long, failed_samples long, measured_seconds double, samples_per_second double, mib_per_second double"
    )
