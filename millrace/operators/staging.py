"""Copying a dataset to faster storage: whether to, and whether the copy is whole."""

from __future__ import annotations

import os
import shutil
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StagingError
from ..sources import treewalk


def check_safety(num_bytes: int, memory_bytes: int | None, fraction: float = 0.5) -> None:
    """Refuse to stage into memory what does not fit in ``fraction`` of it, or where the memory is not known."""
    if not 0 < fraction <= 1:
        raise StagingError(f"the safety fraction must be above 0 and at most 1, not {fraction}")
    if memory_bytes is None:
        raise StagingError("the memory of this allocation is not known")
    if num_bytes > int(memory_bytes * fraction):
        raise StagingError(f"{num_bytes} bytes exceed {fraction:g} of {memory_bytes} bytes of memory")


def copy_differences(source: DataFrame, copy: DataFrame) -> DataFrame:
    """(path, problem): paths of ``source`` that the copy lacks or holds with another size."""
    s, c = source.select("path", F.col("size").alias("want")), copy.select("path", F.col("size").alias("have"))
    both = s.join(c, "path", "left")
    return both.filter("have is null or have <> want").select("path", F.when(F.col("have").isNull(), "absent").otherwise("size").alias("problem"))


@contextmanager
def staged(
        spark: SparkSession, source: str, directory: str, memory_bytes: int | None, fraction: float = 0.5, validate: bool = True
) -> Iterator[dict[str, object]]:
    """A copy of a file or tree under ``directory``, gone again at the end: its path, sizes and what making it cost.

    Nothing is copied that the memory does not hold safely, nor over what is there
    already; a copy that differs from its source is not given out. The driver copies,
    for work that runs on its own machine.
    """
    if not os.path.exists(source):
        raise StagingError(f"there is no {source} to stage")
    before = treewalk.walk(spark, source).filter("kind = 'file'")
    size = before.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    check_safety(size["bytes"], memory_bytes, fraction)
    new_root = not os.path.isdir(directory)
    target = os.path.join(directory, os.path.basename(os.path.normpath(source)))
    if os.path.lexists(target):
        raise StagingError(f"{target} is there already")
    os.makedirs(directory, exist_ok=True)
    try:
        began = time.perf_counter()
        (shutil.copytree if os.path.isdir(source) else shutil.copy2)(source, target)
        copied = time.perf_counter()
        if validate:
            validate_staged(before, treewalk.walk(spark, target).filter("kind = 'file'"))
        yield {
            "staged_path": target, "staging_source": source, "staging_destination": target, "staged_files": size["files"], "staged_bytes": size["bytes"], "staging_seconds": copied - began,
            "validation_seconds": time.perf_counter() - copied, "memory_allocated_bytes": memory_bytes, "dataset_fraction_of_memory": size["bytes"] / memory_bytes, "safety_fraction": fraction,
        }
    finally:
        shutil.rmtree(directory if new_root else target, ignore_errors=True)
        if os.path.lexists(target):
            os.remove(target)


def absent_samples(manifest: DataFrame, present: DataFrame, key: str = "sample_id") -> DataFrame:
    """Manifest rows whose key is not among ``present``."""
    return manifest.join(present.select(key), key, "left_anti")


def validate_staged(source: DataFrame, copy: DataFrame) -> None:
    problem = copy_differences(source, copy).orderBy("path").take(1)
    if problem:
        raise StagingError(f"the copy differs at {problem[0]['path']}: {problem[0]['problem']}")
