"""Run summaries: a closed set of named fields, read with types and written only if valid."""

from __future__ import annotations

import json
import os
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SummaryError

VERSION = "1.0"

# Fields of every summary, with their types and defaults.
COMMON = {
    "schema_version": ("string", VERSION), "run_name": ("string", ""), "timestamp_utc": ("string", ""), "git_commit": ("string", ""), "config_path": ("string", ""), "config_hash": ("string", ""), "hostname": ("string", ""), "slurm_job_id": ("string", ""), "layout": ("string", ""), "storage": ("string", ""),
    "world_size": ("int", 1), "rank": ("int", 0), "num_workers": ("int", 0), "warmup_batches": ("int", 0), "measured_batches": ("int", 0), "samples_measured": ("long", 0), "bytes_read": ("long", 0), "startup_seconds": ("double", 0.0), "staging_seconds": ("double", 0.0), "measured_seconds": ("double", 0.0),
    "samples_per_second": ("double", 0.0), "mib_per_second": ("double", 0.0), "mean_batch_wait_seconds": ("double", 0.0), "p95_batch_wait_seconds": ("double", 0.0), "mean_data_wait_fraction": ("double", 0.0), "peak_memory_bytes": ("long", 0), "failed_samples": ("long", 0), "duplicate_samples": ("long", 0), "missing_samples": ("long", 0),
}

# Fields that a summary may have, with their types. Nested ones are kept as JSON.
OPTIONAL = {
    "manifest_path": "string", "manifest_hash": "string", "resolved_config": "string", "slurm_context": "map<string,string>",
    "cpus_available": "int", "allocated_cores": "int", "threads_per_core": "int", "batch_size": "int",
    "prefetch_factor": "int", "persistent_workers": "boolean", "shuffle": "boolean", "shuffle_buffer": "int", "seed": "long",
    "compute_steps": "int", "notes": "string", "total_samples": "long", "adapter": "string",
    "batches_measured": "int", "files_opened": "long", "batches_per_second": "double",
    "median_batch_wait_seconds": "double", "max_batch_wait_seconds": "double", "compute_seconds": "double",
    "warmup_seconds": "double", "unique_samples": "long", "measured_epochs": "int",
    "user_cpu_seconds": "double", "system_cpu_seconds": "double", "cpu_utilization": "double",
    "voluntary_context_switches": "long", "involuntary_context_switches": "long",
    "involuntary_switches_per_second": "double", "child_processes": "int",
    "oversubscription_ratio": "double", "processes_per_physical_core": "double",
    "num_shards": "int", "mean_shard_bytes": "double", "min_shard_bytes": "long", "max_shard_bytes": "long",
    "shard_bytes_cv": "double", "shard_work_cv": "double", "samples_per_shard": "int",
    "max_samples_per_shard": "int", "shard_opens": "long", "shard_open_seconds": "double",
    "filesystem_objects": "long", "image_bytes": "long", "mount_seconds": "double", "artifact_bytes": "long",
    "row_groups": "int", "chunk_size": "int",
    "validation_seconds": "double", "estimated_epoch_seconds": "double", "per_epoch_seconds": "array<double>",
    "total_job_seconds": "double", "peak_tmp_bytes": "long", "staged_bytes": "long", "staged_files": "long",
    "staging_source": "string", "staging_destination": "string", "memory_allocated_bytes": "long",
    "memory_source": "string", "dataset_fraction_of_memory": "double", "safety_fraction": "double",
    "rank_summaries": "string", "min_rank_throughput": "double", "max_rank_throughput": "double",
    "rank_throughput_spread": "double", "min_rank_elapsed_seconds": "double",
    "max_rank_elapsed_seconds": "double", "rank_elapsed_spread": "double", "max_data_wait_fraction": "double",
    "coverage_fraction": "double", "idle_ranks": "array<int>", "partitioning_valid": "boolean",
}
TYPES = {k: t for k, (t, _) in COMMON.items()} | OPTIONAL
SCHEMA = ", ".join(f"{k} {t}" for k, t in TYPES.items())
# What is printed as KEY=VALUE, in order.
PRINTED = (
    "layout", "storage", "world_size", "num_workers", "samples_measured", "bytes_read", "samples_per_second", "mib_per_second", "startup_seconds", "mean_batch_wait_seconds", "p95_batch_wait_seconds", "mean_data_wait_fraction",
    "failed_samples", "duplicate_samples", "missing_samples",
)


def new_summary(**values: Any) -> dict[str, Any]:
    if other := sorted(set(values) - set(TYPES)):
        raise SummaryError(f"unknown fields {other}")
    return {k: d for k, (_, d) in COMMON.items()} | values


def validate(summary: dict[str, Any], where: str = "summary") -> dict[str, Any]:
    if absent := sorted(set(COMMON) - set(summary)):
        raise SummaryError(f"{where}: lacks {absent}")
    if other := sorted(set(summary) - set(TYPES)):
        raise SummaryError(f"{where}: unknown fields {other}")
    if summary["schema_version"] != VERSION:
        raise SummaryError(f"{where}: version {summary['schema_version']!r}, not {VERSION!r}")
    return summary


def write_summary(path: str, summary: dict[str, Any]) -> str:
    """Write a valid summary; an invalid one is never stored."""
    validate(summary)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        f.write(json.dumps(summary, indent=2, sort_keys=True) + "\n")
    return path


def key_values(summary: dict[str, Any]) -> str:
    return "\n".join(f"{k.upper()}={summary[k]}" for k in PRINTED if k in summary)


def _uri(spark: SparkSession, path: str) -> str:
    """A path as the reader's metadata names its file: qualified and encoded."""
    one = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path if "://" in path else os.path.abspath(path))
    return one.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(one).toUri().toString()


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per given path, with ``input_ordinal`` as given; a path given twice gives two rows.

    Names are checked on the raw keys, as typed readers drop unknown ones. A path
    that no row came from is an error.
    """
    given = [(i, re.sub("^file:/+", "/", _uri(spark, p))) for i, p in enumerate(paths)]
    raw = spark.read.text(sorted(set(paths)), wholetext=True).select(
        "value", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("_path")
    )
    keys = F.json_object_keys("value")
    need, may = F.array(*[F.lit(k) for k in COMMON]), F.array(*[F.lit(k) for k in TYPES])
    rows = raw.select(
        "_path", keys.isNull().alias("_bad"), F.array_except(need, keys).alias("_absent"), F.array_except(keys, may).alias("_other"),
        F.from_json("value", SCHEMA).alias("r")
    )
    seen = {
        w["_path"]: w for w in rows.select(
            "_path", "_bad", "_absent", "_other", F.col("r.schema_version").eqNullSafe(VERSION).alias("_same")
        ).collect()
    }  # one row per file
    for _, path in given:
        w = seen.get(path)
        if w is None:
            raise SummaryError(f"{path}: no run was read from it")
        if w["_bad"] or w["_absent"] or w["_other"] or not w["_same"]:
            raise SummaryError(
                f"{path}: " + (
                    "not a JSON object" if w["_bad"] else f"lacks {w['_absent']}" if w["_absent"] else f"unknown fields {w['_other']}" if w["_other"] else f"version is not {VERSION!r}"
                )
            )
    order = spark.createDataFrame(given, "input_ordinal long, _path string")
    return rows.join(F.broadcast(order), "_path").select("input_ordinal", "r.*")  # one row per file
