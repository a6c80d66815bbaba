"""Queries that write the tables' rows in a storage format and read them again: sources and sinks, held against SQL.

Files go to the folder that driver and executors share, and away when the session ends.
"""

from __future__ import annotations

import os
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions import scalars
from ..operators import inspect, shards
from ..sources import manifest, runs, tarshards, tracks, treewalk
from . import views as v

GROUP_ROWS = 64


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, else in the warehouse; only where these are mounted as files."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir") + "/_work"
    path = os.path.join(re.sub("^file:/+", "/", shared), f"millrace-{name}-{uuid.uuid4().hex}")
    if not os.path.isabs(path):
        raise ConfigError(f"{shared} is not mounted as files: tar and record files need a shared folder that is")
    os.makedirs(path)
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file:{path}")
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(gone)
    return path


def listed(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest columns and payload of every document: a file of its text, by source and language."""
    d = v.table(spark, sf, "documents").filter("text is not null and doc_id is not null")
    payload = F.encode("text", "UTF-8")
    return d.select(
        scalars.sample_id(F.col("doc_id")).alias("sample_id"), F.concat(
            F.lit("docs/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")
        ).alias("relative_path"), scalars.class_of(F.col("doc_id"), 100).alias("class_id"),
        F.octet_length("text").cast("long").alias("byte_size"), F.lit(1).alias("width"), F.col("n_chars").cast("int").alias("height"), scalars.checksum(payload).alias("checksum"), F.col("n_chars").cast("long").alias("estimated_decode_cost"), payload.alias("payload"),
    )


def stored(rows: DataFrame, root: str) -> None:
    """Each row's payload as a file under ``root``."""

    def store(found):
        for r in found:
            path = os.path.join(root, r["relative_path"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(r["payload"])

    rows.select("relative_path", "payload").foreachPartition(store)


def walked_tree(spark: SparkSession, sf: str) -> DataFrame:
    root = folder(spark, "tree")
    stored(listed(spark, sf), root)
    os.makedirs(os.path.join(root, "empty", "inside"))
    return inspect.tree_totals(treewalk.walk(spark, root))


def walked_files(spark: SparkSession, sf: str) -> DataFrame:
    root = folder(spark, "tree")
    stored(listed(spark, sf), root)
    return treewalk.walk(spark, root).filter("kind = 'file'").select("path", "parent", "depth", "size", "extension")


def manifest_rows(spark: SparkSession, sf: str) -> DataFrame:
    path = manifest.write_manifest(listed(spark, sf).drop("payload"), os.path.join(folder(spark, "manifest"), "manifest.jsonl"))
    return manifest.read_manifest(spark, path)


def loose_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose id is a multiple of nine are not there: failed samples."""
    root, rows = folder(spark, "loose"), listed(spark, sf)
    stored(rows.filter("cast(substring(sample_id, 2) as long) % 9 <> 0"), root)
    return manifest.payloads(rows.drop("payload"), root).select(
        "sample_id", "failed", "read_bytes", F.when(~F.col("failed"), scalars.checksum(F.col("payload"))).alias("read_checksum")
    )


PLAN = shards.ShardPlan(samples_per_shard=100)


def _tar(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    root, rows = folder(spark, "tar"), listed(spark, sf)
    planned = shards.plan_shards(rows.drop("payload"), PLAN).select("sample_id", "shard_id", "position")
    return root, tarshards.write_shards(rows.join(planned, "sample_id").withColumn("extension", F.lit("txt")), root, PLAN)


def tar_samples(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = _tar(spark, sf)
    found = [tarshards.read_shards(spark, root, k, 3, seed=5) for k in range(3)]
    every = found[0].union(found[1]).union(found[2])
    return every.select("sample_id", "class_id", "shard", scalars.checksum(F.col("payload")).alias("checksum"))


def shard_index_rows(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = _tar(spark, sf)
    found = tarshards.read_index(spark, os.path.join(root, tarshards.INDEX_NAME))
    return found.select(
        "shard_id", "shard", "samples", "sample_bytes", "estimated_work", "tar_bytes", F.array_min("sample_ids").alias("least_id"),
        F.size("sample_ids").cast("long").alias("ids")
    )


def _track(fmt: str):
    def read(spark: SparkSession, sf: str) -> DataFrame:
        root, rows = folder(spark, fmt), listed(spark, sf)
        tracks.convert(rows, fmt, root, GROUP_ROWS)
        return tracks.read_track(spark, root, fmt, rows.count()).select("sample_id", "class_id", scalars.checksum(F.col("payload")).alias("checksum"))

    return read


def parquet_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Every row by its position, backwards, and one position that is not there."""
    root, rows = folder(spark, "parquet"), listed(spark, sf)
    n = tracks.convert(rows, "parquet", root, GROUP_ROWS)["rows"]
    asked = spark.range(n + 1).select((F.lit(n) - F.col("id")).alias("position"))
    return tracks.read_positions(asked, root, n).select("position", "sample_id", "failed", scalars.checksum(F.col("payload")).alias("checksum"))


class Texts:
    """An adapter for the tests' tables: the documents of one Parquet file by position."""

    def __init__(self, path: str):
        self.texts = pd.read_parquet(path, columns=["doc_id", "text"]).dropna().sort_values("doc_id")["text"].tolist()

    def read_payload(self, index: int) -> bytes:
        return self.texts[index].encode()


def adapter_payloads(spark: SparkSession, sf: str) -> DataFrame:
    placed = shards.ordered(listed(spark, sf).drop("payload"), shards.ShardPlan(shuffle=False)).withColumnRenamed("rank", "position")
    found = tracks.read_adapter(placed, f"{__name__}:Texts", path=f"{sf}/documents.parquet")
    return found.select("sample_id", "position", scalars.checksum(F.col("payload")).alias("read_checksum"), "failed")


def summaries_read(spark: SparkSession, sf: str) -> DataFrame:
    """One run a layout, with a space in its path; the first is given twice."""
    root = folder(spark, "runs")
    each = v.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type").collect()  # one row per type
    paths = []
    for r in each:
        paths.append(
            runs.write_summary(
                os.path.join(root, f"run {r['event_type']}.json"),
                runs.new_summary(run_name=r["event_type"], layout=r["event_type"], samples_measured=r["n"], seed=7)
            )
        )
    return runs.read_runs(spark, [*paths, paths[0]]).select("input_ordinal", "run_name", "samples_measured", "seed")


LISTED = """(SELECT 's' || lpad(doc_id::VARCHAR, 8, '0') AS sample_id, doc_id, 'docs/' || source || '/' || lang AS parent, (doc_id % 100)::INTEGER AS class_id, strlen(text)::BIGINT AS byte_size, substr(sha256(text), 1, 16) AS checksum, n_chars::BIGINT AS cost, n_chars
    FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)"""
DEALT = f"(SELECT *, (rank // {PLAN.samples_per_shard})::INTEGER AS shard_id FROM (SELECT *, row_number() OVER (ORDER BY md5(sample_id || ':{PLAN.seed}'), sample_id) - 1 AS rank FROM {LISTED}))"
SHARD_NAME = "'shard-' || lpad(shard_id::VARCHAR, 5, '0') || '.tar' AS shard"
TRACK_SQL = f"SELECT sample_id, class_id, checksum FROM {LISTED}"

QUERIES = {
    "walked_tree": (
        walked_tree,
        f"""SELECT count(*) AS total_files, sum(byte_size)::BIGINT AS total_bytes, 0::BIGINT AS symlinks, 0::BIGINT AS other_entries, 0::BIGINT AS hardlinked_files, 0::BIGINT AS unreadable_directories, 0::BIGINT AS unreadable_files,
            count(DISTINCT parent) + count(DISTINCT split_part(parent, '/', 2)) + 4 AS directories, count(*) + count(DISTINCT parent) + count(DISTINCT split_part(parent, '/', 2)) + 4 AS filesystem_objects FROM {LISTED}""",
    ),
    "walked_files": (
        walked_files, f"SELECT parent || '/' || doc_id || '.txt' AS path, parent, 3 AS depth, byte_size AS size, '.txt' AS extension FROM {LISTED}"
    ),
    "manifest_rows": (
        manifest_rows,
        f"SELECT sample_id, parent || '/' || doc_id || '.txt' AS relative_path, class_id, byte_size, 1 AS width, n_chars::INTEGER AS height, checksum, cost AS estimated_decode_cost FROM {LISTED}"
    ),
    "loose_payloads": (
        loose_payloads,
        f"SELECT sample_id, doc_id % 9 = 0 OR byte_size = 0 AS failed, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE byte_size END::BIGINT AS read_bytes, CASE WHEN doc_id % 9 <> 0 AND byte_size > 0 THEN checksum END AS read_checksum FROM {LISTED}"
    ),
    "tar_samples": (tar_samples, f"SELECT sample_id, class_id, {SHARD_NAME}, checksum FROM {DEALT}"),
    "shard_index_rows": (
        shard_index_rows,
        f"""SELECT shard_id, {SHARD_NAME}, count(*) AS samples, sum(byte_size)::BIGINT AS sample_bytes, sum(cost)::BIGINT AS estimated_work, ((sum(512 + (byte_size + 511) // 512 * 512 + 1024) + 1024 + 10239) // 10240 * 10240)::BIGINT AS tar_bytes,
            min(sample_id) AS least_id, count(*) AS ids FROM {DEALT} GROUP BY shard_id""",
    ),
    "parquet_rows": (_track("parquet"), TRACK_SQL),
    "arrow_rows": (_track("arrow"), TRACK_SQL),
    "parquet_positions": (
        parquet_positions,
        f"SELECT row_number() OVER (ORDER BY sample_id) - 1 AS position, sample_id, false AS failed, checksum FROM {LISTED} UNION ALL SELECT count(*), NULL, true, NULL FROM {LISTED}"
    ),
    "adapter_payloads": (
        adapter_payloads,
        f"SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS position, checksum AS read_checksum, byte_size = 0 AS failed FROM {LISTED}"
    ),
    "summaries_read": (
        summaries_read,
        "WITH e AS (SELECT event_type AS run_name, count(*) AS samples_measured, row_number() OVER (ORDER BY event_type) - 1 AS i FROM events GROUP BY event_type) SELECT i AS input_ordinal, run_name, samples_measured, 7::BIGINT AS seed FROM e UNION ALL SELECT (SELECT count(*) FROM e), run_name, samples_measured, 7 FROM e WHERE i = 0"
    ),
}
