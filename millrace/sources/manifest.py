"""Sample manifests: one JSON object a line, eight fields, sorted by id, ids unique."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ManifestError
from ..functions.scalars import checksum

FIELDS = {
    "sample_id": "string", "relative_path": "string", "class_id": "int", "byte_size": "long", "width": "int", "height": "int", "checksum": "string",
    "estimated_decode_cost": "long"
}
SCHEMA = ", ".join(f"{k} {t}" for k, t in FIELDS.items())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's rows; blank lines are skipped, anything else that is wrong is an error that names a line.

    Lines are parsed and checked in parallel. Only if a check fails is the file read
    again in order, to find the first bad line's number.
    """
    if not os.path.exists(path) and "://" not in path:
        raise ManifestError(f"no manifest at {path}")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    keys = F.json_object_keys("value")
    wanted = F.array(*[F.lit(k) for k in FIELDS])
    parsed = lines.select(F.from_json("value", SCHEMA).alias("r"), keys.alias("k"))
    untyped = F.exists(F.array(*[F.col(f"r.{k}").isNull() for k in FIELDS]), lambda x: x)  # a value of another type is read as null
    wrong = parsed.filter(
        F.col("k").isNull() | (F.size(F.array_except("k", wanted)) > 0) | (F.size(F.array_except(wanted, F.col("k"))) > 0) | untyped
    )
    rows = parsed.select("r.*")
    repeated = rows.groupBy("sample_id").count().filter("count > 1")
    if wrong.take(1) or repeated.take(1):
        _explain(path)
    return rows


def _explain(path: str) -> None:
    seen: set[str] = set()
    with open(path) as f:
        for n, line in enumerate(f, 1):
            if not line.strip():
                continue
            try:
                found = json.loads(line)
            except ValueError:
                raise ManifestError(f"{path}, line {n}: not JSON") from None
            if not isinstance(found, dict):
                raise ManifestError(f"{path}, line {n}: not an object")
            if absent := [k for k in FIELDS if k not in found]:
                raise ManifestError(f"{path}, line {n}: lacks {absent}")
            if other := sorted(set(found) - set(FIELDS)):
                raise ManifestError(f"{path}, line {n}: unknown {other}")
            if wrong := [k for k, t in FIELDS.items() if not isinstance(found[k], str if t == "string" else int) or isinstance(found[k], bool)]:
                raise ManifestError(f"{path}, line {n}: {wrong} of another type than {[FIELDS[k] for k in wrong]}")
            if found["sample_id"] in seen:
                raise ManifestError(f"{path}, line {n}: {found['sample_id']} occurs twice")
            seen.add(found["sample_id"])
    raise ManifestError(f"{path}: a number is out of range")


def write_manifest(samples: DataFrame, path: str) -> str:
    """Write sorted by id, with sorted keys: the same bytes whatever the order of the rows.

    One file of the same bytes has one writer: rows pass through the driver, partition
    by partition, already sorted, and are not held there.
    """
    if samples.groupBy("sample_id").count().filter("count > 1").take(1):
        raise ManifestError("a sample_id occurs twice")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        for row in samples.select(*FIELDS).orderBy("sample_id").toLocalIterator(prefetchPartitions=True):
            f.write(json.dumps(row.asDict(), sort_keys=True) + "\n")
    return path


def manifest_hash(path: str) -> str:
    """The first 16 hex digits of the file's SHA-256."""
    found = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            found.update(block)
    return found.hexdigest()[:16]


def content_hash(samples: DataFrame) -> DataFrame:
    """One row: a hash of the rows whatever their order, computed where they are."""
    columns = [F.col(c) for c in FIELDS]
    return samples.agg(
        F.lower(F.hex(F.bit_xor(F.xxhash64(*columns)))).alias("content_hash"), F.count("*").alias("samples"), F.sum("byte_size").alias("total_bytes")
    )


def payloads(samples: DataFrame, root: str, verify: bool = False) -> DataFrame:
    """``samples`` and their files' bytes under ``root``; an absent or empty file is a failed sample with size 0.

    With ``verify`` a file whose checksum is not the manifest's has failed, too.
    """
    spark = samples.sparkSession
    base = os.path.abspath(root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    found = found.select(F.regexp_replace("path", "^file:/+", "/").alias("_full"), F.col("content").alias("payload"))
    joined = samples.withColumn("_full", F.concat(F.lit(base + "/"), "relative_path")).join(found, "_full", "left").drop("_full")
    failed = F.col("payload").isNull() | (F.octet_length("payload") == 0)
    if verify:
        failed = failed | ~checksum(F.col("payload")).eqNullSafe(F.col("checksum"))
    return joined.withColumn("failed", failed).withColumn("read_bytes", F.when(failed, 0).otherwise(F.octet_length("payload")).cast("long"))


def struct() -> T.StructType:
    return T.StructType.fromDDL(SCHEMA)
