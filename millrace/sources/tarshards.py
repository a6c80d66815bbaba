"""Tar shards: a source that streams them, a sink that writes them byte for byte alike, and their index."""

from __future__ import annotations

import io
import json
import os
import random
import sys
import tarfile
import textwrap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import ManifestError
from ..operators.shards import ShardPlan

SCHEMA = "sample_id string, payload binary, class_id int, shard string"
ARROW = pa.schema([("sample_id", pa.string()), ("payload", pa.binary()), ("class_id", pa.int32()), ("shard", pa.string())])
INDEX_VERSION = "1.0"
INDEX_NAME = "shard_index.json"
BATCH_BYTES = 8 << 20


class _Shard(InputPartition):
    def __init__(self, path: str):
        self.path = path
        super().__init__(path)


class TarShardReader(DataSourceReader):
    """One task a shard: the assignment to readers prunes partitions, so a reader opens its own shards only.

    With a seed the shards are dealt in a seeded order, the same in every epoch.
    """

    def __init__(self, directory: str, reader: int, readers: int, seed: int | None, skip_broken: bool):
        self.directory, self.reader, self.readers, self.seed, self.skip_broken = directory, reader, readers, seed, skip_broken

    def partitions(self) -> list[InputPartition]:
        names = sorted(n for n in os.listdir(self.directory) if n.endswith(".tar"))
        if self.seed is not None:
            random.Random(self.seed).shuffle(names)
        return [_Shard(os.path.join(self.directory, n)) for n in names[self.reader :: self.readers]]

    def read(self, partition: _Shard | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a reader without shards
            return
        held, size, shard = [], 0, os.path.basename(partition.path)
        try:
            for sample_id, payload, class_id in samples_of(partition.path):
                held.append((sample_id, payload, class_id, shard))
                size += len(payload)
                if size >= BATCH_BYTES:
                    yield self._batch(held)
                    held, size = [], 0
        except (tarfile.TarError, OSError, ValueError) as e:
            if not self.skip_broken:
                raise
            print(f"warning: the rest of {partition.path} cannot be read: {e}", file=sys.stderr)
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def samples_of(path: str) -> Iterator[tuple[str, bytes, int]]:
    """Samples of a tar file, read forward only: members share a stem, one of them the class. Incomplete samples are passed over."""
    stem, payload, label = None, None, None
    with tarfile.open(path, "r|") as archive:
        for member in archive:
            if not member.isfile():
                continue
            name, _, suffix = member.name.rpartition(".")
            if name != stem:
                stem, payload, label = name, None, None
            data = archive.extractfile(member).read()
            if suffix == "cls":
                label = int(data)
            else:
                payload = data
            if payload is not None and label is not None:
                yield stem, payload, label
                stem, payload, label = None, None, None


class TarShards(DataSource):
    """Options: path (a folder of shards); reader and readers (default 0 of 1); seed (order of shards; default by name); broken (``skip`` or ``fail``)."""

    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        readers = int(self.options.get("readers", "1"))
        if readers < 1:
            raise ValueError("there must be at least one reader")
        seed, broken = self.options.get("seed"), self.options.get("broken", "skip")
        if broken not in ("skip", "fail"):
            raise ValueError(f"broken must be skip or fail, not {broken!r}")
        return TarShardReader(
            self.options["path"], int(self.options.get("reader", "0")), readers, None if seed is None else int(seed), broken == "skip"
        )


def read_shards(spark: SparkSession, directory: str, reader: int = 0, readers: int = 1, seed: int | None = None, broken: str = "skip") -> DataFrame:
    """Samples of a reader's shards. A shard that breaks off gives what comes before the fault and a warning, or fails the job."""
    spark.dataSource.register(TarShards)
    found = spark.read.format("tarshards").option("path", str(directory)).option("reader", str(reader)).option("readers", str(readers)).option("broken", broken)
    return (found if seed is None else found.option("seed", str(seed))).load()


def _add(archive: tarfile.TarFile, name: str, data: bytes) -> None:
    info = tarfile.TarInfo(name)
    info.size, info.mtime, info.mode = len(data), 0, 0o644
    archive.addfile(info, io.BytesIO(data))


def write_shards(members: DataFrame, directory: str, plan: ShardPlan) -> DataFrame:
    """Write planned ``members`` (sample_id, payload, class_id, extension, shard_id, position) as tar files.

    A shard is one task's rows, in the plan's order, streamed into one file that is
    renamed when it is whole: a task that runs again writes the same bytes. The
    folder must be one that all executors share. A task writes its shard's entry of
    the index beside the shard, so sample ids never pass through the driver's
    results; entries are then copied into the index one at a time. Returns the
    index rows without their sample ids.
    """
    os.makedirs(directory, exist_ok=True)
    target = os.path.abspath(directory)
    columns = members.select("shard_id", "position", "sample_id", "payload", "class_id", "extension", "byte_size", "estimated_decode_cost")
    rows = columns.repartition("shard_id").sortWithinPartitions("shard_id", "position")
    shape = pa.schema(
        [
            ("shard_id", pa.int32()), ("shard", pa.string()), ("samples", pa.int64()), ("bytes", pa.int64()), ("sample_bytes", pa.int64()),
            ("estimated_work", pa.int64())
        ]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, archive, temporary, ids, size, cost = None, None, "", [], 0, 0

        def close() -> pa.RecordBatch:
            archive.close()
            name = f"shard-{now:05d}.tar"
            os.replace(temporary, os.path.join(target, name))
            entry = {
                "shard": name, "samples": len(ids), "bytes": os.path.getsize(os.path.join(target, name)), "sample_bytes": size, "estimated_work": cost
            }
            with open(temporary, "w") as f:
                f.write(json.dumps(entry | {"sample_ids": ids}, indent=2, sort_keys=True))
            os.replace(temporary, _entry_path(target, now))
            return pa.RecordBatch.from_pylist([entry | {"shard_id": now}], schema=shape)

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard_id"] != now:
                    if archive:
                        yield close()
                    now, ids, size, cost = r["shard_id"], [], 0, 0
                    temporary = os.path.join(target, f".shard-{now:05d}.{os.getpid()}.part")
                    archive = tarfile.open(temporary, "w")  # noqa: SIM115
                _add(archive, f"{r['sample_id']}.{(r['extension'] or 'bin').lstrip('.')}", bytes(r["payload"]))
                _add(archive, f"{r['sample_id']}.cls", str(r["class_id"]).encode())
                ids.append(r["sample_id"])
                size += r["byte_size"]
                cost += r["estimated_decode_cost"]
        if archive:
            yield close()

    schema = "shard_id int, shard string, samples long, bytes long, sample_bytes long, estimated_work long"
    found = rows.mapInArrow(write, schema).orderBy("shard_id").collect()  # one row per shard, of six numbers
    write_index(
        os.path.join(target, INDEX_NAME), [_entry_path(target, r["shard_id"]) for r in found], sum(r["samples"] for r in found),
        sum(r["bytes"] for r in found), plan
    )
    return members.sparkSession.createDataFrame(found, schema)


def _entry_path(directory: str, shard: int) -> str:
    return os.path.join(directory, f".shard-{shard:05d}.json")


def write_index(path: str, entries: list[str], samples: int, num_bytes: int, plan: ShardPlan) -> None:
    """The index as sorted, indented JSON, from files with one shard's entry each, which are removed."""
    about = {
        "samples_per_shard": plan.samples_per_shard, "shuffle_before_sharding": plan.shuffle, "seed": plan.seed, "balance_by": plan.balance_by,
        "imbalance_factor": plan.imbalance_factor
    }
    head, tail = json.dumps(
        {"plan": about, "schema_version": INDEX_VERSION, "shards": [], "total_bytes": num_bytes, "total_samples": samples}, indent=2, sort_keys=True
    ).split("[]")
    with open(path, "w") as f:
        f.write(head + "[")
        for i, one in enumerate(entries):
            with open(one) as e:
                f.write(("," if i else "") + "\n" + textwrap.indent(e.read(), "    "))
        f.write(("\n  ]" if entries else "]") + tail + "\n")
    for one in entries:
        os.remove(one)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows (shard_id, shard, samples, bytes, sample_bytes, estimated_work, sample_ids) of a checked index."""
    try:
        with open(path) as f:
            found = json.load(f)
    except FileNotFoundError:
        raise ManifestError(f"no shard index at {path}") from None
    except ValueError:
        raise ManifestError(f"{path}: not JSON") from None
    if found.get("schema_version") != INDEX_VERSION:
        raise ManifestError(f"{path}: version {found.get('schema_version')!r}, not {INDEX_VERSION!r}")
    if absent := [k for k in ("shards", "total_samples", "plan") if k not in found]:
        raise ManifestError(f"{path}: lacks {absent}")
    if not found["shards"]:
        raise ManifestError(f"{path}: lists no shards")
    schema = "shard string, samples long, bytes long, sample_bytes long, estimated_work long, sample_ids array<string>"
    rows = spark.read.schema(f"shards array<struct<{', '.join(x.replace(' ', ':', 1) for x in schema.split(', '))}>>").json(path, multiLine=True)
    return rows.select(F.posexplode("shards").alias("shard_id", "s")).select("shard_id", "s.*").withColumn("tar_bytes", F.col("bytes"))
