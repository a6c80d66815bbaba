"""Record formats: samples converted to Parquet, Arrow or HDF5, read back by position, and adapters by name.

Readers open files in the task that reads, so each process has its own handle.
"""

from __future__ import annotations

import contextlib
import glob
import importlib
import importlib.util
import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, StagingError

GROUP_ROWS = 1000
ROW = pa.schema([("sample_id", pa.string()), ("class_id", pa.int32()), ("payload", pa.large_binary())])
FORMATS = ("parquet", "arrow", "hdf5")


def _groups(batches: Iterator[pa.RecordBatch], group_rows: int) -> Iterator[pa.Table]:
    """Tables of ``group_rows`` rows, the last one shorter: what a task holds at a time."""
    held, rows = [], 0
    for batch in batches:
        batch = batch.cast(ROW)
        while len(batch):
            part = batch.slice(0, group_rows - rows)
            held.append(part)
            rows, batch = rows + len(part), batch.slice(len(part))
            if rows == group_rows:
                yield pa.Table.from_batches(held, ROW).combine_chunks()
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held, ROW).combine_chunks()


@contextlib.contextmanager
def _writer(to: str, path: str, group_rows: int, compression: str) -> Iterator[Callable[[pa.Table], None]]:
    """A function that appends a group of rows to a file."""
    if to == "parquet":
        with pq.ParquetWriter(path, ROW, compression=compression.upper() if compression != "none" else "NONE") as w:
            yield lambda group: w.write_table(group, row_group_size=group_rows)
    elif to == "arrow":
        with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, ROW) as w:
            yield lambda group: w.write_table(group, max_chunksize=group_rows)
    else:
        import h5py
        import numpy as np

        kinds = {"payload": h5py.vlen_dtype(np.uint8), "class_id": np.int32, "sample_id": h5py.string_dtype()}
        with h5py.File(path, "w") as h:
            data = {name: h.create_dataset(name, (0,), maxshape=(None,), dtype=kind, chunks=(group_rows,)) for name, kind in kinds.items()}

            def append(group: pa.Table) -> None:
                start = data["class_id"].shape[0]
                for x in data.values():
                    x.resize((start + len(group),))
                data["class_id"][start:] = group["class_id"].to_numpy()
                data["sample_id"][start:] = group["sample_id"].to_pylist()
                for i, x in enumerate(group["payload"]):
                    data["payload"][start + i] = np.frombuffer(x.as_py(), np.uint8)

            yield append


def convert(samples: DataFrame, to: str, directory: str, group_rows: int = GROUP_ROWS, compression: str = "none", overwrite: bool = False) -> dict:
    """Write samples (sample_id, class_id, payload) in id order, ``group_rows`` rows a group, and a record of it.

    Rows are range-partitioned by id; each task writes one file whose name rises with
    its ids, and holds one group of rows at a time.
    """
    if to not in FORMATS:
        raise ConfigError(f"format must be one of {FORMATS}, not {to!r}")
    if to == "hdf5" and importlib.util.find_spec("h5py") is None:
        raise ConfigError("HDF5 needs h5py, which is not installed")
    if os.path.isdir(directory) and os.listdir(directory) and not overwrite:
        raise ConfigError(f"{directory} is not empty")
    os.makedirs(directory, exist_ok=True)
    for old in glob.glob(os.path.join(directory, "part-*")):
        os.remove(old)
    target = os.path.abspath(directory)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId()
        path = os.path.join(target, f"part-{n:05d}.{ {'parquet': 'parquet', 'arrow': 'arrow', 'hdf5': 'h5'}[to]}")
        rows = groups = 0
        with contextlib.ExitStack() as still_open:
            put = None
            for group in _groups(batches, group_rows):
                put = put or still_open.enter_context(_writer(to, path, group_rows, compression))
                put(group)
                rows, groups = rows + len(group), groups + 1
        if rows:
            yield pa.RecordBatch.from_pydict(
                {
                    "rows": pa.array([rows], pa.int64()), "bytes": pa.array([os.path.getsize(path)], pa.int64()),
                    "groups": pa.array([groups], pa.int32())
                }
            )

    ordered = samples.select(
        "sample_id", F.col("class_id").cast("int").alias("class_id"), "payload"
    ).repartitionByRange("sample_id").sortWithinPartitions("sample_id")
    done = ordered.mapInArrow(write, "rows long, bytes long, groups int").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("groups"), F.lit(0)).alias("groups"), F.count("*").alias("files")
    ).first()
    record = {
        "format": to, "rows": done["rows"], "bytes": done["bytes"], "row_groups": done["groups"], "files": done["files"], "group_rows": group_rows,
        "compression": compression
    }
    with open(os.path.join(directory, "conversion.json"), "w") as f:
        f.write(json.dumps(record, indent=2, sort_keys=True) + "\n")
    return record


def read_track(spark: SparkSession, directory: str, fmt: str, expected: int | None = None) -> DataFrame:
    """sample_id, class_id, payload; with ``expected`` the number of rows must be that."""
    if fmt == "parquet":
        found = spark.read.parquet(*sorted(glob.glob(os.path.join(directory, "part-*.parquet"))))
    elif fmt == "arrow":
        names = spark.createDataFrame([(p,) for p in sorted(glob.glob(os.path.join(os.path.abspath(directory), "part-*.arrow")))], "path string")

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    with pa.memory_map(path) as f:
                        reader = pa.ipc.open_file(f)
                        for i in range(reader.num_record_batches):
                            b = reader.get_batch(i)
                            yield pa.RecordBatch.from_arrays(
                                [b.column(0), b.column(1), b.column(2).cast(pa.binary())], names=["sample_id", "class_id", "payload"]
                            )

        found = names.repartition(max(1, names.count()), "path").mapInArrow(load, "sample_id string, class_id int, payload binary")
    elif fmt == "hdf5" and importlib.util.find_spec("h5py") is not None:
        names = spark.createDataFrame([(p,) for p in sorted(glob.glob(os.path.join(os.path.abspath(directory), "part-*.h5")))], "path string")

        def load_hdf5(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import h5py

            for batch in batches:
                for path in batch.column(0).to_pylist():
                    with h5py.File(path, "r", locking=False) as h:
                        for i in range(0, len(h["class_id"]), GROUP_ROWS):
                            part = slice(i, i + GROUP_ROWS)
                            yield pa.RecordBatch.from_pydict(
                                {
                                    "sample_id": pa.array([x.decode() for x in h["sample_id"][part]]),
                                    "class_id": pa.array(h["class_id"][part], pa.int32()),
                                    "payload": pa.array([x.tobytes() for x in h["payload"][part]], pa.binary())
                                }
                            )

        found = names.repartition(max(1, names.count()), "path").mapInArrow(load_hdf5, "sample_id string, class_id int, payload binary")
    else:
        raise ConfigError(f"cannot read {fmt!r} here")
    if expected is not None and (n := found.count()) != expected:
        raise StagingError(f"{directory} has {n} rows, not {expected}")
    return found


def group_bounds(spark: SparkSession, directory: str) -> DataFrame:
    """(file, row_group, start, end): the positions that each row group of a Parquet artifact holds, from the files' footers.

    Files follow one another by name, as they were written in id order. One row per group.
    """
    found, start = [], 0
    for path in sorted(glob.glob(os.path.join(os.path.abspath(directory), "part-*.parquet"))):
        about = pq.read_metadata(path)
        for g in range(about.num_row_groups):
            n = about.row_group(g).num_rows
            found.append((path, g, start, start + n))
            start += n
    return spark.createDataFrame(found, "file string, row_group int, start long, end long")


def read_positions(positions: DataFrame, directory: str, expected: int | None = None) -> DataFrame:
    """(position, sample_id, class_id, payload, failed) for rows with column ``position``, by row group and offset.

    Positions are dealt out by group, and a group is read once for all of its
    positions; a position outside the artifact is ``failed``. With ``expected`` the
    artifact must hold that many rows.
    """
    spark = positions.sparkSession
    bounds = [tuple(r) for r in group_bounds(spark, directory).collect()]  # one row per group
    total = bounds[-1][3] if bounds else 0
    if expected is not None and total != expected:
        raise StagingError(f"{directory} has {total} rows, not {expected}")
    starts = [b[2] for b in bounds]
    table = spark.createDataFrame([(i, b[2], b[3]) for i, b in enumerate(bounds)], "_group int, start long, end long")
    asked = positions.select(F.col("position").cast("long").alias("position"))
    # Groups have one length but for the last of a file: a position's group is found by its multiple of the shortest.
    width = max(1, min((b[3] - b[2] for b in bounds), default=1))
    cells = table.withColumn("_cell", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}"))))
    inside = (F.expr(f"position div {width}") == F.col("_cell")) & (F.col("position") >= F.col("start")) & (F.col("position") < F.col("end"))
    placed = asked.join(cells, inside, "left").select("position", "_group")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema(
            [("position", pa.int64()), ("sample_id", pa.string()), ("class_id", pa.int32()), ("payload", pa.binary()), ("failed", pa.bool_())]
        )
        now, rows = None, None
        for batch in batches:
            at, group = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for g in dict.fromkeys(group):
                mine = [p for p, x in zip(at, group, strict=True) if x == g]
                if g is None:
                    none = pa.nulls(len(mine))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(mine, pa.int64()), none.cast(pa.string()), none.cast(pa.int32()), none.cast(pa.binary()),
                            pa.array([True] * len(mine))
                        ],
                        schema=shape
                    )
                    continue
                if g != now:
                    rows, now = pq.ParquetFile(bounds[g][0]).read_row_group(bounds[g][1], columns=["sample_id", "class_id", "payload"]), g
                got = rows.take([p - starts[g] for p in mine]).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mine, pa.int64()),
                        *[
                            got[c].cast(t).combine_chunks()
                            for c, t in (("sample_id", pa.string()), ("class_id", pa.int32()), ("payload", pa.binary()))
                        ],
                        pa.array([False] * len(mine))
                    ],
                    schema=shape
                )

    dealt = placed.repartition(F.col("_group")).sortWithinPartitions("_group", "position")
    return dealt.mapInArrow(read, "position long, sample_id string, class_id int, payload binary, failed boolean")


def by_position(track: DataFrame, samples: DataFrame) -> DataFrame:
    """Manifest rows with the payload of the artifact's row of the same id; ``failed`` where there is none."""
    return samples.join(track.select("sample_id", "payload"), "sample_id", "left").withColumn("failed", F.col("payload").isNull())


class Adapter:
    """What a user's adapter offers: ``length``, ``read_payload(index)``, and numbers about itself."""

    def __init__(self, **options: str):
        self.options = options

    def length(self) -> int:
        raise NotImplementedError

    def read_payload(self, index: int) -> bytes:
        raise NotImplementedError

    def describe(self) -> dict[str, float]:
        return {}


def load_adapter(spec: str) -> type:
    """The class that ``module:Class`` names."""
    module, colon, name = spec.partition(":")
    if not colon or not module or not name:
        raise ConfigError(f"an adapter is named module:Class, not {spec!r}")
    try:
        found = getattr(importlib.import_module(module), name, None)
    except ImportError as e:
        raise ConfigError(f"cannot import {module}: {e}") from None
    if found is None or not hasattr(found, "read_payload"):
        raise ConfigError(f"{spec} is not an adapter")
    return found


def read_adapter(samples: DataFrame, spec: str, **options: str) -> DataFrame:
    """``samples`` (with column position) and their payloads; an adapter is opened once a task, when it first reads."""
    kind = load_adapter(spec)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adapter = None
        for batch in batches:
            adapter = adapter or kind(**options)
            out = []
            for i in batch.column(1).to_pylist():
                try:
                    out.append(adapter.read_payload(i))
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_pydict({"sample_id": batch.column(0), "payload": pa.array(out, pa.binary())})

    got = samples.select("sample_id", F.col("position").cast("long").alias("position")).mapInArrow(read, "sample_id string, payload binary")
    return samples.join(got, "sample_id").withColumn("failed", F.coalesce(F.octet_length("payload"), F.lit(0)) == 0)
