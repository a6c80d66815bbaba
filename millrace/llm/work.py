"""Shared by the operators: written intermediate tables, bucket counts, Arrow batches."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that split words in every contract: space and 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: At least so many buckets for ranks and running totals, however few the rows.
MIN_BUCKETS = 1024
#: Rows that one bucket of a rank or running total is planned to hold.
BUCKET_ROWS = 100_000
#: Rows that one row unfolds into at a time, rows that a partition of unfolded ones is planned to hold, and the least and most partitions.
RUN, PART, MIN_PARTS, MOST_PARTS = 4096, 500_000, 12, 100_000
#: Bits of a filter for each key, and its least and greatest size: beyond that it passes more rows, none less.
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Cuts the lineage, survives lost executors, and fixes the rows where a plan
    reads them more than once. The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/millrace-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    hdfs_path = jvm.org.apache.hadoop.fs.Path(path)
    hdfs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hdfs_path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(df: DataFrame) -> int:
    """Buckets for ranks over ``df``: in proportion to its rows, ``MIN_BUCKETS`` at least."""
    return max(MIN_BUCKETS, -(-df.count() // BUCKET_ROWS))


def running_before(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, name: str, whole: str = "_whole") -> DataFrame:
    """``df`` with column ``name``: the sum of ``value`` over the rows before, in ``group`` by ``bucket`` then ``order``.

    Column ``whole`` gets the sum over all the group.

    Rows are totalled by (group, bucket) first, so a group of any size is dealt
    out by bucket and no task holds more than one bucket's rows at a time.
    ``bucket`` must rise with ``order``. Read twice: pass a written table.
    """
    keys = [*group, bucket]
    part = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    starts = totals.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], (F.sum("_total").over(part.orderBy(bucket)) - F.col("_total")).alias("_start"),
        F.sum("_total").over(part).cast("long").alias(whole)
    )
    same = [df[c].eqNullSafe(starts[f"_k{i}"]) for i, c in enumerate(keys)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(starts, on).withColumn(
        name, (F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")
    ).drop("_start", *[f"_k{i}" for i in range(len(keys))])


def text_slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches with the texts of column ``text`` as bytes (null: empty), of about ``most`` bytes."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        text = text.cast(pa.large_binary()) if not pa.types.is_large_binary(text.type) else text
        start, held = 0, 0
        for i in range(len(text)):
            held += len(text[i].as_buffer() or b"") if text[i].is_valid else 0
            if held >= most or i == len(text) - 1:
                yield batch.slice(start, i + 1 - start), [x or b"" for x in text.slice(start, i + 1 - start).to_pylist()]
                start, held = i + 1, 0


def unfolded(df: DataFrame, count: str) -> DataFrame:
    """Each row as often as column ``count`` says, with ``at`` counting from 0: first in runs, dealt out, so that no task unfolds a whole large one."""
    rows = df.filter(f"{count} > 0")
    total = rows.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    # By what the rows unfold into: adaptive execution would go by the few bytes that they are before.
    parts = max(df.sparkSession.sparkContext.defaultParallelism, min(total // PART, MOST_PARTS))
    runs = rows.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {RUN}"))))
    runs = runs.repartition(parts, F.xxhash64(*[c for c, t in runs.dtypes if t in ("string", "int", "bigint")]))
    return runs.withColumn("at", F.explode(F.sequence(F.col("_run") * RUN, F.least((F.col("_run") + 1) * RUN, F.col(count)) - 1))).drop("_run")


def each_copy(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``copies``, a written table, as so many rows each, with ``at``; only rows with many copies are dealt out anew."""
    few = rows.filter(f"copies <= {RUN}").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return few.unionByName(unfolded(rows.filter(f"copies > {RUN}"), "copies")).drop("copies")


def passes(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test for values of ``key``: true for all that ``keys`` has (a written table) and few others.

    Bits are sized by the number of keys, within bounds, and reach the plan as a
    scalar subquery of one row.
    """
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_BITS * keys.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    some = keys.select(place(F.col(key)).alias("b")).distinct().groupBy(F.expr("cast(b div 64 as int)").alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits")
    )
    every = keys.sparkSession.range(size // 64).select(F.col("id").cast("int").alias("i"))
    full = every.join(some, "i", "left").select(F.struct("i", F.coalesce("bits", F.lit(0)).cast("long").alias("bits")).alias("s"))
    bits = cut(full.agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["bits"]).alias("bits")))
    return lambda c: F.getbit(F.element_at(bits.scalar(), (F.floor(place(c) / 64) + 1).cast("int")), (place(c) % 64).cast("int")) == 1


def labelled_sample(docs: DataFrame, known: DataFrame, rows: int, most_bytes: int) -> DataFrame:
    """The columns of ``known`` (doc_id and labels) with ``text``: at most ``rows`` rows of at most ``most_bytes`` bytes together.

    Ids are taken by hash; then rows of ``docs`` by hash of id and text, so that an id
    that many rows share cannot exceed the bound. A row repeated with id, text and
    labels is taken once; a text that would exceed the bytes left is passed over.
    Only ids, hashes and sizes of at most ``rows`` rows reach the driver.
    """
    labels = [c for c in known.columns if c != "doc_id"]
    chosen = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", *labels).limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows
    sizes = met.select("doc_id", F.xxhash64("text").alias("_hash"), F.octet_length("text").alias("_bytes")).distinct()
    left, picked = most_bytes, []
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "_hash", "_bytes").limit(rows).collect():
        if r["_bytes"] <= left:
            left -= r["_bytes"]
            picked.append((r["doc_id"], r["_hash"]))
    wanted = docs.sparkSession.createDataFrame(picked, "doc_id long, _hash long")
    found = texts.withColumn("_hash", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "_hash"]).dropDuplicates(["doc_id", "_hash"])
    return found.drop("_hash").join(F.broadcast(chosen), "doc_id")


def process_cache() -> dict:
    """A dict that lives as long as this Python process: modules are pickled by value, so their globals last one task."""
    return sys.__dict__.setdefault("_millrace_cache", {})


def released(found: Iterator[pa.RecordBatch], keep: bool = False) -> Iterator[pa.RecordBatch]:
    """``found``, after which the worker gives back what the task has freed.

    Workers outlive their tasks, more of them than run at a time, and idle ones count
    as the executor's memory. Without ``keep`` the worker also lets go of what tasks
    of other operators have kept in ``process_cache``.
    """
    if not keep:
        process_cache().clear()
    try:
        yield from found
    finally:
        del found
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # only glibc has it
            pass


def in_python(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, keep: bool = False) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with ``released`` tasks."""
    return df.mapInArrow(lambda it: released(run(it), keep), schema)
