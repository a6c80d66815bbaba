"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source and ranked; row ``r`` of
``n`` gets the fraction ``(2r + 1) / 2n``. Sorting all rows by that fraction
interleaves the sources in proportion, so any run of consecutive rows holds the
mixture of the whole, and equal cuts of the order are the shards.

No task holds a whole source or the whole order: both ranks are running counts
over hash buckets (``work.running_before``) of rows that differ, so a row repeated
often, or ids that lack, are not one task's either. Only ids, sizes, checksums and
hashes are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

SEED = 20240229


def interleave(
        docs: DataFrame, shards: int, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, text_crc32, position, shard, slot.

    ``size`` is the UTF-8 bytes of the text plus 16. Row counts of shards differ by
    one at most; ``slot`` counts from 0 in each shard, in the interleaved order.

    Nulls: a null source is a source of its own, ordered last; a null text has size
    16 and checksum 0; null ids count as empty ones. The shuffle goes by id and text; rows equal in both
    and in source are interchangeable, and lie side by side. An empty table gives no rows. Other columns are not read.
    """
    raw = F.encode(F.col(text_col), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (
            F.coalesce(F.octet_length(text_col), F.lit(0)) + 16
        ).cast("long").alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.md5(
            F.concat(
                F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(F.coalesce(raw, F.lit("").cast("binary")))
            ).cast("binary")
        ).alias("_mix"),
    ).groupBy("doc_id", "source", "size", "text_crc32", "_mix").agg(F.count("*").alias("copies"))
    buckets = work.bucket_count(docs)
    rows = work.cut(rows.withColumn("_bucket", F.floor(F.conv(F.substring("_mix", 1, 8), 16, 10).cast("double") * buckets / 2**32).cast("long")))
    order = [F.col("_mix"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    ranked = work.cut(work.running_before(rows, ["source"], "_bucket", order, F.col("copies"), "_rank", "_rows").drop("_bucket"))
    ranked = work.each_copy(ranked).withColumn("_rank", F.col("_rank") + F.col("at")).drop("at")
    ranked = ranked.withColumn("_share", (2 * F.col("_rank") + 1).cast("double") / (2 * F.col("_rows")).cast("double"))
    ranked = work.cut(ranked.withColumn("_bucket", F.floor(F.col("_share") * buckets).cast("long")))
    placed = work.running_before(ranked, [], "_bucket", [F.col("_share"), F.col("source").asc_nulls_last(), *order], F.lit(1), "position", "_total")
    placed = placed.withColumn("shard", F.expr(f"position * {shards} div _total").cast("int"))
    return placed.select(
        "doc_id", "source", "size", "text_crc32", "position", "shard",
        F.expr(f"position - (shard * _total + {shards - 1}) div {shards}").cast("long").alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = SEED) -> DataFrame:
    """The query's columns for ``interleave``; the law that holds is ``rows``."""
    found = interleave(docs, shards, seed)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
