"""Exact deduplication by content hash, with a comparison of bytes.

Texts are normalised (A to Z lower-cased), hashed to 128 bits and grouped by hash.
Every member of a group of two or more is then compared, byte by byte, with the
group's representative; a text that only shares the hash gets a class of its own.

Hashes are pre-aggregated before the shuffle. Members of a group are salted, one salt
for each ``SALT_ROWS`` of them, and the representative's text is sent once a salt, so
no task compares a whole hot group. Joins that carry a hash as key end in a written
table before anything is grouped, so adaptive execution can split them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import work

#: Members of a group that one task is planned to compare with their representative.
SALT_ROWS = 1000
#: Not names that tables have: two hashes of a row, and the id, the hashes and the number of copies of a row that stays.
ONE, TWO = "_millrace_row_1", "_millrace_row_2"
STAYS = [f"_millrace_stays_{x}" for x in ("id", "1", "2", "copies")]


def _hashed(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for part, texts in work.text_slices(batches):
        plain = [x.lower() for x in texts]
        both = [divmod(xxhash.xxh3_128_intdigest(x), 1 << 64) for x in plain]
        columns = {c: part.column(i) for i, c in enumerate(part.schema.names)}
        columns |= {"h1": pa.array([a - (1 << 63) for a, _ in both], pa.int64()), "h2": pa.array([b - (1 << 63) for _, b in both], pa.int64())}
        columns |= {"plain": pa.array(plain, pa.binary())} if "plain" in names else {}
        columns["text_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in plain], pa.string())
        yield pa.RecordBatch.from_pydict({k: columns[k] for k in names})


def hashed(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, the 128-bit hash as two longs, SHA-256, and on demand the normalised bytes; with the hashes of the row where ``docs`` has them."""
    rows = [c for c in (ONE, TWO) if c in docs.columns and not with_text]
    schema = "doc_id long, " + "".join(f"{c} long, " for c in rows) + "h1 long, h2 long, " + "plain binary, " * with_text + "text_sha256 string"
    names = tuple(x.split()[0] for x in schema.split(", "))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rows)
    return work.in_python(texts, lambda it: _hashed(it, names), schema)


def _classed(docs: DataFrame, best: Column) -> DataFrame:
    """``hashed(docs)`` with column ``other``, a written table: rows of equal texts share (h1, h2, other).

    ``other`` is empty for the texts that equal the representative of their hash,
    and a digest of the text for those that only share its hash.
    """
    base = work.cut(hashed(docs))
    several = base.groupBy("h1", "h2").agg(F.count("*").alias("n"), best.alias("rep_id")).filter("n > 1")
    several = work.cut(several.select("h1", "h2", "rep_id", F.ceil(F.col("n") / SALT_ROWS).alias("salts")))
    members = hashed(docs, with_text=True).join(several, ["h1", "h2"])
    members = work.cut(members.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("salts"))))
    reps = work.cut(members.filter("doc_id <=> rep_id").select("h1", "h2", "salts", F.col("plain").alias("rep_plain")).dropDuplicates(["h1", "h2"]))
    reps = reps.select("h1", "h2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "rep_plain")
    # The table is empty but for a true collision.
    differing = work.cut(members.join(reps, ["h1", "h2", "salt"]).filter("plain <> rep_plain").select("h1", "h2", "text_sha256"))
    differing = work.cut(differing.distinct().withColumn("other", F.col("text_sha256")))
    return work.cut(base.join(differing, ["h1", "h2", "text_sha256"], "left").withColumn("other", F.coalesce("other", F.lit(""))))


def classes(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The largest (or smallest) doc_id of equal texts stays. Nulls: a null text counts as empty; a
    null doc_id is passed over, and is kept only where all of a group are null. Rows that repeat one doc_id with one text are each counted in
    group_size and each reported as kept; ``deduplicate`` keeps one of them. An
    empty table gives no rows. Other columns are not read.
    """
    best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    marked = _classed(docs, best)
    final = work.cut(marked.groupBy("h1", "h2", "other").agg(F.count("*").alias("group_size"), best.alias("keep_id")).filter("group_size > 1"))
    found = marked.join(final, ["h1", "h2", "other"], "left")
    staying = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", staying.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(staying).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of which exactly one of each class of equal texts stays: the smallest doc_id.

    Of rows with one doc_id and equal texts the one with the least hash over its
    columns stays, of rows equal in all columns any one. Rows without a doc_id come
    last: one of them stays only where no row of their class has a doc_id. A null
    text is an empty one. An empty table gives no rows.
    """
    columns = [F.col(f.name) for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]  # those cannot be hashed
    rows = docs.withColumns({ONE: F.xxhash64(F.lit(1), *columns), TWO: F.xxhash64(F.lit(2), *columns)})
    marked = _classed(rows, F.min("doc_id"))
    copies = marked.groupBy("h1", "h2", "other", "doc_id", ONE, TWO).agg(F.count("*").alias("copies"))
    first = copies.groupBy("h1", "h2", "other").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ONE, TWO, "copies")).alias("s"))
    staying = work.cut(first.select(*[F.col(f"s.{c}").alias(k) for c, k in zip(("doc_id", ONE, TWO, "copies"), STAYS, strict=True)]))
    same = (F.col(ONE) == F.col(STAYS[1])) & (F.col(TWO) == F.col(STAYS[2])) & F.col("doc_id").cast("long").eqNullSafe(F.col(STAYS[0]))
    once, often = staying.filter(F.col(STAYS[3]) == 1), staying.filter(F.col(STAYS[3]) > 1)
    found = rows.join(once, same, "left_semi")
    if often.take(1):
        # Grouped by less than the join's key, so that the join can still be split, and copies merge before they are sent on.
        found = found.union(rows.join(often, same, "left_semi").dropDuplicates([ONE, TWO]))
    return found.drop(ONE, TWO)
