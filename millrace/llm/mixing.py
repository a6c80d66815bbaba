"""Mixing sources to target weights, with DataFrame operations only.

Each source's words are laid end to end, in a seeded order of its documents, and
packed into blocks of ``BLOCK`` words. The output is as many slots as the targets
need blocks, dealt to the output shards in turn. Each slot draws its source with
the targets' probabilities, so the counts of a shard's sources are multinomial.
What a source draws over its target, evenly spread slots of it, goes to the sources
that drew less than theirs: sources meet their targets, none exceeds its cap.

A source's slots are numbered through the shards. Slot numbers are mapped to blocks,
pass after pass over the source, by a pseudorandom permutation of the block
indices, another for each source and pass: rounds that swap an index with its mirror
image about a seeded point, or leave both, as a hash of the pair says. Each round is
a permutation of any number of indices, so nothing is sorted or walked. Slots and
blocks are joined by index.

Word counts are written once as a narrow table. Sums over a source are running sums
over hash buckets of distinct rows, so neither a source that holds most rows nor a
row that is repeated often is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import work

SEED = 20240301
#: Words of a block.
BLOCK = 32
#: No source is repeated more often than this.
CAP = 3
#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
#: Output shards of a mix.
SHARDS = 64
#: Rounds of the permutation of block indices, and the prime modulo which its hash squares.
ROUNDS, PRIME = 12, 2147483647
#: Not names that tables have: two hashes of a row, the same in the plan of what is taken, that, and the new text.
ONE, TWO, PLAN_ONE, PLAN_TWO, TIMES, PARTS, TEXT = (f"_millrace_{x}" for x in ("row_1", "row_2", "plan_1", "plan_2", "times", "parts", "text"))


def _hashed(*parts: Column) -> Column:
    """52 bits of the MD5 of some strings, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def _keys() -> list[Column]:
    return [F.xxhash64(F.lit(i), "doc_id", "source", "text").alias(name) for i, name in ((1, ONE), (2, TWO))]


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size in words, two hashes of the row, and its seeded place ``_mix``."""
    text = F.coalesce("text", F.lit(""))
    mix = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(text.cast("binary"))).cast("binary"))
    return docs.select("doc_id", "source", *_keys(), F.regexp_count(text, F.lit(work.WORD)).cast("long").alias("size"), mix.alias("_mix"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, target from (source, source_size): shares by weight, at most ``cap`` times the size.

    What capped sources leave is shared again by weight. That ends with some level
    ``x`` at which each source gets the lesser of its cap and ``x`` times its weight;
    in order of cap by weight the capped sources come first, so running sums find
    it. One row per source: the windows hold no documents.
    """
    ranked = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights))) + 1).cast("int")
    )
    found = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(cap))
    up = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, rest, every = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    # The level if just the sources before this one are capped; the first source under its cap at that level sets it for all.
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    found = found.withColumn("_level", level).withColumn("_at", F.row_number().over(up))
    found = found.withColumn("_x", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_at", "_level"))).over(every)["_level"])
    return found.select("source", "source_size", F.coalesce(F.least(F.col("_cap"), F.col("_x") * F.col("_w")), F.col("_cap")).alias("target"))


def _goals(plan: DataFrame, block: int) -> DataFrame:
    """Sources with something to take: goal in words, blocks, wanted slots, and the first of the tickets that draw the source. One row per source."""
    goals = plan.withColumn("goal", F.round("target").cast("long")).filter("source_size > 0 and goal > 0")
    goals = goals.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    goals = goals.withColumn("wanted", F.expr(f"goal div source_size * blocks + (goal % source_size + {block - 1}) div {block}"))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return work.cut(goals.withColumn("first", F.coalesce(F.sum("wanted").over(before), F.lit(0))))


def draw(goals: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(source, shard, n): how many of each output shard's slots draw each source, multinomial with the goals' shares."""
    spark = goals.sparkSession
    known = goals.agg(F.coalesce(F.sum("wanted"), F.lit(0)).alias("slots"), F.count("*").alias("sources")).first()
    slots, cells = known["slots"], max(1024, 4 * known["sources"])
    if not slots:
        return spark.createDataFrame([], "source string, shard int, n long")
    slot = spark.range(slots).select(
        F.pmod("id", F.lit(shards)).cast("int").alias("shard"),
        F.pmod(_hashed(F.col("id").cast("string"), F.lit(str(seed))), F.lit(slots)).alias("ticket")
    )
    # A ticket finds its source among those that overlap its cell: an equality join, broadcast or not by size.
    cell = lambda x: F.floor(x.cast("double") * cells / slots).cast("long")
    owners = goals.select("source", "first", (F.col("first") + F.col("wanted")).alias("end")).withColumn(
        "cell", F.explode(F.sequence(cell(F.col("first")), cell(F.col("end") - 1)))
    )
    met = slot.withColumn("cell", cell(F.col("ticket"))).join(owners, "cell").filter("ticket >= first and ticket < end")
    return met.groupBy("source", "shard").agg(F.count("*").alias("n"))


def permuted(index: Column, n: Column, keys: Column) -> Column:
    """Where a permutation of 0 to n - 1 sends ``index``: one round for each key."""

    def swap(x: Column, key: Column) -> Column:
        other = F.pmod(F.pmod(key, n) - x, n)
        z = F.pmod(F.greatest(x, other) + key, F.lit(PRIME))
        z = F.pmod(z * z + F.pmod(key, F.lit(PRIME)), F.lit(PRIME))
        z = F.pmod(z * z, F.lit(PRIME))
        return F.when(F.pmod(F.shiftright(z, 10), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(keys, index, swap)


def slots(plan: DataFrame, shards: int = SHARDS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """The mix: source, pass, slot, block index, words taken from its start, and output shard, one row per slot.

    ``plan`` has source, source_size and target. Full blocks are permuted; the last,
    short one ends each pass, so that whole passes take each word once.
    """
    goals = _goals(plan, block)
    by_shard = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = work.cut(draw(goals, shards, seed)).withColumn("rank", F.coalesce(F.sum("n").over(by_shard), F.lit(0)))
    counts = drawn.groupBy("source").agg(F.sum("n").alias("all"))
    # One row per source: what it drew over its wanted slots, or short of them, and where that starts when laid end to end.
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    goals = goals.join(
        counts.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left"
    ).withColumn("all", F.coalesce("all", F.lit(0))).drop("_source")
    goals = goals.withColumns(
        {"over": F.greatest(F.col("all") - F.col("wanted"), F.lit(0)), "short": F.greatest(F.col("wanted") - F.col("all"), F.lit(0))}
    )
    goals = goals.withColumns(
        {"over_at": F.coalesce(F.sum("over").over(before), F.lit(0)), "short_at": F.coalesce(F.sum("short").over(before), F.lit(0))}
    )
    goals = work.cut(goals)
    about = ["source_size", "goal", "blocks"]
    runs = drawn.join(
        goals.select(F.col("source").alias("_source"), "all", "over", "over_at", *about), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    each = work.unfolded(runs, "n").withColumn("rank", F.col("rank") + F.col("at"))
    each = each.withColumns({"gone": F.expr("(rank * over) div all"), "gone_next": F.expr("((rank + 1) * over) div all")})
    kept = each.filter("gone = gone_next").select("source", *about, F.expr("rank - gone").alias("number"), "shard")
    freed = each.filter("gone < gone_next").select(F.expr("over_at + gone").alias("turn"), "shard")
    filled = work.unfolded(goals.filter("short > 0"), "short").select(
        "source", *about, F.expr("all + at").alias("number"), F.expr("short_at + at").alias("turn")
    )
    used = kept.unionByName(filled.join(freed, "turn").drop("turn")).withColumns(
        {"pass": F.expr("number div blocks"), "slot": F.expr("number % blocks")}
    )
    # One row per source and pass.
    passes = goals.select(
        F.col("source").alias("_source"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(goal - 1) div source_size"))).alias("_pass")
    )
    passes = passes.withColumn(
        "keys",
        F.array(*[_hashed(F.lit(str(seed)), F.coalesce("_source", F.lit("")), F.col("_pass").cast("string"), F.lit(str(i))) for i in range(ROUNDS)])
    )
    used = used.join(
        passes, F.col("source").eqNullSafe(F.col("_source")) & (F.col("pass") == F.col("_pass"))
    ).withColumn("full", F.expr(f"source_size div {block}"))
    take = F.least(F.col("source_size"), F.col("goal") - F.col("pass") * F.col("source_size"))
    index = F.when(F.col("slot") < F.col("full"), permuted(F.col("slot"), F.col("full"), F.col("keys"))).otherwise(F.col("full"))
    return used.select(
        "source", "pass", "slot", index.alias("block"), F.least(F.lit(block).cast("long"), take - F.col("slot") * block).alias("words"), "shard"
    )


def _placed(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(distinct rows with ``copies``, every row with its first word ``_at`` in its source and a number ``_row``), written tables."""
    buckets = work.bucket_count(docs)
    bucket = F.floor(F.conv(F.substring("_mix", 1, 8), 16, 10).cast("double") * buckets / 2**32).cast("long")
    names = ["doc_id", "source", ONE, TWO, "size", "_mix"]
    rows = work.cut(sized(docs, seed).groupBy(*names).agg(F.count("*").alias("copies")).withColumn("_bucket", bucket))
    order = [F.col(c) for c in ("_mix", "doc_id", "size", ONE, TWO)]
    at = work.cut(
        work.running_before(rows, ["source"], "_bucket", order, F.col("size") * F.col("copies"), "_at", "source_size").drop("_bucket", "_mix")
    )
    return rows, work.cut(
        work.each_copy(at).withColumn(
            "_at", F.col("_at") + F.col("at") * F.col("size")
        ).drop("at").withColumn("_row", F.monotonically_increasing_id())
    )


def mix(
        docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP
) -> tuple[DataFrame, DataFrame]:
    """(documents, uses): the words that the mix takes of each document, and which slots take them.

    documents: doc_id, size, source, source_size, target, taken, n_shards (the output
    shards that words of the document go to). uses: source, block, pass, slot, shard,
    words, the document's row and hashes, its first word in its source and the words
    of it that the slot takes.

    Nulls: a null text has no words; a null source is a source, the last; a null
    doc_id is placed as the empty id. Repeated rows are separate documents that lie
    side by side; rows equal in all columns read are interchangeable. Sources
    without words have target 0. An empty table gives no rows. Other columns are not read.
    """
    rows, placed = _placed(docs, seed)
    plan = work.cut(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, cap))
    pieces = placed.filter("size > 0").select(
        "_row", ONE, TWO, F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"), "_at", "size",
        F.explode(F.sequence(F.expr(f"_at div {block}"), F.expr(f"(_at + size - 1) div {block}"))).alias("block")
    )
    used = slots(plan, shards, seed, block).select(
        F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"), "pass", "slot", "block", "words", "shard"
    )
    # Sizes of exploded rows are underestimated: never broadcast either side.
    met = pieces.join(used.hint("merge"), ["_s", "_n", "block"])
    overlap = F.least(F.col("_at") + F.col("size"), F.col("block") * block + F.col("words")) - F.greatest(F.col("_at"), F.col("block") * block)
    uses = met.withColumn("taken", overlap).filter("taken > 0")
    # A bit a shard, in words of 64 shards.
    bits = [F.expr(f"bit_or(if(shard div 64 = {i}, shiftleft(1L, shard % 64), 0L))").alias(f"_b{i}") for i in range(-(-shards // 64))]
    taken = uses.groupBy("_row").agg(F.sum("taken").alias("taken"), *bits)
    n_shards = sum((F.bit_count(f"_b{i}") for i in range(len(bits))), F.lit(0))
    known = placed.join(plan.select(F.col("source").alias("_source"), "target"), F.col("source").eqNullSafe(F.col("_source")), "left")
    documents = known.join(taken, "_row", "left").select(
        "doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce(n_shards, F.lit(0)).cast("int").alias("n_shards"), "_row"
    )
    return documents, uses


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """``docs``, all columns, with the words that the mix takes of each text; rows of which it takes none go.

    A text taken in whole passes is repeated, on lines of its own; a part is the words
    of the blocks taken, in order, with single spaces. Rows that repeat id, source and
    text come out one by one, with the other columns of any of them. Column n_chars, where
    there is one, is counted anew.
    """
    block = settings.get("block", BLOCK)
    _, uses = mix(docs, **settings)
    part = F.struct(F.greatest(F.col("block") * block - F.col("_at"), F.lit(0).cast("long")).alias("at"), F.col("taken").alias("n"))
    by_pass = uses.groupBy("_row", ONE, TWO, "pass").agg(
        (F.sum("taken") == F.max("size")).alias("whole"), F.array_sort(F.collect_list(part)).alias("parts")
    )
    plan = by_pass.groupBy("_row", ONE, TWO).agg(
        F.count_if("whole").cast("int").alias(TIMES), F.collect_list(F.when(~F.col("whole"), F.struct("pass", "parts"))).alias(PARTS)
    )
    plan = work.cut(
        plan.select(
            F.col(ONE).alias(PLAN_ONE), F.col(TWO).alias(PLAN_TWO), TIMES, F.flatten(F.transform(F.array_sort(PARTS), lambda p: p["parts"])).alias(PARTS)
        )
    )
    keyed = docs.select("*", *_keys())
    often = work.cut(plan.groupBy(PLAN_ONE, PLAN_TWO).count().filter("count > 1"))
    same = (F.col(ONE) == F.col(PLAN_ONE)) & (F.col(TWO) == F.col(PLAN_TWO))
    if often.take(1):
        keyed = keyed.join(often, same, "left_anti").union(work.cut(keyed.join(often, same, "left_semi").dropDuplicates([ONE, TWO])))
    joined = keyed.join(plan, same)
    words = F.regexp_extract_all("text", F.lit(f"({work.WORD})"), F.lit(1))
    # The words are bound to a lambda's variable: as a column they would be found anew for each part.
    some = F.transform(
        F.array(words),
        lambda ws: F.array_join(F.flatten(F.transform(PARTS, lambda p: F.slice(ws, (p["at"] + 1).cast("int"), p["n"].cast("int")))), " ")
    )
    rest = F.element_at(some, 1)
    joined = joined.withColumn(
        TEXT,
        F.array_join(
            F.concat(
                F.array_repeat(F.col("text"), F.col(TIMES)), F.when(F.size(PARTS) > 0, F.array(rest)).otherwise(F.array().cast("array<string>"))
            ),
            "\n"
        )
    )
    return joined.select(
        *[F.col(TEXT).alias("text") if c == "text" else F.length(TEXT).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    )
