"""Personal data: patterns, keys, and terms that disclose what these protect.

Protected entities are what the patterns find (e-mail addresses, IP addresses,
payment cards, telephone numbers) and secrets: long runs of letters and digits mixed,
as keys and tokens are. Over the whole corpus, terms are counted that stand near an
entity, by entity, and in how many documents each term stands at all. An entity is
taken twice: by its value (who is it) and by its kind (that there is one).

A term discloses an entity if it stands near it in enough different texts, if most
documents with the term have it near that entity, and if their pointwise mutual
information exceeds a threshold. The share ``P(entity | term)`` of one half or more
says that the information is within a bit of all that the entity carries. In texts with
the entity its disclosing terms are sanitised too, wherever they stand in the text:
removed, or generalised to their kind.

DataFrame functions only. Texts are shuffled at no point; the corpus counts cover
every word of every text, and words that no entity has near it are dropped before
the shuffle by a filter sized by the terms, which passes all words that matter. Copies of
one text alone disclose nothing: the support counts different texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import work

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the spans that the method adds: secrets, and terms by the corpus statistics.
SECRET, TERM = "secret", "term"
#: Code points on either side of an entity in which terms count as near it.
CONTEXT = 120
#: Different texts in which a term must stand near an entity, by its value and by its kind.
SUPPORT, KIND_SUPPORT = 2, 5
#: Least part of the documents with the term that have it near the entity, and least mutual information in bits.
SHARE, INFORMATION = 0.5, 3.0
#: Shorter terms disclose nothing by themselves.
MIN_LENGTH = 3
#: Code points of a stretch in which a long text is looked into, and stretches of spans on either side that a context can touch: spans have five code points at least.
CHUNK, BLOCKS = 4096, CONTEXT // 5 + 2
OPEN, CLOSE, OTHER = "\u0001", "\u0002", "\u0003"
EDGES = ".,;:!?()[]{}\"'|<>*#$%&"
#: What parts terms: white space, and what stands between a name and its value.
SPACES = "[\\x20\\x09-\\x0D=:\"]"
LOCAL = "[A-Za-z0-9._%+-]"
#: The contract's patterns, written so that no input makes them backtrack or recurse: a run is tried from its start only, and taken whole.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){15,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Sixteen or more letters and digits with at least one of each.
KEY = "(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+"
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _phone(value: Column) -> Column:
    return F.length(_digits(value)).between(8, 15)


def _ip(value: Column) -> Column:
    return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")


def _bound(value: Column, body) -> Column:
    """``body`` of a variable that holds ``value``: inside lambdas an expression would be worked out again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(items: Column, zero: Column, step) -> Column:
    """(before, item) for each item: the state that ``step`` reaches from ``zero`` over the items before it.

    Arrays grow by copying, so items go in as many chunks as a chunk has items: n times
    the root of n, not n squared.
    """

    def whole(acc: Column, chunk: Column) -> Column:
        return _bound(
            F.aggregate(chunk, acc["state"], step), lambda after: F.struct(after.alias("state"), F.concat(acc["got"], F.array(after)).alias("got"))
        )

    def inside(chunk: Column, first: Column) -> Column:
        none = F.filter(F.transform(chunk, lambda x: F.struct(first.alias("before"), x.alias("item"))), lambda x: F.lit(False))
        start = F.struct(first.alias("state"), none.alias("got"))
        return F.aggregate(
            chunk, start, lambda acc,
            x: F.struct(
                step(acc["state"], x).alias("state"),
                F.concat(acc["got"], F.array(F.struct(acc["state"].alias("before"), x.alias("item")))).alias("got")
            ),
            lambda acc: acc["got"]
        )

    def in_chunks(chunks: Column) -> Column:
        starts = F.aggregate(chunks, F.struct(zero.alias("state"), F.array(zero).alias("got")), whole, lambda acc: acc["got"])
        return _bound(starts, lambda st: F.flatten(F.transform(chunks, lambda chunk, i: inside(chunk, F.get(st, i)))))

    def over(its: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(its))).cast("int"))
        chunks = F.transform(
            F.sequence(F.lit(0), F.floor((F.greatest(F.size(its), F.lit(1)) - 1) / width).cast("int")), lambda c: F.slice(its, c * width + 1, width)
        )
        return _bound(chunks, in_chunks)

    return _bound(items, over)


def _chunks(text: Column) -> Column:
    """A text in stretches of ``CHUNK`` code points: finding a place in a string means counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{CHUNK}}})"), F.lit(1))


def _between(chunks: Column, start: Column, end: Column) -> Column:
    """Code points from start to end of the text in ``_chunks``."""
    at = lambda x: F.floor(x / CHUNK).cast("int")
    chunk = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    off = (start - at(start) * CHUNK + 1).cast("int")
    across = F.concat(
        F.substr(chunk(at(start)), off), F.array_join(F.slice(chunks, at(start) + 2, F.greatest(at(end) - at(start) - 1, F.lit(0))), ""),
        F.substr(chunk(at(end)), F.lit(1), (end - at(end) * CHUNK).cast("int"))
    )
    return F.when(at(start) == at(end), F.substr(chunk(at(start)), off, (end - start).cast("int"))).otherwise(across)


def _spans(text: Column, kind: str, pattern: str, maybe: Column, valid=None) -> Column:
    """Spans of the pattern's matches: put marks around them, split there, and add up lengths."""
    parts = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN)
    value = lambda p: F.substring_index(p, CLOSE, 1)
    placed = _scan(F.slice(parts, F.lit(2), F.size(parts)), F.length(F.element_at(parts, 1)), lambda at, p: at + F.length(p) - 1)
    found = F.transform(
        placed,
        lambda x: F.struct(
            F.lit(kind).alias("kind"), x["before"].alias("start"), (x["before"] + F.length(value(x["item"]))).alias("end"),
            value(x["item"]).alias("value")
        )
    )
    found = F.filter(found, lambda s: valid(s["value"])) if valid else found
    return F.when(maybe, found).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with column text) and column ``spans``: what the patterns find, by kind as listed, then start."""
    text = F.col("_plain")
    found = docs.withColumn("_plain", F.translate(F.coalesce("text", F.lit("")), OPEN + CLOSE, OTHER + OTHER))
    number = text.rlike("[0-9]")
    each = (
        _spans(text, "email", EMAIL, F.contains(text, F.lit("@"))),
        _spans(text, "ip", IP, number & text.rlike(r"[0-9]\.[0-9]"), _ip),
        _spans(text, "card", CARD, number & text.rlike(CARD), _luhn),
        _spans(text, "phone", PHONE, F.contains(text, F.lit("+")), _phone),
    )
    return found.withColumn("spans", F.concat(*each)).drop("_plain")


def _apart(spans: Column, found: Column, kind: str) -> Column:
    """Those of ``found`` that none of ``spans`` touches, as spans of ``kind`` by their start."""
    tag = lambda c, own: F.transform(
        c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"), s["value"].alias("value"))
    )

    def apart(every: Column) -> Column:
        ends = _scan(every, F.lit(0), lambda at, s: F.when(s["own"], at).otherwise(F.greatest(at, s["end"])))
        starts = F.reverse(_scan(F.reverse(every), F.lit(2147483647), lambda at, s: F.when(s["own"], at).otherwise(F.least(at, s["start"]))))
        both = F.zip_with(ends, starts, lambda a, b: F.struct(a["item"].alias("s"), a["before"].alias("end"), b["before"].alias("start")))
        kept = F.filter(both, lambda x: x["s"]["own"] & (x["end"] <= x["s"]["start"]) & (x["start"] >= x["s"]["end"]))
        return F.transform(
            kept,
            lambda x: F.struct(
                F.lit(kind).alias("kind"), x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["value"].alias("value")
            )
        )

    return _bound(F.array_sort(F.concat(tag(spans, False), tag(found, True))), apart)


def _names(s: Column) -> Column:
    """The two entities of a span: its kind with its value, and its kind."""
    value = F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"].isin("ip", SECRET), s["value"]).otherwise(_digits(s["value"]))
    return F.array(F.concat_ws(":", s["kind"], value), s["kind"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with columns text and spans) and column ``secrets``: runs of letters and digits that look like keys, none that a span touches."""
    text = F.translate(F.coalesce("text", F.lit("")), OPEN + CLOSE, OTHER + OTHER)
    found = docs.withColumn("_keys", _spans(text, SECRET, KEY, text.rlike(KEY)))
    alone = _apart(F.col("spans"), F.col("_keys"), SECRET)
    secrets = F.when(F.size("_keys") == 0, F.col("_keys")).when(F.size("spans") == 0, F.col("_keys")).otherwise(alone)
    return found.withColumn("secrets", secrets).drop("_keys")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _near(entities: DataFrame) -> DataFrame:
    """(_row, _text, entity, term, start, end): words within reach of each entity, by its value and by its kind, none that a span touches.

    Spans that overlap are one block; a context touches few blocks, so each entity
    carries those next to its own, and two short stretches of the text.
    """
    order = F.array_sort(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    )
    new = lambda x: x["item"]["start"] >= x["before"]["end"]
    step = lambda at, s: F.struct(
        (at["n"] + F.when(s["start"] >= at["end"], 1).otherwise(0)).alias("n"), F.greatest(at["end"], s["end"]).alias("end")
    )
    placed = _scan(order, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)

    def blocks_of(every: Column) -> Column:
        last = F.array_max(F.transform(every, lambda x: x["item"]["end"]))
        return _bound(
            last,
            lambda end: _bound(
                F.filter(every, new),
                lambda heads: F.transform(
                    heads, lambda x,
                    i: F.struct(x["item"]["start"].alias("start"), F.coalesce(F.get(heads, i + 1)["before"]["end"], end).alias("end"))
                )
            )
        )

    def about(x: Column, blocks: Column, chunks: Column, length: Column) -> Column:
        s, e = x["item"]["start"], x["item"]["end"]
        n = x["before"]["n"] + F.when(new(x), 1).otherwise(0)
        low, high = F.greatest(s - CONTEXT, F.lit(0)), F.least(e + CONTEXT, length)
        left = F.struct(low.alias("at"), _between(chunks, low, s).alias("part"), (low > 0).alias("first"), F.lit(True).alias("last"))
        right = F.struct(e.alias("at"), _between(chunks, e, high).alias("part"), F.lit(True).alias("first"), (high < length).alias("last"))
        return F.struct(
            x["item"]["kind"].alias("kind"), x["item"]["value"].alias("value"),
            F.slice(blocks, F.greatest(n - BLOCKS, F.lit(1)), F.lit(2 * BLOCKS + 1)).alias("blocks"), F.array(left, right).alias("sides")
        )

    text = F.col("text")
    found = _bound(
        placed,
        lambda every: _bound(
            blocks_of(every),
            lambda blocks: _bound(
                _chunks(text), lambda chunks: _bound(F.length(text), lambda length: F.transform(every, lambda x: about(x, blocks, chunks, length)))
            )
        )
    )
    each = entities.select("_row", "_text", F.explode(found).alias("s"))
    # A word at the edge of the reach may be cut, one at the entity may belong to it: neither counts.
    each = each.select(
        "_row", "_text", F.col("s.blocks").alias("blocks"), _names(F.col("s")).alias("names"), F.explode("s.sides").alias("c")
    ).withColumn("words", F.split("c.part", SPACES))
    placed = _scan(F.col("words"), F.col("c.at"), lambda at, w: at + F.length(w) + 1)
    kept = F.filter(placed, lambda x, i: ~((i == 0) & F.col("c.first")) & ~((i == F.size("words") - 1) & F.col("c.last")))
    each = each.select("_row", "_text", "blocks", "names", F.explode(kept).alias("w"))
    word = F.col("w.item")
    head = F.length(word) - F.length(F.ltrim(word, F.lit(EDGES)))
    term = F.trim(word, F.lit(EDGES))
    each = each.select(
        "_row", "_text", "blocks", "names", F.lower(term).alias("term"), (F.col("w.before") + head).alias("start"),
        (F.col("w.before") + head + F.length(term)).alias("end")
    )
    apart = ~F.exists("blocks", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    each = each.filter((F.length("term") >= MIN_LENGTH) & apart)
    return each.select("_row", "_text", F.explode("names").alias("entity"), "term", "start", "end")


def disclosing(
        near: DataFrame, docs: DataFrame, support: int = SUPPORT, kind_support: int = KIND_SUPPORT, share: float = SHARE,
        information: float = INFORMATION
) -> DataFrame:
    """(entity, term, share, information) of the terms that disclose an entity, over all of ``docs`` (column text)."""
    each = near.groupBy("entity", "term", "_row").agg(F.min("_text").alias("_text"))
    together = each.groupBy("entity", "term", "_text").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(
        F.sum("n").alias("both"), F.count("*").alias("texts")
    )
    least = F.when(F.contains("entity", F.lit(":")), support).otherwise(kind_support)
    frequent = work.cut(together.filter(F.col("texts") >= least).drop("texts"))
    entities = near.select("entity", "_row").distinct().groupBy("entity").agg(F.count("*").alias("entity_rows"))
    maybe = work.passes(frequent, "term")
    # A text's words are made different from each other before they are dealt out, so a word costs one count a task.
    split = F.split(F.lower(F.coalesce("text", F.lit(""))), SPACES)
    words = docs.select(F.explode(F.array_distinct(F.transform(split, lambda w: F.trim(w, F.lit(EDGES))))).alias("term"))
    passed = words.filter(maybe(F.col("term")))
    stands = passed.groupBy("term").agg(F.count("*").alias("rows_with"))
    found = frequent.join(stands, "term").join(entities, "entity").withColumn("all_rows", docs.agg(F.count("*")).scalar())
    found = found.withColumn("share", F.col("both") / F.col("rows_with")).withColumn(
        "information", F.log2(F.col("both") * F.col("all_rows") / (F.col("rows_with") * F.col("entity_rows")))
    )
    return found.filter((F.col("share") >= share) & (F.col("information") >= information)).select("entity", "term", "share", "information")


def _everywhere(entities: DataFrame, known: DataFrame) -> DataFrame:
    """(_row, terms): the words of a text that disclose an entity of that text, wherever they stand, none that a span touches.

    Entities and words are told apart by filters first, so that only words that can
    disclose are shuffled, with the spans of their texts; texts are not.
    """
    named = entities.select("_row", F.explode("spans").alias("s")).select("_row", F.explode(_names(F.col("s"))).alias("entity")).distinct()
    told = work.cut(named.join(work.cut(known.select("entity").distinct()), "entity", "left_semi"))
    held, maybe = work.passes(told, "_row"), work.passes(known, "term")
    texts = entities.filter(held(F.col("_row"))).select("_row", F.split("text", SPACES).alias("words"))
    each = texts.select("_row", F.explode(_scan(F.col("words"), F.lit(0), lambda at, w: at + F.length(w) + 1)).alias("w"))
    word = F.col("w.item")
    start = F.col("w.before") + F.length(word) - F.length(F.ltrim(word, F.lit(EDGES)))
    term = F.trim(word, F.lit(EDGES))
    each = each.select("_row", F.lower(term).alias("term"), start.alias("start"), (start + F.length(term)).alias("end"))
    met = work.cut(each.filter(maybe(F.col("term")))).join(known, "term").join(told, ["_row", "entity"], "left_semi")
    found = met.groupBy("_row").agg(F.collect_set(F.struct("start", "end", F.col("term").alias("value"))).alias("found"))
    spans = entities.filter(held(F.col("_row"))).select("_row", "spans")
    return found.join(spans, "_row").select("_row", _apart(F.col("spans"), F.col("found"), TERM).alias("terms"))


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (base), extra (secrets, then terms), sanitised.

    Spans are ordered by kind as listed, then start. Positions are code points of the
    text, ends exclusive. ``sanitised`` is the text with all spans generalised, null
    where there are none. Nulls: a null text is
    empty and has no spans; a null doc_id stays null. Repeated rows each have their
    spans, and are one text in the support. An empty table gives no rows.
    Other columns are not read.
    """
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = secret_spans(base_spans(plain)).withColumn("text", F.when((F.size("spans") > 0) | (F.size("secrets") > 0), F.col("text")))
    rows = work.cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    entities = rows.filter("text is not null").withColumns({"_text": F.xxhash64("text"), "spans": F.concat("spans", "secrets")})
    near = work.cut(_near(entities))
    known = work.cut(disclosing(near, plain).select("entity", "term"))
    terms = _everywhere(entities, known)
    found = rows.join(terms, "_row", "left").withColumn("extra", F.concat("secrets", F.coalesce("terms", F.array().cast(SPAN))))
    return found.select(
        "doc_id", "spans", "extra", F.when(F.col("text").isNotNull(), sanitise(F.col("text"), F.concat("spans", "extra"))).alias("sanitised")
    )


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns for ``find``; n_spans counts all spans, sanitised_sha256 is of the sanitised text."""
    found = find(docs)
    count = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.concat("spans", "extra")
    return found.select(
        "doc_id", *[count("spans", k) for k in KINDS], F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(every).alias("spans"),
        *[count("extra", k) for k in (SECRET, TERM)], F.size(every).cast("long").alias("n_spans"), F.sha2("sanitised", 256).alias("sanitised_sha256"),
    )


def sanitise(text: Column, spans: Column, generalise: bool = True) -> Column:
    """The text with its spans removed, or replaced by their kind in brackets. Spans that overlap go as one, of the kind that starts first."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    placed = _scan(order, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
    heads = F.filter(placed, lambda x: x["item"]["start"] >= x["before"])
    put = lambda x: F.concat(F.lit("["), F.upper(x["item"]["kind"]), F.lit("]")) if generalise else F.lit("")
    end = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))

    def cut(chunks: Column) -> Column:
        pieces = F.transform(heads, lambda x: F.concat(_between(chunks, x["before"], x["item"]["start"]), put(x)))
        return F.concat(F.array_join(pieces, ""), _between(chunks, end, F.length(text)))

    return _bound(_chunks(text), cut)
