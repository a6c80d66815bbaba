"""The engine's inputs, derived from the driver's tables.

samples, files, reads, ranks, batches and runs have the columns that the operators
ask for; each view has a SQL twin in ``VIEW_SQL`` for checking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

WORLD_SIZE = 8
# File extensions dealt to documents in turn (the empty one: none).
EXTENSIONS = (".txt", ".JPG", ".jpg", ".png", ".json", ".npy", ".parquet", ".gz", ".csv", ".md", ".xml", ".html", ".h5", ".bin", "")
WORKERS = (0, 2, 6, 7, 13, 28)
PLACEMENTS = ("scratch", "flash", "tmp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple, index) -> object:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", scalars.sample_id(F.col("doc_id")).alias("sample_id"), scalars.class_of(F.col("doc_id"), 100).alias("class_id"), F.octet_length("text").cast("long").alias("byte_size"), scalars.checksum(F.col("text").cast("binary")).alias("checksum"), F.col("n_chars").alias("estimated_decode_cost"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, p = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    docs = d.select(
        F.concat(F.lit("docs/"), "source", F.lit("/"), "lang").alias("parent"),
        F.concat(F.col("doc_id").cast("string"), _pick(EXTENSIONS, F.col("doc_id") % len(EXTENSIONS))).alias("name"),
        F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") % 50 == 0).alias("linked")
    )
    pages = p.select(
        F.concat(F.lit("pages/p"), (F.col("page_id") % 7).cast("string")).alias("parent"),
        F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.octet_length("html").cast("long").alias("size"),
        F.lit(False).alias("linked")
    )
    both = docs.unionByName(pages)
    return both.select(
        F.concat_ws("/", "parent", "name").alias("path"), "parent", F.size(F.split("parent", "/")).alias("depth"), F.lit("file").alias("kind"), "size", F.when(F.col("linked"), 2).otherwise(1).alias("nlink"), scalars.extension(F.col("name")).alias("extension"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who read what: ranks 0 to 7, epochs 1 to 7."""
    return table(spark, sf_dir, "lineitem").select(
        F.pmod("l_suppkey", F.lit(WORLD_SIZE)).cast("int").alias("rank"), F.col("l_linenumber").alias("epoch"),
        F.col("l_partkey").alias("sample_index")
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").agg(F.count("*").alias("total"))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of ranks, from what each shipped."""
    li = table(spark, sf_dir, "lineitem")
    each = li.groupBy(F.pmod("l_suppkey", F.lit(WORLD_SIZE)).cast("int").alias("rank")).agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("w")
    )
    return each.select(
        "rank", (F.col("n") / (F.col("q") / 100.0)).alias("samples_per_second"), (F.col("q") / 100.0).alias("elapsed_seconds"),
        (F.col("w") * 8.0).alias("data_wait_fraction")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per event; the first runs come first."""
    e = table(spark, sf_dir, "events")
    u, v, n = F.col("user_id"), F.col("value"), F.col("event_id")
    workers = _pick(WORKERS, F.pmod(u, F.lit(len(WORKERS))))
    return e.select(
        n.alias("input_ordinal"), F.concat(F.lit("run-"), n.cast("string")).alias("run_name"), F.col("event_type").alias("layout"), _pick(
            PLACEMENTS, F.pmod(u, F.lit(len(PLACEMENTS)))
        ).alias("storage"), workers.alias("num_workers"),
        v.alias("samples_per_second"), (v * 0.0025).alias("mib_per_second"), (F.lit(64.0) / (v + 1.0)).alias("mean_batch_wait_seconds"), (F.lit(128.0) / (v + 1.0)).alias("p95_batch_wait_seconds"), (F.pmod(n, F.lit(100)) / 100.0).alias("mean_data_wait_fraction"), (F.pmod(n, F.lit(7)) + 0.5).alias("startup_seconds"),
        F.when(
            F.col("event_type") == "click", 41
        ).otherwise(1000).cast("long").alias("files_opened"), F.when(
            F.col("event_type") == "click", 41
        ).otherwise(50002).cast("long").alias("filesystem_objects"),
        F.lit("m1").alias("manifest_hash"), F.lit("1.0").alias("schema_version"), F.lit(64).alias("batch_size"), F.lit(1000).alias("measured_batches"), F.lit(1).alias("world_size"), F.lit(1234).cast("long").alias("seed"), F.when(n % 3 == 0, F.lit(None)).otherwise(F.lit(1)).cast("int").alias("compute_steps"),
        (F.col("event_type") != "view").alias("shuffle"), F.when(n % 2 == 0, 1000).otherwise(F.lit(None)).cast("int").alias("shuffle_buffer"),
        (
            F.when(n % 997 == 0, 1).otherwise(0)
        ).cast("long").alias("failed_samples"), F.lit(0).cast("long").alias("duplicate_samples"), F.lit(0).cast("long").alias("missing_samples"),
        (F.lit(50000.0) / (v + 1.0)).alias("estimated_epoch_seconds"), F.when(
            F.pmod(u, F.lit(3)) == 2, 100.0 + F.pmod(n, F.lit(10))
        ).otherwise(0.0).alias("staging_seconds"), F.when(F.pmod(u, F.lit(3)) == 2, 2.0).otherwise(0.0).alias("validation_seconds"), F.when(
            F.pmod(u, F.lit(3)) == 2, 0.25
        ).otherwise(0.0).alias("dataset_fraction_of_memory"),
        (F.pmod(n, F.lit(90)) / 100.0).alias("cpu_utilization"), (F.lit(1000.0) * (workers + 1)).alias("peak_memory_bytes"), (
            F.lit(2.0) * workers * workers
        ).alias(
            "involuntary_switches_per_second"
        ), workers.cast("double").alias("child_processes"),
        ((workers + 1) / F.lit(14.0)).alias("oversubscription_ratio"), ((workers + 1) / F.lit(7.0)).alias("processes_per_physical_core"), F.lit(7.0).alias("allocated_cores"), F.lit(14.0).alias("cpus_available"),
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches in order of events: wait and whole seconds, and epochs of 1000 batches."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("ordinal"), F.expr("event_id div 1000").alias("epoch"), (F.col("value") / 1000.0).alias("wait"),
        (F.col("value") / 1000.0 + 0.01).alias("seconds")
    )


VIEW_SQL = {
    "v_samples": """
        SELECT doc_id, 's' || lpad(doc_id::VARCHAR, 8, '0') AS sample_id, (doc_id % 100)::INTEGER AS class_id, strlen(text)::BIGINT AS byte_size, substr(sha256(text), 1, 16) AS checksum, n_chars AS estimated_decode_cost FROM documents""",
    "v_files0": f"""
        SELECT 'docs/' || source || '/' || lang AS parent, doc_id::VARCHAR || ([{", ".join(f"'{e}'" for e in EXTENSIONS)}])[(doc_id % {len(EXTENSIONS)} + 1)::INTEGER] AS name, strlen(text)::BIGINT AS size, doc_id % 50 = 0 AS linked FROM documents
        UNION ALL SELECT 'pages/p' || (page_id % 7)::VARCHAR, page_id::VARCHAR || '.html', strlen(html)::BIGINT, false FROM pages""",
    "v_files": """
        SELECT parent || '/' || name AS path, parent, name, size, CASE WHEN linked THEN 2 ELSE 1 END AS nlink, CASE WHEN contains(substr(name, 2), '.') THEN lower('.' || split_part(name, '.', -1)) ELSE '(none)' END AS extension FROM v_files0""",
    "v_dirs": """
        SELECT DISTINCT array_to_string(p[1:i], '/') AS path, i AS depth FROM (SELECT string_split(parent, '/') AS p, unnest(range(1, len(string_split(parent, '/')) + 1)) AS i FROM (SELECT DISTINCT parent FROM v_files)) UNION ALL SELECT '', 0""",
    "v_reads": f"SELECT (l_suppkey % {WORLD_SIZE})::INTEGER AS rank, l_linenumber AS epoch, l_partkey AS sample_index FROM lineitem",
    "v_ranks": f"""
        SELECT rank, n / (q / 100.0::DOUBLE) AS samples_per_second, q / 100.0::DOUBLE AS elapsed_seconds, w * 8.0::DOUBLE AS data_wait_fraction
        FROM (SELECT (l_suppkey % {WORLD_SIZE})::INTEGER AS rank, count(*) AS n, sum(l_quantity) AS q, avg(l_discount) AS w FROM lineitem GROUP BY 1)""",
    "v_runs": f"""
        SELECT event_id AS input_ordinal, event_type AS layout, ([{", ".join(f"'{p}'" for p in PLACEMENTS)}])[(user_id % 3 + 1)::INTEGER] AS storage, w AS num_workers, value AS samples_per_second, value * 0.0025::DOUBLE AS mib_per_second,
        64.0::DOUBLE / (value + 1) AS mean_batch_wait_seconds, 128.0::DOUBLE / (value + 1) AS p95_batch_wait_seconds, (event_id % 100) / 100.0::DOUBLE AS mean_data_wait_fraction, (event_id % 7 + 0.5)::DOUBLE AS startup_seconds,
        (CASE WHEN event_type = 'click' THEN 41 ELSE 1000 END)::DOUBLE AS files_opened, (CASE WHEN event_type = 'click' THEN 41 ELSE 50002 END)::DOUBLE AS filesystem_objects,
        'm1' AS manifest_hash, '1.0' AS schema_version, '64' AS batch_size, '1000' AS measured_batches, '1' AS world_size, '1234' AS seed, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '1' END AS compute_steps,
        CASE WHEN event_type <> 'view' THEN 'true' ELSE 'false' END AS shuffle, CASE WHEN event_id % 2 = 0 THEN '1000' END AS shuffle_buffer, CASE WHEN event_id % 997 = 0 THEN 1 ELSE 0 END AS failed_samples, 0 AS duplicate_samples, 0 AS missing_samples,
        50000.0::DOUBLE / (value + 1) AS estimated_epoch_seconds, CASE WHEN user_id % 3 = 2 THEN 100.0::DOUBLE + event_id % 10 ELSE 0.0::DOUBLE END AS staging_seconds, CASE WHEN user_id % 3 = 2 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS validation_seconds,
        CASE WHEN user_id % 3 = 2 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS dataset_fraction_of_memory, (event_id % 90) / 100.0::DOUBLE AS cpu_utilization, 2.0::DOUBLE * w * w AS involuntary_switches_per_second, w::DOUBLE AS child_processes, (w + 1) / 14.0::DOUBLE AS oversubscription_ratio, (w + 1) / 7.0::DOUBLE AS processes_per_physical_core
        FROM (SELECT *, ([{", ".join(map(str, WORKERS))}])[(user_id % 6 + 1)::INTEGER] AS w FROM events)""",
    "v_batches": "SELECT event_id AS ordinal, event_id // 1000 AS epoch, value / 1000.0::DOUBLE AS wait, value / 1000.0::DOUBLE + 0.01::DOUBLE AS seconds FROM events",
}


def with_views(sql: str) -> str:
    """``sql`` after the definitions of the views that it names."""
    need, order = set(), list(VIEW_SQL)
    text = sql
    for name in reversed(order):
        if name in text:
            need.add(name)
            text += VIEW_SQL[name]
    found = ", ".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in order if n in need)
    body = sql.strip()
    if not found:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{found}, {body.removeprefix(head)}"
    return f"WITH {found} {body}"
