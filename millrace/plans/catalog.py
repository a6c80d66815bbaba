"""The query catalogue: names, Spark plans, and the SQL that gives the same rows.

Doubles are rounded to six places on both sides, as sums are added in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import batching, compare, coverage, decide, inspect, ladder, placement, shards, staging
from . import roundtrips
from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MEMORY = 64 << 20
TARGET = 1 << 20
READERS = 8
PLAN = shards.ShardPlan(samples_per_shard=100)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = v.with_views(sql)
        return f

    return add


def _stats(metric: str) -> str:
    return f"round(coalesce(quantile_cont({metric}::DOUBLE, 0.5), 0), 6) AS {metric}_median, round(min({metric}::DOUBLE), 6) AS {metric}_min, round(max({metric}::DOUBLE), 6) AS {metric}_max, round(coalesce(stddev_samp({metric}::DOUBLE) / nullif(avg({metric}::DOUBLE), 0), 0), 6) AS {metric}_cv"


CV = "coalesce(stddev_samp(samples_per_second) / nullif(avg(samples_per_second), 0), 0)"
P50 = "quantile_cont({}, 0.5)"
FAILURES = "sum(failed_samples)::BIGINT AS failed_samples, sum(duplicate_samples)::BIGINT AS duplicate_samples, sum(missing_samples)::BIGINT AS missing_samples"


# Coverage


@query(
    "SELECT epoch, count(*) AS observed, count(DISTINCT sample_index) AS unique_samples, count(*) - count(DISTINCT sample_index) AS duplicate_samples, greatest(0, (SELECT count(*) FROM part) - count(DISTINCT sample_index))::BIGINT AS missing_samples FROM v_reads GROUP BY epoch"
)
def epoch_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.epoch_coverage(v.reads(spark, sf), v.universe(spark, sf))


VERDICT = f"""
    WITH n AS (SELECT count(*) AS total_samples FROM part), m AS (SELECT count(*) AS samples_measured, count(DISTINCT sample_index) AS unique_samples FROM v_reads),
    idle AS (SELECT coalesce(list(r::INTEGER ORDER BY r), []::INTEGER[]) AS idle_ranks FROM range({{world}}) t(r) WHERE r NOT IN (SELECT rank FROM v_reads)),
    x AS (SELECT *, samples_measured - unique_samples AS duplicate_samples, CASE WHEN samples_measured >= total_samples THEN greatest(0, total_samples - unique_samples) ELSE 0 END::BIGINT AS missing_samples FROM n, m, idle)
    SELECT {{world}} AS world_size, total_samples, samples_measured, unique_samples, duplicate_samples, missing_samples, round(unique_samples / total_samples::DOUBLE, 6) AS coverage_fraction, array_to_string(idle_ranks, ',') AS idle_ranks, duplicate_samples = 0 AND missing_samples = 0 AND len(idle_ranks) = 0 AS partitioning_valid FROM x"""


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("idle_ranks", F.array_join("idle_ranks", ","))


@query(VERDICT.format(world=10))
def cross_rank_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(coverage.cross_rank_verdict(v.reads(spark, sf), v.universe(spark, sf), 10))


@query("SELECT r::INTEGER AS rank FROM range(10) t(r) WHERE r NOT IN (SELECT rank FROM v_reads)")
def idle_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.idle_ranks(v.reads(spark, sf), 10)


BALANCE = """SELECT count(*) AS ranks, round(sum(samples_per_second), 6) AS total_samples_per_second, round(min(samples_per_second), 6) AS min_rank_throughput, round(max(samples_per_second), 6) AS max_rank_throughput, round(avg(samples_per_second), 6) AS mean_rank_throughput,
    round((max(samples_per_second) - min(samples_per_second)) / max(samples_per_second), 6) AS rank_throughput_spread, round(min(elapsed_seconds), 6) AS min_rank_elapsed, round(max(elapsed_seconds), 6) AS max_rank_elapsed, round((max(elapsed_seconds) - min(elapsed_seconds)) / max(elapsed_seconds), 6) AS rank_elapsed_spread, round(max(data_wait_fraction), 6) AS max_data_wait_fraction FROM v_ranks"""


@query(BALANCE)
def rank_balance(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.rank_balance(v.ranks(spark, sf))


@query("""
    WITH d AS (SELECT count(*) - count(DISTINCT sample_index) AS dup, count(DISTINCT sample_index) AS uniq, count(*) AS n FROM v_reads), t AS (SELECT count(*) AS total FROM part), b AS (SELECT (max(elapsed_seconds) - min(elapsed_seconds)) / max(elapsed_seconds) AS spread, max(data_wait_fraction) AS wait FROM v_ranks),
    i AS (SELECT count(*) AS idle FROM range(10) g(r) WHERE r NOT IN (SELECT rank FROM v_reads)), x AS (SELECT *, CASE WHEN n >= total THEN greatest(0, total - uniq) ELSE 0 END AS miss FROM d, t, b, i)
    SELECT 1 AS ordinal, 'idle-ranks' AS rule_id, 'blocking' AS severity, round(idle::DOUBLE, 6) AS value FROM x WHERE idle > 0
    UNION ALL SELECT 2, 'duplicate-samples', 'blocking', round(dup::DOUBLE, 6) FROM x WHERE dup > 0 UNION ALL SELECT 3, 'missing-samples', 'blocking', round(miss::DOUBLE, 6) FROM x WHERE miss > 0
    UNION ALL SELECT 4, 'rank-imbalance', 'caution', round(spread, 6) FROM x WHERE spread > 0.2 UNION ALL SELECT 5, 'healthy', 'info', 0.0::DOUBLE FROM x WHERE idle = 0 AND dup = 0 AND miss = 0 AND spread <= 0.2 UNION ALL SELECT 6, 'data-wait', 'limitation', round(wait, 6) FROM x WHERE wait > 0.5""")
def distributed_findings(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.distributed_findings(
        coverage.cross_rank_verdict(v.reads(spark, sf), v.universe(spark, sf), 10), coverage.rank_balance(v.ranks(spark, sf))
    )


@query("SELECT count(DISTINCT sample_index) AS distinct_samples FROM v_reads")
def distinct_samples(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.distinct_samples(v.reads(spark, sf))


@query("SELECT DISTINCT rank, sample_index FROM v_reads")
def unique_samples(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.unique_samples(v.reads(spark, sf))


@query("SELECT doc_id, sample_id FROM v_samples WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_samples(spark: SparkSession, sf: str) -> DataFrame:
    return staging.absent_samples(v.samples(spark, sf), v.table(spark, sf, "labels"), "doc_id").select("doc_id", "sample_id")


@query(
    "SELECT epoch, count(*) AS batches, lag(epoch) OVER (ORDER BY min(ordinal)) IS NOT NULL AND lead(epoch) OVER (ORDER BY min(ordinal)) IS NOT NULL AS complete FROM v_batches GROUP BY epoch"
)
def complete_epochs(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.complete_epochs(v.batches(spark, sf))


@query(
    "SELECT count(*) AS batches, round(avg(wait), 6) AS mean_batch_wait_seconds, round(quantile_cont(wait, 0.5), 6) AS median_batch_wait_seconds, round(quantile_cont(wait, 0.95), 6) AS p95_batch_wait_seconds, round(max(wait), 6) AS max_batch_wait_seconds, round(sum(wait) / sum(seconds), 6) AS mean_data_wait_fraction FROM v_batches WHERE ordinal > 20 AND ordinal <= 1020"
)
def batch_wait_profile(spark: SparkSession, sf: str) -> DataFrame:
    measured = batching.measured_window(v.batches(spark, sf), 20, 1000).filter(F.col("window") == "measured")
    return coverage.wait_profile(measured)


@query("""SELECT t AS total, b AS batch, w AS workers, d AS drop_last, s AS streaming, CASE WHEN NOT d OR s THEN t ELSE t // b * b END::BIGINT AS expected, CASE WHEN d AND s THEN (b - 1) * greatest(1, w) ELSE 0 END::BIGINT AS allowance
    FROM (VALUES (10, 4, 2, true, false), (100, 8, 4, true, true), (10, 4, 0, false, false), (50000, 64, 0, true, true)) x(t, b, w, d, s)""")
def coverage_expectation(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(
        [(10, 4, 2, True, False), (100, 8, 4, True, True), (10, 4, 0, False, False), (50000, 64, 0, True, True)],
        "total int, batch int, workers int, drop_last boolean, streaming boolean"
    )
    c = F.col
    return rows.select(
        "*", scalars.expected_samples(c("total"), c("batch"), c("drop_last"), c("streaming")).alias("expected"),
        scalars.missing_allowance(c("batch"), c("workers"), c("drop_last"), c("streaming")).alias("allowance")
    )


@query(
    "SELECT class_id AS reader, (rn - 1) // 4 AS batch, count(*) AS samples FROM (SELECT class_id, row_number() OVER (PARTITION BY class_id ORDER BY sample_id) AS rn FROM v_samples) GROUP BY 1, 2 HAVING count(*) = 4"
)
def reader_batches(spark: SparkSession, sf: str) -> DataFrame:
    return batching.batches(v.samples(spark, sf).withColumnRenamed("class_id", "reader"), 4, True, "reader", "sample_id")


# Inspection


@query(
    "SELECT count(*) AS total_files, sum(size)::BIGINT AS total_bytes, 0::BIGINT AS symlinks, 0::BIGINT AS other_entries, count(*) FILTER (nlink > 1) AS hardlinked_files, 0::BIGINT AS unreadable_directories, 0::BIGINT AS unreadable_files, (SELECT count(*) FROM v_dirs) AS directories, count(*) + (SELECT count(*) FROM v_dirs) AS filesystem_objects FROM v_files"
)
def tree_totals(spark: SparkSession, sf: str) -> DataFrame:
    return inspect.tree_totals(v.files(spark, sf))


@query(
    """SELECT *, round(p95 / nullif(med, 0), 6) AS p95_to_median_ratio FROM (SELECT min(size) AS min_bytes, round(quantile_cont(size, 0.05), 6) AS p5_bytes, round(quantile_cont(size, 0.5), 6) AS median_bytes, round(avg(size), 6) AS mean_bytes, round(quantile_cont(size, 0.95), 6) AS p95_bytes, max(size) AS max_bytes, round(stddev_samp(size) / avg(size), 6) AS coefficient_of_variation, quantile_cont(size, 0.95) AS p95, quantile_cont(size, 0.5) AS med FROM v_files)""".replace(
        "SELECT *,", "SELECT * EXCLUDE (p95, med),"
    )
)
def size_profile(spark: SparkSession, sf: str) -> DataFrame:
    return inspect.size_profile(v.files(spark, sf))


@query(
    "SELECT t AS bytes, count(*) FILTER (size < t) AS files, round(count(*) FILTER (size < t) / count(*)::DOUBLE, 6) AS fraction FROM v_files, (SELECT unnest([4096, 65536, 1048576])::BIGINT AS t) GROUP BY t"
)
def size_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return inspect.size_thresholds(v.files(spark, sf))


@query(
    "SELECT 2048::BIGINT AS threshold_bytes, count(*) FILTER (size < 2048) AS files, round(count(*) FILTER (size < 2048) / count(*)::DOUBLE, 6) AS fraction FROM v_files"
)
def small_files(spark: SparkSession, sf: str) -> DataFrame:
    return inspect.small_files(v.files(spark, sf), 2048)


@query("""
    WITH g AS (SELECT extension, count(*) AS files, sum(size)::BIGINT AS bytes, row_number() OVER (ORDER BY count(*) DESC, extension) AS pos FROM v_files GROUP BY extension)
    SELECT CASE WHEN pos <= 12 THEN extension ELSE '(other)' END AS extension, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, round(sum(files) / (SELECT sum(files) FROM g)::DOUBLE, 6) AS fraction FROM g GROUP BY pos <= 12, 1""")
def extension_mix_top_other(spark: SparkSession, sf: str) -> DataFrame:
    return inspect.extension_mix(v.files(spark, sf))


@query("""
    WITH g AS (SELECT parent, count(*) AS n FROM v_files GROUP BY parent)
    SELECT (SELECT count(*) FROM v_dirs) AS directories, (SELECT max(depth) FROM v_dirs)::INTEGER AS max_depth, max(n) AS max_files_in_one_directory, (SELECT parent FROM g ORDER BY n DESC, parent LIMIT 1) AS max_files_directory, round(sum(n) / (SELECT count(*) FROM v_dirs)::DOUBLE, 6) AS mean_files_per_directory FROM g""")
def directory_shape(spark: SparkSession, sf: str) -> DataFrame:
    return inspect.directory_shape(v.files(spark, sf))


PACKED = ", ".join(f"'{e}'" for e in inspect.COMPRESSED)
PACKAGING = f"""
    WITH t AS (SELECT count(*) AS files, sum(size)::BIGINT AS bytes, coalesce(sum(size) FILTER (extension IN ({PACKED})), 0) AS packed FROM v_files),
    s AS (SELECT *, greatest(1, (bytes + {TARGET - 1}) // {TARGET})::BIGINT AS size_based_shards FROM t), x AS (SELECT *, least(greatest(size_based_shards, 8), files)::BIGINT AS suggested_shards FROM s)
    SELECT files + (SELECT count(*) FROM v_dirs) AS filesystem_objects_now, 1::BIGINT AS filesystem_objects_as_image, round(packed / bytes::DOUBLE, 6) AS already_compressed_byte_fraction, packed / bytes::DOUBLE < 0.5 AS compression_likely_to_help, bytes AS estimated_packaged_bytes, size_based_shards, suggested_shards, files // suggested_shards AS suggested_samples_per_shard, suggested_shards > size_based_shards AS floor_decides FROM x"""


@query(PACKAGING)
def packaging_plan(spark: SparkSession, sf: str) -> DataFrame:
    return inspect.packaging_plan(v.files(spark, sf), TARGET)


@query(
    f"SELECT sum(size)::BIGINT AS total_bytes, {MEMORY}::BIGINT AS allocated_bytes, round(sum(size) / {MEMORY}::DOUBLE, 6) AS dataset_fraction_of_memory, sum(size) / {MEMORY}::DOUBLE <= 0.5 AS tmp_staging_within_safety_margin FROM v_files"
)
def memory_fit(spark: SparkSession, sf: str) -> DataFrame:
    return inspect.memory_fit(v.files(spark, sf), MEMORY)


@query(
    f"SELECT DISTINCT extension, topic FROM v_files JOIN (VALUES {', '.join(f'({e!r}, {t!r})' for e, t in inspect.FORMAT_TOPICS.items())}) h(e, topic) ON extension = e"
)
def format_hints(spark: SparkSession, sf: str) -> DataFrame:
    return inspect.format_hints(v.files(spark, sf))


@query(f"""
    WITH o AS (SELECT count(*) AS n, count(*) FILTER (size < 65536) AS s, sum(size) AS b, quantile_cont(size, 0.5) AS p50, quantile_cont(size, 0.95) AS p95 FROM v_files)
    SELECT 1 AS ordinal, 'loose-file-baseline' AS experiment FROM o WHERE n > 0 UNION ALL SELECT 2, 'squashfs' FROM o WHERE n >= 1000 AND s / n::DOUBLE >= 0.5 UNION ALL SELECT 3, 'webdataset' FROM o WHERE n >= 1000 UNION ALL SELECT 4, 'benchmark-native-representation' FROM o WHERE n < 1000
    UNION ALL SELECT 5, 'shard-balancing' FROM o WHERE p95 / nullif(p50, 0) >= 4 UNION ALL SELECT 6, 'tmp-staging' FROM o WHERE b / {MEMORY}::DOUBLE <= 0.5 UNION ALL SELECT 7, 'avoid-tmp-staging' FROM o WHERE b / {MEMORY}::DOUBLE > 0.5""")
def candidate_experiments(spark: SparkSession, sf: str) -> DataFrame:
    return inspect.candidate_experiments(v.files(spark, sf), MEMORY, many=1000)


# Samples and shards


@query("SELECT sample_id, checksum FROM v_samples")
def sample_checksums(spark: SparkSession, sf: str) -> DataFrame:
    return v.samples(spark, sf).select("sample_id", "checksum")


@query(
    "SELECT checksum, count(*) AS copies, sum(byte_size)::BIGINT AS bytes, min(sample_id) AS first_sample FROM v_samples GROUP BY checksum HAVING count(*) > 1"
)
def duplicate_payloads(spark: SparkSession, sf: str) -> DataFrame:
    return v.samples(spark, sf).groupBy("checksum").agg(
        F.count("*").alias("copies"), F.sum("byte_size").alias("bytes"), F.min("sample_id").alias("first_sample")
    ).filter("copies > 1")


SHARDS = f"""
    WITH r AS (SELECT *, row_number() OVER (ORDER BY md5(sample_id || ':{PLAN.seed}'), sample_id) - 1 AS rank FROM v_samples),
    i AS (SELECT (rank // {PLAN.samples_per_shard})::INTEGER AS shard_id, count(*) AS samples, sum(byte_size)::BIGINT AS sample_bytes, sum(estimated_decode_cost)::BIGINT AS estimated_work, ((sum(512 + (byte_size + 511) // 512 * 512 + 1024) + 1024 + 10239) // 10240 * 10240)::BIGINT AS tar_bytes FROM r GROUP BY 1)"""


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return shards.shard_index(shards.plan_shards(v.samples(spark, sf), PLAN))


@query(SHARDS + " SELECT * FROM i")
def shard_plan_count(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf)


@query(
    SHARDS + " SELECT count(*) AS shards, round(avg(tar_bytes), 6) AS mean_bytes, min(tar_bytes) AS min_bytes, max(tar_bytes) AS max_bytes, round(coalesce(stddev_samp(tar_bytes) / nullif(avg(tar_bytes), 0), 0), 6) AS bytes_cv, round(coalesce(stddev_samp(estimated_work) / nullif(avg(estimated_work), 0), 0), 6) AS work_cv, min(samples) AS min_samples, max(samples) AS max_samples FROM i"
)
def shard_balance_stats(spark: SparkSession, sf: str) -> DataFrame:
    return shards.shard_statistics(_index(spark, sf))


LOADS = SHARDS + f""", a AS (SELECT ((row_number() OVER (ORDER BY shard_id) - 1) % {READERS})::INTEGER AS reader, samples, sample_bytes FROM i),
    l AS (SELECT g.r::INTEGER AS reader, count(a.reader) AS shards, coalesce(sum(samples), 0)::BIGINT AS samples, coalesce(sum(sample_bytes), 0)::BIGINT AS sample_bytes, count(a.reader) = 0 AS is_idle FROM range({READERS}) g(r) LEFT JOIN a ON a.reader = g.r GROUP BY 1)"""


@query(LOADS + " SELECT * FROM l")
def shard_reader_loads(spark: SparkSession, sf: str) -> DataFrame:
    return shards.reader_loads(_index(spark, sf), READERS)


@query(LOADS + """ SELECT *, CASE WHEN idle_readers > 0 THEN 'idle-readers' WHEN lo <> hi THEN 'unequal-shard-counts' WHEN load_spread > 0.2 THEN 'uneven-load' ELSE 'balanced' END AS finding FROM
    (SELECT count(*) AS readers, sum(shards)::BIGINT AS shards, min(samples) AS min_samples, max(samples) AS max_samples, count(*) FILTER (is_idle) AS idle_readers, round(coalesce((max(samples) - min(samples)) / nullif(max(samples), 0)::DOUBLE, 0), 6) AS load_spread, min(shards) AS lo, max(shards) AS hi FROM l)""".replace(
        "SELECT *, CASE", "SELECT * EXCLUDE (lo, hi), CASE"
    ))
def shard_preflight(spark: SparkSession, sf: str) -> DataFrame:
    return shards.preflight(shards.reader_loads(_index(spark, sf), READERS))


TAR_SUM = "((sum(512 + (byte_size + 511) // 512 * 512 + 1024) + 1024 + 10239) // 10240 * 10240)::BIGINT AS tar_bytes"
INDEXED = f"count(*) AS samples, sum(byte_size)::BIGINT AS sample_bytes, sum(estimated_decode_cost)::BIGINT AS estimated_work, {TAR_SUM}"


@query(f"""
    WITH RECURSIVE o AS (SELECT *, row_number() OVER (ORDER BY estimated_decode_cost DESC, sample_id) AS n, (count(*) OVER () + 99) // 100 AS bins FROM v_samples),
    p(n, loads, bin) AS (SELECT 0::BIGINT, list_transform(range((SELECT max(bins) FROM o)), lambda x: 0::BIGINT), 0::BIGINT
        UNION ALL SELECT o.n, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + estimated_decode_cost ELSE x END), list_position(loads, list_min(loads))::BIGINT FROM p JOIN o ON o.n = p.n + 1),
    used AS (SELECT bin, (row_number() OVER (ORDER BY bin) - 1)::INTEGER AS shard_id FROM (SELECT DISTINCT bin FROM p WHERE n > 0))
    SELECT shard_id, {INDEXED} FROM o JOIN p USING (n) JOIN used USING (bin) GROUP BY shard_id""")
def shard_plan_work(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy packing: the costliest sample next, to the shard with least work."""
    return shards.shard_index(shards.plan_shards(v.samples(spark, sf), shards.ShardPlan(100, balance_by="work")))


UNEVEN = shards.ShardPlan(100, imbalance_factor=6.0)
#: The weights that the SQL has at hand: enough for 100,000 samples.
WEIGHTS = shards.uneven_weights(UNEVEN, 1000)


@query(f"""
    WITH r AS (SELECT *, row_number() OVER (ORDER BY md5(sample_id || ':{UNEVEN.seed}'), sample_id) - 1 AS rank FROM v_samples), t AS (SELECT count(*) AS total, greatest(1, (count(*) + 99) // 100) AS n FROM r),
    w AS (SELECT unnest(({WEIGHTS}::DOUBLE[])[1:n]) AS w, unnest(range(n)) AS i, total, n FROM t), lengths AS (SELECT *, greatest(1, round_even(total * w / (SELECT sum(w ORDER BY i) FROM w), 0))::BIGINT AS len FROM w),
    ends AS (SELECT i, CASE WHEN i = n - 1 THEN total ELSE least(total, sum(len) OVER (ORDER BY i)) END AS hi FROM lengths), runs AS (SELECT i, coalesce(lag(hi) OVER (ORDER BY i), 0) AS lo, hi FROM ends),
    kept AS (SELECT lo, hi, (row_number() OVER (ORDER BY i) - 1)::INTEGER AS shard_id FROM runs WHERE hi > lo)
    SELECT shard_id, {INDEXED} FROM r JOIN kept ON rank >= lo AND rank < hi GROUP BY shard_id""")
def shard_plan_imbalanced(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of random lengths; the weights are given to the SQL."""
    return shards.shard_index(shards.plan_shards(v.samples(spark, sf), UNEVEN))


@query(
    "SELECT path, 'size' AS problem FROM v_files WHERE nlink > 1 AND extension <> '.txt' UNION ALL SELECT path, 'absent' FROM v_files WHERE extension = '.txt'"
)
def copy_differences(spark: SparkSession, sf: str) -> DataFrame:
    files = v.files(spark, sf)
    copy = files.filter("extension <> '.txt'").withColumn("size", F.when(F.col("nlink") > 1, F.col("size") + 1).otherwise(F.col("size")))
    return staging.copy_differences(files, copy)


# Runs


@query(f"""
    WITH g AS (SELECT layout AS "group", count(*) AS runs, {", ".join(_stats(m) for m in compare.METRICS)}, {FAILURES}, min(input_ordinal) AS first_seen FROM v_runs GROUP BY 1),
    m AS (SELECT layout AS "group", {", ".join(f"quantile_cont({m}::DOUBLE, 0.5) AS {m}" for m in compare.METRICS)} FROM v_runs GROUP BY 1), b AS (SELECT m.* FROM m JOIN g USING ("group") ORDER BY first_seen LIMIT 1)
    SELECT g.*, g."group" = b."group" AS is_baseline, {", ".join(f"round((m.{x} - b.{x}) / nullif(b.{x}, 0) * 100, 6) AS {x}_percent" for x in compare.METRICS)} FROM g JOIN m USING ("group"), b""")
def layout_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return compare.layout_comparison(v.runs(spark, sf))


FIELDS = " UNION ALL ".join(f"SELECT '{f}' AS field, {f}::VARCHAR AS v FROM v_runs" for f in (*compare.BLOCKING_FIELDS, *compare.CONTROLLED_FIELDS))
MISMATCHES = f"SELECT field, (count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END))::BIGINT AS distinct_values, field IN ('manifest_hash', 'schema_version') AS blocking FROM ({FIELDS}) GROUP BY field HAVING count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) > 1"
WITHIN = " UNION ALL ".join(
    f"""SELECT layout AS "group", '{f}' AS field, (count(DISTINCT {f}) + max(CASE WHEN {f} IS NULL THEN 1 ELSE 0 END))::BIGINT AS distinct_values FROM v_runs GROUP BY layout HAVING count(DISTINCT {f}) + max(CASE WHEN {f} IS NULL THEN 1 ELSE 0 END) > 1""" for f in compare.WITHIN_GROUP_FIELDS
)


@query(MISMATCHES)
def run_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return compare.mismatches(v.runs(spark, sf))


@query(WITHIN)
def within_group_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return compare.within_group_mismatches(v.runs(spark, sf))


@query(
    "SELECT count(DISTINCT s) > 1 AS shuffle_differs FROM (SELECT layout, list(DISTINCT shuffle ORDER BY shuffle) AS s FROM v_runs GROUP BY layout)"
)
def shuffle_differs(spark: SparkSession, sf: str) -> DataFrame:
    return compare.shuffle_differs(v.runs(spark, sf))


@query(f"""
    WITH g AS (SELECT layout AS subject, count(*) AS runs, {CV} AS cv, sum(failed_samples) AS f FROM v_runs GROUP BY 1), m AS ({MISMATCHES}), w AS ({WITHIN})
    SELECT 1 AS ordinal, 'failed-samples' AS rule_id, 'caution' AS severity, subject, round(f::DOUBLE, 6) AS value FROM g WHERE f > 0 UNION ALL SELECT 4, 'single-run', 'caution', subject, runs::DOUBLE FROM g WHERE runs < 2
    UNION ALL SELECT 5, 'noisy', 'caution', subject, round(cv, 6) FROM g WHERE cv > 0.1 AND (SELECT min(runs) FROM g) >= 2 UNION ALL SELECT 6, 'mismatch', CASE WHEN blocking THEN 'blocking' ELSE 'uncontrolled' END, field, distinct_values::DOUBLE FROM m
    UNION ALL SELECT 7, 'within-group', 'uncontrolled', "group" || ':' || field, distinct_values::DOUBLE FROM w""")
def comparison_cautions(spark: SparkSession, sf: str) -> DataFrame:
    return compare.comparison_cautions(v.runs(spark, sf))


def _ladder(spark: SparkSession, sf: str) -> DataFrame:
    return ladder.ladder_rows(v.runs(spark, sf))


@query(
    """SELECT num_workers, count(*) AS runs, round(coalesce(stddev_samp(samples_per_second) / avg(samples_per_second), 0), 6) AS samples_per_second_cv, """ + ", ".join(
        f"round(quantile_cont({m}, 0.5), 6) AS {m}" for m in (
            "samples_per_second", "mean_batch_wait_seconds", "mean_data_wait_fraction", "cpu_utilization", "involuntary_switches_per_second",
            "oversubscription_ratio", "startup_seconds"
        )
    ) + " FROM v_runs GROUP BY num_workers"
)
def worker_ladder_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _ladder(spark, sf).select(
        "num_workers", "runs", "samples_per_second_cv", "samples_per_second", "mean_batch_wait_seconds", "mean_data_wait_fraction", "cpu_utilization",
        "involuntary_switches_per_second", "oversubscription_ratio", "startup_seconds"
    )


RUNGS = """
    WITH r AS (SELECT num_workers AS w, quantile_cont(samples_per_second, 0.5) AS s, quantile_cont(cpu_utilization, 0.5) AS cpu, quantile_cont(mean_data_wait_fraction, 0.5) AS wait, quantile_cont(involuntary_switches_per_second, 0.5) AS sw, quantile_cont(oversubscription_ratio, 0.5) AS o FROM v_runs GROUP BY 1),
    best AS (SELECT w, s FROM r ORDER BY s DESC, w LIMIT 1), ok AS (SELECT * FROM r WHERE o <= 1 OR NOT EXISTS (SELECT 1 FROM r WHERE o <= 1)), aff AS (SELECT w, s FROM ok ORDER BY s DESC, w LIMIT 1),
    rec AS (SELECT min(ok.w) AS w FROM ok, aff WHERE ok.s >= aff.s * 0.95), low AS (SELECT s FROM r ORDER BY w LIMIT 1), l AS (SELECT w, s FROM r ORDER BY w DESC LIMIT 1), p AS (SELECT s FROM r ORDER BY w DESC LIMIT 1 OFFSET 1),
    pat AS (SELECT CASE WHEN low.s <= 0 THEN 'inconclusive' WHEN coalesce((SELECT min(r.s) FROM r WHERE r.w > best.w), best.s) < best.s * 0.95 THEN 'regression' WHEN best.w = l.w AND l.s > p.s * 1.05 THEN 'still-improving' WHEN best.s > low.s * 1.05 THEN 'plateau' ELSE 'flat' END AS pattern FROM best, low, l, p)"""


@query(RUNGS + " SELECT rec.w AS recommended_workers, best.w AS best_workers, aff.w AS best_affordable_workers, pattern FROM rec, best, aff, pat")
def worker_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    return ladder.recommendation(_ladder(spark, sf)).select("recommended_workers", "best_workers", "best_affordable_workers", "pattern")


@query(
    RUNGS + " SELECT CASE pattern WHEN 'still-improving' THEN 'not-yet-saturated' WHEN 'regression' THEN 'oversubscribed' WHEN 'flat' THEN 'not-worker-bound' ELSE CASE WHEN cpu >= 0.85 THEN 'cpu-decode' WHEN wait >= 0.5 THEN 'storage-or-synchronisation' ELSE 'balanced' END END AS limiting_factor, sw > 0 AND (SELECT max(sw) FROM r) >= sw * 10 AS scheduling_note FROM pat, rec JOIN r USING (w)"
)
def limiting_factor(spark: SparkSession, sf: str) -> DataFrame:
    return ladder.recommendation(_ladder(spark, sf)).select("limiting_factor", "scheduling_note")


@query(f"""
    WITH g AS (SELECT num_workers AS w, count(*) AS n, {CV} AS cv, quantile_cont(oversubscription_ratio, 0.5) AS o, quantile_cont(processes_per_physical_core, 0.5) AS p FROM v_runs GROUP BY 1)
    SELECT 1 AS ordinal, 'failed-samples' AS rule_id, 'caution' AS severity, 'ladder' AS subject, sum(failed_samples)::DOUBLE AS value FROM v_runs HAVING sum(failed_samples) > 0
    UNION ALL SELECT 4, 'single-run', 'caution', w::VARCHAR, n::DOUBLE FROM g WHERE n < 2 UNION ALL SELECT 5, 'noisy', 'caution', w::VARCHAR, round(cv, 6) FROM g WHERE cv > 0.1 UNION ALL SELECT 7, 'oversubscribed', 'caution', w::VARCHAR, round(o, 6) FROM g WHERE o > 1 UNION ALL SELECT 8, 'smt-saturated', 'caution', w::VARCHAR, round(p, 6) FROM g WHERE p > 1 AND p <= 2""")
def ladder_cautions(spark: SparkSession, sf: str) -> DataFrame:
    return ladder.ladder_cautions(v.runs(spark, sf))


def _places(spark: SparkSession, sf: str) -> DataFrame:
    return placement.placement_rows(v.runs(spark, sf))


PLACE = f"""
    WITH g AS (SELECT storage, count(*) AS runs, {CV} AS cv, quantile_cont(samples_per_second, 0.5) AS s, quantile_cont(estimated_epoch_seconds, 0.5) AS e, quantile_cont(staging_seconds, 0.5) + quantile_cont(validation_seconds, 0.5) AS c, quantile_cont(dataset_fraction_of_memory, 0.5) AS m, sum(failed_samples) AS f, min(input_ordinal) AS o FROM v_runs GROUP BY 1),
    b AS (SELECT * FROM g WHERE storage = 'scratch'),
    x AS (SELECT g.storage, b.storage AS baseline, b.e - g.e AS saved, g.c - b.c AS cost, (g.s - b.s) / b.s * 100 AS change, sqrt((b.cv * 100) ** 2 + (g.cv * 100) ** 2) AS noise FROM g, b WHERE g.storage <> 'scratch'),
    t AS (SELECT storage, c + e * 3 AS cost, cv, o FROM g), ch AS (SELECT * FROM t ORDER BY cost, o LIMIT 1), pr AS (SELECT * FROM t WHERE storage = 'scratch')"""


@query(
    PLACE.split("b AS")[0].rstrip().rstrip(",") + " SELECT storage, runs, round(cv, 6) AS samples_per_second_cv, round(s, 6) AS samples_per_second, round(e, 6) AS estimated_epoch_seconds, round(c, 6) AS setup_seconds, round(m, 6) AS dataset_fraction_of_memory, f::BIGINT AS failed_samples, o AS first_seen FROM g"
)
def placement_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _places(spark, sf).select(
        "storage", "runs", "samples_per_second_cv", "samples_per_second", "estimated_epoch_seconds", placement.setup_cost().alias("setup_seconds"),
        "dataset_fraction_of_memory", "failed_samples", "first_seen"
    )


@query(
    PLACE + " SELECT storage, baseline, round(saved, 6) AS per_epoch_time_saved, round(cost, 6) AS setup_cost_seconds, round(CASE WHEN saved > 0 THEN CASE WHEN cost > 0 THEN cost / saved ELSE 0 END END, 6) AS break_even_epochs, round(change, 6) AS throughput_change_percent FROM x"
)
def break_even(spark: SparkSession, sf: str) -> DataFrame:
    return placement.break_even(_places(spark, sf)).drop("noise_percent", "indistinguishable")


@query(PLACE + " SELECT storage, round(noise, 6) AS noise_percent, noise > 0 AND abs(change) < noise AS indistinguishable FROM x")
def placement_noise(spark: SparkSession, sf: str) -> DataFrame:
    return placement.break_even(_places(spark, sf)).select("storage", "noise_percent", "indistinguishable")


@query(
    PLACE + " SELECT epochs, storage, round(c + e * epochs, 6) AS total_cost_seconds, row_number() OVER (PARTITION BY epochs ORDER BY c + e * epochs, o) = 1 AS is_cheapest FROM g, (SELECT unnest([1, 3, 10, 50])::INTEGER AS epochs)"
)
def cost_by_horizon(spark: SparkSession, sf: str) -> DataFrame:
    return placement.cost_by_horizon(_places(spark, sf))


TIE = PLACE + ", tie AS (SELECT ch.storage AS cheapest, ch.cost AS cost, (pr.cost - ch.cost) / greatest(ch.cost, 1e-9) AS margin, sqrt(ch.cv * ch.cv + pr.cv * pr.cv) AS band FROM ch, pr), pick AS (SELECT *, cheapest <> 'scratch' AND margin <= band AS broken FROM tie), fin AS (SELECT *, CASE WHEN broken THEN 'scratch' ELSE cheapest END AS rec FROM pick)"


@query(
    TIE + " SELECT rec AS recommended_storage, cheapest, round(cost, 6) AS cheapest_cost, round(margin, 6) AS margin, round(band, 6) AS noise_band, broken AS tie_broken FROM fin"
)
def near_tie_choice(spark: SparkSession, sf: str) -> DataFrame:
    return placement.near_tie_choice(_places(spark, sf), 3)


STAGE = TIE + ", y AS (SELECT CASE WHEN saved > 0 THEN CASE WHEN cost > 0 THEN cost / saved ELSE 0 END END AS even FROM x WHERE storage = 'tmp'), st AS (SELECT CASE WHEN even IS NULL OR even > 3 THEN 'not-recommended' WHEN rec = 'tmp' THEN 'recommended' ELSE 'viable' END AS node_local_staging, even FROM y, fin)"


@query(STAGE + " SELECT node_local_staging, round(even, 6) AS break_even_epochs, 3 AS planned_epochs FROM st")
def staging_decision(spark: SparkSession, sf: str) -> DataFrame:
    return placement.staging_decision(_places(spark, sf), 3)


@query(
    PLACE + " SELECT 1 AS ordinal, 'failed-samples' AS rule_id, 'caution' AS severity, storage AS subject, f::DOUBLE AS value FROM g WHERE f > 0 UNION ALL SELECT 4, 'noisy', 'caution', storage, round(cv, 6) FROM g WHERE cv > 0.1 UNION ALL SELECT 6, 'staged-memory', 'caution', storage, round(m, 6) FROM g WHERE m > 0 UNION ALL SELECT 7, 'indistinguishable', 'caution', storage, round(noise, 6) FROM x WHERE noise > 0 AND abs(change) < noise"
)
def placement_cautions(spark: SparkSession, sf: str) -> DataFrame:
    return placement.placement_cautions(v.runs(spark, sf))


def _sound(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of layouts that all read their data."""
    return v.runs(spark, sf).withColumn(
        "failed_samples", F.when(F.col("layout") == "error", F.col("failed_samples")).otherwise(F.lit(0)).cast("long")
    )


@query(f"""
    WITH z AS (SELECT layout, CASE WHEN layout = 'error' THEN failed_samples ELSE 0 END AS fs, samples_per_second, input_ordinal FROM v_runs)
    SELECT layout AS recommended_layout FROM (SELECT layout, sum(fs) AS f, quantile_cont(samples_per_second, 0.5) AS s, min(input_ordinal) AS o FROM z GROUP BY layout) WHERE f = 0 ORDER BY s DESC, o LIMIT 1""")
def layout_choice(spark: SparkSession, sf: str) -> DataFrame:
    return decide.layout_choice(compare.group_summaries(_sound(spark, sf)))


@query(RUNGS.replace("WITH r AS", STAGE.strip() + ", r AS", 1) + """,
    lf AS (SELECT CASE pattern WHEN 'still-improving' THEN 'not-yet-saturated' WHEN 'regression' THEN 'oversubscribed' WHEN 'flat' THEN 'not-worker-bound' ELSE CASE WHEN cpu >= 0.85 THEN 'cpu-decode' WHEN wait >= 0.5 THEN 'storage-or-synchronisation' ELSE 'balanced' END END AS factor, rec.w AS w, pattern FROM pat, rec JOIN r USING (w)),
    lay AS (SELECT layout, sum(failed_samples) AS f, quantile_cont(samples_per_second, 0.5) AS s, min(input_ordinal) AS o, count(*) AS n FROM v_runs GROUP BY layout), d AS (SELECT count(*) - count(DISTINCT sample_index) AS dup, count(DISTINCT sample_index) AS uniq, count(*) AS n FROM v_reads),
    bal AS (SELECT (max(elapsed_seconds) - min(elapsed_seconds)) / max(elapsed_seconds) AS spread, max(data_wait_fraction) AS wait FROM v_ranks), mi AS (SELECT CASE WHEN n >= (SELECT count(*) FROM part) THEN greatest(0, (SELECT count(*) FROM part) - uniq) ELSE 0 END AS missing FROM d),
    cnt AS (SELECT (SELECT count(*) FROM lay WHERE f > 0) + (dup > 0)::INT + (missing > 0)::INT AS blocking_count, 1 + (pattern = 'still-improving')::INT + (pattern = 'inconclusive')::INT + ((SELECT count(*) FROM x WHERE noise > 0 AND abs(change) < noise) > 0)::INT + (spread > 0.2)::INT AS caution_count, (factor IN ('storage-or-synchronisation', 'cpu-decode'))::INT + (bal.wait > 0.5)::INT AS limitation_count FROM d, mi, bal, lf)
    SELECT blocking_count::BIGINT AS blocking_count, caution_count::BIGINT AS caution_count, limitation_count::BIGINT AS limitation_count, CASE WHEN blocking_count > 0 THEN 'NOT_READY' WHEN caution_count > 0 THEN 'READY_WITH_CAUTION' ELSE 'READY' END AS data_readiness, CASE WHEN blocking_count > 0 THEN 'fix-blocking-issues-then-revalidate' ELSE 'scaling-baseline' END AS next_experiment,
    coalesce((SELECT layout FROM lay WHERE f = 0 ORDER BY s DESC, o LIMIT 1), 'unknown') AS recommended_layout, lf.w AS recommended_workers_per_rank, factor AS main_limiting_factor, rec AS recommended_storage, node_local_staging, CASE WHEN dup = 0 AND missing = 0 THEN 'valid' ELSE 'invalid' END AS distributed_partitioning, 3 AS planned_epochs, 'distributed,inspection,layouts,storage,workers' AS inputs_provided
    FROM cnt, lf, fin, st, d, mi""")
def readiness_verdict(spark: SparkSession, sf: str) -> DataFrame:
    runs = v.runs(spark, sf)
    distributed = coverage.cross_rank_verdict(
        v.reads(spark, sf), v.universe(spark, sf), v.WORLD_SIZE
    ).crossJoin(F.broadcast(coverage.rank_balance(v.ranks(spark, sf))))
    return decide.decide(spark, layouts=runs, distributed=distributed, inspection=v.files(spark, sf), workers=runs, storage=runs)


# Sources and sinks

for _name, (_read, _sql) in roundtrips.QUERIES.items():
    QUERIES[_name], ORACLE_SQL[_name] = _read, _sql
