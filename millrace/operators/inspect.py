"""What a dataset looks like on storage, from one row per file.

``files``: path, parent, depth, kind (file, dir, symlink, other, unreadable_file,
unreadable_dir), size, nlink, extension. Nothing here opens a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import coefficient_of_variation, percentile, ratio

SMALL_FILE_BYTES = 64 * 1024
THRESHOLDS = (4 * 1024, 64 * 1024, 1024 * 1024)
MANY_FILES = 10_000
SMALL_FRACTION = 0.5
SIZE_RATIO = 4.0
TMP_SAFETY_FRACTION = 0.5
TARGET_SHARD_BYTES = 512 * 1024 * 1024
MIN_SHARDS = 8
EXTENSIONS_REPORTED = 12
COMPRESSION_HELPS_BELOW = 0.5

# Extensions of formats whose bytes are compressed already.
COMPRESSED = (
    ".jpg", ".jpeg", ".png", ".webp", ".gif", ".avif", ".heic",
    ".mp3", ".flac", ".ogg", ".opus", ".m4a",
    ".mp4", ".mkv", ".webm", ".mov",
    ".gz", ".bz2", ".xz", ".zst", ".zip", ".7z", ".lz4",
    ".parquet", ".orc",
)

# What a file's extension suggests about its access, by topic.
FORMAT_TOPICS = {
    ".parquet": "columnar-table", ".arrow": "arrow-table", ".h5": "dense-array", ".hdf5": "dense-array", ".nc": "netcdf-array", ".zarr": "chunked-array",
    ".npy": "numpy-intermediate", ".npz": "numpy-intermediate", ".tar": "tar-package", ".squashfs": "filesystem-image", ".sqfs": "filesystem-image",
    ".tfrecord": "record-stream", ".sqlite": "embedded-database", ".mdb": "embedded-database",
}


def regular(files: DataFrame) -> DataFrame:
    return files.filter("kind = 'file'")


def directories(files: DataFrame) -> DataFrame:
    """Every directory: path and depth. The root ``''`` (depth 0), those that are entries themselves, empty or unreadable ones too, and those above any entry."""
    own = files.filter("kind in ('dir', 'unreadable_dir') and path <> ''").select(F.col("path").alias("p"))
    named = files.filter("parent <> ''").select(F.col("parent").alias("p")).union(own).distinct().select(F.split("p", "/").alias("p"))
    above = named.select(F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"), "p").select(
        F.concat_ws("/", F.slice("p", 1, F.col("depth"))).alias("path"), "depth"
    ).distinct()
    return above.union(files.sparkSession.sql("select '' as path, 0 as depth"))


def tree_totals(files: DataFrame) -> DataFrame:
    """One row of counts over every entry."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    found = files.agg(
        kind("file").alias("total_files"), F.coalesce(
            F.sum(F.when(F.col("kind") == "file", F.col("size"))), F.lit(0)
        ).alias("total_bytes"), kind("symlink").alias("symlinks"), kind("other").alias("other_entries"),
        F.count_if(
            (F.col("kind") == "file") & (F.col("nlink") > 1)
        ).alias("hardlinked_files"), kind("unreadable_dir").alias("unreadable_directories"), kind("unreadable_file").alias("unreadable_files"),
    )
    dirs = directories(files).agg(F.count("*").alias("directories"))
    return found.crossJoin(F.broadcast(dirs)).withColumn("filesystem_objects", F.col("total_files") + F.col("directories"))


def directory_shape(files: DataFrame) -> DataFrame:
    """Directories, depth, and the directory that holds most files (ties: the first path)."""
    each = regular(files).groupBy("parent").agg(F.count("*").alias("n"))
    busiest = each.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("max_files_in_one_directory"),
        F.coalesce(F.min_by("parent", F.struct(-F.col("n"), "parent")), F.lit("")).alias("max_files_directory"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("files")
    )
    dirs = directories(files).agg(F.count("*").alias("directories"), F.max("depth").alias("max_depth"))
    both = dirs.crossJoin(F.broadcast(busiest))
    return both.select(
        "directories", "max_depth", "max_files_in_one_directory", "max_files_directory",
        (F.col("files") / F.col("directories")).alias("mean_files_per_directory")
    )


def size_profile(files: DataFrame) -> DataFrame:
    found = regular(files).agg(
        F.coalesce(F.min("size"), F.lit(0)).alias("min_bytes"), percentile("size", 5.0).alias("p5_bytes"), percentile("size", 50.0).alias("median_bytes"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean_bytes"),
        percentile("size", 95.0).alias("p95_bytes"), F.coalesce(F.max("size"), F.lit(0)).alias("max_bytes"), coefficient_of_variation("size").alias("coefficient_of_variation"),
    )
    return found.withColumn("p95_to_median_ratio", ratio("p95_bytes", "median_bytes"))


def size_thresholds(files: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Per threshold: files strictly below it, and their fraction. One pass over the files."""
    limits = sorted({int(t) for t in thresholds})
    one = regular(files).agg(F.count("*").alias("n"), *[F.count_if(F.col("size") < t).alias(f"b{t}") for t in limits])
    rows = F.array(
        *[F.struct(F.lit(t).cast("long").alias("bytes"), F.col(f"b{t}").alias("files"), ratio(f"b{t}", "n").alias("fraction")) for t in limits]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def small_files(files: DataFrame, threshold: int = SMALL_FILE_BYTES) -> DataFrame:
    one = regular(files).agg(F.count("*").alias("n"), F.count_if(F.col("size") < threshold).alias("files"))
    return one.select(F.lit(threshold).cast("long").alias("threshold_bytes"), "files", ratio("files", "n").alias("fraction"))


def extension_mix(files: DataFrame, reported: int = EXTENSIONS_REPORTED) -> DataFrame:
    """The commonest extensions (files falling, then name) and one row ``(other)`` for what remains."""
    each = regular(files).groupBy("extension").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("files"), "extension"))  # one row per extension
    named = each.withColumn("_at", place).withColumn("extension", F.when(F.col("_at") <= reported, F.col("extension")).otherwise(F.lit("(other)")))
    total = F.sum(F.sum("files")).over(Window.partitionBy(F.lit(0)))
    return named.groupBy("extension", (F.col("_at") <= reported).alias("_own")).agg(
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), (F.sum("files") / total).alias("fraction")
    ).drop("_own")


def packaging_plan(files: DataFrame, target_shard_bytes: int = TARGET_SHARD_BYTES, min_shards: int = MIN_SHARDS) -> DataFrame:
    """How many shards a tree would make, and whether compressing again could help."""
    found = regular(files).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(F.col("extension").isin(*COMPRESSED), F.col("size"))), F.lit(0)).alias("packed")
    )
    dirs = directories(files).agg(F.count("*").alias("directories"))
    found = found.crossJoin(F.broadcast(dirs))
    by_size = F.expr(f"(bytes + {target_shard_bytes - 1}) div {target_shard_bytes}")
    found = found.withColumn("size_based_shards", F.when(F.col("bytes") > 0, F.greatest(F.lit(1), by_size)).otherwise(F.lit(0)).cast("long"))
    found = found.withColumn("suggested_shards", F.least(F.greatest("size_based_shards", F.lit(min_shards)), "files").cast("long"))
    return found.select(
        (
            F.col("files") + F.col("directories")
        ).alias("filesystem_objects_now"), F.when(F.col("files") > 0, 1).otherwise(0).cast("long").alias("filesystem_objects_as_image"), ratio("packed", "bytes").alias(
            "already_compressed_byte_fraction"
        ),
        (
            ratio("packed", "bytes") < COMPRESSION_HELPS_BELOW
        ).alias("compression_likely_to_help"), F.col("bytes").alias("estimated_packaged_bytes"), "size_based_shards", "suggested_shards",
        F.when(
            F.col("suggested_shards") > 0, F.expr("files div suggested_shards")
        ).otherwise(F.lit(0)).cast("long").alias("suggested_samples_per_shard"), (
            F.col("suggested_shards") > F.col("size_based_shards")
        ).alias("floor_decides"),
    )


def memory_fit(files: DataFrame, memory_bytes: int | None, safety_fraction: float = TMP_SAFETY_FRACTION) -> DataFrame:
    """Three-valued: null where the memory is not known or not positive."""
    memory = F.lit(memory_bytes if memory_bytes and memory_bytes > 0 else None).cast("long")
    one = regular(files).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))
    part = F.col("total_bytes") / memory
    return one.select(
        "total_bytes", F.lit(memory_bytes).cast("long").alias("allocated_bytes"), part.alias("dataset_fraction_of_memory"),
        (part <= safety_fraction).alias("tmp_staging_within_safety_margin")
    )


def format_hints(files: DataFrame) -> DataFrame:
    table = files.sparkSession.createDataFrame(list(FORMAT_TOPICS.items()), "extension string, topic string")
    return regular(files).select("extension").distinct().join(F.broadcast(table), "extension")  # 14 rows


def candidate_experiments(
        files: DataFrame, memory_bytes: int | None = None, safety_fraction: float = TMP_SAFETY_FRACTION, small: int = SMALL_FILE_BYTES,
        many: int = MANY_FILES
) -> DataFrame:
    """(ordinal, experiment): what to measure next, the baseline first."""
    one = regular(files).agg(
        F.count("*").alias("n"), F.count_if(F.col("size") < small).alias("s"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"),
        percentile("size", 50.0).alias("p50"), percentile("size", 95.0).alias("p95")
    )
    bad = files.agg(F.count_if(F.col("kind").startswith("unreadable")).alias("bad"))
    one = one.crossJoin(F.broadcast(bad))
    n, large = F.col("n") > 0, F.col("n") >= many
    mostly_small = ratio("s", "n") >= SMALL_FRACTION
    fits = F.col("b") / F.lit(memory_bytes if memory_bytes and memory_bytes > 0 else None).cast("long") <= safety_fraction
    rules = [
        ("none", ~n), ("loose-file-baseline", n), ("squashfs", n & large & mostly_small), ("webdataset", n & large), (
            "benchmark-native-representation", n & ~large
        ),
        (
            "shard-balancing", n & (ratio("p95", "p50") >= SIZE_RATIO)
        ), ("tmp-staging", n & fits), ("avoid-tmp-staging", n & ~fits), ("fix-permissions-first", n & (F.col("bad") > 0)),
    ]
    rows = F.array(
        *[
            F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("experiment"))) for i,
            (name, c) in enumerate(rules)
        ]
    )
    return one.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select("r.*")


def inspection_report(
        files: DataFrame, memory_bytes: int | None = None, thresholds: Sequence[int] = THRESHOLDS, small: int = SMALL_FILE_BYTES,
        target_shard_bytes: int = TARGET_SHARD_BYTES, safety_fraction: float = TMP_SAFETY_FRACTION
) -> DataFrame:
    """All sections as one nested row."""
    as_struct = lambda df, name: df.select(F.struct("*").alias(name))
    as_list = lambda df, name, key: df.agg(
        F.sort_array(F.collect_list(F.struct(key, *[c for c in df.columns if c != key]))).alias(name)
    )
    parts = [
        as_struct(tree_totals(files), "tree"), as_struct(size_profile(files), "file_sizes"), as_list(
            size_thresholds(files, thresholds), "thresholds", "bytes"
        ), as_struct(small_files(files, small), "small_files"), as_list(extension_mix(files), "extensions", "extension"),
        as_struct(directory_shape(files), "directories"), as_struct(packaging_plan(files, target_shard_bytes), "packaging"), as_struct(
            memory_fit(files, memory_bytes, safety_fraction), "memory"
        ), as_list(format_hints(files), "format_hints", "extension"), as_list(
            candidate_experiments(files, memory_bytes, safety_fraction, small), "candidates", "ordinal"
        ),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.crossJoin(F.broadcast(p))
    return whole.withColumn("report_version", F.lit("1.0"))
