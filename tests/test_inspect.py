import os

import pytest

from millrace import render
from millrace.errors import StagingError
from millrace.functions import scalars
from millrace.operators import inspect, staging
from millrace.sources import treewalk
from pyspark.sql import functions as F


def tree(tmp_path, sizes):
    for name, n in sizes.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * n)
    return str(tmp_path)


def files(spark, sizes, ext=".jpg"):
    return spark.createDataFrame(
        [(f"d/{i}{ext}", "d", 1, "file", n, 1, ext) for i, n in enumerate(sizes)],
        "path string, parent string, depth int, kind string, size long, nlink int, extension string"
    )


def test_walk_counts(spark, tmp_path):
    root = tree(tmp_path, {"a/one.jpg": 10, "a/two.jpg": 20, "b/three.png": 30})
    (tmp_path / "link").symlink_to(tmp_path / "a/one.jpg")
    found = treewalk.walk(spark, root)
    t = inspect.tree_totals(found).first()
    assert (t.total_files, t.total_bytes, t.directories, t.filesystem_objects, t.symlinks) == (3, 60, 3, 6, 1)
    d = inspect.directory_shape(found).first()
    assert (d.max_depth, d.max_files_in_one_directory, d.max_files_directory) == (1, 2, "a")


def test_empty_directories_count(spark, tmp_path):
    root = tree(tmp_path, {"a/one.jpg": 10, "b/c/d/two.jpg": 20})
    for name in ("a/empty", "b/none/none"):
        (tmp_path / name).mkdir(parents=True)
    t = inspect.tree_totals(treewalk.walk(spark, root)).first()
    assert (t.total_files, t.directories, t.filesystem_objects) == (2, 8, 10)  # the root, a, a/empty, b, b/c, b/c/d, b/none, b/none/none
    d = inspect.directory_shape(treewalk.walk(spark, root)).first()
    assert (d.directories, d.max_depth, d.mean_files_per_directory) == (8, 3, 0.25)


def test_one_deep_directory_is_dealt_to_tasks(spark, tmp_path):
    root = tree(tmp_path, {f"only/way/d{i}/e{j}/f.bin": 1 for i in range(12) for j in range(3)})
    parts = treewalk.TreeWalkReader(root, 4).partitions()
    assert len(parts) == 4 and all(len([r for r in treewalk.TreeWalkReader(root, 4)._rows(p) if r[3] == "file"]) >= 6 for p in parts)
    found = treewalk.walk(spark, root, 4).collect()
    want = {os.path.relpath(os.path.join(at, n), root) for at, inner, names in os.walk(root) for n in inner + names}
    assert sorted(r.path for r in found) == sorted(want) and {r.parent for r in found if r.kind == "file"} == {
        f"only/way/d{i}/e{j}" for i in range(12) for j in range(3)
    }


def test_walk_of_one_file_and_of_nothing(spark, tmp_path):
    root = tree(tmp_path, {"x.tar.gz": 7, ".hidden/.bashrc": 1})
    assert [(r.kind, r["size"], r.extension) for r in treewalk.walk(spark, root + "/x.tar.gz").collect()] == [("file", 7, ".gz")]
    kinds = {r.path: (r.kind, r.extension) for r in treewalk.walk(spark, root).collect()}
    assert kinds[".hidden/.bashrc"] == ("file", "(none)") and kinds[".hidden"][0] == "dir"


def test_extension_of_names(spark):
    rows = spark.createDataFrame(
        [("a.JPG",), ("x.tar.gz",), (".bashrc",), ("none",)], "n string"
    ).select(scalars.extension(F.col("n")).alias("e")).collect()
    assert [r.e for r in rows] == [".jpg", ".gz", "(none)", "(none)"]
    assert [treewalk.extension_of(n) for n in ("a.JPG", "x.tar.gz", ".bashrc", "none")] == [".jpg", ".gz", "(none)", "(none)"]


def test_outlier_moves_cv_but_not_the_ratio(spark):
    found = inspect.size_profile(files(spark, [1000] * 200 + [5_000_000])).first()
    assert found.p95_to_median_ratio < 1.5 and found.coefficient_of_variation > 1
    names = [r.experiment for r in inspect.candidate_experiments(files(spark, [1000] * 200 + [5_000_000])).orderBy("ordinal").collect()]
    assert "shard-balancing" not in names


def test_thresholds_are_strict_and_sorted(spark):
    found = inspect.size_thresholds(files(spark, [100, 5000, 100_000]), [10_000, 1000, 1000]).collect()
    assert [(r.bytes, r.files) for r in found] == [(1000, 1), (10_000, 2)]


def test_packaging_floor_and_target(spark):
    rows = files(spark, [1000] * 100)
    assert tuple(
        inspect.packaging_plan(rows, 10_000).select("size_based_shards", "suggested_shards", "suggested_samples_per_shard").first()
    ) == (10, 10, 10)
    assert tuple(inspect.packaging_plan(rows).select("size_based_shards", "suggested_shards", "suggested_samples_per_shard").first()) == (1, 8, 12)
    assert inspect.packaging_plan(files(spark, [1000] * 10, ".npy")).first().compression_likely_to_help


def test_memory_is_three_valued(spark):
    rows = files(spark, [1000] * 10)
    assert inspect.memory_fit(rows, None).first().tmp_staging_within_safety_margin is None
    for memory, name in ((1_000_000, "tmp-staging"), (12_000, "avoid-tmp-staging")):
        assert name in [r.experiment for r in inspect.candidate_experiments(rows, memory).collect()]


def test_many_small_files(spark):
    rows = spark.range(10_000).select(
        F.concat(F.lit("d/"), F.col("id").cast("string")).alias("path"), F.lit("d").alias("parent"), F.lit(1).alias("depth"),
        F.lit("file").alias("kind"), F.lit(2048).cast("long").alias("size"), F.lit(1).alias("nlink"), F.lit(".jpg").alias("extension")
    )
    assert [
        r.experiment for r in inspect.candidate_experiments(rows).orderBy("ordinal").collect()
    ] == ["loose-file-baseline", "squashfs", "webdataset"]


def test_empty_tree(spark):
    none = files(spark, [1]).limit(0)
    assert [r.experiment for r in inspect.candidate_experiments(none).collect()] == ["none"]
    assert inspect.size_profile(none).first().p95_bytes == 0.0
    assert inspect.inspection_report(none).first().tree.total_files == 0


def test_copies_and_memory_guard(spark):
    a = files(spark, [10, 20, 30])
    b = files(spark, [10, 21])
    assert {(r.path, r.problem) for r in staging.copy_differences(a, b).collect()} == {("d/1.jpg", "size"), ("d/2.jpg", "absent")}
    staging.check_safety(10, 100, 0.5)
    for args in ((10, None, 0.5), (60, 100, 0.5), (1, 100, 0.0)):
        with pytest.raises(StagingError):
            staging.check_safety(*args)


def test_staged_copy_is_checked_and_goes(spark, tmp_path):
    root = tree(tmp_path / "data", {"a/one.jpg": 10, "b/two.jpg": 20})
    at = str(tmp_path / "tmp")
    with staging.staged(spark, root, at, 1000) as copy:
        assert (copy["staged_files"], copy["staged_bytes"], copy["dataset_fraction_of_memory"]) == (2, 30, 0.03)
        assert os.path.getsize(os.path.join(copy["staged_path"], "b/two.jpg")) == 20
        with pytest.raises(StagingError), staging.staged(spark, root, at, 1000):
            pass
        assert os.path.isdir(copy["staged_path"])
    assert not os.path.exists(at)
    for memory, source in ((40, root), (None, root), (1000, root + "/none")):
        with pytest.raises(StagingError), staging.staged(spark, source, at, memory):
            pass
    assert not os.path.exists(at)
    with staging.staged(spark, root + "/a/one.jpg", str(tmp_path), 1000) as copy:
        assert copy["staged_files"] == 1
    assert os.path.isdir(root) and not os.path.exists(tmp_path / "one.jpg")


def test_reports_as_text(spark):
    row = inspect.inspection_report(files(spark, [100] * 9 + [100_000])).first()
    assert "10 files" in render.dataset_sentence(row) and render.dataset_sentence(inspect.inspection_report(files(spark, [])).first()) == ""
    details = render.inspection_details(row)
    assert "under 4096 bytes: 9 files, 90.0%" in details and ".jpg: 10 files" in details and "1. loose-file-baseline" in details
    assert "8 shards of some 1 samples, so that readers have shards to share" in details
    assert "not judged" in render.accounting_note(0) and render.accounting_note(2).startswith("2 whole epochs")
