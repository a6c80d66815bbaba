import heapq
import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import ordering, shards
from millrace.sources import manifest, synthetic, tarshards, tracks


def samples(spark, n, cost=100, extra=()):
    rows = [(f"s{i:08d}", 1000 + i, cost) for i in range(n)] + [(f"s{n + i:08d}", 9, c) for i, c in enumerate(extra)]
    return spark.createDataFrame(rows, "sample_id string, byte_size long, estimated_decode_cost long")


def groups(df):
    found = {}
    for r in df.orderBy("shard_id", "position").collect():
        found.setdefault(r.shard_id, []).append(r.sample_id)
    return found


@pytest.mark.parametrize(
    "plan",
    [shards.ShardPlan(10), shards.ShardPlan(10, balance_by="work"), shards.ShardPlan(10, imbalance_factor=6.0), shards.ShardPlan(10, shuffle=False)]
)
def test_every_sample_is_planned_once(spark, plan):
    found = groups(shards.plan_shards(samples(spark, 33), plan))
    assert sorted(x for g in found.values() for x in g) == [f"s{i:08d}" for i in range(33)]
    assert sorted(found) == list(range(len(found)))
    assert groups(shards.plan_shards(samples(spark, 33).repartition(3), plan)) == found


def test_counts_and_order(spark):
    plain = groups(shards.plan_shards(samples(spark, 25), shards.ShardPlan(10, shuffle=False)))
    assert [len(plain[i]) for i in range(3)] == [10, 10, 5] and plain[0][0] == "s00000000" and plain[2][-1] == "s00000024"
    mixed = groups(shards.plan_shards(samples(spark, 25), shards.ShardPlan(10)))
    assert [len(mixed[i]) for i in range(3)] == [10, 10, 5] and mixed != plain
    assert groups(shards.plan_shards(samples(spark, 25), shards.ShardPlan(10, seed=9))) != mixed


def test_work_balance_is_the_greedy_loop(spark):
    rows = samples(spark, 20, extra=(10_000,) * 4)
    found = shards.plan_shards(rows, shards.ShardPlan(6, balance_by="work"))
    heap, want = [(0, i) for i in range(4)], {}
    for r in sorted(rows.collect(), key=lambda r: (-r.estimated_decode_cost, r.sample_id)):
        load, i = heapq.heappop(heap)
        want.setdefault(i, []).append(r.sample_id)
        heapq.heappush(heap, (load + r.estimated_decode_cost, i))
    assert groups(found) == want


def test_imbalance_is_uneven(spark):
    even = shards.shard_statistics(shards.shard_index(shards.plan_shards(samples(spark, 400), shards.ShardPlan(20)))).first()
    uneven = shards.shard_statistics(shards.shard_index(shards.plan_shards(samples(spark, 400), shards.ShardPlan(20, imbalance_factor=6.0)))).first()
    assert even.min_samples == even.max_samples == 20 and uneven.max_samples > 1.5 * uneven.min_samples and uneven.work_cv > even.work_cv


@pytest.mark.parametrize("readers", [1, 3, 8])
def test_assignment_is_disjoint_and_complete(spark, readers):
    index = shards.shard_index(shards.plan_shards(samples(spark, 50), shards.ShardPlan(10)))
    loads = shards.reader_loads(index, readers)
    assert loads.count() == readers and loads.agg(F.sum("samples")).first()[0] == 50
    assert loads.filter("is_idle").count() == max(0, readers - 5)
    assert shards.preflight(loads).first().finding == {1: "balanced", 3: "unequal-shard-counts", 8: "idle-readers"}[readers]


def test_bad_plans():
    for plan in (shards.ShardPlan(0), shards.ShardPlan(balance_by="x"), shards.ShardPlan(imbalance_factor=0.5)):
        with pytest.raises(ValueError):
            plan.validate()


def test_shards_round_trip_and_rebuild_alike(spark, tmp_path):
    made = synthetic.samples(spark, synthetic.Profile("t", 40, 16, 16, classes=4)).withColumn("extension", F.lit("jpg")).cache()
    plan = shards.ShardPlan(12)
    for name in ("a", "b"):
        rows = made if name == "a" else made.repartition(5)
        members = rows.join(shards.plan_shards(rows, plan).select("sample_id", "shard_id", "position"), "sample_id")
        index = tarshards.write_shards(members, str(tmp_path / name), plan)
    assert all((tmp_path / "a" / n.name).read_bytes() == n.read_bytes() for n in (tmp_path / "b").iterdir())
    want = shards.shard_index(shards.plan_shards(made, plan)).select("shard_id", "tar_bytes")
    assert {tuple(r) for r in want.collect()} == {(r.shard_id, r.bytes) for r in index.collect()}
    back = tarshards.read_shards(spark, str(tmp_path / "a"))
    assert {
        (r.sample_id, bytes(r.payload), r.class_id) for r in back.collect()
    } == {(r.sample_id, bytes(r.payload), r.class_id) for r in made.collect()}
    parts = [tarshards.read_shards(spark, str(tmp_path / "a"), i, 3).count() for i in range(3)]
    assert sum(parts) == 40 and min(parts) > 0
    listed = tarshards.read_index(spark, str(tmp_path / "a" / "shard_index.json"))
    assert listed.agg(F.sum("samples")).first()[0] == 40


@pytest.mark.parametrize("fmt", ["parquet", "arrow"])
def test_formats_return_the_same_bytes(spark, tmp_path, fmt):
    made = synthetic.samples(spark, synthetic.Profile("t", 30, 16, 16, classes=4))
    record = tracks.convert(made, fmt, str(tmp_path / fmt), 10)
    assert record["rows"] == 30
    back = tracks.read_track(spark, str(tmp_path / fmt), fmt, 30)
    assert {(r.sample_id, bytes(r.payload)) for r in back.collect()} == {(r.sample_id, bytes(r.payload)) for r in made.collect()}
    with pytest.raises(ValueError):
        tracks.convert(made, fmt, str(tmp_path / fmt))
    with pytest.raises(ValueError):
        tracks.read_track(spark, str(tmp_path / fmt), fmt, 31)


def test_manifest_round_trip_and_errors(spark, tmp_path):
    made = synthetic.samples(spark, synthetic.Profile("t", 12, 16, 16, classes=4)).drop("payload")
    a, b = str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")
    manifest.write_manifest(made, a)
    manifest.write_manifest(made.repartition(4).orderBy(F.desc("sample_id")), b)
    assert manifest.manifest_hash(a) == manifest.manifest_hash(b)
    assert manifest.read_manifest(spark, a).count() == 12
    lines = open(a).read().splitlines()
    for bad, text in (
            (lines + [lines[0]], "line 13"), ([lines[0], "", "{"], "line 3"), ([lines[0].replace('"width"', '"wide"')], "lacks"),
            ([lines[0][:-1] + ', "more": 1}'], "unknown"), ([lines[1], lines[0].replace('"width": 16', '"width": "16"')], "line 2.*width")
    ):
        p = tmp_path / "bad.jsonl"
        p.write_text("\n".join(bad) + "\n")
        with pytest.raises(ValueError, match=text):
            manifest.read_manifest(spark, str(p))
    with pytest.raises(ValueError):
        manifest.write_manifest(made.union(made), b)


def test_loose_files_and_failures(spark, tmp_path):
    made = synthetic.samples(spark, synthetic.Profile("t", 6, 16, 16, classes=2)).cache()
    for r in made.collect()[:5]:
        p = tmp_path / r.relative_path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(bytes(r.payload))
    back = manifest.payloads(made.drop("payload"), str(tmp_path)).collect()
    assert [r.failed for r in sorted(back, key=lambda r: r.sample_id)] == [False] * 5 + [True]
    assert sum(r.read_bytes for r in back) == sum(len(r.payload) for r in made.collect()[:5])
    changed = made.orderBy("sample_id").first()
    (tmp_path / changed.relative_path).write_bytes(b"\0" + bytes(changed.payload)[1:])
    assert [
        r.failed for r in manifest.payloads(made.drop("payload"), str(tmp_path), verify=True).orderBy("sample_id").collect()
    ] == [True, False, False, False, False, True]


def test_ranges_of_ids_are_even_in_sorted_input(spark):
    rows = spark.range(0, 60_000, 1, 6).select(F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("sample_id"))
    found = rows.withColumn("b", ordering.range_bucket(rows, "sample_id", 1000)).groupBy("b").agg(
        F.count("*").alias("n"), F.min("sample_id").alias("lo"), F.max("sample_id").alias("hi")
    ).orderBy("b").collect()
    assert len(found) > 50 and max(r.n for r in found) < 5000 and all(a.hi < b.lo for a, b in zip(found, found[1:]))
    ranks = ordering.ranked(rows, [], ordering.range_bucket(rows, "sample_id", 1000), ["sample_id"], total="total")
    assert ranks.filter("rank <> cast(substring(sample_id, 2) as long) or total <> 60000").count() == 0
    odd = spark.createDataFrame([(None,), ("a",), ("a",), ("b",)], "sample_id string")
    assert sorted(r["rank"] for r in ordering.ranked(odd, [], ordering.range_bucket(odd, "sample_id", 1), ["sample_id"]).collect()) == [0, 1, 2, 3]


def test_shards_in_a_seeded_order_and_broken_ones(spark, tmp_path):
    made = synthetic.samples(spark, synthetic.Profile("t", 40, 16, 16, classes=4)).withColumn("extension", F.lit("jpg")).cache()
    plan = shards.ShardPlan(samples_per_shard=5)
    members = made.join(shards.plan_shards(made.drop("payload", "extension"), plan).select("sample_id", "shard_id", "position"), "sample_id")
    tarshards.write_shards(members, str(tmp_path), plan)
    whole = json.load(open(tmp_path / tarshards.INDEX_NAME))
    assert open(tmp_path / tarshards.INDEX_NAME).read() == json.dumps(whole, indent=2, sort_keys=True) + "\n" and sum(
        len(s["sample_ids"]) for s in whole["shards"]
    ) == 40
    assert not [n for n in os.listdir(tmp_path) if n.startswith(".") and not n.endswith(".crc")]
    order = lambda seed: [os.path.basename(p.path) for p in tarshards.TarShardReader(str(tmp_path), 0, 1, seed, True).partitions()]
    assert order(3) == order(3) and sorted(order(3)) == order(None) and len({tuple(order(i)) for i in range(5)}) > 1
    dealt = [r.sample_id for k in range(3) for r in tarshards.read_shards(spark, str(tmp_path), k, 3, seed=7).collect()]
    assert sorted(dealt) == sorted(r.sample_id for r in made.collect())
    with open(tmp_path / "shard-00002.tar", "r+b") as f:
        f.truncate(2000)
    (tmp_path / "shard-00099.tar").write_bytes(b"no tar file at all" * 99)
    left = {r.shard for r in tarshards.read_shards(spark, str(tmp_path)).collect()}
    assert len(left) >= 7 and "shard-00099.tar" not in left
    with pytest.raises(Exception):  # noqa: B017
        tarshards.read_shards(spark, str(tmp_path), broken="fail").collect()


def test_rows_by_position(spark, tmp_path):
    made = synthetic.samples(spark, synthetic.Profile("t", 57, 16, 16, classes=4)).cache()
    tracks.convert(made, "parquet", str(tmp_path), group_rows=4)
    bounds = tracks.group_bounds(spark, str(tmp_path)).collect()
    assert bounds[0].start == 0 and bounds[-1].end == 57 and all(a.end == b.start and a.end - a.start <= 4 for a, b in zip(bounds, bounds[1:]))
    want = {i: r for i, r in enumerate(made.orderBy("sample_id").collect())}
    asked = spark.createDataFrame([(i,) for i in [*range(56, -1, -2), 3, 3, 57, -1]], "position long")
    found = tracks.read_positions(asked, str(tmp_path), 57).collect()
    assert len(found) == 33 and {r.position for r in found if r.failed} == {57, -1}
    assert all(
        (r.sample_id, r.class_id, bytes(r.payload)) == (
            want[r.position].sample_id, want[r.position].class_id, bytes(want[r.position].payload)
        ) for r in found if not r.failed
    )
    with pytest.raises(ValueError):
        tracks.read_positions(asked, str(tmp_path), 58)
