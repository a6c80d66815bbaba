import json

import pytest

from millrace import config, env, render
from millrace.cli import main
from millrace.operators import compare, decide, ladder, placement
from millrace.sources import runs

BASE = dict(
    layout="loose", storage="scratch", num_workers=4, batch_size=64, seed=1234, manifest_hash="m", measured_batches=200, compute_steps=1, shuffle=True
)


def frame(spark, rows):
    made = [runs.new_summary(**(BASE | r)) for r in rows]
    names = sorted({k for r in made for k in r})
    types = ", ".join(f"{k} {runs.TYPES[k]}" for k in names)
    return spark.createDataFrame([(i, *[r.get(k) for k in names]) for i, r in enumerate(made)], f"input_ordinal long, {types}")


def rungs(spark, found, **more):
    return frame(spark, [dict(num_workers=w, samples_per_second=float(s), oversubscription_ratio=(w + 1) / 14) | more for w, s in found])


@pytest.mark.parametrize(
    ("found", "more", "want"),
    [
        ([(0, 100), (2, 400), (7, 900)], {}, (7, 7, "still-improving", "not-yet-saturated")),
        ([(0, 100), (2, 900), (7, 920)], {}, (2, 7, "plateau", "balanced")),
        ([(0, 100), (2, 900), (7, 950), (28, 400)], {}, (7, 7, "regression", "oversubscribed")),
        ([(0, 100), (2, 900), (7, 910)], {"cpu_utilization": 0.9}, (2, 7, "plateau", "cpu-decode")),
        ([(0, 100), (2, 900), (7, 905)], {"cpu_utilization": 0.2, "mean_data_wait_fraction": 0.9}, (2, 7, "plateau", "storage-or-synchronisation")),
        ([(0, 100), (2, 101), (7, 102)], {}, (0, 7, "flat", "not-worker-bound")),
        ([(0, 100), (2, 900), (7, 1200), (28, 2000)], {}, (7, 28, "still-improving", "not-yet-saturated")),
    ],
)
def test_ladder_shapes(spark, found, more, want):
    r = ladder.recommendation(ladder.ladder_rows(rungs(spark, found, **more))).first()
    assert (r.recommended_workers, r.best_workers, r.pattern, r.limiting_factor) == want


def test_paths_with_spaces_and_repeats(spark, tmp_path):
    """Every given path gives its row, however it is spelled; one that gives none is an error."""
    paths = []
    for name in ("plain", "with space", "per%20cent", "plus+and#hash"):
        (tmp_path / name).mkdir()
        paths.append(runs.write_summary(str(tmp_path / name / "run one.json"), runs.new_summary(run_name=name)))
    given = [paths[1], paths[0], paths[1], paths[2], paths[3], "file://" + paths[0]]
    found = {r.input_ordinal: r.run_name for r in runs.read_runs(spark, given).collect()}
    assert found == {0: "with space", 1: "plain", 2: "with space", 3: "per%20cent", 4: "plus+and#hash", 5: "plain"}
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        runs.read_runs(spark, [paths[0], str(tmp_path / "empty")])


def test_published_ladder(spark):
    r = ladder.recommendation(ladder.ladder_rows(rungs(spark, [(0, 2454), (2, 4223), (6, 11558), (7, 11291), (13, 13062), (28, 15966)]))).first()
    assert (r.recommended_workers, r.best_workers, r.pattern) == (13, 28, "still-improving")


def test_repeats_are_one_rung(spark):
    r = ladder.ladder_rows(rungs(spark, [(2, 100), (2, 200), (2, 5000)])).collect()
    assert len(r) == 1 and r[0].samples_per_second == 200 and r[0].samples_per_second_cv > 0
    assert ladder.recommendation(ladder.ladder_rows(rungs(spark, [(2, 100)]))).first().pattern == "inconclusive"


def test_all_rungs_oversubscribed(spark):
    rows = frame(spark, [dict(num_workers=w, samples_per_second=s, oversubscription_ratio=(w + 1) / 4.0) for w, s in ((20, 500.0), (40, 900.0))])
    assert ladder.recommendation(ladder.ladder_rows(rows)).first().recommended_workers == 40


def places(spark, found):
    return placement.placement_rows(
        frame(spark, [dict(storage=s, samples_per_second=v, estimated_epoch_seconds=e, staging_seconds=c) for s, v, e, c in found])
    )


def test_break_even_and_horizons(spark):
    r = placement.break_even(places(spark, [("scratch", 10.0, 100.0, 0.0), ("tmp", 20.0, 50.0, 100.0)])).first()
    assert (r.per_epoch_time_saved, r.setup_cost_seconds, r.break_even_epochs, r.throughput_change_percent) == (50, 100, 2.0, 100.0)
    assert placement.break_even(places(spark, [("scratch", 10.0, 50.0, 0.0), ("tmp", 10.0, 50.0, 100.0)])).first().break_even_epochs is None
    rows = places(spark, [("scratch", 10.0, 100.0, 0.0), ("tmp", 40.0, 25.0, 200.0)])
    best = {r.epochs: r.storage for r in placement.cost_by_horizon(rows, (1, 50)).filter("is_cheapest").collect()}
    assert best == {1: "scratch", 50: "tmp"}
    assert placement.staging_decision(rows, 500).first().node_local_staging == "recommended"
    assert placement.staging_decision(rows, 1).first().node_local_staging == "not-recommended"
    assert placement.staging_decision(places(spark, [("scratch", 1.0, 1.0, 0.0)]), 3).first().node_local_staging == "not-measured"


def test_noise_keeps_scratch(spark):
    close = places(
        spark, [("scratch", 13243.0, 3.7, 0.0), ("scratch", 13708.0, 3.7, 0.0), ("flash", 13648.0, 3.6, 0.0), ("flash", 14500.0, 3.6, 0.0)]
    )
    assert placement.break_even(close).first().indistinguishable
    assert placement.near_tie_choice(close, 3).first().recommended_storage == "scratch"
    far = places(spark, [("scratch", 1000.0, 50.0, 0.0), ("scratch", 1010.0, 50.0, 0.0), ("flash", 5000.0, 10.0, 0.0), ("flash", 5050.0, 10.0, 0.0)])
    assert not placement.break_even(far).first().indistinguishable
    assert placement.near_tie_choice(far, 3).first().recommended_storage == "flash"
    alone = places(spark, [("scratch", 10.0, 10.0, 0.0), ("flash", 10.1, 9.9, 0.0)])
    assert placement.near_tie_choice(alone, 3).first().recommended_storage == "flash"


def test_first_seen_is_the_baseline(spark):
    rows = frame(
        spark, [dict(layout="b", samples_per_second=100.0), dict(layout="a", samples_per_second=150.0), dict(layout="a", samples_per_second=250.0)]
    )
    found = {r.group: r for r in compare.layout_comparison(rows).collect()}
    assert found["b"].is_baseline and found["a"].samples_per_second_percent == 100.0 and found["a"].runs == 2
    assert {r.group: r.is_baseline for r in compare.layout_comparison(rows, baseline="a").collect()} == {"a": True, "b": False}


def test_mismatches_count_null_and_block(spark):
    rows = frame(spark, [{}, dict(manifest_hash="other", compute_steps=None), {}])
    found = {r.field: (r.distinct_values, r.blocking) for r in compare.mismatches(rows).collect()}
    assert found == {"manifest_hash": (2, True), "compute_steps": (2, False)}
    assert compare.mismatches(frame(spark, [{}])).count() == 0
    v = compare.verdict(rows).first()
    assert not v.controlled and not v.comparable
    mixed = frame(spark, [dict(shuffle=True), dict(shuffle=False)])
    assert [(r.group, r.field) for r in compare.within_group_mismatches(mixed).collect()] == [("loose", "shuffle")]
    assert "single-run" not in [r.rule_id for r in compare.comparison_cautions(mixed).collect()]


def verdict(spark, **more):
    base = dict(world_size=8, unique_samples=800, duplicate_samples=0, missing_samples=0, rank_elapsed_spread=0.05, max_data_wait_fraction=0.1) | more
    idle = base.pop("idle", [])
    return spark.createDataFrame(
        [(*base.values(), idle)],
        ", ".join(f"{k} {'double' if isinstance(x, float) else 'long'}" for k, x in base.items()) + ", idle_ranks array<int>"
    )


def reports(spark, **more):
    two = [dict(layout=n, samples_per_second=s, num_workers=4) for n, s in (("loose", 100.0), ("shards", 300.0)) for _ in range(2)]
    found = dict(
        layouts=frame(spark, two), distributed=verdict(spark), inspection=spark.range(1), workers=rungs(spark, [(0, 100), (2, 900), (7, 920)]),
        storage=frame(spark, [dict(storage="scratch", samples_per_second=10.0)] * 2)
    )
    return found | more


def test_decisions(spark):
    ready = decide.decide(spark, **reports(spark)).first()
    assert (ready.data_readiness, ready.recommended_layout, ready.recommended_workers_per_rank) == ("READY", "shards", 2)
    assert decide.decide(spark, **reports(spark, distributed=None)).first().data_readiness == "INCONCLUSIVE"
    for bad in (dict(duplicate_samples=3), dict(missing_samples=1), dict(idle=[3])):
        assert decide.decide(spark, **reports(spark, distributed=verdict(spark, **bad))).first().data_readiness == "NOT_READY"
    failed = frame(spark, [dict(layout="loose", failed_samples=2)] * 2)
    worst = decide.decide(spark, **reports(spark, layouts=failed, distributed=None)).first()
    assert worst.data_readiness == "NOT_READY" and worst.recommended_layout == "unknown"
    assert decide.decide(spark, **reports(spark, distributed=verdict(spark, rank_elapsed_spread=0.34))).first().data_readiness == "READY_WITH_CAUTION"
    assert decide.decide(spark, **reports(spark, storage=None)).first().data_readiness == "READY_WITH_CAUTION"
    with pytest.raises(ValueError):
        decide.decide(spark, planned_epochs=0)


def test_summaries_are_closed(spark, tmp_path):
    good = str(tmp_path / "a.json")
    runs.write_summary(good, runs.new_summary(run_name="a", cpu_utilization=0.5))
    assert runs.read_runs(spark, [good]).first().cpu_utilization == 0.5
    for change in ({"mystery": 1}, {"schema_version": "0"}, None):
        bad = tmp_path / "b.json"
        d = json.loads(open(good).read())
        bad.write_text(json.dumps({k: x for k, x in d.items() if k != "layout"} if change is None else d | change))
        with pytest.raises(ValueError):
            runs.read_runs(spark, [str(bad)])
    with pytest.raises(ValueError):
        runs.new_summary(mystery=1)
    assert main(["summarize", good]) == 0 and main(["summarize", str(bad)]) == 1
    assert main(["compare", "layouts", good]) == 2
    other = str(tmp_path / "c.json")
    runs.write_summary(other, runs.new_summary(run_name="c", manifest_hash="x"))
    assert main(["compare", "layouts", good, other]) == 3
    assert main(["compare", "workers", good, other, "--allow-incompatible", "--no-report"]) == 0
    assert main(["decide", "--layouts", good, good, "--output-dir", str(tmp_path)]) == 6


def test_config_rules(tmp_path):
    raw = {"run": {"name": "r"}, "dataset": {"layout": "loose-files", "root": "$ROOT/x", "manifest": "m"}, "output": {"directory": "o"}}
    c = config.build(raw, environ={"ROOT": "/r"})
    assert c.dataset.root == "/r/x" and c.config_hash() == config.build(raw | {"output": {"directory": "p"}}, environ={"ROOT": "/r"}).config_hash()
    with pytest.raises(ValueError, match="ROOT"):
        config.build(raw, environ={})
    bad = [
        {"more": {}}, {"loader": {"x": 1}}, {"loader": {"num_workers": 0}}, {"storage": {"location": "tmp"}}, {"storage": {"safety_fraction": 0.0}},
        {"dataset": {"layout": "webdataset", "root": "r", "manifest": "m"}}, {"dataset": {"layout": "adapter", "root": "r", "manifest": "m"}},
        {"dataset": {"layout": "loose-files"}}
    ]
    for change in bad:
        with pytest.raises(ValueError):
            config.build(raw | change, environ={"ROOT": "/r"})
    p = tmp_path / "c.yaml"
    p.write_text(json.dumps(raw))
    assert config.load_config(str(p), {"run.seed": 7}, {"ROOT": "/r"}).run.seed == 7
    assert config.parse_override("loader.shuffle=false") == ("loader.shuffle", False)
    for text in ("x", "seed=1"):
        with pytest.raises(ValueError):
            config.parse_override(text)


def test_environment_and_rendering(spark):
    assert env.allocated_memory({"SLURM_MEM_PER_NODE": "100"})[0] == 100 << 20
    assert env.allocated_memory({"SLURM_MEM_PER_CPU": "10", "SLURM_CPUS_PER_TASK": "4"})[0] == 40 << 20
    assert env.allocated_memory({})[0] is None
    assert env.rank_and_world({"SLURM_PROCID": "3", "SLURM_NTASKS": "8"}) == (3, 8) and env.rank_and_world({}) == (0, 1)
    text = render.table(spark.createDataFrame([("a", 0.123456, None)], "x string, y double, z int"))
    assert text.splitlines()[-1].split() == ["a", "0.1235", "-"]


def test_context_names_fields_of_a_summary():
    found = env.context()
    assert set(found) <= set(runs.TYPES) and found["allocated_cores"] * found["threads_per_core"] <= found["cpus_available"]
    assert found["child_processes"] >= 0 and found["voluntary_context_switches"] > 0 and set(found["slurm_context"]) == set(env.SCHEDULER)
    runs.validate(runs.new_summary(**{k: v for k, v in found.items() if v is not None}))


def test_reports_of_ladders_and_placements(spark, tmp_path, capsys):
    rungs = [
        runs.write_summary(
            str(tmp_path / f"w{w}.json"), runs.new_summary(**(BASE | dict(run_name=f"w{w}", num_workers=w, samples_per_second=s)))
        ) for w,
        s in ((0, 100.0), (2, 900.0), (7, 920.0))
    ]
    assert main(["compare", "workers", *rungs, "--no-report"]) == 0
    out = capsys.readouterr().out
    assert "2 *" in out and "RECOMMENDED_WORKERS=2" in out
    places = [
        runs.write_summary(
            str(tmp_path / f"{p}.json"),
            runs.new_summary(**(BASE | dict(run_name=p, storage=p, samples_per_second=1.0, estimated_epoch_seconds=e, staging_seconds=s)))
        ) for p,
        e, s in (("scratch", 100.0, 0.0), ("tmp", 50.0, 100.0))
    ]
    assert main(["compare", "storage", *places, "--no-report"]) == 0
    assert "tmp against scratch: saves 50 s an epoch for 100 s of set-up, even after 2 epochs" in capsys.readouterr().out
    made = main(
        [
            "decide", "--layouts", rungs[0], str(tmp_path / "gone.json"), "--inspection", str(tmp_path / "nowhere"), "--output-dir",
            str(tmp_path / "out")
        ]
    )
    assert made == 6 and "gone.json is not there" in capsys.readouterr().err


def test_profiles(tmp_path):
    from millrace.sources import synthetic

    p = tmp_path / "p.yaml"
    for text, fine in (
            ("dataset: {profile: x, samples: 3, width: 4, height: 5}", True), ("dataset: {profile: x, samples: 0, width: 4, height: 5}", False),
            ("dataset: {profile: x}", False), ("dataset: {profile: x, samples: 3, width: 4, height: 5, more: 1}", False), ("other: {}", False),
            ("dataset: {profile: x, samples: 3, width: 4, height: 5, encoding: gif}", False)
    ):
        p.write_text(text)
        if fine:
            assert synthetic.load_profile(str(p)).extension == "jpg"
        else:
            with pytest.raises(ValueError):
                synthetic.load_profile(str(p))
