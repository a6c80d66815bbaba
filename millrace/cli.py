"""Command line: ``python -m millrace.cli COMMAND``. Exit codes are part of each command's contract."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .config import load_config, parse_override
from .env import allocated_memory, context
from .errors import ConfigError, ManifestError, StagingError, SummaryError
from .functions import scalars
from .operators import compare as comparing
from .operators import coverage, decide, inspect, ladder, measure, placement, shards
from .sources import manifest, runs, synthetic, tarshards, tracks, treewalk

BAD_INPUT = 2


def _session() -> SparkSession:
    return SparkSession.builder.appName("millrace").getOrCreate()


def _save(df: DataFrame, path: str | None) -> None:
    if path:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w") as f:
            f.write(json.dumps([json.loads(r) for r in df.toJSON().collect()], indent=2, sort_keys=True) + "\n")


def byte_list(text: str) -> list[int]:
    found = [int(x) for x in text.split(",") if x.strip()]
    if not found or min(found) < 1:
        raise argparse.ArgumentTypeError("byte counts must be 1 or more")
    return found


def inspect_dataset(a) -> int:
    files = treewalk.walk(_session(), a.path)
    memory = a.memory_bytes or allocated_memory()[0]
    report = inspect.inspection_report(files, memory, a.thresholds, a.small_file_bytes, a.target_shard_bytes, a.tmp_safety_fraction)
    if not a.no_report:
        _save(report, a.output)
    row = report.first()
    print(render.key_values(row["tree"]))
    for c in row["candidates"]:
        print(f"CANDIDATE={c['experiment']}")
    if a.details:
        print(render.inspection_details(row))
    return 0


def generate_dataset(a) -> int:
    spark = _session()
    profile = synthetic.load_profile(a.profile_config) if a.profile_config else synthetic.PROFILES[a.profile]
    if os.path.isdir(a.output) and os.listdir(a.output) and not a.overwrite:
        raise ConfigError(f"{a.output} is not empty")
    rows = synthetic.samples(spark, profile, a.samples)
    target = os.path.abspath(a.output)

    def store(found):
        for r in found:
            path = os.path.join(target, r["relative_path"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(r["payload"])

    rows.foreachPartition(store)
    listed = a.manifest or os.path.join(a.output, "manifest.jsonl")
    manifest.write_manifest(rows, listed)
    with open(os.path.join(a.output, "dataset_profile.json"), "w") as f:
        f.write(json.dumps(synthetic.profile_record(profile, listed, manifest.read_manifest(spark, listed)), indent=2, sort_keys=True) + "\n")
    return 0


def _with_payloads(spark: SparkSession, a) -> DataFrame:
    return manifest.payloads(manifest.read_manifest(spark, a.manifest), a.source)


def build_shards(a) -> int:
    spark = _session()
    plan = shards.ShardPlan(a.samples_per_shard, not a.no_shuffle, a.seed, a.balance_by, a.imbalance_factor)
    if os.path.isdir(a.output) and os.listdir(a.output) and not a.overwrite:
        raise ConfigError(f"{a.output} is not empty")
    rows = _with_payloads(spark, a)
    planned = shards.plan_shards(rows.drop("payload"), plan).select("sample_id", "shard_id", "position")
    members = rows.join(planned, "sample_id").withColumn(
        "extension", F.regexp_replace(scalars.extension(F.col("relative_path")), r"^\.|^\(none\)$", "")
    )
    index = tarshards.write_shards(members, a.output, plan)
    print(render.table(index))
    return 0 if index.agg(F.sum("samples")).first()[0] == rows.count() else 1


def convert_dataset(a) -> int:
    spark = _session()
    rows = _with_payloads(spark, a)
    record = tracks.convert(rows, a.to, a.output, a.group_size, a.compression, a.overwrite)
    print("\n".join(f"{k.upper()}={x}" for k, x in record.items()))
    return 0 if record["rows"] == rows.count() else 1


def shard_summary(a) -> int:
    spark, idle = _session(), 0
    for path in a.directories:
        index = tarshards.read_index(spark, os.path.join(path, tarshards.INDEX_NAME))
        loads = shards.reader_loads(index, a.readers)
        print(path, render.table(shards.shard_statistics(index)), render.table(loads), render.table(shards.preflight(loads)), sep="\n")
        idle += loads.filter("is_idle").count()
    return 1 if idle else 0


def compare(a) -> int:
    spark = _session()
    if len(a.summaries) < 2:
        raise SummaryError("a comparison needs two runs or more")
    found = runs.read_runs(spark, a.summaries)
    if comparing.mismatches(found).filter("blocking").take(1) and not a.allow_incompatible:
        print("these runs did not read the same data", file=sys.stderr)
        return 3
    if a.kind == "layouts":
        groups = comparing.group_summaries(found, a.key or "layout")
        if a.baseline and not groups.filter(F.col("group") == a.baseline).take(1):
            raise SummaryError(f"no group {a.baseline!r}")
        report, notes = comparing.layout_comparison(found, a.key or "layout", a.baseline), comparing.comparison_cautions(found, a.key or "layout")
    elif a.kind == "workers":
        report, notes = ladder.recommendation(ladder.ladder_rows(found)), ladder.ladder_cautions(found)
    else:
        rows = placement.placement_rows(found)
        report, notes = placement.cost_by_horizon(rows, a.epochs or placement.HORIZONS), placement.placement_cautions(
            found, a.baseline or placement.DEFAULT_PLACEMENT
        )
    if a.kind == "workers":
        text = render.ladder_report(ladder.ladder_rows(found), report.first())
    elif a.kind == "storage":
        text = render.placement_report(rows, placement.break_even(rows, a.baseline or placement.DEFAULT_PLACEMENT), report)
    else:
        text = render.table(report)
    print(text, *render.findings(notes), sep="\n")
    if not a.no_report:
        _save(report, a.output)
    return 0


def _present(paths: list[str] | None) -> list[str]:
    """The paths that exist; a warning for each other one, as a decision can do without it."""
    for p in paths or []:
        if not os.path.exists(p):
            print(f"warning: {p} is not there and is left out", file=sys.stderr)
    return [p for p in paths or [] if os.path.exists(p)]


def render_decision(a) -> int:
    spark = _session()
    load = lambda names: runs.read_runs(spark, there) if (there := _present(names)) else None
    for kind in ("layouts", "workers", "storage", "distributed"):
        if not getattr(a, kind):
            print(f"no {kind} runs given", file=sys.stderr)
    dist = load(a.distributed)
    if dist is not None:
        dist = dist.select(
            "duplicate_samples", "missing_samples", F.coalesce("idle_ranks", F.array().cast("array<int>")).alias("idle_ranks"),
            F.coalesce("rank_elapsed_spread", F.lit(0.0)).alias("rank_elapsed_spread"),
            F.coalesce("max_data_wait_fraction", F.lit(0.0)).alias("max_data_wait_fraction")
        ).limit(1)
    tree = treewalk.walk(spark, a.inspection) if _present([a.inspection] if a.inspection else []) else None
    inputs = {"layouts": load(a.layouts), "workers": load(a.workers), "storage": load(a.storage), "distributed": dist, "inspection": tree}
    evidence = decide.Evidence(spark, **inputs)
    verdict = decide.decide(spark, evidence, planned_epochs=a.planned_epochs)
    row = verdict.first()
    notes = render.findings(decide.findings(spark, evidence))
    os.makedirs(a.output_dir, exist_ok=True)
    _save(verdict, os.path.join(a.output_dir, "decision.json"))
    with open(os.path.join(a.output_dir, "decision.md"), "w") as f:
        f.write(render.decision_markdown(row, notes, render.dataset_sentence(inspect.inspection_report(tree).first()) if tree is not None else ""))
    print(render.key_values(row))
    return {"NOT_READY": 5, "INCONCLUSIVE": 6}.get(row["data_readiness"], 0)


def summarize(a) -> int:
    """Print each summary; 1 if any of them is not valid."""
    spark, bad = _session(), 0
    for path in a.summaries:
        try:
            found = runs.read_runs(spark, [path])
            print(render.table(found, ["run_name", *runs.PRINTED]) if a.table else runs.key_values(found.first().asDict()))
        except SummaryError as e:
            print(e, file=sys.stderr)
            bad = 1
    return bad


def benchmark(a) -> int:
    """Time the configured layout and write a summary of the median repeat."""
    spark = _session()
    c = load_config(a.config, dict(map(parse_override, a.set or [])))
    if c.dataset.layout == "squashfs" and c.dataset.squashfs_mode == "squashfuse":
        print("mounting an image is left to the system: use prebound", file=sys.stderr)
        return 3
    samples = manifest.read_manifest(spark, c.dataset.manifest)
    if c.dataset.layout == "webdataset":
        source = lambda: tarshards.read_shards(spark, c.dataset.root)
    elif c.dataset.layout == "adapter":
        place = samples.withColumn("position", F.expr("cast(substring(sample_id, 2) as long)"))
        source = lambda: tracks.read_adapter(place, c.dataset.adapter, root=c.dataset.root)
    else:
        source = lambda: manifest.payloads(samples, c.dataset.root)
    timed = measure.measure(spark, {c.dataset.layout: source}, repeats=3)
    row = sorted(timed.collect(), key=lambda r: r["samples_per_second"])[1]
    known = {k: x for k, x in context().items() if k in runs.TYPES}
    if c.dataset.layout == "adapter":
        about = tracks.load_adapter(c.dataset.adapter)(root=c.dataset.root)
        known |= {k: x for k, x in (about.describe() if hasattr(about, "describe") else {}).items() if k in runs.OPTIONAL}
    summary = runs.new_summary(
        **known, run_name=c.run.name, config_path=a.config, config_hash=c.config_hash(), layout=c.dataset.layout, storage=c.storage.location, num_workers=c.loader.num_workers, samples_measured=row["samples_measured"], bytes_read=row["bytes_read"], measured_seconds=row["measured_seconds"],
        samples_per_second=row["samples_per_second"], mib_per_second=row["mib_per_second"], failed_samples=row["failed_samples"], manifest_hash=manifest.manifest_hash(c.dataset.manifest), seed=c.run.seed, batch_size=c.loader.batch_size,
    )
    runs.write_summary(os.path.join(c.output.directory, a.summary_name or f"{c.run.name}.json"), summary)
    print(runs.key_values(summary))
    return 0


def distributed(a) -> int:
    """Which reader would read what, from a shard index: 4 if the ranks would not partition the samples."""
    spark = _session()
    c = load_config(a.config, dict(map(parse_override, a.set or [])))
    index = shards.assign_shards(tarshards.read_index(spark, os.path.join(c.dataset.root, tarshards.INDEX_NAME)), a.ranks)
    each = index.select("reader", F.explode("sample_ids").alias("sample_id"))
    every = spark.range(a.ranks).select(F.col("id").cast("int").alias("rank"))
    reads = each.select(
        F.col("reader").alias("rank"), F.lit(0).alias("epoch"), F.xxhash64("sample_id").alias("sample_index")
    ) if c.distributed.partition_by_rank else each.select("sample_id").crossJoin(F.broadcast(every)).select(
        "rank", F.lit(0).alias("epoch"), F.xxhash64("sample_id").alias("sample_index")
    )
    total = manifest.read_manifest(spark, c.dataset.manifest).agg(F.count("*").alias("total"))
    verdict = coverage.cross_rank_verdict(reads, total, a.ranks)
    row = verdict.first()
    _save(verdict, os.path.join(c.output.directory, a.verdict_name))
    print(render.key_values(row))
    return 0 if row["partitioning_valid"] or not c.distributed.validate_unique_samples else 4


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace")
    sub = top.add_subparsers(dest="command", required=True)

    def command(f, name: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, description=f.__doc__)
        p.set_defaults(run=f)
        return p

    p = command(inspect_dataset, "inspect")
    p.add_argument("--path", required=True)
    p.add_argument("--output", default="inspection.json")
    p.add_argument("--small-file-bytes", type=int, default=inspect.SMALL_FILE_BYTES)
    p.add_argument("--thresholds", type=byte_list, default=list(inspect.THRESHOLDS))
    p.add_argument("--memory-bytes", type=int)
    p.add_argument("--tmp-safety-fraction", type=float, default=inspect.TMP_SAFETY_FRACTION)
    p.add_argument("--target-shard-bytes", type=int, default=inspect.TARGET_SHARD_BYTES)
    p.add_argument("--no-report", action="store_true")
    p.add_argument("--details", action="store_true")
    p = command(generate_dataset, "generate")
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--profile", choices=sorted(synthetic.PROFILES))
    which.add_argument("--profile-config")
    p.add_argument("--output", required=True)
    p.add_argument("--manifest")
    p.add_argument("--samples", type=int)
    p.add_argument("--overwrite", action="store_true")
    p = command(build_shards, "build-shards")
    for name in ("--source", "--manifest", "--output"):
        p.add_argument(name, required=True)
    p.add_argument("--samples-per-shard", type=int, default=1000)
    p.add_argument("--balance-by", choices=("count", "work"), default="count")
    p.add_argument("--seed", type=int, default=1234)
    p.add_argument("--imbalance-factor", type=float, default=1.0)
    p.add_argument("--no-shuffle", action="store_true")
    p.add_argument("--overwrite", action="store_true")
    p = command(convert_dataset, "convert")
    p.add_argument("--to", required=True, choices=tracks.FORMATS)
    for name in ("--source", "--manifest", "--output"):
        p.add_argument(name, required=True)
    p.add_argument("--group-size", type=int, default=tracks.GROUP_ROWS)
    p.add_argument("--compression", default="none")
    p.add_argument("--overwrite", action="store_true")
    p = command(shard_summary, "shard-summary")
    p.add_argument("directories", nargs="+")
    p.add_argument("--readers", type=int, default=8)
    p = command(compare, "compare")
    p.add_argument("kind", choices=("layouts", "workers", "storage"))
    p.add_argument("summaries", nargs="+")
    p.add_argument("--baseline")
    p.add_argument("--key")
    p.add_argument("--epochs", type=int, nargs="*")
    p.add_argument("--output")
    p.add_argument("--no-report", action="store_true")
    p.add_argument("--allow-incompatible", action="store_true")
    p = command(render_decision, "decide")
    for name in ("--layouts", "--workers", "--storage", "--distributed"):
        p.add_argument(name, nargs="*")
    p.add_argument("--inspection", help="a tree to inspect")
    p.add_argument("--planned-epochs", type=int, default=decide.PLANNED_EPOCHS)
    p.add_argument("--output-dir", default=".")
    p = command(summarize, "summarize")
    p.add_argument("summaries", nargs="+")
    p.add_argument("--table", action="store_true")
    p = command(benchmark, "benchmark")
    p.add_argument("--config", required=True)
    p.add_argument("--set", action="append")
    p.add_argument("--summary-name")
    p = command(distributed, "distributed")
    p.add_argument("--config", required=True)
    p.add_argument("--set", action="append")
    p.add_argument("--ranks", type=int, default=8)
    p.add_argument("--verdict-name", default="verdict.json")
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        return a.run(a)
    except (ConfigError, ManifestError, StagingError, SummaryError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return BAD_INPUT


if __name__ == "__main__":
    sys.exit(main())
