"""Reports as text, on the driver, from rows already reduced to a few."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# Wording by rule; what a finding is about and its value are filled in.
RULES = {
    "failed-samples": "{subject}: {value:.0f} samples could not be read, so its rate is no result.",
    "duplicate-samples": "{subject}: {value:.0f} samples were read more than once in an epoch.",
    "missing-samples": "{subject}: {value:.0f} samples were never read in a complete epoch.",
    "single-run": "{subject} was measured {value:.0f} time: repeat it before trusting small differences.",
    "noisy": "{subject}: repeats differ by a coefficient of variation of {value:.3f}.",
    "mismatch": "{subject} has {value:.0f} different values across runs ({severity}).",
    "within-group": "{subject} has {value:.0f} different values within one group.",
    "oversubscribed": "{subject} workers ask for {value:.2f} processes a CPU.",
    "smt-saturated": "{subject} workers put {value:.2f} processes on a physical core.",
    "workers-not-started": "Of {subject} workers only {value:.0f} were seen.",
    "staged-memory": "{subject}: the staged copy takes {value:.0%} of the memory.",
    "indistinguishable": "{subject} cannot be told from the baseline: noise is {value:.1f}%.",
    "rank-imbalance": "Ranks differ by {value:.0%} in elapsed time.",
    "idle-ranks": "{value:.0f} ranks read nothing.",
    "data-wait": "A rank waited {value:.0%} of its time.",
    "healthy": "Every sample was read once, by ranks that kept pace.",
}


def finding(row) -> str:
    d = row.asDict()
    text = RULES.get(d["rule_id"], "{subject}: " + d["rule_id"].replace("-", " ") + ".")
    return text.format(subject=d.get("subject", ""), value=d.get("value") or 0.0, severity=d.get("severity", ""))


def findings(df: DataFrame) -> list[str]:
    return [finding(r) for r in df.orderBy(*[c for c in ("ordinal", "subject") if c in df.columns]).collect()]


def _cell(x: object) -> str:
    if x is None:
        return "-"
    return f"{x:.4g}" if isinstance(x, float) else str(x)


def table(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    names = list(columns or df.columns)
    rows = [[_cell(v) for v in r] for r in df.select(*names).collect()]
    widths = [max(len(x) for x in col) for col in zip(names, *rows, strict=True)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip()
    return "\n".join([line(names), line(["-" * w for w in widths]), *map(line, rows)])


def key_values(row, names: Sequence[str] | None = None) -> str:
    d = row.asDict()
    return "\n".join(f"{k.upper()}={d[k]}" for k in (names or d))


def _titled(df: DataFrame, titles: dict[str, str], mark: str | None = None, marked: object = None) -> str:
    """A table under given titles; the row whose ``mark`` column has the value ``marked`` gets a star."""
    shown = df.select(*titles)
    rows = [[_cell(v) + (" *" if c == mark and v == marked else "") for c, v in zip(titles, r, strict=True)] for r in shown.collect()]
    widths = [max(map(len, col)) for col in zip(titles.values(), *rows, strict=True)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)) + " |"
    return "\n".join([line(list(titles.values())), line(["-" * w for w in widths]), *map(line, rows)])


def ladder_report(rungs: DataFrame, verdict) -> str:
    """Rungs by worker count, the recommended one starred, and the verdict."""
    titles = {
        "num_workers": "Workers", "runs": "Runs", "samples_per_second": "Samples/s", "mean_batch_wait_seconds": "Mean wait", "p95_batch_wait_seconds": "P95 wait", "mean_data_wait_fraction": "Wait frac",
        "cpu_utilization": "CPU util", "processes_per_physical_core": "Proc/core", "peak_memory_bytes": "Peak bytes", "involuntary_switches_per_second": "Invol cs/s",
    }
    d = verdict.asDict()
    body = _titled(rungs.orderBy("num_workers"), titles, "num_workers", d["recommended_workers"])
    return f"{body}\n* recommended\n\n" + key_values(verdict)


def placement_report(rows: DataFrame, even: DataFrame, costs: DataFrame) -> str:
    """Placements, when each pays its set-up cost back, and what each costs at several numbers of epochs."""
    titles = {
        "storage": "Placement", "runs": "Runs", "samples_per_second": "Samples/s", "estimated_epoch_seconds": "Epoch s",
        "staging_seconds": "Staging s", "validation_seconds": "Validate s"
    }
    pays = []
    for r in even.orderBy("storage").collect():
        if r["storage"] != r["baseline"]:
            epochs = "never" if r["break_even_epochs"] is None else f"{r['break_even_epochs']:.4g}"
            pays.append(
                f"{r['storage']} against {r['baseline']}: saves {r['per_epoch_time_saved']:.4g} s an epoch for {r['setup_cost_seconds']:.4g} s of set-up, even after {epochs} epochs"
            )
    note = "Wall times with set-up: read the row of the epochs you mean to run. They say nothing of what the storage costs."
    return "\n\n".join(
        [_titled(rows.orderBy("storage"), titles), *(["\n".join(pays)] if pays else []), table(costs.orderBy("epochs", "storage")), note]
    )


def inspection_details(row) -> str:
    """Sizes, extensions, format topics and next experiments of an inspection report."""
    d = row.asDict(recursive=True)
    parts = []
    if len({t["fraction"] for t in d["thresholds"]}) > 1:
        parts.append(["Sizes", *(f"under {t['bytes']} bytes: {t['files']} files, {t['fraction']:.1%}" for t in d["thresholds"])])
    parts.append(["Extensions", *(f"{e['extension']}: {e['files']} files, {e['bytes']} bytes, {e['fraction']:.1%}" for e in d["extensions"])])
    if d["format_hints"]:
        parts.append(["Formats, by name only", *(f"{h['extension']}: {h['topic']}" for h in d["format_hints"])])
    plan = d["packaging"]
    if plan["suggested_shards"]:
        why = "so that readers have shards to share" if plan["floor_decides"] else "by their size"
        parts.append(["Packaging", f"{plan['suggested_shards']} shards of some {plan['suggested_samples_per_shard']} samples, {why}"])
    parts.append(["Next experiments", *(f"{i}. {c['experiment']}" for i, c in enumerate(d["candidates"], 1))])
    return "\n\n".join("\n".join([p[0], *("  " + x for x in p[1:])]) for p in parts)


def dataset_sentence(row) -> str:
    """One sentence on an inspected dataset; none for an empty one."""
    d = row.asDict(recursive=True)
    files, small = d["tree"]["total_files"], d["small_files"]
    if not files:
        return ""
    return f"The dataset has {files} files of {d['tree']['total_bytes'] / 2**30:.2f} GiB together, half of them below {d['file_sizes']['median_bytes'] / 1024:.1f} KiB; {small['fraction']:.0%} are smaller than {small['threshold_bytes']} bytes."


def accounting_note(complete_epochs: int) -> str:
    """What a measured window can say about samples never read."""
    if complete_epochs < 1:
        return "No epoch was measured whole: missing samples are not judged, repeated ones are."
    return f"{complete_epochs} whole epochs were measured: missing samples are judged over these."


def decision_markdown(row, notes: Sequence[str] = (), about: str = "") -> str:
    """The verdict as a short document."""
    d = row.asDict()
    head = f"# Data readiness: {d['data_readiness']}\n\n" + (about + "\n\n" if about else "")
    body = "".join(
        f"- {k.replace('_', ' ')}: {d[k]}\n" for k in (
            "recommended_layout", "recommended_storage", "recommended_workers_per_rank", "main_limiting_factor", "node_local_staging",
            "distributed_partitioning", "planned_epochs", "next_experiment"
        )
    )
    return head + body + ("\n## Findings\n\n" + "".join(f"- {n}\n" for n in notes) if notes else "")
