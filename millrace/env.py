"""What this process runs on: memory, CPUs, scheduler variables, commit."""

from __future__ import annotations

import os
import platform
import resource
import subprocess
from collections.abc import Mapping
from datetime import UTC, datetime


def allocated_memory(environ: Mapping[str, str] | None = None) -> tuple[int | None, str]:
    """(bytes, where from): per node, else per CPU times CPUs; None where neither is given."""
    known = os.environ if environ is None else environ
    number = lambda k: int(known[k]) if known.get(k, "").isdigit() else None
    if (mib := number("SLURM_MEM_PER_NODE")) is not None:
        return mib << 20, "SLURM_MEM_PER_NODE"
    each, cpus = number("SLURM_MEM_PER_CPU"), number("SLURM_CPUS_PER_TASK")
    if each is not None and cpus is not None:
        return (each * cpus) << 20, "SLURM_MEM_PER_CPU x SLURM_CPUS_PER_TASK"
    return None, "unknown"


def rank_and_world(environ: Mapping[str, str] | None = None) -> tuple[int, int]:
    """From the launcher's variables, else the scheduler's, else one process alone."""
    known = os.environ if environ is None else environ
    for rank, world in (("RANK", "WORLD_SIZE"), ("SLURM_PROCID", "SLURM_NTASKS")):
        if known.get(rank, "").isdigit() and known.get(world, "").isdigit():
            return int(known[rank]), int(known[world])
    return 0, 1


# Scheduler variables that a run records, empty where they are not set.
SCHEDULER = (
    "SLURM_JOB_ID", "SLURM_JOB_NAME", "SLURM_JOB_NUM_NODES", "SLURM_NTASKS", "SLURM_CPUS_PER_TASK", "SLURM_GPUS_PER_NODE", "SLURM_JOB_PARTITION",
    "SLURM_JOB_ACCOUNT"
)


def _commit() -> str:
    try:
        done = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10, check=False)
    except (OSError, subprocess.SubprocessError):
        return "unknown"
    return done.stdout.strip() if done.returncode == 0 and done.stdout.strip() else "unknown"


def children() -> int:
    """Processes that this one started and that still run; -1 where the system does not say."""
    own, found = str(os.getpid()), 0
    try:
        pids = [n for n in os.listdir("/proc") if n.isdigit()]
    except OSError:
        return -1
    for pid in pids:
        try:
            with open(f"/proc/{pid}/status") as f:
                found += any(line.split() == ["PPid:", own] for line in f if line.startswith("PPid:"))
        except OSError:
            continue  # it has ended since
    return found


def cores() -> tuple[int, int]:
    """(physical cores, hardware threads of each) among the CPUs that this process may use; a CPU is a core where the system does not say."""
    cpus, seen = os.sched_getaffinity(0), set()
    for n in cpus:
        try:
            with open(f"/sys/devices/system/cpu/cpu{n}/topology/thread_siblings_list") as f:
                seen.add(f.read().strip())
        except OSError:
            seen.add(str(n))
    return len(seen), max(1, len(cpus) // max(1, len(seen)))


def context() -> dict[str, object]:
    own, ended = resource.getrusage(resource.RUSAGE_SELF), resource.getrusage(resource.RUSAGE_CHILDREN)
    memory, source = allocated_memory()
    physical, threads = cores()
    return {
        "timestamp_utc": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "hostname": platform.node(), "git_commit": _commit(), "slurm_job_id": os.environ.get("SLURM_JOB_ID", ""), "slurm_context": {
            k: os.environ.get(k, "") for k in SCHEDULER
        },
        "cpus_available": len(os.sched_getaffinity(0)), "allocated_cores": physical, "threads_per_core": threads, "child_processes": children(), "memory_allocated_bytes": memory, "memory_source": source,
        "voluntary_context_switches": own.ru_nvcsw + ended.ru_nvcsw, "involuntary_context_switches": own.ru_nivcsw + ended.ru_nivcsw, "user_cpu_seconds": own.ru_utime + ended.ru_utime, "system_cpu_seconds": own.ru_stime + ended.ru_stime,
        "peak_memory_bytes": max(own.ru_maxrss, ended.ru_maxrss) * 1024,
    }
