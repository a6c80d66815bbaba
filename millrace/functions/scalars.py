"""Expressions over single rows: names, checksums, sizes, expectations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import rate, ratio

TAR_BLOCK = 512
TAR_RECORD = 10240


def sample_id(index: Column) -> Column:
    return F.concat(F.lit("s"), F.lpad(index.cast("string"), 8, "0"))


def class_of(index: Column, classes: int) -> Column:
    return F.pmod(index, F.lit(classes)).cast("int")


def sample_path(index: Column, classes: int, extension: str) -> Column:
    """Where the synthetic source stores a sample."""
    return F.concat(
        F.lit("images/class_"), F.lpad(class_of(index, classes).cast("string"), 4, "0"), F.lit("/"), sample_id(index), F.lit("." + extension)
    )


def checksum(payload: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(payload, 256), 1, 16)


def extension(name: Column) -> Column:
    """The lower-cased last suffix of a file name; ``(none)`` for names without one and for dot files."""
    found = F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))
    return F.when(found == "", F.lit("(none)")).otherwise(found)


def tar_member_bytes(size: Column) -> Column:
    """A payload and its class record in a tar file: two headers, the padded payload, one padded block."""
    return F.lit(TAR_BLOCK) + (F.floor((size + TAR_BLOCK - 1) / TAR_BLOCK) * TAR_BLOCK) + F.lit(2 * TAR_BLOCK)


def tar_bytes(members: Column) -> Column:
    """A tar file of that many bytes in members: two zero blocks, padded to a record."""
    return (F.floor((members + 2 * TAR_BLOCK + TAR_RECORD - 1) / TAR_RECORD) * TAR_RECORD).cast("long")


def oversubscription(workers: Column, cpus: Column) -> Column:
    """Processes by CPU: the workers and the process that consumes."""
    return ratio(workers + 1, cpus)


def cpu_utilization(user: Column, system: Column, seconds: Column, cpus: Column) -> Column:
    return ratio(user + system, seconds * cpus)


def epoch_seconds(total: Column, samples: Column, seconds: Column) -> Column:
    """How long all samples would take at the measured rate."""
    return ratio(total, rate(samples, seconds))


def expected_samples(total: Column, batch: Column, drop_last: Column, streaming: Column) -> Column:
    """Samples that a complete epoch should deliver."""
    return F.when(~drop_last | streaming, total).otherwise(F.floor(total / batch) * batch).cast("long")


def missing_allowance(batch: Column, workers: Column, drop_last: Column, streaming: Column) -> Column:
    """Samples that may stay unread: a stream drops a short batch in each worker."""
    return F.when(drop_last & streaming, (batch - 1) * F.greatest(F.lit(1), workers)).otherwise(F.lit(0)).cast("long")


def files_opened(streaming: Column, shard_opens: Column, samples: Column) -> Column:
    return F.when(streaming, shard_opens).otherwise(samples)
