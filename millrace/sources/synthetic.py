"""Synthetic samples, the same for a seed and index however they are partitioned."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions import scalars


# Least and greatest value of each number of a profile.
RANGES = {
    "samples": (1, math.inf), "width": (1, math.inf), "height": (1, math.inf), "classes": (1, math.inf),
    "noise": (0, 255), "jpeg_quality": (1, 100), "png_compress_level": (0, 9),
}
# Encodings and the extension of their files.
ENCODINGS = {"jpeg": "jpg", "png": "png"}


@dataclass(frozen=True)
class Profile:
    """What a synthetic dataset is like; impossible values are refused when one is made."""

    profile: str
    samples: int
    width: int
    height: int
    encoding: str = "jpeg"
    classes: int = 100
    seed: int = 1234
    noise: int = 24
    jpeg_quality: int = 85
    png_compress_level: int = 6

    def __post_init__(self) -> None:
        wrong = [f"{k} must be from {low} to {high}" for k, (low, high) in RANGES.items() if not low <= getattr(self, k) <= high]
        wrong += [] if self.encoding in ENCODINGS else [f"encoding must be one of {', '.join(ENCODINGS)}"]
        if wrong:
            raise ConfigError(f"profile {self.profile}: " + "; ".join(wrong))

    @property
    def extension(self) -> str:
        return ENCODINGS[self.encoding]


# The profiles by name.
PROFILES = {
    "tiny": Profile("tiny", 256, 32, 32, classes=8),
    "metadata-heavy": Profile("metadata-heavy", 50_000, 64, 64),
    "balanced": Profile("balanced", 20_000, 224, 224),
    "decode-heavy": Profile("decode-heavy", 10_000, 1024, 1024, encoding="png", noise=48),
}


def load_profile(path: str) -> Profile:
    import yaml

    with open(path) as f:
        found = yaml.safe_load(f)
    about = found.get("dataset") if isinstance(found, dict) and len(found) == 1 else None
    if not isinstance(about, dict):
        raise ConfigError(f"{path}: must hold one mapping, dataset")
    try:
        return Profile(**about)
    except TypeError as e:  # an option that is unknown or lacking, or a value that is no number
        raise ConfigError(f"{path}: {e}") from None


def profile_record(profile: Profile, manifest_path: str, rows: DataFrame) -> dict[str, Any]:
    """How a dataset came about, to be kept beside it: its profile, and what its manifest adds up to."""
    sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("b")).first()
    return {"dataset": asdict(profile), "manifest_path": manifest_path, "total_samples": sums["n"], "total_bytes": sums["b"]}


def payload(seed: int, index: int, size: int) -> bytes:
    """``size`` bytes that follow from seed and index. No image library is assumed: they are noise, not a picture."""
    key = int.from_bytes(hashlib.sha256(f"{seed}:{index}".encode()).digest()[:8], "little")
    return np.random.default_rng(key).integers(0, 256, size, dtype=np.uint8).tobytes()


def samples(spark: SparkSession, profile: Profile, count: int | None = None) -> DataFrame:
    """Manifest columns and ``payload``; sizes vary by a few percent about a tenth of the pixels and a header."""
    base, seed = 256 + profile.width * profile.height // 10, profile.seed

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                ids = batch.column(0).slice(at, 256).to_pylist()
                data = [payload(seed, i, base + (i * 7919) % (base // 20 + 1)) for i in ids]
                yield pa.RecordBatch.from_pydict({"index": pa.array(ids, pa.int64()), "payload": pa.array(data, pa.binary())})

    made = spark.range(profile.samples if count is None else count).mapInArrow(fill, "index long, payload binary")
    i = F.col("index")
    return made.select(
        scalars.sample_id(i).alias("sample_id"), scalars.sample_path(
            i, profile.classes, profile.extension
        ).alias("relative_path"), scalars.class_of(i, profile.classes).alias("class_id"), F.octet_length("payload").cast("long").alias("byte_size"),
        F.lit(profile.width).alias("width"), F.lit(profile.height).alias("height"), scalars.checksum(F.col("payload")).alias("checksum"), F.lit(
            profile.width * profile.height
        ).cast("long").alias("estimated_decode_cost"), "payload",
    )
