"""Audit of historical recordings that no plan binds: nothing missing is made up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.audio_files import probe_observations
from ..sources.wav import OBSERVED, prosody_observation
from .checks import ContractViolation, require_empty

MAX_ROWS = 10_000
#: Fields that must be there, even if null.
EXPLICIT = ("seed", "prompt_id", "requested_text")
PROBED = [f"prosody_{name}" for name in OBSERVED]


def check_manifest(manifest: DataFrame) -> None:
    """Identity fields present and unique; the explicit ones must be columns; at most ``MAX_ROWS`` rows."""
    missing = [c for c in EXPLICIT if c not in manifest.columns]
    if missing:
        raise ContractViolation(f"not stated, not even as null: {', '.join(missing)}")
    if manifest.limit(MAX_ROWS + 1).count() > MAX_ROWS:
        raise ContractViolation(f"more than {MAX_ROWS} rows")
    require_empty(manifest.groupBy("sample_id").count().where("count > 1 or sample_id is null"), "sample ids repeat or are missing")


def audit_prosody(spark: SparkSession, manifest: DataFrame, base: str) -> dict[str, DataFrame]:
    """Probe results and coverage of ``manifest(sample_id, audio_path, audio_sha256, seed, prompt_id, requested_text)``."""
    check_manifest(manifest)
    results = probe_observations(spark, manifest.withColumn("valid", F.lit(True)), base, prosody_observation, PROBED)
    stated = [F.count_if(F.col(c).isNotNull()).alias(f"with_{c}") for c in EXPLICIT]
    coverage = manifest.agg(F.count("*").alias("rows"), *stated).crossJoin(results.agg(F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "failed").alias("failed")))
    return {"results": results, "coverage": coverage}
