"""Generation attempts: receipts that bind an observation to the plan, the runtime and the audio."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.identity import canonical_sha256
from .rules import Rule, failures

#: Columns that are derived after generation and do not identify an attempt.
DERIVED = (
    "augmentation_history", "clipping_fraction", "evidence", "extractor_failures", "hypothesis_text", "reference_speaker_embedding", "reference_speaker_embeddings", "sample_rate_hz", "silence_fraction", "speaker_embedding",
)


def with_digest(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Adds the canonical digest of an object of ``columns``; numbers print as Python prints them, and nulls are kept."""
    out = StructType([*rows.schema.fields, StructField(name, StringType())])  # rows.schema itself is cached
    text = F.to_json(F.struct(*(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}).alias(c) for c in columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(batch.num_columns - 1).to_pylist()
            digests = [canonical_sha256({k: json.loads(v)["v"] for k, v in json.loads(t).items()}) for t in held]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(digests, pa.string())], names=[*batch.schema.names[:-1], name])

    return rows.withColumn("_json", text).mapInArrow(run, out)


def generation_digest(obs: DataFrame) -> DataFrame:
    """Adds generation_sha256: the digest of a row without its derived and prosody columns."""
    own = [c for c in obs.columns if c not in DERIVED and not c.startswith(("prosody_", "_"))]
    return with_digest(obs, own, "generation_sha256")


def receipt_rules() -> list[Rule]:
    audio = F.col("audio_path").isNull() == F.col("audio_sha256").isNull()
    return [Rule("audio_path_and_digest", audio), Rule("valid_has_audio", ~F.col("valid") | F.col("audio_sha256").isNotNull()), Rule.sha256("audio_sha256"), Rule.number("generation_seconds", 0), Rule.number("peak_memory_bytes", 0)]


def build_receipts(obs: DataFrame, plan: DataFrame, runtime_sha256: str) -> tuple[DataFrame, DataFrame]:
    """(receipts, breaches) for observations of planned samples."""
    bad = failures(obs, receipt_rules(), "sample_id")
    unplanned = obs.join(plan, "sample_id", "left_anti").select("sample_id", F.lit("not_planned").alias("rule"))
    rows = generation_digest(obs.join(plan.select("sample_id"), "sample_id", "left_semi")).withColumn("runtime_sha256", F.lit(runtime_sha256))
    receipts = with_digest(rows.select("sample_id", "generation_sha256", "audio_sha256", "runtime_sha256"), ["sample_id", "generation_sha256", "audio_sha256", "runtime_sha256"], "attempt_sha256")
    return receipts, bad.unionByName(unplanned)


def apply_receipts(obs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Observations with their attempt digest and whether they still are what the receipt was made of."""
    now = generation_digest(obs)
    r = receipts.select("sample_id", F.col("generation_sha256").alias("r_generation"), F.col("audio_sha256").alias("r_audio"), "attempt_sha256")
    out = now.join(r, "sample_id", "left")
    bound = F.col("r_generation").eqNullSafe(F.col("generation_sha256")) & F.col("r_audio").eqNullSafe(F.col("audio_sha256"))
    return out.withColumn("attempt_bound", bound & F.col("attempt_sha256").isNotNull()).drop("r_generation", "r_audio")
