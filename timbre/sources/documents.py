"""JSON documents with explicit schemas, and JSONL manifests with line numbers and error rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LINE_BYTES = 8 << 20
MAX_MANIFEST_BYTES = 512 << 20

EMBEDDING = T.ArrayType(T.DoubleType())
#: Objective observations; everything that a row may hold and the engine reads.
OBSERVATION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("observation_schema_version", "sample_id", "candidate_id", "prompt_id")]
    + [T.StructField("seed", T.LongType()), T.StructField("runtime_id", T.StringType()), T.StructField("requested_text", T.StringType()), T.StructField("hypothesis_text", T.StringType()), T.StructField("valid", T.BooleanType())]
    + [T.StructField(n, T.DoubleType()) for n in ("generation_seconds", "audio_duration_seconds", "peak_memory_bytes", "sample_rate_hz", "silence_fraction", "clipping_fraction")]
    + [T.StructField("reference_speaker_embedding", EMBEDDING), T.StructField("speaker_embedding", EMBEDDING)]
    + [T.StructField("reference_speaker_embeddings", T.ArrayType(T.StructType([T.StructField("reference_id", T.StringType()), T.StructField("embedding", EMBEDDING)])))]
    + [T.StructField(n, T.StringType()) for n in ("audio_path", "audio_sha256", "artifact_set_id", "artifact_set_sha256")]
)
#: What evidence of one kind may declare.
EVIDENCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "extractor", "revision", "extractor_artifact_set_sha256", "input_audio_sha256", "extractor_execution_receipt_sha256", "reference_id", "reference_audio_sha256", "reference_transcript_sha256",
        "reference_aggregation", "reference_catalog_sha256", "reference_set_sha256", "reference_assignment_plan_sha256", "reference_assignment_sha256", "speaker_measurement_sha256",
        "generation_plan_sha256", "planned_sample_sha256", "source_generation_observation_sha256", "output_audio_sha256", "attempt_sha256",
    )]
    + [T.StructField("references", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("reference_id", "reference_audio_sha256", "reference_transcript_sha256")])))]
)
#: Observations with all that scoring and extraction read and write.
FULL_OBSERVATION = T.StructType(
    [*OBSERVATION.fields, T.StructField("evidence", T.MapType(T.StringType(), EVIDENCE))]
    + [T.StructField("augmentation_history", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("status", T.StringType()), *EVIDENCE.fields])))]
    + [T.StructField("extractor_failures", T.MapType(T.StringType(), T.StructType([*EVIDENCE.fields, T.StructField("error_type", T.StringType()), T.StructField("error", T.StringType())])))]
    + [T.StructField(f"prosody_{n}", T.BooleanType() if n == "eligible_for_long_form" else T.DoubleType()) for n in (
        "active_frame_fraction", "active_rms_db_std", "analysis_duration_seconds", "eligible_for_long_form", "leading_inactive_seconds", "pause_duration_cv", "pause_fraction", "pause_rate_per_minute",
        "phrase_duration_cv", "trailing_inactive_seconds", "window_rms_db_std", "zero_crossing_rate_hz_std",
    )]
)


def read_array(spark: SparkSession, path: str, field: str, schema: T.StructType) -> DataFrame:
    """Rows of the array ``field`` of a JSON document, with ``_ord``, their place in it."""
    doc = T.StructType([T.StructField(field, T.ArrayType(schema))])
    return spark.read.schema(doc).option("multiLine", True).json(path).select(F.posexplode(field).alias("_ord", "_row")).select("_ord", "_row.*")


def read_manifest(spark: SparkSession, path: str, max_line_bytes: int = MAX_LINE_BYTES, max_bytes: int = MAX_MANIFEST_BYTES) -> DataFrame:
    """(path, line, text, error, manifest_sha256): each line of JSONL manifests; bad lines are rows with an error.

    Errors: line_too_long, invalid_utf8, manifest_too_large (one row for the file, which is then not read).
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "line", "text", "error", "manifest_sha256"]
        for batch in batches:
            for path_, size, content in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "content")), strict=True):
                digest = hashlib.sha256(content).hexdigest()
                rows = []
                if size > max_bytes:
                    rows.append((path_, 0, None, "manifest_too_large", digest))
                else:
                    for i, line in enumerate(content.splitlines(), 1):
                        if len(line) > max_line_bytes:
                            rows.append((path_, i, None, "line_too_long", digest))
                            continue
                        try:
                            rows.append((path_, i, line.decode(), None, digest))
                        except UnicodeDecodeError:
                            rows.append((path_, i, None, "invalid_utf8", digest))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    return files.mapInArrow(split, "path string, line long, text string, error string, manifest_sha256 string")


def manifest_rows(lines: DataFrame, audio: str = "audio", text: str = "text", group: str | None = None) -> DataFrame:
    """Manifest lines parsed, blank ones left out: audio may be a string or an object with a path; values that are not strings count as absent.

    Adds the errors invalid_json and not_an_object.
    """
    out = lines.where("error is not null or trim(text) != ''").withColumn("_v", F.try_parse_json("text"))

    def string(path: str):
        here = F.try_variant_get("_v", path, "variant")
        return F.when(F.schema_of_variant(here) == "STRING", F.trim(F.try_variant_get("_v", path, "string")))

    whole = F.schema_of_variant("_v").startswith("OBJECT")
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("_v").isNull(), "invalid_json").when(~whole, "not_an_object")
    out = out.withColumns({"error": error, "audio_path": F.coalesce(string(f"$.{audio}"), string(f"$.{audio}.path")), "transcript": string(f"$.{text}")})
    return out.withColumn("group_id", F.nullif(string(f"$.{group}"), F.lit("")) if group else F.lit(None).cast("string")).drop("_v")


def write_once(df: DataFrame, path: str) -> None:
    """Write rows where nothing may be overwritten."""
    df.write.mode("errorifexists").json(path)
