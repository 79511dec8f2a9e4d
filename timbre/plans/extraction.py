"""Extractors: their identity, their result documents, and results applied to observations with provenance and history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import canonical_sha256
from ..operators import rules
from ..operators.extract import cover
from ..operators.rules import Rule
from ..sources.audio_files import probe_observations, verify_audio
from ..sources.wav import OBSERVED, level_probe, prosody_observation
from .checks import ContractViolation, require_empty
from .lineage import declarations, held_records, identifier
from .runtime import pinned

PROSODY = tuple(f"prosody_{name}" for name in OBSERVED)
#: The fields that each kind of extractor fills, and prosody fields that may be null or are parts of a whole.
FIELDS = {
    "audio_probe": ("sample_rate_hz", "silence_fraction", "clipping_fraction"), "asr": ("hypothesis_text",), "speaker_encoder": ("reference_speaker_embedding", "speaker_embedding"),
    "speaker_encoder_references": ("reference_speaker_embeddings", "speaker_embedding"), "prosody_proxy": PROSODY,
}
NULLABLE = tuple(f"prosody_{n}" for n in ("active_rms_db_std", "pause_duration_cv", "phrase_duration_cv", "window_rms_db_std", "zero_crossing_rate_hz_std"))
FRACTIONS = ("prosody_active_frame_fraction", "prosody_pause_fraction")
PROBES: dict[str, Callable[[bytes], dict]] = {"audio_probe": level_probe, "prosody_proxy": prosody_observation}


def extractor_identity(spark: SparkSession, kind: str, name: str, revision: str, artifacts: list[str]) -> dict:
    """Who extracted: kind, name, pinned revision and the content of its artifacts (``ROLE=file|tree=PATH``)."""
    if kind not in FIELDS or not name.strip() or not pinned(revision):
        raise ContractViolation("an extractor has a known kind, a name and a pinned revision")
    held = held_records(spark, declarations(artifacts))
    return {"kind": kind, "name": name.strip(), "revision": revision.strip(), "artifact_set_sha256": canonical_sha256(held), "artifacts": held}


def speaker_reference(spark: SparkSession, reference_id: str, audio: str, transcript: str) -> dict:
    """A reference recording and its transcript, by content."""
    held = {r["role"]: {"sha256": r["sha256"], "bytes": r["bytes"]} for r in held_records(spark, [("audio", "file", audio), ("transcript", "file", transcript)])}
    return {"reference_id": identifier(reference_id, "a reference id"), **held}


def speaker_catalog(spark: SparkSession, catalog_id: str, references: dict[str, tuple[str, str]]) -> dict:
    """Several references, in order of the id, with the catalog's own digest; a catalog is a short list."""
    if not references:
        raise ContractViolation("a catalog holds references")
    body = {"catalog_id": identifier(catalog_id, "the catalog id"), "references": [speaker_reference(spark, r, *references[r]) for r in sorted(references)]}
    return body | {"catalog_sha256": canonical_sha256(body)}


def check_catalog(catalog: dict) -> None:
    """A catalog's own digest, sorted and unique ids."""
    body = {k: v for k, v in catalog.items() if k != "catalog_sha256"}
    ids = [r.get("reference_id") for r in catalog.get("references", [])]
    if canonical_sha256(body) != catalog.get("catalog_sha256") or not ids or ids != sorted(set(ids)):
        raise ContractViolation("the catalog does not match its own digest, or its ids are not sorted and unique")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _vector(x: Column) -> Column:
    return (F.size(x) > 0) & ~F.exists(x, lambda v: ~_finite(v))


def value_rules(kind: str) -> list[Rule]:
    """What the values of a complete result must keep; ``reference_ids`` names the references asked for, in order."""
    if kind == "asr":
        return [Rule("hypothesis_text", F.col("hypothesis_text").isNotNull())]
    if kind == "audio_probe":
        rate = F.col("sample_rate_hz")
        return [Rule("sample_rate_hz", _finite(rate) & (rate > 0) & (rate == F.floor(rate)))] + [Rule(c, _finite(F.col(c)) & F.col(c).between(0, 1)) for c in FIELDS[kind][1:]]
    if kind == "prosody_proxy":
        out = []
        for c in PROSODY:
            x = F.col(c)
            ok = x.isNotNull() if c == "prosody_eligible_for_long_form" else _finite(x) & (x >= 0) & ((x <= 1) if c in FRACTIONS else F.lit(True))
            out.append(Rule(c, x.isNull() | ok if c in NULLABLE else ok))
        return out
    own = Rule("speaker_embedding", _vector(F.col("speaker_embedding")))
    if kind == "speaker_encoder":
        r = F.col("reference_speaker_embedding")
        return [own, Rule("reference_speaker_embedding", _vector(r)), Rule("equal_lengths", F.size(r) == F.size("speaker_embedding"))]
    r = F.col("reference_speaker_embeddings")
    return [
        own, Rule("references", (F.size(r) > 0) & ~F.exists(r, lambda x: ~_vector(x["embedding"]) | (F.size(x["embedding"]) != F.size("speaker_embedding")))),
        Rule("reference_ids", F.transform(r, lambda x: x["reference_id"]) == F.col("reference_ids")), Rule("reference_ids_sorted", F.col("reference_ids") == F.array_sort(F.array_distinct("reference_ids"))),
    ]


def document_digest(obs: DataFrame) -> str:
    """Digest of an observation document, independent of how its rows are spread: over the rows' digests in document order."""
    from ..operators.attempts import with_digest

    rows = with_digest(obs, [c for c in obs.columns if c != "_ord"], "_sha256").orderBy("_ord").select("_sha256")
    return canonical_sha256([r["_sha256"] for r in rows.toLocalIterator()])


def probe_results(spark: SparkSession, obs: DataFrame, base: str, kind: str) -> DataFrame:
    """Results of a built-in probe for each valid observation; a file that it cannot take is a failed row."""
    names = list(FIELDS[kind])
    out = probe_observations(spark, obs, base, PROBES[kind], names)
    return out.withColumn("prosody_eligible_for_long_form", F.col("prosody_eligible_for_long_form") > 0) if kind == "prosody_proxy" else out


def apply_extraction(spark: SparkSession, obs: DataFrame, results: DataFrame, identity: dict, base: str, reference: dict[str, str] | None = None, references: DataFrame | None = None) -> DataFrame:
    """Observations with the results' values, evidence, failures and history: built whole or not at all.

    ``obs`` has the columns of ``documents.FULL_OBSERVATION``; ``results(sample_id, audio_sha256, status, <fields>, error_type,
    error)`` covers the valid ones exactly.  The live audio must be what observation and result say.  A field that is
    set, evidence, a failure or history of the same kind are never overwritten.  ``reference`` holds reference_* fields that are the
    same for all; ``references(sample_id, ...)`` those that differ.
    """
    kind = identity["kind"]
    fields = list(FIELDS[kind])
    name = kind.removesuffix("_references")
    require_empty(cover(obs, results), "results do not cover the valid observations exactly")
    require_empty(verify_audio(spark, obs, base).where("fault is not null").select("sample_id", "fault"), "audio is not what was recorded")
    r = results.select("sample_id", F.struct(*(c for c in results.columns if c != "sample_id")).alias("r"))
    both = obs.join(r, "sample_id", "left")
    done = both.where("r is not null")
    require_empty(done.where(~F.col("r.audio_sha256").eqNullSafe(F.col("audio_sha256"))).select("sample_id"), "results of other audio")
    require_empty(done.where(~F.col("r.status").isin("complete", "failed")).select("sample_id"), "unknown status")
    failed = F.col("status") == "failed"
    named = (F.length(F.trim("error_type")) > 0) & (F.length(F.trim("error")) > 0)
    filled = F.lit(False)
    for f in fields:
        filled = filled | F.col(f).isNotNull()
    require_empty(results.where(failed & (~F.coalesce(named, F.lit(False)) | filled)).select("sample_id"), "failed results need an error and hold no values")
    require_empty(rules.failures(results.where(~failed), value_rules(kind), "sample_id"), "values break their rules")
    taken = F.lit(False)
    for f in fields:
        taken = taken | (F.col(f).isNotNull() & (F.col("r.status") == "complete"))
    held = F.map_contains_key(F.coalesce("evidence", F.create_map().cast(obs.schema["evidence"].dataType)), name) | F.exists(F.coalesce("augmentation_history", F.array().cast(obs.schema["augmentation_history"].dataType)), lambda h: h["kind"] == name)
    held = held | F.map_contains_key(F.coalesce("extractor_failures", F.create_map().cast(obs.schema["extractor_failures"].dataType)), name)
    require_empty(done.where(taken | held).select("sample_id"), f"{name} was applied before, or would overwrite fields")
    if references is not None:
        both = both.join(references.select("sample_id", F.struct(*(c for c in references.columns if c != "sample_id")).alias("ref")), "sample_id", "left")
    known = {"extractor": F.lit(identity["name"]), "revision": F.lit(identity["revision"]), "extractor_artifact_set_sha256": F.lit(identity["artifact_set_sha256"]), "input_audio_sha256": F.col("audio_sha256")}
    known |= {k: F.lit(v) for k, v in (reference or {}).items()} | ({c: F.col(f"ref.{c}") for c in references.columns if c != "sample_id"} if references is not None else {})

    def record(kind_of: str, extra: dict[str, Column]) -> Column:
        kinds = obs.schema[kind_of].dataType
        shape = kinds.valueType if hasattr(kinds, "valueType") else kinds.elementType
        return F.struct(*((known | extra).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape))

    complete, bad = F.col("r.status") == "complete", F.col("r.status") == "failed"
    more = F.map_from_arrays(F.array(F.lit(name)), F.array(record("evidence", {})))
    fault = F.map_from_arrays(F.array(F.lit(name)), F.array(record("extractor_failures", {"error_type": F.trim("r.error_type"), "error": F.trim("r.error")})))
    entry = F.array(record("augmentation_history", {"kind": F.lit(name), "status": F.col("r.status")}))
    new = {f: F.when(complete, F.col(f"r.{f}").cast(obs.schema[f].dataType)).otherwise(F.col(f)) for f in fields}
    new["evidence"] = F.when(complete, F.map_concat(F.coalesce("evidence", F.create_map().cast(obs.schema["evidence"].dataType)), more)).otherwise(F.col("evidence"))
    new["extractor_failures"] = F.when(bad, F.map_concat(F.coalesce("extractor_failures", F.create_map().cast(obs.schema["extractor_failures"].dataType)), fault)).otherwise(F.col("extractor_failures"))
    new["augmentation_history"] = F.when(F.col("r").isNotNull(), F.concat(F.coalesce("augmentation_history", F.array().cast(obs.schema["augmentation_history"].dataType)), entry)).otherwise(F.col("augmentation_history"))
    out = both.withColumns(new)
    if name == "speaker_encoder":
        out = _bound_measurements(out)
    return out.select(*obs.columns)


def _measurement(obs: DataFrame) -> DataFrame:
    """(sample_id, m): digest of a speaker measurement with the references that it was taken against."""
    from ..operators.attempts import with_digest

    e = F.try_element_at("evidence", F.lit("speaker_encoder"))
    own = obs.where(e.isNotNull()).select("sample_id", "audio_sha256", "speaker_embedding", "reference_speaker_embedding", "reference_speaker_embeddings", e["reference_set_sha256"].alias("reference_set_sha256"), e["reference_audio_sha256"].alias("reference_audio_sha256"))
    return with_digest(own, [c for c in own.columns if c != "sample_id"], "m").select("sample_id", "m")


def _bound_measurements(obs: DataFrame) -> DataFrame:
    m = _measurement(obs)
    kind = F.lit("speaker_encoder")
    out = obs.join(m, "sample_id", "left")
    changed = F.transform_values("evidence", lambda k, v: F.when(k == kind, v.withField("speaker_measurement_sha256", F.col("m"))).otherwise(v))
    return out.withColumn("evidence", F.when(F.col("m").isNotNull(), changed).otherwise(F.col("evidence"))).drop("m")


def unbound_measurements(obs: DataFrame) -> DataFrame:
    """Samples whose speaker measurement is not the one that their evidence names."""
    e = F.try_element_at("evidence", F.lit("speaker_encoder"))
    return obs.where(e.isNotNull()).join(_measurement(obs), "sample_id").where(~e["speaker_measurement_sha256"].eqNullSafe(F.col("m"))).select("sample_id")
