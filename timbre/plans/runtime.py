"""Runtime artifacts: a source set and a runtime set, related exactly or by declared derivation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import canonical_sha256
from ..operators.rules import MUTABLE
from .checks import ContractViolation
from .lineage import declarations, git_revision, held_records, identifier

RELATIONS = ("exact", "derived")


def pinned(revision: str) -> bool:
    """Whether a revision names fixed content."""
    return revision.strip().lower() not in ("", *MUTABLE) and re.search(r"\s", revision) is None


def build_manifest(spark: SparkSession, artifact_set_id: str, repository: str, revision: str, source: list[str], bindings: list[dict]) -> dict:
    """Manifest of one source set and the artifacts of two or more runtimes.

    A binding names ``runtime_id``, ``relation``, its ``artifacts`` (``ROLE=file|tree=PATH``) and, where derived, the ``conversion`` (tool and
    pinned revision).  An exact relation is proved: the same roles with the same bytes.
    """
    names = [identifier(b.get("runtime_id"), "a runtime id") for b in bindings]
    if len(names) < 2 or len(set(names)) < len(names):
        raise ContractViolation("a manifest binds two or more runtimes, each once")
    origin = held_records(spark, declarations(source))
    digest, out = canonical_sha256(origin), []
    for b in bindings:
        if b.get("relation") not in RELATIONS:
            raise ContractViolation("a relation is exact or derived")
        held = held_records(spark, declarations(b["artifacts"]))
        bound = {"runtime_id": b["runtime_id"], "relation": b["relation"], "artifact_set_sha256": canonical_sha256(held), "artifacts": held}
        if b["relation"] == "exact":
            if held != origin:
                raise ContractViolation(f"the artifacts of {b['runtime_id']} are not the source's")
        else:
            c = b.get("conversion") or {}
            if not str(c.get("tool") or "").strip() or not pinned(str(c.get("revision") or "")):
                raise ContractViolation(f"the derived runtime {b['runtime_id']} needs a conversion tool and its pinned revision")
            bound |= {"derived_from_sha256": digest, "conversion": {"tool": c["tool"].strip(), "revision": c["revision"].strip()}}
        out.append(bound)
    body = {"schema_version": "1.0.0", "artifact_set_id": identifier(artifact_set_id, "the set's id"), "producer": {"repository": repository.strip(), "revision": git_revision(revision)}}
    return body | {"source_artifact_set_sha256": digest, "source_artifacts": origin, "runtime_bindings": out}


def verify_manifest(spark: SparkSession, manifest: dict, source: list[str], bindings: list[dict]) -> bool:
    """Whether building the manifest again from the current files gives the same."""
    producer = manifest.get("producer", {})
    return build_manifest(spark, manifest.get("artifact_set_id"), producer.get("repository", ""), producer.get("revision"), source, bindings) == manifest


def bindings_frame(spark: SparkSession, manifest: dict) -> DataFrame:
    """(runtime_id, relation, runtime_set_sha256) of a manifest's few runtimes."""
    return spark.createDataFrame([(b["runtime_id"], b["relation"], b["artifact_set_sha256"]) for b in manifest["runtime_bindings"]], "runtime_id string, relation string, runtime_set_sha256 string")


def exact_runtimes(manifests: DataFrame, obs: DataFrame) -> DataFrame:
    """Observations whose runtime has an exact manifest: ``manifests(runtime_id, relation, runtime_set_sha256)``."""
    exact = manifests.where("relation = 'exact'").select("runtime_id", F.col("runtime_set_sha256").alias("artifact_set_sha256"))
    return obs.join(exact, ["runtime_id", "artifact_set_sha256"], "left_semi")


def resume_receipt(run_id: str, mode: str, target_updates: int, completed_updates: int, identity: list[dict], checkpoint_updates: int | None = None, resumed_from: int | None = None, signal: str | None = None) -> dict:
    """Receipt of an uninterrupted or an interrupted and resumed run; a resumed run must go on where its checkpoint ended."""
    if mode not in ("uninterrupted", "interrupted_resumed") or not 0 < completed_updates == target_updates or not identity:
        raise ContractViolation("mode, updates or identity artifacts are not those of a complete run")
    resumed, given = mode == "interrupted_resumed", [x is not None for x in (checkpoint_updates, resumed_from, signal)]
    if (not all(given) if resumed else any(given)) or (resumed and not (0 < checkpoint_updates == resumed_from < target_updates)):
        raise ContractViolation("interruption fields do not fit the mode")
    body = {
        "schema_version": "1.0.0", "run_id": run_id, "execution_mode": mode, "target_updates": target_updates, "completed_updates": completed_updates, "identity_artifacts": sorted(identity, key=lambda r: r["role"]),
        "checkpoint_completed_updates": checkpoint_updates, "resumed_from_completed_updates": resumed_from, "interruption_signal": signal,
    }
    return body | {"receipt_sha256": canonical_sha256(body)}
