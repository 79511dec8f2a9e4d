"""Receipts of executions and runs, and the files behind them: which evidence is bound to content, and which files are independent."""

from __future__ import annotations

import os
import re
from pathlib import Path

from ..functions.identity import canonical_sha256
from ..operators.contracts import COUNT, GIT, POSITIVE, SHA256, TEXT, TRUE, Breach, Fields, Items, Leaf, matching, one_of
from .checks import ContractViolation
from .objective import MEAN_OF_REFERENCES
from .packs import ID, SEED
from .runtime import pinned

# Modes, run roles and what an executed extractor must state.
ADAPTATION_MODES = ("zero_shot", "lora", "full_sft", "partial_sft", "prompt_adapter", "provider_managed_fine_tune")
RUN_MODES = ("uninterrupted", "interrupted_resumed")
IDENTITY = ("base_artifact_sha256", "dataset_lineage_sha256", "training_controls_sha256", "initial_state_sha256")
RUNTIME_METRICS = ("generation_seconds", "audio_duration_seconds", "peak_memory_bytes")
COMPUTE_TYPES = ("default", "auto", "int8", "int8_float16", "int8_float32", "int8_bfloat16", "int16", "float16", "bfloat16", "float32")
_ONLY = {"others": Leaf("unsupported", lambda v: False)}
_FALSE, _ZERO = Leaf("false", lambda v: v is False), Leaf("zero", lambda v: v == 0 and not isinstance(v, bool))
_DEVICE = matching("device", r"cpu|cuda(:\d+)?|auto")
_PLACE = {"device": _DEVICE, "python_version": TEXT, "platform": TEXT}
EXECUTIONS = {
    "asr": Fields({
        "backend": TEXT, **_PLACE, "device_index": COUNT, "compute_type": one_of(*COMPUTE_TYPES), "package_versions": Fields({k: TEXT for k in ("faster-whisper", "ctranslate2", "tokenizers", "av")}, **_ONLY),
        "model_loading": Fields({"local_files_only": TRUE}, **_ONLY),
        "decoding": Fields({"language": matching("language", r"[a-z]{2,3}"), "task": one_of("transcribe"), "beam_size": POSITIVE, "temperature": _ZERO, "condition_on_previous_text": _FALSE, "word_timestamps": _FALSE, "vad_filter": _FALSE}, **_ONLY),
    }, **_ONLY),
    "speaker_encoder": Fields({"backend": TEXT, **_PLACE, "trusted_model_checkpoints": TRUE, "package_versions": Fields({k: TEXT for k in ("speechbrain", "torch", "torchaudio")}, **_ONLY)}, **_ONLY),
}
_RUN = Fields({
    "run_id": ID, "producer_repository": TEXT, "producer_revision": GIT, "backend_id": ID, "adaptation_mode": one_of(*ADAPTATION_MODES), **dict.fromkeys(IDENTITY, SHA256),
    "target_updates": POSITIVE, "completed_updates": POSITIVE, "execution_mode": one_of(*RUN_MODES),
})
_RESUME = Fields({"interruption_observed": TRUE, "checkpoint_completed_updates": POSITIVE, "resumed_from_completed_updates": POSITIVE, "interruption_signal": TEXT, "interruption_receipt_sha256": SHA256})
_ASSIGNMENTS = Items(Fields({"prompt_id": TEXT, "seed": SEED, "reference_ids": Items(ID, 1)}, **_ONLY), 1)


def receipt_digest(document: dict) -> str:
    """Digest of a result document without its own receipt."""
    return canonical_sha256({k: v for k, v in document.items() if k != "execution_receipt_sha256"})


def execution_breaches(document: dict) -> list[Breach]:
    """Breaches of an executed extractor's result document: stated execution, frozen decoding, and its receipt."""
    kind = document.get("extractor", {}).get("kind") if isinstance(document.get("extractor"), dict) else None
    if kind not in EXECUTIONS:
        return [("$.extractor.kind", "executed_kind")]
    execution = document.get("execution")
    out = list(EXECUTIONS[kind].breaches(execution, "$.execution"))
    if isinstance(execution, dict) and execution.get("device") == "cpu" and execution.get("device_index", 0) != 0:
        out.append(("$.execution.device_index", "zero_on_cpu"))
    if document.get("execution_receipt_sha256") != receipt_digest(document):
        out.append(("$.execution_receipt_sha256", "matches_document"))
    return out


def run_breaches(receipt: dict, mode: str) -> list[Breach]:
    """Breaches of the receipt of a run in ``mode``: identity, updates and, where it was interrupted, that it went on where its checkpoint ended."""
    out = list(_RUN.breaches(receipt, "$"))
    if not isinstance(receipt, dict):
        return out
    if receipt.get("execution_mode") != mode:
        out.append(("$.execution_mode", "expected_mode"))
    if receipt.get("completed_updates") != receipt.get("target_updates"):
        out.append(("$.completed_updates", "all_updates"))
    held = receipt.get("identity_artifacts")
    if held is not None:
        by = {r.get("role"): r.get("sha256") for r in held if isinstance(r, dict)} if isinstance(held, list) else {}
        out += [("$.identity_artifacts", f"matches_{f}") for f in IDENTITY if by.get(f.removesuffix("_sha256")) != receipt.get(f)]
    resume = receipt.get("resume")
    if mode == "uninterrupted":
        return out + ([("$.resume", "absent")] if resume is not None else [])
    out += _RESUME.breaches(resume, "$.resume")
    if isinstance(resume, dict):
        at, on = resume.get("checkpoint_completed_updates"), resume.get("resumed_from_completed_updates")
        if at != on:
            out.append(("$.resume.resumed_from_completed_updates", "where_the_checkpoint_ended"))
        if isinstance(at, int) and isinstance(receipt.get("target_updates"), int) and at >= receipt["target_updates"]:
            out.append(("$.resume.checkpoint_completed_updates", "before_the_target"))
    return out


def file_identities(path: Path, kind: str) -> set[tuple[int, int]]:
    """(device, inode) of a local file, or of a tree's files; links of either kind inside are refused."""
    if path.is_symlink() or not (path.is_file() if kind == "file" else path.is_dir()):
        raise ContractViolation(f"no plain {kind}: {path}")
    files = [path] if kind == "file" else sorted(p for p in path.rglob("*") if not p.is_dir() or p.is_symlink())
    if not files or any(p.is_symlink() or not p.is_file() for p in files):
        raise ContractViolation(f"a tree without files, or with links: {path}")
    held = [(s.st_dev, s.st_ino) for s in map(os.stat, files)]
    if len(set(held)) < len(held):
        raise ContractViolation(f"one file under two names: {path}")
    return set(held)


def independent(runs: dict[str, dict[str, tuple[Path, str]]]) -> None:
    """Artifacts of all roles of all runs must share no file, not even by a hard link."""
    owner: dict[tuple[int, int], str] = {}
    for run, artifacts in runs.items():
        for role, (path, kind) in sorted(artifacts.items()):
            for key in file_identities(path, kind):
                if key in owner:
                    raise ContractViolation(f"{run}/{role} shares a file with {owner[key]}")
                owner[key] = f"{run}/{role}"


def refuse_output_alias(output: Path, artifacts: dict[str, tuple[Path, str]]) -> None:
    """A report must not be written over, or into, what it reports on."""
    target = output.expanduser().resolve()
    for role, (path, kind) in artifacts.items():
        here = path.expanduser().resolve()
        if target == here or (kind == "tree" and target.is_relative_to(here)):
            raise ContractViolation(f"the report would change the artifact {role}")


def assignment_digest(plan_sha256: str, prompt_id: str, seed: int, reference_ids: list[str]) -> str:
    """Digest of one prompt's and seed's references within an assignment plan."""
    return canonical_sha256({"assignment_plan_sha256": plan_sha256, "prompt_id": prompt_id, "seed": seed, "reference_ids": reference_ids})


def assignment_plan(plan_id: str, generation_plan: dict, catalog: dict, assignments: dict[tuple[str, int], list[str]], policy_id: str, dimensions: list[str], rationale: str) -> dict:
    """Which references each prompt and seed is measured against, bound to plan and catalog; a plan is a short list."""
    keys = sorted({(s["prompt_id"].strip(), s["seed"]) for s in generation_plan.get("samples", [])})
    rows = [{"prompt_id": p, "seed": s, "reference_ids": assignments[p, s]} for p, s in sorted(assignments)]
    known = {r["reference_id"] for r in catalog["references"]}
    found = list(_ASSIGNMENTS.breaches(rows, "$.assignments"))
    if found or not keys or sorted(assignments) != keys:
        raise ContractViolation(f"assignments must be the plan's prompts and seeds: {found[:3]}")
    if any(r["reference_ids"] != sorted(set(r["reference_ids"])) or set(r["reference_ids"]) - known for r in rows):
        raise ContractViolation("references must be in the catalog, sorted, each once")
    if not all(ID.test(x) for x in (plan_id, policy_id, *dimensions)) or not dimensions or dimensions != sorted(set(dimensions)) or not rationale.strip():
        raise ContractViolation("a plan has an id, a policy with sorted dimensions, and a rationale")
    body = {
        "schema_version": "1.0.0", "plan_id": plan_id, "generation_plan_sha256": canonical_sha256(generation_plan), "reference_catalog_sha256": catalog["catalog_sha256"],
        "selection_policy": {"policy_id": policy_id, "stratification_dimensions": dimensions, "rationale": rationale.strip()}, "reference_aggregation": MEAN_OF_REFERENCES, "assignments": rows,
    }
    return body | {"assignment_plan_sha256": canonical_sha256(body)}


def attempt_bound(row: dict, generation_sha256: str, plan_sha256: str | None = None, planned: dict | None = None) -> bool:
    """Whether a row's runtime evidence names the attempt that made it; a binding that is there but wrong is refused.

    ``generation_sha256`` is the row's own digest (``attempts.generation_digest``).
    """
    e = (row.get("evidence") or {}).get("runtime") or {}
    named = ("generation_plan_sha256", "planned_sample_sha256", "source_generation_observation_sha256", "attempt_sha256")
    if not any(e.get(k) for k in (*named, "output_audio_sha256")):
        return False
    output = e.get("output_audio_sha256")
    core = {
        "sample_id": row["sample_id"], "generation_plan_sha256": e.get("generation_plan_sha256"), "planned_sample_sha256": e.get("planned_sample_sha256"), "source_generation_observation_sha256": generation_sha256,
        "output_audio_sha256": output, "runtime_metrics": {k: row[k] for k in RUNTIME_METRICS if row.get(k) is not None}, "producer": {"name": str(e.get("extractor") or "").strip(), "revision": str(e.get("revision") or "").strip()},
    }
    checks = {
        "complete": all(isinstance(e.get(k), str) and re.fullmatch("[0-9a-f]{64}", e[k]) for k in named), "producer": bool(core["producer"]["name"]) and pinned(core["producer"]["revision"]),
        "audio": output == row.get("audio_sha256") if row.get("valid") else output in (None, row.get("audio_sha256")), "row": e.get("source_generation_observation_sha256") == generation_sha256,
        "plan": plan_sha256 in (None, e.get("generation_plan_sha256")), "sample": planned is None or e.get("planned_sample_sha256") == canonical_sha256(planned), "attempt": e.get("attempt_sha256") == canonical_sha256(core),
    }
    if wrong := [k for k, holds in checks.items() if not holds]:
        raise ContractViolation(f"the attempt of {row['sample_id']} does not bind: {', '.join(wrong)}")
    return True


def evidence_faults(row: dict, kinds: list[str], generation_sha256: str, plan_sha256: str, planned: dict, references: dict | None = None) -> list[str]:
    """Why a row's evidence of ``kinds`` is not bound to content, as plan-required metrics ask; empty where it is.

    ``references`` is the assignment plan that speaker evidence must follow.
    """
    out = []
    for kind in sorted(kinds):
        e = (row.get("evidence") or {}).get(kind) or {}
        if kind == "runtime":
            if not attempt_bound(row, generation_sha256, plan_sha256, planned):
                out.append("runtime: no attempt")
            continue
        if not row.get("audio_sha256") or e.get("input_audio_sha256") != row["audio_sha256"]:
            out.append(f"{kind}: other audio")
        if not SHA256.test(e.get("extractor_artifact_set_sha256")):
            out.append(f"{kind}: no artifacts")
        if kind == "speaker_encoder":
            wanted = {(a["prompt_id"], a["seed"]): a["reference_ids"] for a in (references or {}).get("assignments", [])}.get((planned.get("prompt_id"), planned.get("seed")))
            held = [r.get("reference_id") for r in e.get("references") or []]
            if wanted is None or held != wanted:
                out.append("speaker_encoder: not the assigned references")
            elif (e.get("reference_catalog_sha256"), e.get("reference_assignment_plan_sha256"), e.get("reference_assignment_sha256")) != (
                references["reference_catalog_sha256"], references["assignment_plan_sha256"], assignment_digest(references["assignment_plan_sha256"], planned["prompt_id"], planned["seed"], wanted),
            ):
                out.append("speaker_encoder: not bound to the assignment plan")
            if not e.get("speaker_measurement_sha256"):
                out.append("speaker_encoder: no measurement")
    return out


def below(base: Path, name: object) -> Path:
    """A recorded path below ``base``, none of whose parts is a link."""
    if not isinstance(name, str) or not name.strip() or Path(name).is_absolute() or ".." in Path(name).parts:
        raise ContractViolation(f"not a path below its base: {name!r}")
    path = base
    for part in Path(name).parts:
        path = path / part
        if path.is_symlink():
            raise ContractViolation(f"a link on the way: {name}")
    return path
