"""Receipts and bindings, right ones and tampered ones."""

from __future__ import annotations

import os

import pytest

from timbre.functions.identity import canonical_sha256
from timbre.plans import receipts as R
from timbre.plans.checks import ContractViolation

H, G = "a" * 64, "b" * 40


def executed(**changes):
    execution = {
        "backend": "w", "device": "cpu", "device_index": 0, "compute_type": "int8", "python_version": "3", "platform": "l", "package_versions": dict.fromkeys(("faster-whisper", "ctranslate2", "tokenizers", "av"), "1"), "model_loading": {"local_files_only": True},
        "decoding": {"language": "en", "task": "transcribe", "beam_size": 5, "temperature": 0.0, "condition_on_previous_text": False, "word_timestamps": False, "vad_filter": False},
    }
    doc = {"extractor": {"kind": "asr"}, "execution": execution | changes, "results": []}
    return doc | {"execution_receipt_sha256": R.receipt_digest(doc)}


def test_execution_receipts():
    assert R.execution_breaches(executed()) == []
    assert ("$.execution.device_index", "zero_on_cpu") in R.execution_breaches(executed(device_index=1))
    assert ("$.execution.decoding.vad_filter", "false") in R.execution_breaches(executed(decoding=executed()["execution"]["decoding"] | {"vad_filter": True}))
    assert ("$.execution.extra", "unsupported") in R.execution_breaches(executed(extra=1))
    assert ("$.execution_receipt_sha256", "matches_document") in R.execution_breaches(executed() | {"results": [1]})
    assert R.execution_breaches({"extractor": {"kind": "audio_probe"}}) == [("$.extractor.kind", "executed_kind")]


def test_run_receipts():
    run = {"run_id": "r", "producer_repository": "p", "producer_revision": G, "backend_id": "b", "adaptation_mode": "lora", **dict.fromkeys(R.IDENTITY, H), "target_updates": 10, "completed_updates": 10, "execution_mode": "uninterrupted"}
    assert R.run_breaches(run, "uninterrupted") == []
    resume = {"interruption_observed": True, "checkpoint_completed_updates": 4, "resumed_from_completed_updates": 4, "interruption_signal": "SIGTERM", "interruption_receipt_sha256": H}
    resumed = run | {"execution_mode": "interrupted_resumed", "resume": resume}
    assert R.run_breaches(resumed, "interrupted_resumed") == []
    assert ("$.resume", "absent") in R.run_breaches(run | {"resume": resume}, "uninterrupted")
    assert ("$.resume.resumed_from_completed_updates", "where_the_checkpoint_ended") in R.run_breaches(resumed | {"resume": resume | {"resumed_from_completed_updates": 5}}, "interrupted_resumed")
    assert ("$.resume.checkpoint_completed_updates", "before_the_target") in R.run_breaches(resumed | {"resume": resume | {"checkpoint_completed_updates": 10, "resumed_from_completed_updates": 10}}, "interrupted_resumed")
    assert {("$.completed_updates", "all_updates"), ("$.producer_revision", "git_revision")} <= set(R.run_breaches(run | {"completed_updates": 9, "producer_revision": "main"}, "uninterrupted"))
    held = [{"role": f.removesuffix("_sha256"), "sha256": H} for f in R.IDENTITY]
    assert R.run_breaches(run | {"identity_artifacts": held}, "uninterrupted") == [] and R.run_breaches(run | {"identity_artifacts": held[1:]}, "uninterrupted")


def test_independent_files(tmp_path):
    for name in ("one/a", "two/a"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("same bytes")
    runs = {n: {"out": (tmp_path / n, "tree")} for n in ("one", "two")}
    R.independent(runs)
    os.link(tmp_path / "one/a", tmp_path / "two/b")
    with pytest.raises(ContractViolation):
        R.independent(runs)
    os.link(tmp_path / "one/a", tmp_path / "one/c")
    with pytest.raises(ContractViolation):
        R.file_identities(tmp_path / "one", "tree")
    (tmp_path / "link").symlink_to(tmp_path / "one")
    for bad in (lambda: R.file_identities(tmp_path / "link", "tree"), lambda: R.below(tmp_path, "link/a"), lambda: R.below(tmp_path, "../x"), lambda: R.refuse_output_alias(tmp_path / "one" / "report", runs["one"])):
        with pytest.raises(ContractViolation):
            bad()
    assert R.below(tmp_path, "one/a").read_text() == "same bytes"


def test_bindings():
    plan = {"samples": [{"sample_id": "s", "prompt_id": "p", "seed": 1}]}
    catalog = {"catalog_sha256": H, "references": [{"reference_id": "r1"}, {"reference_id": "r2"}]}
    told = R.assignment_plan("plan", plan, catalog, {("p", 1): ["r1", "r2"]}, "policy", ["accent"], "why")
    for bad in ({("p", 1): ["r2", "r1"]}, {("p", 1): ["r9"]}, {("p", 2): ["r1"]}, {}):
        with pytest.raises(ContractViolation):
            R.assignment_plan("plan", plan, catalog, bad, "policy", ["accent"], "why")
    planned, plan_sha = plan["samples"][0], canonical_sha256(plan)
    row = {"sample_id": "s", "valid": True, "audio_sha256": H, "generation_seconds": 1.5}
    core = {
        "sample_id": "s", "generation_plan_sha256": plan_sha, "planned_sample_sha256": canonical_sha256(planned), "source_generation_observation_sha256": "c" * 64, "output_audio_sha256": H,
        "runtime_metrics": {"generation_seconds": 1.5}, "producer": {"name": "x", "revision": "v1"},
    }
    runtime = {k: core[k] for k in ("generation_plan_sha256", "planned_sample_sha256", "source_generation_observation_sha256", "output_audio_sha256")} | {"extractor": "x", "revision": "v1", "attempt_sha256": canonical_sha256(core)}
    speaker = {
        "input_audio_sha256": H, "extractor_artifact_set_sha256": H, "references": [{"reference_id": "r1"}, {"reference_id": "r2"}], "reference_catalog_sha256": H, "reference_assignment_plan_sha256": told["assignment_plan_sha256"],
        "reference_assignment_sha256": R.assignment_digest(told["assignment_plan_sha256"], "p", 1, ["r1", "r2"]), "speaker_measurement_sha256": H,
    }
    good = row | {"evidence": {"runtime": runtime, "speaker_encoder": speaker}}
    assert R.evidence_faults(good, ["runtime", "speaker_encoder"], "c" * 64, plan_sha, planned, told) == []
    assert R.attempt_bound(row | {"evidence": {"runtime": {"extractor": "x"}}}, "c" * 64) is False
    for changed in (good | {"generation_seconds": 2.0}, good | {"audio_sha256": "d" * 64}, good | {"evidence": {"runtime": runtime | {"revision": "main"}}}):
        with pytest.raises(ContractViolation):
            R.attempt_bound(changed, "c" * 64, plan_sha, planned)
    other = good | {"evidence": {"asr": {"input_audio_sha256": "e" * 64}, "speaker_encoder": speaker | {"references": [{"reference_id": "r1"}]}}}
    assert R.evidence_faults(other, ["asr", "speaker_encoder"], "c" * 64, plan_sha, planned, told) == ["asr: other audio", "asr: no artifacts", "speaker_encoder: not the assigned references"]
