"""Command line: one sub-command for each report.  Exit 0: built and good; 1: built, with a negative verdict; 2: inputs break the contract."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.identity import canonical_sha256
from .operators import rules
from .operators.contracts import SHAPES, breaches
from .plans import content, corpus, extraction, history, lineage, listening, matched, objective, pack_documents, packs, receipts, runtime
from .plans.checks import ContractViolation
from .sources import documents
from .sources.audio_files import verify_audio
from .sources.wav import level_probe, prosody_difference, prosody_metrics, prosody_status


def _load(path: str) -> Any:
    return json.loads(Path(path).read_text())


def _rows(df: DataFrame) -> list[dict]:
    """Report rows; a report is a summary, never raw data."""
    return [json.loads(x) for x in df.toJSON().collect()]


def _pairs(texts: list[str]) -> dict[str, str]:
    out = dict(t.split("=", 1) for t in texts if "=" in t)
    if len(out) < len(texts):
        raise ContractViolation("declarations are NAME=PATH, each name once")
    return out


def _observations(spark: SparkSession, path: str) -> DataFrame:
    return documents.read_array(spark, path, "observations", documents.OBSERVATION)


_PLAN = "sample_id string, candidate_id string, prompt_id string, category string, seed long, text string"


def _plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"samples array<struct<{_PLAN.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path).select(F.inline("samples"))


def validate(spark, a):
    found = breaches(a.kind, _load(a.path))
    return {"valid": not found, "errors": [{"path": p, "rule": r} for p, r in found]}, bool(found)


def audit_corpus(spark, a):
    out = corpus.audit(corpus.read_splits(spark, _pairs(a.split), a.audio_field, a.text_field, a.group_field, a.audio_path_group_regex))
    report = {k: _rows(v) for k, v in out.items()}
    return report, bool(report["errors"])


def probe_audio(spark, a):
    return level_probe(Path(a.wav).read_bytes()), False


def probe_prosody(spark, a):
    metrics = prosody_metrics(Path(a.wav).read_bytes())
    return {"status": prosody_status(metrics), "metrics": metrics}, False


def compare_prosody(spark, a):
    return {"candidate_minus_reference": prosody_difference(*(Path(p).read_bytes() for p in (a.reference, a.candidate)))}, False


def _difference(probe: Callable[[bytes], dict]):
    def run(spark, a):
        x, y = (probe(Path(p).read_bytes()) for p in (a.reference, a.candidate))
        return {k: None if x[k] is None or y[k] is None else y[k] - x[k] for k in x}, False

    return run


def validate_observations(spark, a):
    obs = _full(spark, a.observations)
    gates = rules.gate_rules(obs.columns, bool(a.require_version), bool(a.require_seed), bool(a.require_runtime))
    found = _rows(rules.failures(obs, gates, "sample_id")) + [r | {"rule": "repeated"} for r in _rows(rules.repeats(obs, "sample_id"))]
    return {"valid": not found, "errors": found}, bool(found)


def validate_prompt_pack(spark, a):
    found = packs.pack_breaches(_load(a.pack))
    return {"valid": not found, "errors": [{"path": p, "rule": r} for p, r in found]}, bool(found)


def build_generation_plan(spark, a):
    header, rows = packs.plan_from_pack(spark, _load(a.pack), a.candidate)
    return header | {"samples": _rows(rows.orderBy("sample_id"))}, False


def check_suite_coverage(spark, a):
    out = {k: _rows(v) for k, v in packs.coverage(_plan(spark, a.plan), _observations(spark, a.observations)).items()}
    return out, any(r["status"] not in ("ok", "invalid") for r in out["samples"])


def compare(which: Callable):
    def run(spark, a):
        out = which(_observations(spark, a.observations), _plan(spark, a.plan), a.baseline, a.adapted, a.metric)
        return {k: _rows(out[k]) for k in ("summary", "category", "validity")}, False

    return run


def build_lineage(spark, a):
    return lineage.build_receipt(spark, a.id, a.revision, a.input, a.output_artifact), False


def verify_lineage(spark, a):
    rows = _rows(lineage.verify_receipt(spark, _load(a.receipt), a.input, a.output_artifact))
    return {"roles": rows}, any(r["status"] != "exact" for r in rows)


def compare_resume(spark, a):
    paths = {n: {r: (Path(p), k) for r, k, p in lineage.declarations(t)} for n, t in (("uninterrupted", a.uninterrupted), ("resumed", a.resumed))}
    receipts.independent(paths)
    if a.report:
        for held in paths.values():
            receipts.refuse_output_alias(Path(a.report), held)
    rows = _rows(lineage.compare_runs(spark, a.uninterrupted, a.resumed))
    return {"roles": rows}, not all(r["byte_exact"] for r in rows)


def _bindings(path: str) -> tuple[dict, list[str], list[dict]]:
    """A binding plan with its artifacts as declarations; relative paths start at the plan."""
    plan, base = _load(path), Path(path).parent
    told = lambda rows: [f"{r['role']}={r['kind']}={base / r['path']}" for r in rows]
    return plan, told(plan["source_artifacts"]), [b | {"artifacts": told(b["artifacts"])} for b in plan["runtime_bindings"]]


def build_runtime(spark, a):
    plan, source, bindings = _bindings(a.binding_plan)
    return runtime.build_manifest(spark, plan["artifact_set_id"], plan["producer"]["repository"], plan["producer"]["revision"], source, bindings), False


def verify_runtime(spark, a):
    _, source, bindings = _bindings(a.binding_plan)
    good = runtime.verify_manifest(spark, _load(a.manifest), source, bindings)
    return {"unchanged": good}, not good


def _full(spark: SparkSession, path: str) -> DataFrame:
    return documents.read_array(spark, path, "observations", documents.FULL_OBSERVATION)


_FULL_PLAN = (
    "samples array<struct<sample_id:string,candidate_id:string,prompt_id:string,category:string,seed:bigint,text:string,instruction:string,"
    "lexical_anchors:array<struct<anchor_id:string,surface:string,accepted_asr_forms:array<string>>>>>"
)


def _full_plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_FULL_PLAN).option("multiLine", True).json(path).select(F.inline("samples"))


def score_objective(spark, a):
    plan = a.generation_plan and _full_plan(spark, a.generation_plan)
    digest = a.generation_plan and objective.plan_digest(_load(a.generation_plan))
    parts = objective.score_objective(_full(spark, a.observations), plan or None, digest, int(a.seed))
    return {k: _rows(v.orderBy(*v.columns[:3])) if isinstance(v, DataFrame) else v for k, v in parts.items() if k not in ("anchor_results",)}, False


def fingerprint_observations(spark, a):
    return {"sha256": extraction.document_digest(_full(spark, a.observations))}, False


def build_identity(spark, a):
    return extraction.extractor_identity(spark, a.kind, a.name, a.revision, a.artifact), False


def build_reference(spark, a):
    return extraction.speaker_reference(spark, a.reference_id, a.audio, a.transcript), False


def _references(texts: list[str]) -> dict[str, tuple[str, str]]:
    out = {t.split("=")[0]: tuple(t.split("=")[1:]) for t in texts if t.count("=") == 2}
    if len(out) < len(texts):
        raise ContractViolation("references are ID=AUDIO=TRANSCRIPT, each id once")
    return out


def build_catalog(spark, a):
    return extraction.speaker_catalog(spark, a.catalog_id, _references(a.speaker_reference)), False


def build_reference_plan(spark, a):
    catalog = _load(a.reference_catalog)
    extraction.check_catalog(catalog)
    told = {}
    for t in a.assignment:
        prompt, seed, ids = t.split("=")
        told[prompt, int(seed)] = ids.split(",")
    return receipts.assignment_plan(a.plan_id, _load(a.generation_plan), catalog, told, a.policy_id, a.stratification_dimension, a.rationale), False


def validate_execution(spark, a):
    found = receipts.execution_breaches(_load(a.results))
    return {"valid": not found, "errors": [{"path": p, "rule": r} for p, r in found]}, bool(found)


def validate_run(spark, a):
    found = receipts.run_breaches(_load(a.receipt), a.mode)
    return {"valid": not found, "errors": [{"path": p, "rule": r} for p, r in found]}, bool(found)


def _probe(kind: str):
    def run(spark, a):
        obs = _full(spark, a.observations)
        code = Path(__file__).parent / "sources" / "wav.py"
        identity = extraction.extractor_identity(spark, kind, f"timbre_{kind}", a.extractor_revision, [f"implementation=file={code}"])
        rows = _rows(extraction.probe_results(spark, obs, a.audio_base_dir, kind).orderBy("sample_id"))
        return {"schema_version": "1.0.0", "source_observations_sha256": extraction.document_digest(obs), "extractor": identity, "results": rows}, False

    return run


_TYPES = {"hypothesis_text": "string", "speaker_embedding": "array<double>", "reference_speaker_embedding": "array<double>", "reference_speaker_embeddings": "array<struct<reference_id:string,embedding:array<double>>>", "prosody_eligible_for_long_form": "boolean"}


def apply_results(spark, a):
    obs, told = _full(spark, a.observations), _load(a.results)
    if told.get("source_observations_sha256") != extraction.document_digest(obs):
        raise ContractViolation("the results are of other observations")
    identity, artifacts = told["extractor"], a.extractor_artifact
    if not artifacts and identity["name"].startswith("timbre_"):
        artifacts = [f"implementation=file={Path(__file__).parent / 'sources' / 'wav.py'}"]
    if extraction.extractor_identity(spark, identity["kind"], identity["name"], identity["revision"], artifacts or []) != identity:
        raise ContractViolation("the extractor is not what the results name")
    names = extraction.FIELDS[identity["kind"]]
    shape = "sample_id string, audio_sha256 string, status string, " + "".join(f"{n} {_TYPES.get(n, 'double')}, " for n in names) + "reference_ids array<string>, error_type string, error string"
    results = spark.read.schema(shape).json(spark.sparkContext.parallelize([json.dumps({**r, **r.get("values", {})}) for r in told["results"]]))
    out = extraction.apply_extraction(spark, obs, results, identity, a.audio_base_dir)
    return {"observations": _rows(out.orderBy("_ord").drop("_ord"))}, False


def verify_audio_files(spark, a):
    rows = _rows(verify_audio(spark, _full(spark, a.observations), a.audio_base_dir).orderBy("sample_id"))
    return {"samples": rows}, any(r.get("fault") for r in rows)


def content_report(spark, a):
    catalog = _load(a.reference_catalog)
    extraction.check_catalog(catalog)
    paths = _references(a.speaker_reference)
    if extraction.speaker_catalog(spark, catalog["catalog_id"], paths) != catalog:
        raise ContractViolation("the catalog is not of the live references")
    refs = spark.createDataFrame([(r, Path(t).read_text()) for r, (_, t) in sorted(paths.items())], "reference_id string, transcript string")
    wanted = spark.createDataFrame([(x["prompt_id"], x["seed"], x["reference_ids"]) for x in _load(a.speaker_reference_plan)["assignments"]], "prompt_id string, seed long, references array<string>")
    obs, plan = _full(spark, a.observations), _full_plan(spark, a.generation_plan)
    matched.bind_to_plan(obs, plan, [r["candidate_id"] for r in plan.select("candidate_id").distinct().collect()])
    samples = obs.join(plan.select("sample_id", "instruction"), "sample_id").join(wanted, ["prompt_id", "seed"], "left")
    samples = samples.select(F.lit("report").alias("report_id"), "sample_id", "candidate_id", "valid", F.col("requested_text").alias("requested"), F.col("hypothesis_text").alias("hypothesis"), "instruction", F.coalesce("references", F.array().cast("array<string>")).alias("references"))
    got = content.diagnostics(samples, refs, int(a.ngram_size), int(a.instruction_ngram_size))
    report = {"samples": _rows(got.orderBy("sample_id")), "candidates": _rows(content.candidate_summary(got).orderBy("candidate_id")), "generation_plan_sha256": canonical_sha256(_load(a.generation_plan)), "reference_catalog_sha256": catalog["catalog_sha256"]}
    return report, any(r["verdict"] == "failed" for r in report["candidates"])


def build_assignment(spark, a):
    plan, routes = _load(a.generation_plan), listening.routes_frame(spark, _load(a.routing))
    rows = [r.asDict() for r in listening.assignment(_full_plan(spark, a.generation_plan), routes).select("sample_id", "criterion").collect()]
    told = [r.asDict() for r in routes.orderBy("place").collect()]
    return pack_documents.assignment_document(plan, rows, told), False


def build_pack(spark, a):
    samples = _load(a.samples)
    raters = _load(a.rater_ids) if a.rater_ids else None
    review, reveal = pack_documents.blind_pack(samples, int(a.seed), _load(a.assignment_plan), raters)
    return {"review": review, "reveal": reveal}, False


def export_packet(spark, a):
    return pack_documents.rater_packet(_load(a.review), a.rater_id), False


def build_submission(spark, a):
    return pack_documents.submission(_load(a.packet), _load(a.ratings), bool(a.allow_incomplete)), False


def compare_matched_prosody(spark, a):
    out = matched.compare_prosody(_full(spark, a.observations), _plan(spark, a.plan), a.baseline, a.adapted)
    return {"pairs": _rows(out["pairs"].orderBy("prompt_id", "seed", "proxy")), "summary": _rows(out["summary"].orderBy("proxy"))}, False


def audit_history(spark, a):
    rows = spark.read.schema("samples array<struct<sample_id:string,audio_path:string,audio_sha256:string,seed:bigint,prompt_id:string,requested_text:string>>").option("multiLine", True).json(a.manifest).select(F.inline("samples"))
    out = history.audit_prosody(spark, rows, a.audio_base_dir)
    return {"results": _rows(out["results"].orderBy("sample_id")), "coverage": _rows(out["coverage"])}, False


_RATING = "rater_id string, criterion string, blind_id string, score double"


def aggregate_listening(spark, a):
    read = lambda p, s: spark.read.schema(s).option("multiLine", True).json(p)
    out = listening.results(read(a.ratings, _RATING), read(a.reveal, "blind_id string, candidate_id string"), read(a.expected, "rater_id string, criterion string, blind_id string"))
    report = {k: _rows(v) for k, v in out.items()}
    return report, bool(report["missing"])


#: name: (function, arguments); an argument is a name, with + for a repeatable option (* if it may be missing) and ? for a switch; a pair is an option with its default.
COMMANDS: dict[str, tuple[Callable, list]] = {
    "validate": (validate, ["kind", "path"]),
    "audit-corpus": (audit_corpus, ["+split", ("audio-field", "audio"), ("text-field", "text"), ("group-field", None), ("audio-path-group-regex", None)]),
    "probe-audio": (probe_audio, ["wav"]),
    "compare-audio": (_difference(level_probe), ["reference", "candidate"]),
    "probe-prosody": (probe_prosody, ["wav"]),
    "compare-prosody": (compare_prosody, ["reference", "candidate"]),
    "score-objective": (score_objective, ["observations", ("generation-plan", None), ("seed", objective.SEED)]),
    "fingerprint-observations": (fingerprint_observations, ["observations"]),
    "verify-observation-audio": (verify_audio_files, ["observations", ("audio-base-dir", ".")]),
    "build-extractor-identity": (build_identity, [("kind", ""), ("name", ""), ("revision", ""), "+artifact"]),
    "build-speaker-reference": (build_reference, [("reference-id", ""), ("audio", ""), ("transcript", "")]),
    "build-speaker-reference-catalog": (build_catalog, [("catalog-id", ""), "+speaker-reference"]),
    "build-speaker-reference-assignment-plan": (build_reference_plan, [("plan-id", ""), ("generation-plan", ""), ("reference-catalog", ""), ("policy-id", ""), ("rationale", ""), "+stratification-dimension", "+assignment"]),
    "validate-execution-receipt": (validate_execution, ["results"]),
    "validate-resume-run-receipt": (validate_run, ["receipt", ("mode", "uninterrupted")]),
    "build-audio-probe-results": (_probe("audio_probe"), ["observations", ("audio-base-dir", "."), ("extractor-revision", "")]),
    "build-prosody-proxy-results": (_probe("prosody_proxy"), ["observations", ("audio-base-dir", "."), ("extractor-revision", "")]),
    "apply-extractor-results": (apply_results, ["observations", "results", ("audio-base-dir", "."), "*extractor-artifact"]),
    "build-content-faithfulness-report": (content_report, ["observations", ("generation-plan", ""), ("reference-catalog", ""), ("speaker-reference-plan", ""), "+speaker-reference", ("ngram-size", 4), ("instruction-ngram-size", 2)]),
    "build-listening-assignment-plan": (build_assignment, ["generation_plan", ("routing", "")]),
    "build-listening-pack": (build_pack, [("samples", ""), ("assignment-plan", ""), ("rater-ids", None), ("seed", 0)]),
    "export-rater-listening-packet": (export_packet, ["review", ("rater-id", "")]),
    "build-rater-listening-submission": (build_submission, ["packet", "ratings", "?allow-incomplete"]),
    "compare-matched-prosody": (compare_matched_prosody, ["observations", "plan", "baseline", "adapted"]),
    "audit-historical-prosody": (audit_history, ["manifest", ("audio-base-dir", ".")]),
    "validate-observations": (validate_observations, ["observations", "?require-version", "?require-seed", "?require-runtime"]),
    "validate-prompt-pack": (validate_prompt_pack, ["pack"]),
    "build-generation-plan": (build_generation_plan, ["pack", "+candidate"]),
    "check-suite-coverage": (check_suite_coverage, ["plan", "observations"]),
    "compare-matched": (compare(matched.compare_matched), ["observations", "plan", "baseline", "adapted", "+metric"]),
    "compare-runtimes": (compare(matched.compare_runtimes), ["observations", "plan", "baseline", "adapted", "+metric"]),
    "build-dataset-lineage": (build_lineage, [("id", ""), ("revision", ""), "+input", "+output-artifact"]),
    "verify-dataset-lineage": (verify_lineage, ["receipt", "+input", "+output-artifact"]),
    "compare-resume-artifacts": (compare_resume, ["+uninterrupted", "+resumed"]),
    "build-runtime-artifact-manifest": (build_runtime, ["binding_plan"]),
    "verify-runtime-artifact-manifest": (verify_runtime, ["manifest", "binding_plan"]),
    "aggregate-listening": (aggregate_listening, ["ratings", "reveal", "expected"]),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="timbre", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        c = commands.add_parser(name)
        c.add_argument("--report", help="write the report here; without it, to standard output")
        for x in arguments:
            if isinstance(x, tuple):
                c.add_argument(f"--{x[0]}", default=x[1])
            elif x[0] == "?":
                c.add_argument(f"--{x[1:]}", action="store_true")
            elif x[0] in "+*":
                c.add_argument(f"--{x[1:]}", action="append", required=x[0] == "+")
            elif x == "kind":
                c.add_argument(x, choices=sorted(SHAPES))
            else:
                c.add_argument(x)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        report, negative = COMMANDS[a.command][0](spark or SparkSession.builder.getOrCreate(), a)
    except (OSError, ValueError, EOFError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2
    text = json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    if a.report:
        Path(a.report).write_text(text)
    else:
        sys.stdout.write(text)
    return int(negative)


if __name__ == "__main__":
    sys.exit(main())
