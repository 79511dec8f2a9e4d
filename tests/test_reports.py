"""The objective report, extraction, listening documents and signal kernels, against values worked out by hand or by plain Python."""

from __future__ import annotations

import io
import math
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from timbre.operators import corpus, signal, stats
from timbre.plans import extraction, objective, pack_documents
from timbre.plans import corpus as audit
from timbre.plans.checks import ContractViolation
from timbre.queries.audio import recording
from timbre.sources import artifacts, documents, fingerprints, wav

H, SCHEMA = "a" * 64, documents.FULL_OBSERVATION
EVIDENCE = {f.name: None for f in documents.EVIDENCE}


def observation(**values):
    row = {f.name: None for f in SCHEMA} | {"candidate_id": "b", "prompt_id": "p1", "seed": 1, "requested_text": "one two three four", "valid": True, "audio_sha256": H} | values
    return tuple(row[f.name] for f in SCHEMA)


def frame(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], StructType([*SCHEMA.fields, StructField("_ord", IntegerType())]))


def proof(**kinds):
    return {k: EVIDENCE | {"extractor": "x", "revision": "r1"} | v for k, v in kinds.items()}


ROWS = [
    observation(sample_id="b1", hypothesis_text="one two tree four", evidence=proof(asr={"input_audio_sha256": H, "extractor_artifact_set_sha256": H}, runtime={}), generation_seconds=2.0, audio_duration_seconds=4.0),
    observation(sample_id="b2", prompt_id="p2", requested_text="to Bishan now", hypothesis_text="two bee shan now", evidence=proof(asr={}, runtime={}, speaker_encoder={}), generation_seconds=3.0, audio_duration_seconds=2.0, speaker_embedding=[1.0, 0.0], reference_speaker_embeddings=[("r", [1.0, 0.0]), ("s", [0.0, 1.0])]),
    observation(sample_id="a1", candidate_id="a", valid=False, hypothesis_text="x", evidence=proof(asr={}, runtime={}), generation_seconds=5.0, audio_duration_seconds=1.0),
]
PLAN = "sample_id string, candidate_id string, prompt_id string, category string, seed long, text string, lexical_anchors array<struct<anchor_id:string,surface:string,accepted_asr_forms:array<string>>>"


def planned(spark, category="c2", surface="Bishan"):
    anchors = [("b", surface, ["bishan", "Bee Shan"])]
    return spark.createDataFrame([("b1", "b", "p1", " c1 ", 1, "one two three four", None), ("b2", "b", "p2", category, 1, "to Bishan now", anchors), ("a1", "a", "p1", "c1", 1, "one two three four", None)], PLAN)


def test_objective_report(spark):
    out = objective.score_objective(frame(spark, ROWS), planned(spark), H)
    s = {(r["candidate_id"], r["metric"]): r for r in out["candidates"].collect()}
    wer = s["b", "asr_word_error_rate"]
    assert (wer["n"], wer["mean"]) == (2, pytest.approx(0.625))
    draw = random.Random(objective.SEED + 1000 + 1)  # candidate b is the second, the error rate the first metric
    means = sorted(sum(draw.choices([0.25, 1.0], k=2)) / 2 for _ in range(2000))
    assert (wer["ci_low"], wer["ci_high"]) == (pytest.approx(stats.percentile(means, 0.025)), pytest.approx(stats.percentile(means, 0.975)))
    assert s["b", "speaker_embedding_similarity"]["mean"] == 0.5 and s["b", "real_time_factor"]["mean"] == 1.0 and s["a", "generation_seconds"]["mean"] == 5.0 and ("a", "asr_word_error_rate") not in s
    cover = {(r["candidate_id"], r["metric"]): (r["observed"], r["eligible"], r["rate"]) for r in out["coverage"].collect()}
    assert cover["b", "speaker_embedding_similarity"] == (1, 2, 0.5) and cover["a", "generation_seconds"] == (1, 1, 1.0) and cover["a", "asr_word_error_rate"] == (0, 0, None)
    assert {(r["candidate_id"], r["category"]) for r in out["categories"].collect()} == {("b", "c1"), ("b", "c2"), ("a", "c1")}
    assert out["reference_text"]["plan_bound_reference_count"] == 2 and out["category_binding"]["mode"] == "generation_plan"
    assert [(r["sample_id"], r["status"], r["matched_form"]) for r in out["anchor_results"].collect()] == [("b2", "hit", "bee shan")]
    asr = {(r["extractor"], r["extractor_artifact_set_sha256"]): (r["rows"], r["content_bound"]) for r in out["provenance"].where("kind = 'asr'").collect()}
    assert asr == {("x", H): (1, 1), ("x", None): (2, 0)}
    assert objective.score_objective(frame(spark, ROWS))["category_binding"]["mode"] == "unavailable"


def test_objective_report_refuses(spark):
    bad = [
        (ROWS + ROWS[:1], None), ([observation(sample_id="x", hypothesis_text="one")], None), ([observation(sample_id="x", speaker_embedding=[1.0], evidence=proof(speaker_encoder={}))], None),
        ([observation(sample_id="x", sample_rate_hz=1.5, evidence=proof(audio_probe={}))], None), ([observation(sample_id="x", hypothesis_text="a", evidence=proof(asr={"input_audio_sha256": "b" * 64}))], None),
        ([observation(sample_id="x", hypothesis_text="a", evidence=proof(asr={"reference_id": "r"}))], None), (ROWS + [observation(sample_id="z")], "plan"), (ROWS[:2] + [observation(sample_id="a1", candidate_id="a", requested_text="other")], "plan"),
    ]
    for rows, plan in bad:
        with pytest.raises(ContractViolation):
            objective.score_objective(frame(spark, rows), planned(spark) if plan else None, H)
    for plan in (planned(spark, " "), planned(spark, surface="MRT")):
        with pytest.raises(ContractViolation):
            objective.score_objective(frame(spark, ROWS), plan, H)


def test_extraction_end_to_end(spark, tmp_path):
    import hashlib

    data = recording([(0.6, 0.4), (0.3, 0), (0.6, 0.3)])
    (tmp_path / "a.wav").write_bytes(data)
    (tmp_path / "bad.wav").write_bytes(b"no wave")
    digest = hashlib.sha256(data).hexdigest()
    obs = frame(spark, [observation(sample_id="s1", audio_path="a.wav", audio_sha256=digest), observation(sample_id="s2", audio_path="bad.wav", audio_sha256=hashlib.sha256(b"no wave").hexdigest()), observation(sample_id="s3", valid=False, audio_sha256=None)])
    (tmp_path / "code").write_text("v1")
    identity = extraction.extractor_identity(spark, "audio_probe", "probe", "v1.0", [f"implementation=file={tmp_path / 'code'}"])
    results = extraction.probe_results(spark, obs, str(tmp_path), "audio_probe")
    done = extraction.apply_extraction(spark, obs, results, identity, str(tmp_path)).cache()
    rows = {r["sample_id"]: r for r in done.collect()}
    assert rows["s1"]["sample_rate_hz"] == 22_050 and rows["s1"]["evidence"]["audio_probe"]["input_audio_sha256"] == digest and rows["s1"]["augmentation_history"][0]["status"] == "complete"
    assert rows["s2"]["sample_rate_hz"] is None and rows["s2"]["extractor_failures"]["audio_probe"]["error_type"] and rows["s2"]["evidence"] is None and rows["s3"]["augmentation_history"] is None
    prosody = extraction.extractor_identity(spark, "prosody_proxy", "p", "v1.0", [f"implementation=file={tmp_path / 'code'}"])
    more = extraction.apply_extraction(spark, done, extraction.probe_results(spark, done, str(tmp_path), "prosody_proxy"), prosody, str(tmp_path))
    assert {k for k in more.where("sample_id = 's1'").first()["evidence"]} == {"audio_probe", "prosody_proxy"}
    for bad in (
        lambda: extraction.apply_extraction(spark, done, results, identity, str(tmp_path)), lambda: extraction.apply_extraction(spark, obs, results.where("sample_id = 's1'"), identity, str(tmp_path)),
        lambda: extraction.apply_extraction(spark, obs, results.withColumn("silence_fraction", F.lit(2.0)), identity, str(tmp_path)), lambda: extraction.extractor_identity(spark, "audio_probe", "p", "main", [f"a=file={tmp_path / 'code'}"]),
        lambda: extraction.apply_extraction(spark, obs, results.withColumn("audio_sha256", F.lit(H)), identity, str(tmp_path)),
    ):
        with pytest.raises(ContractViolation):
            bad()
    assert extraction.document_digest(obs) == extraction.document_digest(obs.repartition(3)) != extraction.document_digest(done)


def test_speaker_measurements_are_bound(spark, tmp_path):
    (tmp_path / "r.wav").write_bytes(b"r")
    (tmp_path / "r.txt").write_text("hello")
    catalog = extraction.speaker_catalog(spark, "cat", {"r": (str(tmp_path / "r.wav"), str(tmp_path / "r.txt"))})
    extraction.check_catalog(catalog)
    with pytest.raises(ContractViolation):
        extraction.check_catalog(catalog | {"catalog_id": "other"})
    rules_ = extraction.value_rules("speaker_encoder_references")
    rows = [("ok", [1.0, 0.0], [("r", [0.0, 1.0])], ["r"]), ("long", [1.0], [("r", [0.0, 1.0])], ["r"]), ("nan", [math.nan, 0.0], [("r", [0.0, 1.0])], ["r"]), ("ids", [1.0, 0.0], [("r", [0.0, 1.0])], ["s"])]
    df = spark.createDataFrame(rows, "sample_id string, speaker_embedding array<double>, reference_speaker_embeddings array<struct<reference_id:string,embedding:array<double>>>, reference_ids array<string>")
    from timbre.operators.rules import failures

    assert {tuple(r) for r in failures(df, rules_, "sample_id").collect()} == {("long", "references"), ("nan", "speaker_embedding"), ("ids", "reference_ids")}


def test_listening_documents():
    plan = {"samples": [{"sample_id": f"{c}-{p}", "candidate_id": c, "prompt_id": p, "seed": 1, "text": f"say {p}", "lexical_anchors": [{"anchor_id": "x", "surface": "say", "accepted_asr_forms": ["say"]}]} for c in "ab" for p in ("p1", "p2", "p3")]}
    routes = [{"criterion": c, "direction": "higher_is_better", "review_prompt": "r", "low_label": "l", "high_label": "h"} for c in ("nat", "acc")]
    assigned = [{"sample_id": s["sample_id"], "criterion": c} for s in plan["samples"] for c in ("nat", "acc") if c == "nat" or s["prompt_id"] == "p1"]
    doc = pack_documents.assignment_document(plan, assigned, routes)
    samples = [{k: s[k] for k in ("sample_id", "candidate_id", "prompt_id", "seed")} | {"audio_path": f"{s['sample_id']}.WAV"} for s in plan["samples"]]
    review, reveal = pack_documents.blind_pack(samples, 3, doc, ["r2", "r1"])
    assert "accepted_asr_forms" not in str(review) and "candidate_id" not in str(review["samples"]) and reveal["counterbalance_audit"]["max_candidate_position_imbalance"] <= 1
    packet = pack_documents.rater_packet(review, "r1")
    assert len(packet["rating_order"]) == 8 and [t["criterion"] for t in packet["rating_order"]] == ["nat"] * 6 + ["acc"] * 2
    given = {"scale": {"min": 1, "max": 5}, "presentation_log": packet["rating_order"], "ratings": [{**t, "score": 3} for t in reversed(packet["rating_order"])]}
    one = pack_documents.submission(packet, given)
    assert one["coverage"]["status"] == "complete" and [r["blind_id"] for r in one["ratings"]] == [t["blind_id"] for t in packet["rating_order"]]
    two = pack_documents.submission(pack_documents.rater_packet(review, "r2"), given | {"presentation_log": pack_documents.rater_packet(review, "r2")["rating_order"]})
    bundle = {"schema_version": "1.1.0", "scale": one["scale"], "submissions": [two, one]}
    assert len(pack_documents.bundle_ratings(review, bundle)["ratings"]) == 16
    partial = given | {"presentation_log": packet["rating_order"][:2], "ratings": [{**packet["rating_order"][0], "score": 1}]}
    assert pack_documents.submission(packet, partial, True)["coverage"] == {"status": "incomplete", "expected_rating_count": 8, "presented_rating_count": 2, "observed_rating_count": 1, "missing_rating_count": 7}
    other = packet | {"criteria": ["acc", "nat"]}
    for bad in (
        lambda: pack_documents.submission(packet, partial), lambda: pack_documents.submission(packet, given | {"scale": {"min": 1, "max": 2}}), lambda: pack_documents.submission(other, given),
        lambda: pack_documents.check_packet(pack_documents.sealed({k: v for k, v in other.items() if k != "packet_sha256"}, "packet_sha256")), lambda: pack_documents.rater_packet(review, "r9"),
        lambda: pack_documents.bundle_ratings(review, bundle | {"submissions": [one]}), lambda: pack_documents.bundle_ratings(review, bundle | {"submissions": [one, two | {"scale": {"min": 0, "max": 5}}]}),
        lambda: pack_documents.blind_pack(samples[:-1], 3, doc), lambda: pack_documents.blind_pack([*samples[:-1], samples[-1] | {"audio_path": "x.mp3"}], 3, doc), lambda: pack_documents.blind_pack(samples, 3, doc | {"criteria": []}),
    ):
        with pytest.raises(ContractViolation):
            bad()


def test_prosody_by_hand():
    """Constant levels: thresholds, pauses, phrases and crossings can be counted."""
    rate = 1000
    level = lambda n, a: [a if i // 5 % 2 else -a for i in range(n)]
    x = [*[0.0] * 200, *level(400, 0.5), *[0.0] * 100, *level(300, 0.5), *[0.0] * 400, *level(200, 0.25), *[0.0] * 100]
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, rate, 0, "NONE", ""))
        w.writeframes((np.array(x) * 32767).astype("<i2").tobytes())
    m = wav.prosody_metrics(out.getvalue())
    assert len(m) == 25 and m["analyzed_frame_count"] == (len(x) - 40) // 20 + 1 and m["analysis_duration_seconds"] == 1.7
    rms = [math.sqrt(sum(v * v for v in x[i : i + 40]) / 40) for i in range(0, len(x) - 39, 20)]
    threshold = max(10**-2.5, min(sorted(rms)[int(len(rms) * 0.2)] * 3, max(rms) / 2), max(rms) * 0.04)
    active = [v > threshold for v in rms]
    assert m["active_frame_count"] == sum(active) and m["activity_threshold_dbfs"] == pytest.approx(20 * math.log10(threshold), abs=1e-3)
    assert (m["pause_count"], m["phrase_count"]) == (1, 2)  # 100 samples of silence are no pause
    inside = active.index(True), len(active) - 1 - active[::-1].index(True)
    assert m["leading_inactive_seconds"] == pytest.approx(inside[0] * 0.02) and m["trailing_inactive_seconds"] == pytest.approx((len(active) - 1 - inside[1]) * 0.02)
    assert m["window_rms_db_std"] is None and m["zero_crossing_rate_hz_mean"] == pytest.approx(np.mean([sum((a < 0) != (b < 0) for a, b in zip(x[i : i + 40], x[i + 1 : i + 40])) / 0.04 for i, on in zip(range(0, len(x), 20), active) if on]))
    assert wav.prosody_difference(out.getvalue(), out.getvalue()) == {k: None if m[k] is None else 0.0 for k in wav.COMPARED}


def test_phrases_keep_short_gaps(spark):
    on = [0, 1, 1, 0, 1, 0, 0, 0, 1, 1, 0]
    got = signal.phrases(spark.createDataFrame([(1, i, bool(a)) for i, a in enumerate(on)], "signal int, frame int, active boolean"), 2)
    assert sorted((r["first"], r["last"]) for r in got.collect()) == [(1, 4), (8, 9)]


def test_fingerprints_by_hand():
    """Quantised levels from 0 to 31 against a plain loop."""
    data = recording([(0.2, 0.0), (0.5, 0.8), (0.4, 0.2)], 240, 240, 8000)
    got = fingerprints.fingerprint(data)
    samples, width, _, rate = wav.decode(data)
    n, sums, counts = len(samples), [0.0] * 256, [0] * 256
    for i in range(0, n, rate // 2000):
        b = min(255, i * 256 // n)
        sums[b] += abs(samples[i]) / 2 ** (8 * width - 1)
        counts[b] += 1
    bins = [s / c if c else 0.0 for s, c in zip(sums, counts)]
    loud = [i for i, v in enumerate(bins) if v >= max(bins) * 0.02]
    cut = [v / max(bins) for v in bins[loud[0] : loud[-1] + 1]]
    at = [k * (len(cut) - 1) / 63 for k in range(64)]
    want = [round((cut[int(p)] * (1 - p % 1) + cut[min(int(p) + 1, len(cut) - 1)] * (p % 1)) * 31) for p in at]
    assert [got[f"e{i}"] for i in range(64)] == want and got["seconds"] == pytest.approx(n / rate * len(cut) / 256)
    assert np.mean([got[f"z{i}"] for i in range(64)]) == pytest.approx(31 * 480 / 1000, abs=2)


def test_candidates_need_three_bands(spark):
    rng = random.Random(5)
    prints = [(i, f"s{i % 2}", [f"e{rng.randrange(3)}" for _ in range(8)]) for i in range(60)]
    want = {(a, b, n) for a, s, x in prints for b, t, y in prints if a < b and s != t and (n := sum(p == q for p, q in zip(x, y))) >= 3}
    got = corpus.blocking_candidates(spark.createDataFrame(prints, "id int, split string, bands array<string>"))
    assert {tuple(r) for r in got.collect()} == want


def test_manifest_errors(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("\n".join(['{"audio": "a.wav", "text": "ﬁne  day"}', "{broken", "[1]", "", '{"audio": 3, "text": "x"}', '{"audio": "b.wav", "text": 5}', '{"audio": "c_1.wav", "text": "y"}', '{"audio": "d.wav", "text": "z"}']))
    (tmp_path / "v.jsonl").write_text('{"audio": "e_2.wav", "text": "FINE day"}')
    paths = {"train": str(tmp_path / "t.jsonl"), "validation": str(tmp_path / "v.jsonl")}
    out = audit.audit(audit.read_splits(spark, paths, group_pattern=r"_(\d)"))
    assert {(r["split"], r["line"], r["reason"]) for r in out["errors"].collect()} == {("train", 1, "missing_group"), ("train", 2, "invalid_json"), ("train", 3, "not_an_object"), ("train", 5, "missing_audio_path"), ("train", 6, "missing_text"), ("train", 8, "missing_group")}
    assert [(r["split"], r["first_split"]) for r in out["warnings"].collect()] == [("validation", "train")]
    assert {r["reason"] for r in audit.audit(audit.read_splits(spark, paths))["errors"].collect()} == {"invalid_json", "not_an_object", "missing_audio_path", "missing_text"}
    for pattern in ("(", "x", "(a)(b)", "(" + "a" * 600 + ")"):
        with pytest.raises(ContractViolation):
            audit.read_splits(spark, paths, group_pattern=pattern)


def test_trees(spark, tmp_path):
    import hashlib
    import json

    tree = tmp_path / "tree"
    (tree / "sub").mkdir(parents=True)
    for name in ("b.txt", "sub/é.txt", 'q"x.txt'):
        (tree / name).write_text(name)
    files = sorted(("b.txt", 'q"x.txt', "sub/é.txt"))
    want = hashlib.sha256(b"".join(json.dumps({"path": n, "sha256": hashlib.sha256(n.encode()).hexdigest(), "bytes": len(n.encode())}, sort_keys=True, separators=(",", ":")).encode() + b"\n" for n in files)).hexdigest()
    assert artifacts.fingerprint(spark, str(tree), "r", "tree").first()["sha256"] == want
    (tmp_path / "empty").mkdir()
    (tree / "link").symlink_to(tree / "b.txt")
    for bad in (str(tree), str(tmp_path / "empty"), str(tmp_path / "none")):
        with pytest.raises(ValueError):
            artifacts.fingerprint(spark, bad, "r", "tree")


def test_gates(spark):
    from timbre.operators.rules import failures, gate_rules

    rows = [
        observation(sample_id="ok", observation_schema_version="1.0.0", runtime_id="cpu", audio_sha256=None), observation(sample_id="bare", seed=None, audio_sha256=None), observation(sample_id="bad", observation_schema_version="2", runtime_id="A B", artifact_set_id="x", artifact_set_sha256="no", prosody_pause_fraction=1.5, audio_sha256=None),
    ]
    obs = frame(spark, rows)
    loose = {tuple(r) for r in failures(obs, gate_rules(obs.columns), "sample_id").collect()}
    assert loose == {("bad", "observation_schema_version_stated"), ("bad", "runtime_id_stated"), ("bad", "artifact_set_sha256_stated"), ("bad", "prosody_pause_fraction_range")}
    strict = {tuple(r) for r in failures(obs, gate_rules(obs.columns, True, True, True), "sample_id").collect()}
    assert strict - loose == {("bare", "observation_schema_version_stated"), ("bare", "seed_stated"), ("bare", "runtime_id_stated")}


def test_command_line_reports(spark, tmp_path, capsys):
    """From a pack to a scored, probed and rated set of samples, through files."""
    import hashlib
    import json

    from test_plans import PACK

    from timbre import cli

    def run(*argv, code=0):
        assert cli.main([*map(str, argv)], spark) == code
        return json.loads(capsys.readouterr().out or "null")

    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return tmp_path / name

    plan = run("build-generation-plan", put("pack.json", PACK), "--candidate", "b", "--candidate", "a")
    plan_path = put("plan.json", plan)
    (tmp_path / "audio").mkdir()
    rows = []
    for i, s in enumerate(plan["samples"]):
        data = recording([(0.4, 0.3), (0.2, 0.0), (0.3 + 0.05 * i, 0.4)], rate=8000)
        (tmp_path / "audio" / f"{i}.wav").write_bytes(data)
        asr = {"extractor": "x", "revision": "r1"}
        rows.append({k: s[k] for k in ("sample_id", "candidate_id", "prompt_id", "seed")} | {"requested_text": s["text"], "hypothesis_text": s["text"].upper(), "valid": True, "audio_path": f"{i}.wav", "audio_sha256": hashlib.sha256(data).hexdigest(), "evidence": {"asr": asr, "runtime": asr}, "generation_seconds": 1.0})
    obs = put("obs.json", {"observations": rows})
    report = run("score-objective", obs, "--generation-plan", plan_path)
    assert {(r["candidate_id"], r["metric"], r["mean"]) for r in report["candidates"]} == {(c, m, v) for c in "ab" for m, v in (("asr_word_error_rate", 0.0), ("generation_seconds", 1.0))}
    assert report["anchors"][0]["hit"] == 2 and report["category_binding"]["mode"] == "generation_plan"
    results = put("results.json", run("build-prosody-proxy-results", obs, "--audio-base-dir", tmp_path / "audio", "--extractor-revision", "v1.0"))
    done = run("apply-extractor-results", obs, results, "--audio-base-dir", tmp_path / "audio")
    assert all(r["prosody_eligible_for_long_form"] is False and r["evidence"]["prosody_proxy"]["revision"] == "v1.0" for r in done["observations"])
    both = run("compare-matched-prosody", put("done.json", done), plan_path, "b", "a")
    assert {r["n"] for r in both["summary"] if r["proxy"] == "prosody_pause_fraction"} == {4}
    run("apply-extractor-results", put("other.json", {"observations": rows[::-1]}), results, "--audio-base-dir", tmp_path / "audio", code=2)
    labels = {"direction": "higher_is_better", "review_prompt": "how", "low_label": "bad", "high_label": "good"}
    routing = {"routes": [{"criterion": "natural", "selector": "all_samples", **labels}, {"criterion": "names", "selector": "lexical_anchors", **labels}]}
    assigned = put("assigned.json", run("build-listening-assignment-plan", plan_path, "--routing", put("routing.json", routing)))
    samples = put("samples.json", [{k: r[k] for k in ("sample_id", "candidate_id", "prompt_id", "seed", "audio_path")} for r in rows])
    pack = run("build-listening-pack", "--samples", samples, "--assignment-plan", assigned, "--rater-ids", put("raters.json", ["r1", "r2"]), "--seed", 4)
    packet = run("export-rater-listening-packet", put("review.json", pack["review"]), "--rater-id", "r2")
    assert len(packet["rating_order"]) == 12
    given = {"scale": {"min": 1, "max": 5}, "presentation_log": packet["rating_order"][:1], "ratings": [packet["rating_order"][0] | {"score": 2}]}
    run("build-rater-listening-submission", put("packet.json", packet), put("given.json", given), code=2)
    assert run("build-rater-listening-submission", put("packet.json", packet), put("given.json", given), "--allow-incomplete")["coverage"]["missing_rating_count"] == 11
