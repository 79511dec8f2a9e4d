"""Contracts, sources and end-to-end plans on small literal inputs, most of them tampered with."""

from __future__ import annotations

import json
import random
import sys

import pytest
from pyspark.sql import functions as F

from timbre.functions import text as T
from timbre.functions.identity import canonical_sha256, digest_strings
from timbre.operators import attempts, extract, listening, signal, speaker, stats
from timbre.operators.contracts import breaches, validate_documents
from timbre import cli
from timbre.plans import content, corpus, history, lifecycle, lineage, matched, packs, runtime
from timbre.plans import listening as blind
from timbre.plans.checks import ContractViolation
from timbre.queries.audio import recording
from timbre.sources import artifacts, audio_files, documents, fingerprints, wav

H = "a" * 64
SPEECH = [(0.5, 0.3), (0.2, 0.0), (0.9, 0.6), (0.4, 0.0), (0.4, 0.2)]
PACKAGE = {
    "schema_version": "1.0.0", "package_id": "p", "base_model": "m", "rights_note": "r", "evaluation_report": "e", "smoke_command": "c", "artifact": {"path": "x", "sha256": H, "bytes": 3, "kind": "adapter"},
    "code_revision": "b" * 40, "inference_configuration": {}, "known_failure_modes": [],
}
EVALUATION = {
    "schema_version": "1.0.0", "evaluation_id": "e", "experiment_id": "x", "prompt_pack": {"id": "p", "version": "1", "sha256": H},
    "candidates": [{"id": "b", "artifact_ref": "r", "revision": "c" * 40, "role": "baseline"}, {"id": "a", "artifact_ref": "r", "revision": "c" * 40, "role": "candidate"}],
    "objective_results": [{"candidate_id": "a", "metric": "wer", "value": 0.1, "scope": "s", "evidence_ref": "r"}],
    "listening": {"status": "complete", "blind": True, "criteria": ["c"], "review_export": "r", "reveal_mapping": "m"}, "verdict": "v",
}


def test_contracts():
    assert breaches("package", PACKAGE) == [] and breaches("evaluation", EVALUATION) == []
    assert breaches("package", PACKAGE | {"artifact": PACKAGE["artifact"] | {"bytes": True}}) == [("$.artifact.bytes", "positive")]
    assert ("$.composite_score", "forbidden") in breaches("evaluation", EVALUATION | {"composite_score": 1})
    assert ("$.objective_results[0].candidate_id", "declared_candidate") in breaches("evaluation", EVALUATION | {"objective_results": [EVALUATION["objective_results"][0] | {"candidate_id": "z"}]})
    twice = [EVALUATION["candidates"][1]] * 2
    assert {("$.candidates[1].id", "unique"), ("$.candidates", "has_baseline")} <= set(breaches("evaluation", EVALUATION | {"candidates": twice}))
    assert ("$.verdict", "required") in breaches("evaluation", {k: v for k, v in EVALUATION.items() if k != "verdict"})
    same = {"corpus": {"id": "c", "sha256": H, "split_hashes": dict.fromkeys(("train", "validation", "test"), H)}, "backend": {"name": "n", "upstream_revision": "b" * 40, "own_revision": "no"}}
    assert {("$.corpus.split_hashes", "all_different"), ("$.backend.own_revision", "git_revision")} <= set(breaches("experiment", same))
    runtime = {"id": "r", "status": "supported", "artifact_mode": "base", "streaming": False, "evidence": [], "conformance": {"status": "not_run", "clean_checkout": False, "fresh_process": False, "prompt_count": 2, "seed_count": 0}}
    found = breaches("capability", {"schema_version": "1.1.0", "runtimes": [runtime], "adaptation": {"magic": {"status": "supported", "evidence": []}}})
    assert {("$.runtimes[0].conformance", "not_run_counts_nothing"), ("$.runtimes[0].evidence", "claimed_without_evidence"), ("$.adaptation.magic", "known_name"), ("$.adaptation.magic.evidence", "claimed_without_evidence")} <= set(found)


def test_contract_rows(spark):
    rows = [("1", "package", json.dumps(PACKAGE)), ("2", "package", "{"), ("3", "other", "{}"), ("4", "package", None), ("5", "package", "[]")]
    got = {(r["id"], r["rule"]) for r in validate_documents(spark.createDataFrame(rows, "id string, kind string, json string")).collect()}
    assert got == {("2", "json"), ("3", "kind"), ("4", "json"), ("5", "object")}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_error_rate(spark):
    rng = random.Random(0)
    rows = [([f"w{rng.randrange(k)}" for _ in range(rng.randrange(40))], [f"w{rng.randrange(k)}" for _ in range(rng.randrange(40))]) for k in (2, 9, 400) for _ in range(20)]
    df = spark.createDataFrame(rows, "r array<string>, h array<string>").transform(lambda d: T.with_word_errors(d, "r", "h")).withColumnsRenamed({"edits": "e", "wer": "w"})
    for x in df.collect():
        assert x["e"] == edits(x["r"], x["h"]) and (x["w"] is None if not x["r"] else x["w"] == pytest.approx(x["e"] / len(x["r"])))


def test_tokens_and_phrases(spark):
    df = spark.createDataFrame([("Straße, it's A_b 3",), ("a a a",), ("",), (None,)], "text string")
    got = [r[0] for r in df.select(T.tokens(F.col("text"))).collect()]
    assert got == [["strasse", "it's", "a_b", "3"], ["a", "a", "a"], [], None]
    t = T.with_tokens(df, "text").where("text = 'a a a'")
    assert t.select(T.occurrences(F.col("toks"), F.array(F.lit("a"), F.lit("a")))).first()[0] == 2
    assert t.select(T.ngrams(F.col("toks"), 4)).first()[0] == []
    assert spark.createDataFrame([("ﬁ",)], "t string").select(T.nfkc("t")).first()[0] == "fi"


def test_alpha_and_bootstrap(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.randrange(1, 6))) for i in range(30) for _ in range(rng.randrange(1, 5))]
    by = {}
    for i, s in rows:
        by.setdefault(i, []).append(s)
    inner = [(a - b) ** 2 / (len(v) - 1) for v in by.values() if len(v) > 1 for x, a in enumerate(v) for y, b in enumerate(v) if x != y]
    n = sum(len(v) for v in by.values() if len(v) > 1)
    every = [s for _, s in rows]
    outer = sum((a - b) ** 2 for a in every for b in every) / (len(every) * (len(every) - 1))
    got = stats.krippendorff_interval(spark.createDataFrame([("k", *r) for r in rows], "k string, i long, s double"), "i", "s", ["k"]).first()["alpha"]
    assert got == pytest.approx(1 - sum(inner) / n / outer)
    one = spark.createDataFrame([("k", 2.0, 0)], "k string, v double, o long")
    assert tuple(stats.bootstrap_exact(one, ["k"], "v", "o").first()) == ("k", 1, 2.0, 2.0)
    r = random.Random(3)
    xs = [1.0, 2.0, 5.0]
    means = sorted(sum(r.choices(xs, k=3)) / 3 for _ in range(50))
    got = stats.bootstrap_exact(spark.createDataFrame([("k", x, i) for i, x in enumerate(xs)], "k string, v double, o long"), ["k"], "v", "o", 3, 50).first()
    assert got["low"] == pytest.approx(stats.percentile(means, 0.025))


def test_pauses(spark):
    rng = random.Random(2)
    rows = [(s, f, rng.random() < 0.5) for s in range(8) for f in range(40)]
    got = {(r["signal"], r["first"], r["length"]) for r in signal.pauses(spark.createDataFrame(rows, "signal int, frame int, active boolean"), 2).collect()}
    want = set()
    for s in range(8):
        m = [a for x, _, a in rows if x == s]
        on = [i for i, a in enumerate(m) if a]
        i = on[0]
        while i < on[-1]:
            if not m[i]:
                j = i
                while not m[j]:
                    j += 1
                if j - i >= 2:
                    want.add((s, i, j - i))
                i = j
            i += 1
    assert got == want


def test_wav(spark, tmp_path):
    for name, width in (("a", 1), ("b", 2), ("c", 3), ("d", 4)):
        (tmp_path / f"{name}.wav").write_bytes(recording(SPEECH, width=width))
    (tmp_path / "x.wav").write_bytes(b"no wave")
    rows = {r["path"][-5]: r for r in wav.probe_files(spark, str(tmp_path), lambda c: wav.level_probe(c) | wav.prosody_metrics(c), ["peak", "pause_count", "audio_duration_seconds"]).collect()}
    for name in "abcd":
        assert rows[name]["peak"] == pytest.approx(0.6, abs=0.02) and rows[name]["pause_count"] == 2 and rows[name]["audio_duration_seconds"] == pytest.approx(2.4)
    assert rows["x"]["status"] == "failed" and rows["x"]["error_type"]


def test_similar_audio(spark, tmp_path):
    shape = [(0.2, 0.3), (0.2, 0.7), (0.2, 0.2), (0.3, 0.6), (0.2, 0.4), (0.3, 0.8), (0.2, 0.1), (0.2, 0.5)]
    (tmp_path / "train.wav").write_bytes(recording([(0.2, 0), *shape, (0.1, 0)], 240, 240, 8000))
    (tmp_path / "test.wav").write_bytes(recording([(0.15, 0), *((s, a * 0.45) for s, a in shape)], 240, 240, 12000, 1))
    (tmp_path / "test2.wav").write_bytes(recording([(s, 0.9 - a) for s, a in shape], 1300, 1300, 8000))
    p = fingerprints.read_fingerprints(spark, str(tmp_path)).withColumn("id", F.element_at(F.split("path", "/"), -1)).withColumn("split", F.when(F.col("id") == "train.wav", "train").otherwise("test"))
    got = corpus.similar_audio(p)["candidates"].collect()
    assert [(r["left_id"], r["right_id"]) for r in got] == [("test.wav", "train.wav")] and not got[0]["reached"]


def test_manifest_audit(spark, tmp_path):
    lines = {
        "train": ['{"audio": "a.wav", "text": "One", "g": "r1"}', '{"audio": {"path": "b.wav"}, "text": "Two", "g": "r2"}', '{"audio": "a.wav", "text": "Three", "g": "r3"}', '{"audio": "c.wav", "text": " ", "g": "r9"}'],
        "test": ['{"audio": "d.wav", "text": "one ", "g": "r4"}', '{"audio": "e.wav", "text": "Four", "g": "r2"}', '{"audio": "f.wav", "text": "Five", "g": "r9"}'],
    }
    for k, v in lines.items():
        (tmp_path / f"{k}.jsonl").write_text("\n".join(v))
    with (tmp_path / "train.jsonl").open("ab") as f:
        f.write(b"\n\xff\xfe")
    out = corpus.audit(corpus.read_splits(spark, {k: str(tmp_path / f"{k}.jsonl") for k in lines}, group="g"))
    assert {(r["split"], r["line"], r["reason"]) for r in out["errors"].collect()} == {("train", 3, "duplicate_path"), ("train", 4, "missing_text"), ("train", 5, "invalid_utf8"), ("test", 2, "group_leakage")}
    assert [(r["split"], r["line"], r["first_split"]) for r in out["warnings"].collect()] == [("test", 1, "train")]
    with pytest.raises(ContractViolation):
        corpus.read_splits(spark, {"a": "x"}, group="g", group_pattern="(x)")


def test_observations_document(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"observations": [{"sample_id": "s", "seed": 1, "valid": True, "more": 5}, {"sample_id": "t", "generation_seconds": 2}]}))
    got = documents.read_array(spark, str(tmp_path / "o.json"), "observations", documents.OBSERVATION).orderBy("_ord").collect()
    assert [(r["_ord"], r["sample_id"], r["generation_seconds"]) for r in got] == [(0, "s", None), (1, "t", 2.0)]
    documents.write_once(spark.range(1), str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        documents.write_once(spark.range(1), str(tmp_path / "out"))


def test_lineage(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.txt").write_text("a")
    (tree / "b.txt").write_text("b")
    (tmp_path / "f").write_text("x")
    inputs, outputs = [f"raw=tree={tree}"], [f"out=file={tmp_path / 'f'}"]
    receipt = lineage.build_receipt(spark, "id", "c" * 40, inputs, outputs)
    assert {r["role"]: r["status"] for r in lineage.verify_receipt(spark, receipt, inputs, outputs).collect()} == {"raw": "exact", "out": "exact"}
    before = artifacts.file_records(spark, str(tree)).collect()
    (tree / "a.txt").write_text("changed")
    assert {r["role"]: r["status"] for r in lineage.verify_receipt(spark, receipt, inputs, outputs).collect()} == {"raw": "differs", "out": "exact"}
    assert artifacts.unchanged(spark.createDataFrame(before), artifacts.file_records(spark, str(tree))).count() == 1
    for bad in (lambda: lineage.build_receipt(spark, "id", "latest", inputs, outputs), lambda: lineage.build_receipt(spark, "id", "v1.0", inputs, outputs), lambda: lineage.verify_receipt(spark, receipt | {"lineage_id": "d"}, inputs, outputs), lambda: lineage.declarations(["x=y=z"])):
        with pytest.raises(ContractViolation):
            bad()


def test_digests(spark):
    df = spark.createDataFrame([("s1", 1, 0.00001, True, None)], "sample_id string, seed long, x double, valid boolean, y string")
    got = attempts.with_digest(df, ["sample_id", "seed", "x", "valid", "y"], "d").first()["d"]
    assert got == canonical_sha256({"sample_id": "s1", "seed": 1, "x": 1e-05, "valid": True, "y": None})
    assert df.select(digest_strings(b=F.col("sample_id"), a=F.lit("é"))).first()[0] == canonical_sha256({"a": "é", "b": "s1"})
    refs = F.array(F.struct(F.lit("b").alias("reference_id"), F.lit("2").alias("sha256")), F.struct(F.lit("a").alias("reference_id"), F.lit("1").alias("sha256")))
    assert df.select(speaker.reference_set_digest(refs)).first()[0] == canonical_sha256([{"reference_id": "a", "sha256": "1"}, {"reference_id": "b", "sha256": "2"}])


OBS = "sample_id string, candidate_id string, prompt_id string, seed long, category string, valid boolean, requested_text string, generation_seconds double, peak_memory_bytes double, audio_duration_seconds double, runtime_id string"


def observed():
    return [(f"{c}-{p}-{s}", c, p, s, "k", not (c == "a" and p == "p2"), f" text {p}", 1.0 + (c == "a") + s, 5.0, 2.0, f"r-{c}") for c in "ba" for p in ("p1", "p2") for s in (1, 2)]


def test_matched(spark):
    rows = observed()
    obs = spark.createDataFrame(rows, OBS)
    plan = spark.createDataFrame([(r[0], r[1], r[2], r[3], f"text {r[2]}") for r in rows], "sample_id string, candidate_id string, prompt_id string, seed long, text string")
    out = matched.compare_runtimes(obs, plan, "b", "a", ["generation_seconds", "real_time_factor"])
    s = {r["metric"]: r for r in out["summary"].collect()}
    assert s["generation_seconds"]["n"] == 4 and s["generation_seconds"]["mean"] == 1.0 and s["generation_seconds"]["improvement"] == -1.0 and s["real_time_factor"]["n"] == 2
    v = out["validity"].first()
    assert (v["pairs"], v["b_valid"], v["a_valid"]) == (4, 4, 2)
    i = matched.intervals(out["deltas"], [], draws=20).where("metric = 'generation_seconds'").first()
    assert (i["n"], i["low"], i["high"]) == (4, 1.0, 1.0)
    for bad in (obs.where("seed = 1"), obs.unionByName(obs.limit(1)), obs.withColumn("requested_text", F.lit("x")), obs.withColumn("sample_id", F.concat("sample_id", F.lit("x")))):
        with pytest.raises(ContractViolation):
            matched.compare_matched(bad, plan, "b", "a", ["generation_seconds"])
    with pytest.raises(ContractViolation):
        matched.compare_matched(obs, plan, "b", "a", ["audio_duration_seconds", "generation_seconds"], required=["speaker_similarity"])


def test_extraction(spark):
    obs = spark.createDataFrame([("s1", True, None), ("s2", True, 1.0), ("s3", False, None), ("s4", True, None), ("s5", True, None)], "sample_id string, valid boolean, wer double")

    def work(row):
        if row["sample_id"] == "s4":
            raise ValueError("no")
        return {"wer": 0.5}

    results = extract.run_extractor(obs.where("valid and sample_id <> 's5'"), work, {"wer": "double"})
    assert {(r["sample_id"], r["problem"]) for r in extract.cover(obs, results).collect()} == {("s5", "missing_result")}
    got = {r["sample_id"]: (r["outcome"], r["wer"]) for r in extract.apply_results(obs, results, "wer").collect()}
    assert got == {"s1": ("applied", 0.5), "s2": ("conflict", 1.0), "s3": ("excluded", None), "s4": ("failed", None), "s5": ("uncovered", None)}


def test_attempts(spark):
    obs = spark.createDataFrame([("s1", True, "a.wav", H, 1.0, 2.0, "heard"), ("s2", True, None, None, 1.0, 2.0, None), ("s3", False, None, None, -1.0, 2.0, None)], "sample_id string, valid boolean, audio_path string, audio_sha256 string, generation_seconds double, peak_memory_bytes double, hypothesis_text string")
    receipts, bad = attempts.build_receipts(obs, obs.select("sample_id").where("sample_id <> 's3'"), H)
    assert {(r["sample_id"], r["rule"]) for r in bad.collect()} == {("s2", "valid_has_audio"), ("s3", "generation_seconds_range"), ("s3", "not_planned")}
    later = obs.withColumn("hypothesis_text", F.lit("other")).withColumn("generation_seconds", F.when(F.col("sample_id") == "s2", 9.0).otherwise(F.col("generation_seconds")))
    assert {r["sample_id"]: r["attempt_bound"] for r in attempts.apply_receipts(later, receipts).collect()} == {"s1": True, "s2": False, "s3": False}


def test_speaker(spark):
    plan = spark.createDataFrame([("p1", 1), ("p1", 2), ("p2", 1)], "prompt_id string, seed long")
    catalog = spark.createDataFrame([("r1", H, H), ("r2", H, H)], "reference_id string, audio_sha256 string, transcript_sha256 string")
    a = spark.createDataFrame([("p1", 1, ["r1", "r2"]), ("p1", 2, ["r2", "r1"]), ("p3", 1, ["r9"])], "prompt_id string, seed long, reference_ids array<string>")
    got = {tuple(r) for r in speaker.assignment_breaches(a, plan, catalog).collect()}
    assert got == {("p2", 1, "not_assigned"), ("p3", 1, "not_planned"), ("p1", 2, "sorted_unique"), ("p3", 1, "unknown_reference")}
    o = spark.createDataFrame([("s", [1.0, 0.0], [("a", [1.0, 0.0]), ("b", [0.0, 2.0])]), ("t", [1.0], [("a", [1.0, 0.0])])], "sample_id string, speaker_embedding array<double>, reference_speaker_embeddings array<struct<reference_id:string,embedding:array<double>>>")
    assert {r["sample_id"]: r["similarity"] for r in speaker.mean_cosine(o).collect()} == {"s": 0.5, "t": None}


def test_content_gate(spark):
    ref = spark.createDataFrame([("r1", "seven eight nine ten eleven twelve"), ("r2", "one two three four"), ("r3", "ﬁve SIX seven eight")], "reference_id string, transcript string")
    five = "one two three four five"
    rows = [
        ("s1", "c", True, five, five, None, ["r1", "r2"]), ("s2", "c", True, "one two three four", "seven eight nine ten eleven twelve", None, ["r1"]), ("s3", "d", True, "a b", None, None, []),
        ("s4", "e", True, "go " * 8, "go " * 8, "say it fast", ["r1"]), ("s5", "e", False, "x", "x", None, []), ("s6", "f", True, five, five + " say it", "Say it, now", ["r3"]), ("s7", "f", True, "go now", "go go go go go go go", "go now", []),
    ]
    df = spark.createDataFrame(rows, "sample_id string, candidate_id string, valid boolean, requested string, hypothesis string, instruction string, references array<string>").withColumn("report_id", F.lit("r"))
    got = {r["sample_id"]: r for r in content.diagnostics(df, ref).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"s1": "not_flagged", "s2": "failed", "s3": "not_evaluable", "s4": "not_flagged", "s5": "failed", "s6": "failed", "s7": "failed"}
    assert got["s2"]["reference_hits"] == 3 and got["s2"]["reference_transcript_overlap"]
    import hashlib

    grams = sorted(["seven eight nine ten", "eight nine ten eleven", "nine ten eleven twelve"])
    assert got["s2"]["reference_digests"] == [hashlib.sha256(g.encode()).hexdigest() for g in grams]
    assert (got["s6"]["instruction_exclusive"], got["s6"]["instruction_hits"], got["s6"]["spoken_instruction_overlap"]) == (2, 1, True)
    assert (got["s4"]["excess"], got["s4"]["instruction_status"]) == (0, "evaluated") and (got["s7"]["windows"], got["s7"]["excess"], got["s7"]["instruction_status"]) == (4, 3, "no_exclusive_ngrams")
    verdicts = {r["candidate_id"]: r["verdict"] for r in content.candidate_summary(content.diagnostics(df, ref)).collect()}
    assert verdicts == {"c": "failed", "d": "incomplete", "e": "failed", "f": "failed"}
    for bad in (df.withColumn("requested", F.repeat(F.lit("x "), 5000)), df.withColumn("references", F.array(F.lit("r9"))), df.withColumn("requested", F.lit("..."))):
        with pytest.raises(ContractViolation):
            content.diagnostics(bad, ref)


def test_listening(spark):
    plan = spark.createDataFrame([(f"{c}-{p}", c, p, 1, f"k{p[1]}") for c in ("a", "b") for p in ("p1", "p2", "p3")], "sample_id string, candidate_id string, prompt_id string, seed long, category string")
    routes = spark.createDataFrame([("nat", "all_samples", []), ("acc", "categories", ["k1"])], "criterion string, selector string, wanted array<string>")
    assigned = blind.assignment(plan, routes)
    assert assigned.count() == 8
    with pytest.raises(ContractViolation):
        blind.assignment(plan.where("sample_id <> 'a-p1'"), routes)
    review, reveal = blind.blind_pack(assigned, "pack", 1)
    assert "candidate_id" not in review.columns and reveal.select("blind_id").distinct().count() == 6
    sched = review.select(F.lit("r1").alias("rater_id"), "blind_id").withColumn("position", F.expr("cast(substring(blind_id, 8) as int)"))
    packet = blind.rater_packet(sched, review, "r1", ["nat", "acc"])
    scores = packet.select("rater_id", "criterion", "blind_id", (F.col("task") % 5 + 1.0).alias("score"))
    done = blind.submission(packet, scores, 1, 5)
    assert done.count() == 8
    out = blind.results(done, reveal, packet.unionByName(packet.withColumn("rater_id", F.lit("r2"))))
    assert out["missing"].count() == 8 and out["candidates"].count() == 4 and out["agreement"].where("alpha is null").count() == 2
    for bad in (scores.where("criterion <> 'nat'"), scores.withColumn("score", F.lit(9.0)), scores.unionByName(scores.limit(1))):
        with pytest.raises(ContractViolation):
            blind.submission(packet, bad, 1, 5)
    with pytest.raises(ContractViolation):  # p2 and p3 would have no criterion
        blind.assignment(plan, routes.where("criterion = 'acc'"))
    blocks = {(f"p{i}", 1): {c: f"{c}{i}" for c in "abc"} for i in range(4)}
    exact = listening.schedule_exact(blocks, ["r2", "r1"], 5)
    order = sorted(blocks)
    random.Random(int(canonical_sha256({"rater_id": "r2", "schedule_seed": 5})[:16], 16)).shuffle(order)
    assert exact["r2"] == ["abc"[(p + 1 + int(b[0][1])) % 3] + b[0][1] for p in range(3) for b in order] and sorted(exact) == ["r1", "r2"]
    shuffled = ["q", "p", "z"]
    random.Random(1).shuffle(shuffled)
    assert listening.blind_labels_exact(["q", "p", "z"], 1) == {x: f"sample-{i:04d}" for i, x in enumerate(shuffled, 1)}


def test_lifecycle(spark, tmp_path):
    py = sys.executable
    write = lambda name, what: [py, "-c", f"open({name!r}, 'w').write({what!r})"]
    good = lifecycle.Backend("b", ("lora",), (lifecycle.Stage("preflight", write("p", "1"), ["p"]), lifecycle.Stage("training", write("t", "2"), ["t"])))
    assert [r["status"] for r in lifecycle.run(good, tmp_path / "good")] == ["complete", "complete"]
    tampers = lifecycle.Backend("b", ("lora",), (lifecycle.Stage("preflight", write("p", "1"), ["p"]), lifecycle.Stage("training", write("p", "2"), []), lifecycle.Stage("evaluation", write("e", ""), [])))
    rows = lifecycle.run(tampers, tmp_path / "bad")
    assert [r["status"] for r in rows] == ["complete", "failed", "not_run"] and "changed" in rows[1]["error"]
    slow = lifecycle.Backend("b", ("lora",), (lifecycle.Stage("training", [py, "-c", "import time; time.sleep(60)"], [], 0.5),))
    assert lifecycle.run(slow, tmp_path / "slow")[0]["status"] == "failed"
    assert lifecycle.report(spark, rows).count() == 3
    assert lifecycle.resolve([good], "lora") is good
    for bad in (lambda: lifecycle.resolve([good, good], "lora"), lambda: lifecycle.validate_backend(lifecycle.Backend("b", (), good.stages[::-1]))):
        with pytest.raises(ContractViolation):
            bad()


def test_first_seen_stream(spark, tmp_path):
    from timbre.streaming import first_seen

    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 02:00:00")], "k string, t string").withColumn("t", F.to_timestamp("t")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
    q = first_seen(stream, "k", "t").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["k"] for r in spark.table("seen").collect()) == ["a", "b"]


PACK = {
    "id": "pack", "version": "1", "locale": "en-SG", "purpose": "test", "objective_metrics": ["asr_word_error_rate"], "listening_criteria": ["natural"], "measurement_limits": ["none"],
    "generation": {"seeds": [1, 2], "seeds_per_candidate": 2, "require_same_transcripts": True, "require_frozen_generation_settings": True},
    "prompts": [
        {"id": "p1", "text": "Take the MRT to Bishan", "category": "pronunciation", "lexical_anchors": [{"anchor_id": "b", "surface": "Bishan", "accepted_asr_forms": ["bee shan", "bishan"]}]},
        {"id": "p2", "text": "Hello", "category": "long_form_cadence", "instruction": "slowly"},
    ],
}


def test_prompt_packs(spark):
    assert packs.pack_breaches(PACK) == []
    anchor = PACK["prompts"][0]["lexical_anchors"][0]
    bad = PACK | {"generation": PACK["generation"] | {"seeds": [1, 1, 1]}, "objective_metrics": ["loudness"], "prompts": [PACK["prompts"][0] | {"lexical_anchors": [anchor | {"surface": "Toa"}, {"anchor_id": "c", "surface": "MRT", "accepted_asr_forms": ["bee  shan", "take"]}]}, PACK["prompts"][0]]}
    assert {
        ("$.generation.seeds", "unique"), ("$.generation.seeds_per_candidate", "number_of_seeds"), ("$.prompts[1].id", "unique"), ("$.prompts[0].lexical_anchors[0].surface", "occurs_once"), ("$.objective_metrics[0]", "allowed"),
        ("$.prompts[0].lexical_anchors[1].accepted_asr_forms", "collides"), ("$.prompts[0].lexical_anchors[1].accepted_asr_forms", "includes_surface"), ("$.prompts[0].lexical_anchors[1].accepted_asr_forms", "absent_from_text"),
        ("$.prompts", "has_long_form_cadence"), ("$.prompts[1].lexical_anchors", "anchor_ids_unique_across_prompts"),
    } <= set(packs.pack_breaches(bad))
    header, plan = packs.plan_from_pack(spark, PACK, ["b", "a"])
    assert plan.where("prompt_id = 'p1' and candidate_id = 'a' and seed = 2").first()["expected_audio_path"] == "audio/a/p1/seed-2.wav"
    assert header["sample_count"] == plan.count() == 8 and header["prompt_pack"]["sha256"] == canonical_sha256(PACK)
    obs = plan.where("not (candidate_id = 'a' and seed = 2)").withColumn("valid", F.col("prompt_id") == "p1").drop("category")
    got = packs.coverage(plan, obs.unionByName(obs.limit(1)))
    counts = {r["candidate_id"]: (r["total"], r["missing"]) for r in got["candidates"].collect()}
    assert counts == {"a": (4, 2), "b": (4, 0)} and got["samples"].where("status = 'duplicate'").count() == 1
    with pytest.raises(ContractViolation):
        packs.plan_from_pack(spark, PACK, ["a", "a"])


def test_audio_files(spark, tmp_path):
    import hashlib

    data = recording(SPEECH)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(data)
    (tmp_path / "in" / "b.wav").write_bytes(b"")
    digest = hashlib.sha256(data).hexdigest()
    rows = [("s1", "a.wav", digest, True), ("s2", "a.wav", H, True), ("s3", "b.wav", H, True), ("s4", "../a.wav", H, True), ("s5", "c.wav", H, True), ("s6", None, None, True), ("s7", None, None, False)]
    obs = spark.createDataFrame(rows, "sample_id string, audio_path string, audio_sha256 string, valid boolean")
    got = {r["sample_id"]: r["fault"] for r in audio_files.verify_audio(spark, obs, str(tmp_path / "in")).collect()}
    assert got == {"s1": None, "s2": "audio_differs", "s3": "audio_missing", "s4": "audio_path_leaves_base", "s5": "audio_missing", "s6": "audio_path_missing"}
    probed = {r["sample_id"]: (r["status"], r["pause_count"]) for r in audio_files.probe_observations(spark, obs, str(tmp_path / "in"), wav.prosody_metrics, ["pause_count"]).collect()}
    assert probed["s1"] == ("complete", 2.0) and probed["s2"] == ("failed", None) and len(probed) == 6
    manifest = obs.where("sample_id in ('s1', 's5')").selectExpr("sample_id", "audio_path", "audio_sha256", "cast(null as long) seed", "cast(null as string) prompt_id", "'x' requested_text")
    c = history.audit_prosody(spark, manifest, str(tmp_path / "in"))["coverage"].first()
    assert (c["rows"], c["with_seed"], c["with_requested_text"], c["complete"], c["failed"]) == (2, 0, 2, 1, 1)
    with pytest.raises(ContractViolation):
        history.check_manifest(manifest.drop("seed"))
    staged = audio_files.stage_blind([("sample-0001", "a.wav", digest)], tmp_path / "in", tmp_path / "out")
    assert staged == audio_files.stage_blind([("sample-0001", "a.wav", digest)], tmp_path / "in", tmp_path / "out")
    (tmp_path / "out" / "blind_audio" / "sample-0001.wav").write_bytes(b"other")
    with pytest.raises(ValueError, match="other bytes"):
        audio_files.stage_blind([("sample-0001", "a.wav", digest)], tmp_path / "in", tmp_path / "out")
    files = spark.createDataFrame([("s1", bytearray(data)), ("s2", bytearray(b""))], "sample_id string, content binary")
    got = {r["sample_id"]: (r["status"], r["size"]) for r in audio_files.model_extractor(files, lambda: lambda c: {"size": len(c) // (1 if c else 0)}, "size", {"size": "long"}).collect()}
    assert got == {"s1": ("complete", len(data)), "s2": ("failed", None)}


def test_runtime_manifests(spark, tmp_path):
    (tmp_path / "a").write_text("a")
    (tmp_path / "b").write_text("b")
    one, two = [f"weights=file={tmp_path / 'a'}"], [f"weights=file={tmp_path / 'b'}"]
    exact, derived = {"runtime_id": "r", "relation": "exact", "artifacts": one}, {"runtime_id": "q", "relation": "derived", "artifacts": two, "conversion": {"tool": "t", "revision": "v1.2"}}
    m = runtime.build_manifest(spark, "set", "repo", "c" * 40, one, [exact, derived])
    assert runtime.verify_manifest(spark, m, one, [exact, derived]) and m["runtime_bindings"][1]["derived_from_sha256"] == m["source_artifact_set_sha256"]
    obs = spark.createDataFrame([("s", "r", m["source_artifact_set_sha256"]), ("t", "r", H), ("u", "q", m["runtime_bindings"][1]["artifact_set_sha256"])], "sample_id string, runtime_id string, artifact_set_sha256 string")
    assert [r["sample_id"] for r in runtime.exact_runtimes(runtime.bindings_frame(spark, m), obs).collect()] == ["s"]
    (tmp_path / "a").write_text("c")
    assert not runtime.verify_manifest(spark, m, one, [exact, derived])
    (tmp_path / "empty").write_text("")
    identity = [{"role": "corpus", "sha256": H}]
    runtime.resume_receipt("r", "interrupted_resumed", 10, 10, identity, 4, 4, "SIGTERM")
    build = lambda *b, revision="c" * 40: runtime.build_manifest(spark, "set", "repo", revision, one, list(b))
    for bad in (
        lambda: build(exact), lambda: build(exact, exact), lambda: build(exact, derived | {"relation": "exact"}), lambda: build(exact, derived | {"conversion": {"tool": "t", "revision": "main"}}), lambda: build(exact, derived, revision="v1"),
        lambda: build(exact, derived | {"artifacts": [f"weights=file={tmp_path / 'empty'}"]}),
        lambda: runtime.resume_receipt("r", "interrupted_resumed", 10, 10, identity, 4, 5, "SIGTERM"), lambda: runtime.resume_receipt("r", "uninterrupted", 10, 10, identity, 4),
    ):
        with pytest.raises(ContractViolation):
            bad()


def test_command_line(spark, tmp_path, capsys):
    def run(*argv):
        code = cli.main([*map(str, argv)], spark)
        return code, json.loads(capsys.readouterr().out or "null")

    (tmp_path / "package.json").write_text(json.dumps(PACKAGE))
    assert run("validate", "package", tmp_path / "package.json") == (0, {"errors": [], "valid": True})
    assert run("validate", "evaluation", tmp_path / "package.json")[0] == 1
    assert cli.main(["validate", "package", str(tmp_path / "none")], spark) == 2
    (tmp_path / "t.wav").write_bytes(recording(SPEECH))
    assert run("probe-prosody", tmp_path / "t.wav")[1]["metrics"]["pause_count"] == 2 and run("compare-audio", tmp_path / "t.wav", tmp_path / "t.wav")[1]["peak"] == 0
    (tmp_path / "pack.json").write_text(json.dumps(PACK))
    code, plan = run("build-generation-plan", tmp_path / "pack.json", "--candidate", "b", "--candidate", "a")
    assert code == 0 and plan["sample_count"] == 8
    (tmp_path / "plan.json").write_text(json.dumps(plan))
    rows = [{k: s[k] for k in ("sample_id", "candidate_id", "prompt_id", "seed")} | {"requested_text": s["text"], "valid": True, "generation_seconds": 1.0 + (s["candidate_id"] == "a")} for s in plan["samples"]]
    (tmp_path / "o.json").write_text(json.dumps({"observations": rows}))
    assert run("validate-observations", tmp_path / "o.json")[0] == 0
    assert run("check-suite-coverage", tmp_path / "plan.json", tmp_path / "o.json")[0] == 0
    code, out = run("compare-matched", tmp_path / "o.json", tmp_path / "plan.json", "b", "a", "--metric", "generation_seconds")
    assert code == 0 and out["summary"][0]["mean"] == 1.0 and out["validity"][0]["pairs"] == 4
    (tmp_path / "o.json").write_text(json.dumps({"observations": rows[1:]}))
    assert run("check-suite-coverage", tmp_path / "plan.json", tmp_path / "o.json")[0] == 1
    assert cli.main(["compare-matched", str(tmp_path / "o.json"), str(tmp_path / "plan.json"), "b", "a", "--metric", "generation_seconds"], spark) == 2
