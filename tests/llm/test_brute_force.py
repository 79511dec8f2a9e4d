"""Operators that SQL cannot express, against plain versions of their methods."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import brute_lines, brute_near, corpus, frame, words

from timbre.llm import toxicity as tox
from timbre.llm.license_scan import license_scan
from timbre.llm.mixing import bisect_exponent, mix_sources, tempered
from timbre.llm.packing import BIN_COST, best_fit, pack, pack_shard

# --- 2 toxicity ------------------------------------------------------------------------------


def plain_features(text):
    out = set()
    for w in words((text or "").lower()):
        out |= set(tox._features_of(w))
    return out


def test_chain_scores_like_plain_sums(spark):
    texts = ["vile Words here", "calm words", None, "", "vile " * 4000, "vile calm?", "vile Words here"]
    docs = spark.createDataFrame([(i, t, "clash", 9.0) for i, t in enumerate(texts)], "doc_id long, text string, p_toxic string, rejected double")
    labels = spark.createDataFrame([(0, 0, 1), (1, 1, 0), (4, 0, 1), (5, 1, None), (5, 1, 0), (None, 0, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")
    chain = tox.train(docs, labels, {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")})
    assert [m.name for m in chain] == ["junk", "toxic"] and [len(m.earlier) for m in chain] == [0, 1]
    got = {r["doc_id"]: r for r in tox.toxicity(docs, labels).collect()}
    assert len(got) == 7
    for i, t in enumerate(texts):
        earlier = []
        for m in chain:
            z = m.bias + sum(m.weights.get(f, 0.0) for f in plain_features(t)) + sum(w * p for w, p in zip(m.earlier, earlier, strict=True))
            earlier.append(1 / (1 + np.exp(-z)))
            assert got[i][f"p_{m.name}"] == pytest.approx(earlier[-1])
        assert got[i]["rejected"] == (got[i]["p_toxic"] >= 0.5)


def test_later_models_see_out_of_fold_predictions(monkeypatch):
    """Each row's earlier probability comes from a model that was not fitted on the row."""
    fit, seen = tox._fit, []
    monkeypatch.setattr(tox, "_fit", lambda doc, feature, n, extra, y, rows, keep: seen.append((set(rows.tolist()), extra.copy())) or fit(doc, feature, n, extra, y, rows, keep))
    rng = np.random.default_rng(0)
    doc, feature = np.repeat(np.arange(40), 5), rng.integers(0, 12, 200)
    labels = {"a": (np.arange(40) % 3 == 0).astype(int), "b": (np.arange(40) % 5 == 0).astype(int)}
    tox.fit_chain(doc, feature, labels, folds=4)
    first, second = seen[:5], seen[5:]
    assert [len(r) for r, _ in first] == [30, 30, 30, 30, 40] and all(x.shape == (40, 0) for _, x in first)
    names = np.unique(feature, return_inverse=True)[1]
    unseen = np.zeros(40)
    for rows, extra in first[:4]:
        own = sorted(set(range(40)) - rows)
        model = fit(doc, names, 12, extra, labels["a"].astype(float), np.array(sorted(rows)), tox.KEEP_FEATURES)
        unseen[own] = tox._predict(doc, names, 12, extra, 40, model)[own]
    assert all(np.allclose(x[:, 0], unseen) for _, x in second)


def test_repeated_documents_do_not_multiply_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert tox.labelled(docs, labels, {"toxic": F.col("toxic")}, 10).count() == 2


def test_the_driver_gets_models_only(spark):
    """300 documents of 3,000 words: their pairs alone are more than 7 MB."""
    word = lambda x: F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", x), F.lit(20_000)).cast("string"))
    docs = spark.range(300).withColumnRenamed("id", "doc_id").select("doc_id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), word), " ").alias("text"))
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality", "cast(doc_id % 3 = 0 as int) toxic")
    tracemalloc.start()
    chain = tox.train(docs, labels, {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(len(m.weights) > 100 for m in chain) and peak < 6e6


def test_gathered_rows_fit_like_all_pairs_at_once(monkeypatch):
    """Any dealing into batches and any length of parts gives the same models, to the bit."""
    rng = np.random.default_rng(1)
    ids, ys = np.sort(rng.integers(-40, 40, 60)), rng.integers(0, 2, (60, 2))
    order = np.lexsort((ys[:, 1], ys[:, 0], ids))
    ids, ys = ids[order], ys[order]
    lists = [np.unique(rng.integers(0, 30, n) * (1 << 40) + y[0]).tolist() for n, y in zip(rng.integers(0, 20, 60), ys, strict=True)]
    for i in range(1, 60):  # rows that agree in id and labels hold the same text
        if ids[i] == ids[i - 1] and (ys[i] == ys[i - 1]).all():
            lists[i] = lists[i - 1]
    doc, feature = np.repeat(np.arange(60), [len(x) for x in lists]), np.array([f for x in lists for f in x], np.int64)
    want = tox.fit_chain(doc, feature, {"a": ys[:, 0], "b": ys[:, 1]})
    assert any(m.weights for m in want)
    monkeypatch.setattr(tox, "PAIRS_AT_ONCE", 7)
    for n in (1, 3, 60):
        dealt = np.array_split(rng.permutation(60), n)
        batches = [pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(ys[k, 0], pa.int32()), pa.array(ys[k, 1], pa.int32()), pa.array([lists[i] for i in k], pa.list_(pa.int64()))], names=["doc_id", "y_0", "y_1", "features"]) for k in dealt]
        held, d, f, names = tox.gathered(iter(batches), 2)
        assert d.dtype == f.dtype == np.int32 and (names[f] == feature).all() and (d == doc).all() and (held == ys).all()
        assert tox.fit_chain(d, f, {"a": held[:, 0], "b": held[:, 1]}, names=names) == want
    assert [len(x) for x in tox.gathered(iter([]), 2)] == [0] * 4


def test_labelled_texts_without_words(spark):
    docs = spark.createDataFrame([(i, " ") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(6)], "doc_id long, quality int, toxic int")
    assert [(m.weights, len(m.earlier)) for m in tox.train(docs, labels, {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")})] == [({}, 0), ({}, 1)]
    assert [(m.name, m.weights, m.bias) for m in tox.train(docs, labels.limit(0), {"junk": F.col("quality"), "toxic": F.col("toxic")})] == [("junk", {}, -10.0), ("toxic", {}, -10.0)]


# --- 4 packing -------------------------------------------------------------------------------


def plain_best_fit(lengths, capacities, bin_cost, rule):
    """Every open bin is looked at for every chunk."""
    bins = []
    for n in sorted(lengths, reverse=True):
        open_ = [b for b in bins if b[0] - b[1] >= n]
        if open_:
            b = min(open_, key=lambda b: b[0] - b[1])
        else:
            fits = [c for c in capacities if c >= n]
            c = fits[-1] if rule == "largest" else fits[0] if rule == "tight" else min(fits, key=lambda c: ((c + bin_cost) / (c // n), c))
            b = [c, 0]
            bins.append(b)
        b[1] += n
    return sorted(b[1] for b in bins)


@pytest.mark.parametrize("seed", range(4))
def test_packing_against_a_plain_best_fit(seed):
    rng = random.Random(seed)
    capacities = (16, 32, 64)
    lengths = np.array([rng.choice([1, 5, 8, 8, 16, 31, 33, 64, rng.randrange(1, 65)]) for _ in range(300)])
    costs = {}
    for rule in ("amortised", "largest", "tight"):
        of, at, used = best_fit(np.sort(lengths)[::-1], capacities, BIN_COST, rule)
        want = plain_best_fit(lengths.tolist(), capacities, BIN_COST, rule)
        assert sorted(used.tolist()) == want
        costs[rule] = sum(min(c for c in capacities if c >= u) + BIN_COST for u in want)
    of, at, final = pack_shard(lengths, capacities)
    held = Counter()
    for b, n in zip(of.tolist(), lengths.tolist(), strict=True):
        held[b] += n
    ends = dict(zip(of.tolist(), final.tolist(), strict=True))
    assert sum(c + BIN_COST for c in ends.values()) == min(costs.values()) and all(held[b] <= ends[b] == min(c for c in capacities if c >= held[b]) for b in held)


def test_packing_does_not_depend_on_the_order_of_rows(spark):
    """Ties, repeated rows, clashing names, nulls, an empty and a long text."""
    rows = [(i % 9, "w " * (i % 4 * 3), 1, 2, 3) for i in range(40)] + [(None, "a b", 1, 2, 3)] * 3 + [(5, None, 1, 2, 3), (6, "x " * 500, 1, 2, 3)]
    make = lambda rows, n: pack(spark.createDataFrame(rows, "doc_id long, text string, chunk int, length int, copy int").repartition(n), (16, 32), shard_chunks=20)
    one, two = (sorted(map(tuple, make(r, n).collect()), key=repr) for r, n in ((rows, 1), (rows[::-1], 7)))
    assert one == two and sum(r[3] for r in one) == sum(len(words(r[1])) for r in rows)
    assert make([], 2).count() == 0


# --- 6 mixing --------------------------------------------------------------------------------


def test_mixing_against_a_plain_version(spark):
    """Budgets, permutations of blocks, and the cut last pass, with many rows of one document and clashing names."""
    rows = corpus(16, 150) + [(5000, "same words again " * 3, "s1", "clash", i % 2) for i in range(40)]
    seed, block = 3, 4
    df = frame(spark, rows).withColumnsRenamed({"kept": "docs", "n": "taken"})
    got = Counter((r["doc_id"], r["mix_epoch"]) for r in mix_sources(df, 0.9, seed=seed, block_docs=block).collect())
    from timbre.llm.common import row_key

    keys = [(r["source"], r["doc_id"], r["k"], len(words(r["text"]))) for r in df.select("source", "doc_id", "text", F.xxhash64("doc_id", row_key(), F.lit(seed)).alias("k")).collect()]
    sources = sorted({k[0] for k in keys}, key=lambda s: s or "")
    tokens = {s: sum(k[3] for k in keys if k[0] == s) for s in sources}
    total = sum(tokens.values())
    shares = [tokens[s] / total for s in sources]
    weights = tempered(shares, bisect_exponent(shares, 0.9 * np.log(len(sources))))
    want = Counter()
    for s, w in zip(sources, weights, strict=True):
        own = [k for k in keys if k[0] == s]
        n_blocks = max(1, -(-len(own) // block))
        whole, rest = divmod(round(w * total), tokens[s])
        for e in range(whole + (rest > 0)):
            order = {r["b"]: r["o"] for r in spark.range(n_blocks).select(F.col("id").alias("b"), F.xxhash64("id", F.lit(e).cast("long"), F.lit(seed)).alias("o")).collect()}
            left = rest if e == whole else tokens[s] + 1
            for b in sorted(order, key=lambda b: (order[b], b)):
                inside = sorted((k for k in own if k[2] % n_blocks == b), key=lambda k: (k[2], k[3]))
                whole_block = sum(k[3] for k in inside) <= left
                for k in inside if left > 0 else ():
                    if whole_block or left > 0:
                        want[k[1], e] += 1
                        left -= k[3]
    assert got == want


# --- 10 licences -----------------------------------------------------------------------------


def test_inheritance_against_a_plain_search(spark):
    """Nearest directory with a licence file, in a table whose rows stand mostly in one directory; ties, nulls, clashing names."""
    rng = random.Random(4)
    notices = {"MIT": ["released under the mit grant of use"], "GPL": ["copyleft terms of the gnu project apply"]}
    dirs = ["", "a", "a/b", "a/b/c", "d", "d/e"]
    rows = [(f"{d}/LICENSE".lstrip("/"), notices[k][0]) for d, k in (("a", "MIT"), ("a/b/c", "GPL"), ("d", "GPL"))]
    rows += [(f"{rng.choice(dirs)}/f{i}".lstrip("/"), "int main") for i in range(60)] + [(f"d/e/g{i}", None) for i in range(200)] + [(None, "int main"), ("d/e/g1", ""), ("a/x", "int main")]
    rows += [("d/COPYING", notices["MIT"][0])]  # an equal score: the smaller path speaks
    got = license_scan(spark.createDataFrame([(*r, "clash", 1) for r in rows], "path string, text string, license string, m int"), notices).select("path", "license", "how").collect()
    speaks = {"a": "MIT", "a/b/c": "GPL", "d": "MIT"}

    def plain(path, text):
        for name, (notice,) in notices.items():
            if text == notice:
                return name, "file"
        if path is None:
            return None, None
        here = path.rsplit("/", 1)[0] if "/" in path else ""
        while True:
            if here in speaks:
                return speaks[here], "inherited"
            if not here:
                return None, None
            here = here.rsplit("/", 1)[0] if "/" in here else ""

    assert sorted(map(tuple, got), key=repr) == sorted(((p, *plain(p, t)) for p, t in rows), key=repr)


# --- pipeline --------------------------------------------------------------------------------


def test_pipeline_against_plain_versions(spark, tmp_path):
    """Each stage on its own input: nulls, empty texts, ties, repeated rows and an extra column."""
    import corpus_pipeline as p

    rng = random.Random(12)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(40)) for _ in range(12)]
    texts = [*base, *base[:3], *(b.replace("w1", "v1", 1) for b in base[:4]), None, "", "  ", base[0] + "\nfooter of every page here\n" + base[5], "x\nfooter of every page here", "bad vile " * 5, "long " * 3000]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "extra") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rk string").write.parquet(str(tmp_path / "documents.parquet"))
    toxic = next(i for i, t in enumerate(texts) if t and t.startswith("bad"))
    labels = [(i, 1, 0) for i in range(12)] + [(toxic, 0, 1)] * 6
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = {}
    for name, stage in p.STAGES:
        docs = p.materialize(stage(spark, docs, str(tmp_path)))
        out[name] = docs.collect()
    given = [(r[0], r[1]) for r in rows]
    first = [(r["doc_id"], r["text"]) for r in out["toxicity"]]
    assert toxic not in dict(first) and sorted(dict(given).keys() - dict(first).keys()) == [toxic]
    second = {r["doc_id"]: r["text"] for r in out["line dedup"]}
    cut = {d: (t, gone) for d, t, _, gone in brute_lines(sorted(first), 20)}
    assert second == {d: t for d, (t, gone) in cut.items() if gone == 0 or words(t)}
    third = {r["doc_id"]: r["text"] for r in out["near dedup"]}
    assert third == {d: second[d] for d, _, least, kept in brute_near(sorted(second.items()), 5, 80) if kept}
    fourth = Counter(r["doc_id"] for r in out["mixing"])
    assert set(fourth) <= set(third)
    assert sum(r["length"] for r in out["packing"]) == sum(len(words(third[d])) * n for d, n in fourth.items())
    bins = Counter()
    for r in out["packing"]:
        if r["bin_id"] is not None:
            bins[r["bin_id"], r["capacity"]] += r["length"]
    assert all(n <= c for (_, c), n in bins.items())
