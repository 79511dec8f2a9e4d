"""Each corpus operator against a brute-force version on small fixtures, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timbre.llm.common import connected_components, hash_words, split_words
from timbre.llm.exact_dedup import exact_dedup
from timbre.llm.license_scan import SLOTS, _Matcher, _slot, _terms, license_scan, standard_templates
from timbre.llm.line_dedup import line_dedup
from timbre.llm.minhash_dedup import bayes_survivors, least_matches, near_duplicates
from timbre.llm.mixing import bisect_exponent, entropy, mix_sources, tempered
from timbre.llm.packing import pack, pack_shard
from timbre.llm.substring_dedup import substring_dedup, window_symbols
from timbre.llm.topk_search import top_k
from timbre.llm.toxicity import toxicity
from timbre.llm.url_filter import url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, kept string, n int"


def words(text):
    return WORD.findall(text or "")


def corpus(seed: int, n: int = 60) -> list[tuple]:
    """Random texts over few words, with copies, edits, nulls, empty and one long text; extra columns clash with result names."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "A", "a", "ﬁ"]
    texts: list = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.5 and (base := rng.choice(texts)):
            w = base.split(" ")
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 14, 30, 80]))))
    texts += ["", None, "   \n\t ", "x " * 40, " ".join(rng.choice(vocab) for _ in range(9000)), "same same same same same same same same same same same same same same same"]
    return [(i, t, None if i % 7 == 0 else f"s{i % 3}", "clash", i) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# --- word arrays and components --------------------------------------------------------------


def test_words_are_split_and_hashed_alike():
    texts = [" a  b\x0bc\x1cd é\x85f\n", "", None, "\t", "x" * 100 + " " + "x" * 101, "a é"]
    got, at = split_words(pa.array(texts))
    assert [got[at[i] : at[i + 1]].to_pylist() for i in range(len(texts))] == [words(t) for t in texts]
    values = hash_words(got)
    by = {}
    for w, v in zip(got.to_pylist(), values, strict=True):
        assert by.setdefault(w, v) == v
    assert len(set(by.values())) == len(by)


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    for limit in (0, 1 << 20) if seed else (1 << 20,):  # by rounds, and in one task
        got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), limit=limit).collect()}
        assert got == {x: find(x) for x in parent}


def test_hot_groups_are_joined_whole(spark, monkeypatch):
    from timbre.llm import common

    monkeypatch.setattr(common, "is_small", lambda *a: False)
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"))
    groups = common.materialize(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    got = common.join_groups(rows, groups, ["key"], "n")
    assert got.columns == ["key", "id", "n", "least"] and got.count() == 6000
    assert {(r["key"], r["n"], r["least"]) for r in got.distinct().collect()} == {(r["key"], r["n"], r["least"]) for r in groups.collect()}


# --- 1 url filters ---------------------------------------------------------------------------


def test_url_filter_spreads_blocks_to_aliases(spark):
    rules = [("allow", "good.com", "/"), ("block", "bad.com", "/x/"), ("block", "net", "/")]
    link = '<html><link rel="canonical" href="{}"></html>'
    pages = [
        (1, "https://a.bad.com/x/1", None, "c"), (2, "http://alias.org/p", link.format("https://a.bad.com/x/1"), "c"), (3, "http://good.com/q", link.format("http://alias.org/p"), "c"),
        (4, "http://lone.org/z#top", None, "c"), (5, None, None, "c"), (6, "no scheme", None, "c"), (7, "HTTP://Sub.NET?x", None, "c"), (8, "http://meta.org/", '<meta http-equiv="refresh" content="0; url=http://q.net/">', "c"),
        (9, "http://far.org/", None, "c"), (9, "http://far.org/", None, "c"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, verdict string")
    edges = spark.createDataFrame([("http://far.org/", "http://meta.org/")], "a string, b string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["via_alias"]) for r in url_filter(df, rules, edges).collect()}
    assert got[1] == ("a.bad.com", "/x/1", "bad.com/x/", "block", False)
    assert got[3][2:] == ("good.com/", "allow", False)
    assert got[2][2:] == (None, "allow", False)  # its class holds an explicitly allowed address
    assert got[4] == ("lone.org", "/z", None, "allow", False)
    assert got[5] == ("", "", None, "allow", False) and got[6] == ("", "", None, "allow", False)
    assert got[7] == ("sub.net", "", None, "allow", False)  # path does not start with the rule's
    assert got[8][2:] == (None, "block", True) and got[9][2:] == (None, "block", True)
    assert url_filter(df.limit(0), rules).count() == 0


def test_url_filter_resolves_every_form_of_link(spark):
    rules = [("block", "bad.com", "/")]
    link, meta = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    bad = "http://bad.com/a/item.html?x=1&y=2"
    forms = [  # page, html, address it is tied to
        ("http://h1.org/a/b.html", link.format("item.html"), "http://h1.org/a/item.html"), ("http://h2.org/a/b/c", link.format("../x"), "http://h2.org/a/x"), ("http://h3.org/a?id=1", link.format("?id=3"), "http://h3.org/a?id=3"),
        ("http://h4.org/a", link.format(bad.replace("&", "&amp;")), bad), ("http://h5.org/a", meta.format(bad.replace("&", "&#38;")), bad), ("http://h6.org", link.format("p"), "http://h6.org/p"), ("http://h7.org/a/b", meta.format("./c"), "http://h7.org/a/c"),
        ("http://h8.org/a", f'<link rel="alternate canonical" href="{bad}">', bad), ("http://h9.org/a", f"<link href='{bad}' rel='canonical nofollow'>", bad), ("http://h10.org/a", f"<LINK REL=canonical HREF={bad}>", bad),
        ("http://h11.org/a", '<base href="http://h12.org/d/">' + link.format("e"), "http://h12.org/d/e"), ("http://h13.org/a/b", link.format("/c"), "http://h13.org/c"), ("http://h14.org/a", link.format("//h15.org/c"), "http://h15.org/c"),
    ]
    other = [("http://n1.org/a", f'<link rel="canonicals" href="{bad}">'), ("http://n2.org/a", link.format("#top")), ("http://n3.org/a", link.format("http://[x"))]
    pages = [(i, u, h) for i, (u, h, *_) in enumerate(forms + other)]
    edges = spark.createDataFrame([(to, bad) for _, _, to in forms if to != bad], "a string, b string")
    got = {r["page_id"]: r["verdict"] for r in url_filter(spark.createDataFrame(pages, "page_id long, url string, html string"), rules, edges).collect()}
    assert got == {i: "block" if i < len(forms) else "allow" for i in range(len(pages))}


# --- 2 toxicity ------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/labels.parquet")
    fit, held = labels.where("doc_id % 4 > 0"), labels.where("doc_id % 4 = 0")
    out = toxicity(docs, fit).join(held, "doc_id").toPandas()
    hit = out["rejected"] == (out["toxic"] == 1)
    assert hit.mean() >= 0.95
    assert ((out["p_junk"] >= 0.5) == (out["quality"] == 0)).mean() >= 0.9


def test_toxicity_edges(spark):
    rows = frame(spark, corpus(1)).withColumnRenamed("kept", "p_toxic").withColumnRenamed("n", "rejected")
    labels = spark.createDataFrame([(i, 1 if i % 2 else None, int(i % 2 == 0)) for i in range(40)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity(rows, labels)
    assert out.count() == rows.count() and out.where("p_toxic is null or rejected is null").count() == 0
    assert toxicity(rows, labels.limit(0)).where("rejected").count() == 0
    assert toxicity(rows.limit(0), labels).count() == 0


# --- 3 substring dedup -----------------------------------------------------------------------


def brute_substrings(rows, window):
    least = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = {j for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("seed,window", [(1, 13), (2, 13), (3, 5), (4, 2)])
def test_substring_dedup(spark, seed, window):
    rows = corpus(seed)
    got = sorted(tuple(r) for r in substring_dedup(frame(spark, rows).repartition(5), window).collect())
    assert got == brute_substrings(rows, window)


def test_equal_windows_choose_equal_symbols():
    rng = np.random.default_rng(0)
    for trial in range(20):
        piece = rng.integers(0, 2 if trial % 2 else 12, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        left, right = (rng.integers(0, 12, rng.integers(0, 20)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in "ab")
        seen = {}
        for names in (piece, np.concatenate([left, piece, right]), np.concatenate([right, piece])):
            best = window_symbols(names, np.array([0, len(names)]))
            for i in range(len(names) - 12):
                assert seen.setdefault(names[i : i + 13].tobytes(), best[i]) == best[i]


def test_substring_dedup_repeats_and_nulls(spark):
    long = " ".join(f"t{i}" for i in range(30))
    rows = [(5, long, None, "x", 1), (5, long, None, "x", 1), (None, long, None, "x", 1), (9, "p " + long, None, "x", 1)]
    got = sorted(((r["doc_id"], r["n_removed"]) for r in substring_dedup(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(5, 30), (5, 30), (None, 0), (9, 30)], key=repr)
    assert substring_dedup(frame(spark, [])).count() == 0


# --- 4 packing -------------------------------------------------------------------------------


def test_packing_places_every_word_once(spark):
    rows = corpus(5) * 2
    out = pack(frame(spark, rows), capacities=(16, 32, 64), shard_chunks=50).toPandas()
    held = out[out["length"] > 0]
    assert held["length"].sum() == sum(len(words(r[1])) for r in rows)
    assert len(out[out["length"] == 0]) == sum(not words(r[1]) for r in rows)
    for _, b in held.groupby("bin_id"):
        b = b.sort_values("place")
        assert b["capacity"].nunique() == 1 and b["capacity"].iloc[0] in (16, 32, 64)
        assert b["length"].sum() <= b["capacity"].iloc[0]
        assert (b["place"].to_numpy() == np.concatenate([[0], b["length"].cumsum().to_numpy()[:-1]])).all()
        assert b["length"].sum() > {16: 0, 32: 16, 64: 32}[int(b["capacity"].iloc[0])]  # downsized
    for d, c in held.groupby("doc_id"):
        assert c["length"].sum() == 2 * len(words(rows[int(d)][1]))
    assert pack(frame(spark, [])).count() == 0
    assert pack(frame(spark, [(None, "a b", None, None, None)])).first()["doc_id"] is None


def test_packing_costs_no_more_than_one_length():
    lengths = np.random.default_rng(0).integers(1, 65, 500)
    of, _, cap = pack_shard(lengths, (16, 32, 64), 2)
    joint = sum({b: c + 2 for b, c in zip(of, cap, strict=True)}.values())
    of, _, cap = pack_shard(lengths, (64,), 2)
    assert joint <= sum({b: c + 2 for b, c in zip(of, cap, strict=True)}.values())
    assert joint <= 1.06 * (lengths.sum() + 2 * lengths.sum() / 64)


# --- 5 top-k ---------------------------------------------------------------------------------


def test_topk_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, -1.5, 0.25, 3.7, 1e-3]) for _ in range(rng.choice([3, 5]))], "x") for i in range(130)]
    rows += [(150, None, "x"), (200, [None, 1.0], "x"), (250, [float("nan")], "x"), (300, [float("inf")], "x"), (350, [], "x"), (None, [1.0], "x"), (7, rows[7][1], "x"), (50, rows[50][1], "x")]
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), 5, 50).collect())
    import math

    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in ok if i % 50 == 0}.items():
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)
        want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:5])]
    assert got == sorted(want)


def test_topk_large_components_and_few_rows(spark):
    df = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, -3.0]), (2, [1e15, 2.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in top_k(df).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, 2**63 - 1)]
    assert top_k(df.limit(0)).count() == 0 and top_k(df.where("vec_id = 0")).count() == 0


def topk_brute(rows, k=5, every=50):
    """By Python integers; rows without repeated ids."""
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows]
    out = []
    for q, a in v:
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in v if i != q)[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_topk_neither_shuffles_nor_broadcasts_blocks(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "vec_id long, embedding array<double>")
    plan = top_k(df)._jdf.queryExecution().executedPlan().toString()
    # queries x candidates bytes were shuffled before; now only the tasks' selections are
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(query_id" in plan


@pytest.mark.parametrize("shape", ["dense", "sparse", "ties", "wide", "huge"])
def test_topk_many_blocks_and_tiles(spark, monkeypatch, shape):
    from timbre.llm import topk_search

    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", (1500, 1500 * 8))
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", (7, 56))
    monkeypatch.setattr(topk_search, "QUERIES_PER_TASK", 20)
    rng = random.Random(shape)
    one = {
        "dense": lambda: [rng.uniform(-1, 1) for _ in range(8)],
        "sparse": lambda: [rng.uniform(-1, 1) if rng.random() < 0.05 else 0.0 for _ in range(rng.choice([0, 3, 8]))],
        "ties": lambda: [0.5, -0.25] if rng.random() < 0.9 else [0.5, 0.25],
        "wide": lambda: [rng.uniform(-1e5, 1e5) for _ in range(rng.choice([2, 9000]) if rng.random() < 0.005 else 4)],
        "huge": lambda: [rng.uniform(-1, 1) * 10 ** rng.choice([0, 5]) for _ in range(4)],
    }[shape]
    rows = [(i, one()) for i in rng.sample(range(-4000, 4000), 2600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    assert sorted(tuple(r) for r in top_k(df).collect()) == topk_brute(rows)


def test_topk_kinds_of_sums_agree():
    from timbre.llm.topk_search import _Best, _score

    rng = np.random.default_rng(4)
    q, c = rng.integers(-50, 50, (30, 6)).astype(np.float64), rng.integers(-50, 50, (1300, 6)).astype(np.float64)
    q_ids, c_ids = np.arange(0, 60, 2), np.sort(rng.integers(0, 2000, 1300))  # some ids are repeated
    found = []
    for scale in (1.0, 2.0**8, 2.0**20, 2.0**23, 2.0**40):  # 32 bit floats, 64 bit floats, 64 bit integers, Python integers, held at the limits
        best = _Best(q_ids, 5)
        for a in range(0, 1300, 700):
            _score(best, q * scale, c_ids[a : a + 700], c[a : a + 700] * scale)
        found.append(sorted(zip(best.row.tolist(), (-best.score).tolist(), best.vec.tolist(), strict=True)))
    want = []
    for i, own in enumerate(q_ids.tolist()):
        want += sorted((i, -int(s), int(j)) for s, j in zip(c @ q[i], c_ids, strict=True) if j != own)[:5]
    for scale, got in zip((1, 2**16, 2**40, 2**46), found, strict=False):
        assert got == [(i, s * scale, j) for i, s, j in want]
    assert len(found[-1]) == len(want) and {s for _, s, _ in found[-1]} == {1 - 2**63}


# --- 6 mixing --------------------------------------------------------------------------------


def test_exponent_meets_target():
    shares = [0.6, 0.3, 0.07, 0.03]
    target = 0.9 * np.log(4)
    x = bisect_exponent(shares, target_entropy=target)
    assert abs(entropy(tempered(shares, x)) - target) < 1e-9
    x = bisect_exponent(shares, max_repeats=3.0)
    assert max(w / s for w, s in zip(tempered(shares, x), shares, strict=True)) == pytest.approx(3.0)
    assert bisect_exponent(shares, target_entropy=0.0) == 1.0 and bisect_exponent(shares, max_repeats=100.0) == 0.0


def test_mixing_meets_budgets(spark):
    rows = corpus(6, 300)
    out = mix_sources(frame(spark, rows), 0.99, block_docs=8).toPandas()
    total = sum(len(words(r[1])) for r in rows)
    longest = max(len(words(r[1])) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(words(r[1]))
    for source, size in sizes.items():
        own = out[out["source"].isna() if source is None else out["source"] == source]
        budget = own["mix_weight"].iloc[0] * total
        assert budget - 1 <= own["mix_tokens"].sum() < budget + longest + 1
        whole = int(budget // size)
        counts = own.groupby("doc_id").size()
        assert counts.max() <= whole + 1
        assert (own[own["mix_epoch"] < whole].groupby("mix_epoch").size() == sum(r[2] == source for r in rows)).all()
    assert mix_sources(frame(spark, [])).count() == 0
    assert mix_sources(frame(spark, [(1, None, None, None, None)] * 2)).count() == 2


# --- 7 near dedup ----------------------------------------------------------------------------


def brute_near(rows, size, percent):
    sets = {}
    for d, t, *_ in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


@pytest.mark.parametrize("seed,size", [(7, 2), (8, 5)])
def test_near_duplicates(spark, seed, size):
    rows = corpus(seed, 120)
    got = sorted(tuple(r) for r in near_duplicates(frame(spark, rows), size, 80).collect())
    assert got == brute_near(rows, size, 80)


def test_near_duplicates_in_one_large_chain(spark):
    """Texts that drift by one word each: neighbours link, the ends do not, and all are one component."""
    base = [f"a{i}" for i in range(60)]
    rows = []
    for i in range(40):
        base = [*base[1:], f"b{i}"]
        rows.append((i, " ".join(base), None, None, None))
    got = sorted(tuple(r) for r in near_duplicates(frame(spark, rows), 2, 80).collect())
    assert got == brute_near(rows, 2, 80) and {r[2] for r in got} == {0}


def test_near_duplicates_in_blocks_with_refuted_candidates(spark, monkeypatch):
    """A crowd of variants around a few originals, compared in blocks of five, with an overlap bound that lets every candidate through."""
    from timbre.llm import minhash_dedup

    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(300)]
    rows = []
    for g in range(3):
        base = [rng.choice(vocab) for _ in range(60)]
        for _ in range(30):
            w = list(base)
            for _ in range(rng.choice([1, 3, 5, 7])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w), "s", "", 0))
    want = brute_near(rows, 2, 80)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 5)
    found = minhash_dedup.NearDuplicates(frame(spark, rows), 2, 80)
    found.bound = 60
    assert sorted((r.doc_id, r.component_id) for r in found.components().collect()) == [(d, c) for d, _, c, _ in want]


def test_near_duplicates_edges(spark):
    rows = [(3, "a b c", None, None, None), (3, "a b c", None, None, None), (None, "a b c", None, None, None), (4, None, None, None, None), (4, "", None, None, None), (3, "z y x", None, None, None)]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(frame(spark, rows), 2, 80).collect()), key=repr)
    assert got == sorted([(3, 3, True), (3, 3, True), (3, 3, True), (None, 3, False), (4, 4, True), (4, 4, True)], key=repr)
    assert near_duplicates(frame(spark, [])).count() == 0


def test_posterior_bound():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 32, (2000, 128), dtype=np.uint32)
    b = np.where(rng.random((2000, 128)) < 0.8, a, a + np.uint32(1))
    assert len(bayes_survivors(a, b, 0.8, 1e-7)) == 2000
    c = np.where(rng.random((2000, 128)) < 0.3, a, a + np.uint32(1))
    assert len(bayes_survivors(a, c, 0.8, 1e-7)) < 5
    assert [least_matches(n, 0.8, 1e-7) for n in (1, 16)] == sorted(least_matches(n, 0.8, 1e-7) for n in (1, 16))


# --- 8 exact dedup ---------------------------------------------------------------------------


@pytest.mark.parametrize("block", [4096, 7, 1])
def test_exact_dedup(spark, block):
    rows = [r for r in corpus(9, 50) if block > 1 or len(r[1] or "") < 200] + [(200, "AbC", None, None, None), (201, "aBc", None, None, None), (202, "É", None, None, None), (203, "é", None, None, None), (204, "ab" * 40, None, None, None), (205, "AB" * 40, None, None, None)]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(low(t), []).append(d)
    want = sorted((d, max(groups[low(t)]), len(groups[low(t)]), d == max(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for d, t, *_ in rows)
    assert sorted(tuple(r) for r in exact_dedup(frame(spark, rows), block).collect()) == want


def test_exact_dedup_where_all_blocks_share_a_hash(spark, monkeypatch):
    from timbre.llm import exact_dedup as module

    monkeypatch.setattr(module, "block_hash", lambda block: F.lit(7).cast("long"))
    rows = [(i, ("abc" if i % 2 else "abd") * 5, None, None, None) for i in range(400)]
    got = exact_dedup(frame(spark, rows), 8).groupBy("keep_id", "group_size").count().collect()
    assert sorted(tuple(r) for r in got) == [(398, 200, 200), (399, 200, 200)]


def test_exact_dedup_edges(spark):
    rows = [(1, "a" * 9, None, None, None), (1, "a" * 9, None, None, None), (1, "b" * 9, None, None, None), (None, "B" * 9, None, None, None), (None, None, None, None, None)]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(frame(spark, rows), 2).collect()), key=repr)
    assert got == sorted([(1, 1, 2, True), (1, 1, 2, True), (1, 1, 2, True), (None, 1, 2, False), (None, None, 1, True)], key=repr)
    assert exact_dedup(frame(spark, [])).count() == 0


# --- 9 line dedup ----------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    p = next((i for i in range(n) if a[i] != b[i]), n)
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def brute_lines(rows, least):
    held = [(d, i, x) for d, t, *_ in rows if t is not None for i, x in enumerate(t.split("\n"))]
    gone = set()
    for k, (d, i, x) in enumerate(held):
        if words(x) and any(x == y or (len(x) >= least and len(y) >= least and one_edit(x, y)) for _, _, y in held[:k]):
            gone.add((d, i))
    out = []
    for d, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        left = None if t is None else "\n".join(x for i, x in enumerate(lines) if (d, i) not in gone)
        out.append((d, left, len(lines), sum((d, i) in gone for i in range(len(lines)))))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    lines = ["".join(rng.choice("ab é") for _ in range(rng.choice([3, 8, 9, 20]))) for _ in range(30)]
    for _ in range(60):
        x, i = rng.choice(lines), rng.randrange(9)
        lines.append(rng.choice([x[:i] + x[i + 1 :], x[:i] + "c" + x[i:], x[:i] + "d" + x[i + 1 :], x, "", "  "]))
    rows = [(d, None if d == 5 else "\n".join(rng.choice(lines) for _ in range(rng.randrange(6))), None, "clash", d) for d in range(30)]
    df = frame(spark, rows).withColumnRenamed("n", "n_lines")
    got = line_dedup(df, min_chars=8)
    assert got.columns == ["doc_id", "text", "source", "kept", "n_lines", "n_removed"]
    assert sorted(tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()) == brute_lines(rows, 8)


def test_near_lines_of_a_megabyte(spark):
    """Long single lines that differ by one edit, wherever it lies, and others that share all but two edits."""
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1 << 20))
    at = 700_000
    texts = [base, base[:at] + "X" + base[at + 1 :], base[: at + 5] + base[at + 6 :], base + "y", "z" + base, base[:9] + "QQ" + base[11:], base[:300], base[:150] + "!" + base[150:300], "short"]
    got = {r.doc_id: r.n_removed for r in line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 1, 8: 0}


def test_line_dedup_edges(spark):
    rows = [(1, "hello there\nhello there", None, None, None), (1, "hello there\nhello there", None, None, None), (None, "hello there", None, None, None)]
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, ""), (1, ""), (None, "hello there")], key=repr)
    assert line_dedup(frame(spark, [])).count() == 0


# --- 10 licences -----------------------------------------------------------------------------


def test_license_scan(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License.", "c"), ("a/x/y/code", "int main;", "c"), ("a/x/own", "some words here\nLicensed under the Apache License, Version 2.0.\nmore of them", "c"), ("b/code", "print", "c"),
        ("a/x/none", None, "c"), (None, "All rights reserved.", "c"), ("top", "", "c"), ("a/x/none", None, "c"), ("long", "word " * 3000 + "\nreleased UNDER the  MIT license\n" + "word " * 3000, "c"), ("near", "The license of this dog is under the table", "c"),
    ]
    df = spark.createDataFrame(files, "path string, text string, license string")
    got = sorted(((r["path"], r["license"], r["how"], r["from_dir"]) for r in license_scan(df).collect()), key=repr)
    want = [
        ("a/LICENSE", "MIT", "file", None), ("a/x/y/code", "MIT", "inherited", "a"), ("a/x/own", "Apache-2.0", "header", None), ("b/code", None, None, None), ("a/x/none", "MIT", "inherited", "a"),
        (None, "Proprietary", "file", None), ("top", None, None, None), ("a/x/none", "MIT", "inherited", "a"), ("long", "MIT", "header", None), ("near", None, None, None),
    ]
    assert got == sorted(want, key=repr)
    assert license_scan(df.limit(0)).count() == 0


def test_full_license_texts_speak_for_their_directories(spark):
    texts = standard_templates()
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"]
    files = [(f"{n}/LICENSE", "Copyright (c) 2020 A. Writer <a@writer.org>\n\n" + texts[n][-1]) for n in names] + [(f"{n}/src/deep/code.c", "int main;") for n in names]
    files += [("prose/COPYING", "the work of the writer and the copy of the license " * 300), ("prose/code.c", "int main;")]
    got = {r["path"]: (r["license"], r["how"], r["from_dir"]) for r in license_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    want = {f"{n}/LICENSE": (n, "file", None) for n in names} | {f"{n}/src/deep/code.c": (n, "inherited", n) for n in names}
    assert got == want | {"prose/COPYING": (None, None, None), "prose/code.c": (None, None, None)}


def test_license_notices_over_several_lines_are_found_anywhere(spark):
    gpl = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
    mit = "\n".join("# " + x for x in standard_templates()["MIT"][-1].splitlines())
    code = "\n".join(f"import module{i}.part{i} as name{i}" for i in range(30))
    files = [("top.c", f"/*\n{gpl}\n */\n{code}"), ("deep.c", f"{code}\n/*\n{gpl}\n */\n{code}"), ("mit.py", f"{code}\n{mit}\n{code}"), ("none.py", code)]
    got = {r["path"]: (r["license"], r["how"]) for r in license_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"top.c": ("GPL-3.0", "header"), "deep.c": ("GPL-3.0", "header"), "mit.py": ("MIT", "header"), "none.py": (None, None)}


def test_license_runs_are_the_best_of_all_runs():
    rng, texts = random.Random(5), {"A": ["alpha beta gamma delta"], "B": ["one two three two one", "beta one"], "C": ["gamma gamma delta " * 9]}
    idf = np.random.default_rng(5).uniform(1, 4, SLOTS)
    matcher = _Matcher(9, 10 / np.exp(idf - 1) - 1, texts)
    for sizes in [[1, 3, 9]] * 150 + [[120]] * 2:
        lines = [" ".join(rng.choice("alpha beta gamma delta one two three other more".split()) for _ in range(rng.choice([0, 1, 2, 4]))) for _ in range(rng.choice(sizes))]
        terms, _, line = _terms(pa.array(["\n".join(lines)]))
        want = [0.0, 0.0]
        at = [terms[line == i] for i in range(len(lines))]
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                uniq, n = np.unique(np.concatenate(at[i:j]), return_counts=True)
                x = dict(zip(uniq.tolist(), n * matcher.idf[_slot(uniq)], strict=True))
                norm = np.sqrt(sum(v * v for v in x.values()))
                cos = max((sum(x.get(t, 0) * v for t, v in zip(u.tolist(), w, strict=True)) / norm for u, w in matcher.vectors), default=0) if x else 0
                want[1] = max(want[1], cos)
                if (i, j) == (0, len(lines)):
                    want[0] = cos
        got = [0.0, 0.0]
        for _, able in matcher.near(terms, np.zeros(len(terms), np.int64), 1, 0.8):
            got = [v for _, v in matcher.runs(terms, line, able, 0.8)]
        want = [v if v >= 0.8 else 0 for v in want]
        assert np.allclose(got[:1] if want[0] else got, want[:1] if want[0] else want, atol=1e-9), (lines, got, want)


# --- the pipeline ----------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols = docs.columns
    counts = [docs.count()]
    for i, (name, stage) in enumerate(p.STAGES):
        out = p.materialize(stage(spark, docs, sf_dir))
        if i < len(p.STAGES) - 1:
            assert out.columns == cols, name
        counts.append(out.count())
        docs = out
    assert counts[1] <= counts[0] and counts[2] <= counts[1] and counts[3] <= counts[2]
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1")
    assert p.run(spark, sf_dir).join(toxic, "doc_id", "left_semi").count() == 0


def test_frames_of_other_order(spark):
    """Results do not hang on how rows are dealt to tasks."""
    rows = corpus(11)
    a, b = (near_duplicates(frame(spark, rows).repartition(n), 2, 80).orderBy("doc_id").collect() for n in (1, 9))
    assert a == b
    a, b = (mix_sources(frame(spark, rows).repartition(n)).orderBy(F.col("doc_id"), "mix_epoch").select("doc_id", "mix_epoch").collect() for n in (1, 9))
    assert a == b
