"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another.  Each category's logistic model
reads hashed word and word-beginning features and the probabilities of the
categories before it; in training those are out-of-fold predictions, so that a
later model sees earlier probabilities as good, or as bad, as it will meet them.

Models are fitted on a bounded sample of labelled rows (``train_rows``, those
least by a hash of the id), in one task of an executor; the driver gets the
finished models only.  Every document is scored, over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, split_words

TRAIN_ROWS = 6000
FOLDS = 4
KEEP_FEATURES = 3000
#: (document, feature) pairs that the fit looks at together; its temporary arrays are of that length.
PAIRS_AT_ONCE = 1 << 20
_STRIP = ".,;:!?\"'()[]{}<>|*_-«»¿¡…"


def _features_of(word: str) -> list[int]:
    """Hashed: the word without outer punctuation, and its first 4, 5 and 6 characters."""
    w = word.strip(_STRIP)
    if not w:
        return []
    return [xxhash.xxh3_64_intdigest("w" + w) >> 1] + [xxhash.xxh3_64_intdigest(f"p{k}" + w[:k]) >> 1 for k in (4, 5, 6) if len(w) >= k]


def feature_lists(texts: pa.Array, known: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, distinct, of the texts; with ``known`` only its features, by their index there."""
    words, offsets = split_words(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = words.dictionary_encode()
    per_word = [_features_of(w) for w in coded.dictionary.to_pylist()]
    if known is not None:
        per_word = [[known[f] for f in fs if f in known] for fs in per_word]
    sizes = np.array([len(fs) for fs in per_word], np.int64)
    flat = np.array([f for fs in per_word for f in fs], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    hit = sizes[index] > 0 if len(index) else np.zeros(0, bool)
    index, doc = index[hit], doc[hit]
    # a word counts once for each document
    order = np.lexsort((index, doc))
    index, doc = index[order], doc[order]
    new = np.ones(len(index), bool)
    new[1:] = (index[1:] != index[:-1]) | (doc[1:] != doc[:-1])
    index, doc = index[new], doc[new]
    n = sizes[index]
    at = np.repeat(starts[index] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
    doc, feature = np.repeat(doc, n), flat[at] if len(at) else np.zeros(0, np.int64)
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    return doc[new], feature[new]


@dataclass
class Linear:
    """One category: weights by feature, then one for each earlier category, then the bias."""

    name: str
    weights: dict[int, float]
    earlier: list[float]
    bias: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _fit(doc: np.ndarray, feature: np.ndarray, n_features: int, extra: np.ndarray, y: np.ndarray, rows: np.ndarray, keep: int, l2: float = 1e-3, rounds: int = 200):
    """Logistic regression on ``rows``: the ``keep`` features of the largest chi-square, by accelerated gradient steps."""
    inside = np.zeros(len(y), bool)
    inside[rows] = True
    n, pos = len(rows), y[rows].sum()
    total, hits = np.zeros(n_features), np.zeros(n_features)
    # counts are whole numbers, so their sums do not depend on the parts
    step = max(PAIRS_AT_ONCE, n_features)
    parts = [slice(i, i + step) for i in range(0, len(doc), step)]
    for part in parts:
        use = inside[doc[part]]
        d, f = doc[part][use], feature[part][use]
        total += np.bincount(f, minlength=n_features)
        hits += np.bincount(f, weights=y[d], minlength=n_features)
    expect = total * pos / max(n, 1)
    chi = np.where(total >= 2, (hits - expect) ** 2 / np.maximum(expect * (1 - total / max(n, 1)), 1e-9), 0)
    chosen = np.argsort(-chi, kind="stable")[:keep]
    chosen = chosen[chi[chosen] > 3.8]
    new = np.full(n_features, -1)
    new[chosen] = np.arange(len(chosen))
    row = np.full(len(y), -1)
    row[rows] = np.arange(n)
    held = []
    for part in parts:
        f = new[feature[part]]
        use = (f >= 0) & inside[doc[part]]
        held.append((row[doc[part][use]], f[use]))
    d, f = (np.concatenate([h[i] for h in held] or [np.zeros(0, np.int64)]) for i in (0, 1))
    x, t, m = extra[rows], y[rows], len(chosen)
    theta = np.zeros(m + x.shape[1] + 1)
    rate = pos / max(n, 1)
    theta[-1] = np.log((rate + 1e-3) / (1 - rate + 1e-3))
    # Adam copes with the very different frequencies of the features
    a, b = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = np.bincount(d, weights=theta[f], minlength=n) + x @ theta[m:-1] + theta[-1]
        g = (_sigmoid(z) - t) / max(n, 1)
        grad = np.concatenate([np.bincount(f, weights=g[d], minlength=m), x.T @ g, [g.sum()]])
        grad[:-1] += l2 * theta[:-1] / max(n, 1)
        a, b = 0.9 * a + 0.1 * grad, 0.99 * b + 0.01 * grad**2
        theta -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
    return chosen, theta[:m], theta[m:-1], theta[-1]


def _predict(doc, feature, n_features, extra, n, model) -> np.ndarray:
    chosen, w, e, bias = model
    full, taken = np.zeros(n_features), np.zeros(n_features, bool)
    full[chosen], taken[chosen] = w, True
    hit = taken[feature]
    return _sigmoid(np.bincount(doc[hit], weights=full[feature[hit]], minlength=n) + extra @ e + bias)


def fit_chain(doc: np.ndarray, feature: np.ndarray, labels: dict[str, np.ndarray], folds: int = FOLDS, keep: int = KEEP_FEATURES, names: np.ndarray | None = None) -> list[Linear]:
    """Models of the categories in ``labels`` (0/1 arrays), in that order, from (document, feature) pairs; with ``names``, sorted, ``feature`` holds places in it."""
    n = len(next(iter(labels.values())))
    if names is None:
        names, feature = np.unique(feature, return_inverse=True)
    fold = np.arange(n) % folds
    extra, out = np.zeros((n, 0)), []
    for name, y in labels.items():
        y = y.astype(float)
        unseen = np.zeros(n)
        for k in range(folds):
            rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            unseen[own] = _predict(doc, feature, len(names), extra, n, _fit(doc, feature, len(names), extra, y, rest, keep))[own]
        chosen, w, e, bias = _fit(doc, feature, len(names), extra, y, np.arange(n), keep)
        out.append(Linear(name, {int(names[i]): float(v) for i, v in zip(chosen, w, strict=True)}, [float(v) for v in e], float(bias)))
        extra = np.column_stack([extra, unseen])
    return out


def labelled(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int) -> DataFrame:
    """(doc_id, y_0.., text): at most ``rows`` labelled documents, those least by a hash of the id; of rows that repeat a doc_id one text, the least by its hash."""
    cols = [F.coalesce(e, F.lit(0)).cast("int").alias(f"y_{i}") for i, e in enumerate(categories.values())]
    sample = labels.where(F.col("doc_id").isNotNull()).select("doc_id", *cols).orderBy(F.xxhash64("doc_id"), "doc_id", *(f"y_{i}" for i in range(len(cols)))).limit(rows)
    # at most ``rows`` short rows: a bounded broadcast, so the documents are only scanned
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return texts.join(F.broadcast(sample), "doc_id")


def gathered(batches: Iterator[pa.RecordBatch], n_labels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (doc_id, y_0.., features) of all batches, by id and labels: (rows, ``n_labels``) labels; document and feature of each pair, the latter as a place in the last array, the sorted features.

    A pair takes 8 bytes; the features themselves are held once for each batch.
    """
    keys, sizes, parts = [], [], []
    for batch in batches:
        lists = batch.column("features")
        known, code = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        parts.append((known, code.astype(np.int32)))
        sizes.append(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        keys.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(n_labels + 1)], axis=1))
    if not keys:
        return np.zeros((0, n_labels), np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
    keys, sizes = np.concatenate(keys), np.concatenate(sizes)
    names = np.unique(np.concatenate([known for known, _ in parts]))
    codes = np.concatenate([np.searchsorted(names, known).astype(np.int32)[code] for known, code in parts])
    del parts
    order = np.lexsort(keys.T[::-1])
    ends = np.cumsum(sizes)
    feature = np.concatenate([codes[ends[i] - sizes[i] : ends[i]] for i in order])
    return keys[order, 1:], np.repeat(np.arange(len(order), dtype=np.int32), sizes[order]), feature, names


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int = TRAIN_ROWS) -> list[Linear]:
    """Fit the chain on at most ``rows`` labelled documents; ``categories`` maps names to 0/1 expressions over ``labels``.

    Features are taken in many tasks and fitted in one; what comes to the driver is at most ``KEEP_FEATURES`` weights for each category.
    """
    held = labelled(docs, labels, categories, rows)
    names = [f"y_{i}" for i in range(len(categories))]
    schema = pa.schema([pa.field("doc_id", pa.int64()), *(pa.field(c, pa.int32()) for c in names), pa.field("features", pa.list_(pa.int64()))])
    model = pa.schema([pa.field("place", pa.int32()), pa.field("features", pa.list_(pa.int64())), pa.field("weights", pa.list_(pa.float64())), pa.field("earlier", pa.list_(pa.float64())), pa.field("bias", pa.float64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                doc, feature = feature_lists(batch.column("text")[a:b])
                at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(feature))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b].cast(pa.int64()), *(batch.column(c)[a:b] for c in names), lists], schema=schema)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, doc, feature, known = gathered(batches, len(names))
        if len(ys):
            chain = fit_chain(doc, feature, {c: ys[:, i] for i, c in enumerate(names)}, names=known)
            columns = [range(len(chain)), [list(m.weights) for m in chain], [list(m.weights.values()) for m in chain], [m.earlier for m in chain], [m.bias for m in chain]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, model, strict=True)], schema=model)

    got = held.select("doc_id", *names, "text").mapInArrow(extract, f"doc_id long, {', '.join(f'{c} int' for c in names)}, features array<long>")
    fitted = sorted(got.repartition(1).mapInArrow(fit, "place int, features array<long>, weights array<double>, earlier array<double>, bias double").collect(), key=lambda r: r["place"])
    if not fitted:
        return [Linear(c, {}, [0.0] * i, -10.0) for i, c in enumerate(categories)]
    return [Linear(c, dict(zip(r["features"], r["weights"], strict=True)), r["earlier"], r["bias"]) for c, r in zip(categories, fitted, strict=True)]


def score_texts(texts: pa.Array, chain: list[Linear], known: dict[int, int], weights: np.ndarray) -> np.ndarray:
    """(texts, categories) probabilities."""
    doc, feature = feature_lists(texts, known)
    out = np.zeros((len(texts), len(chain)))
    for i, model in enumerate(chain):
        z = np.bincount(doc, weights=weights[i][feature], minlength=len(texts)) + model.bias
        out[:, i] = _sigmoid(z + out[:, :i] @ np.array(model.earlier)) if i else _sigmoid(z)
    return out


def score(docs: DataFrame, chain: list[Linear]) -> DataFrame:
    """``docs`` with a column p_<category> for each category of the chain; a null text has no features.

    Columns of ``docs`` that have such a name are replaced.
    """
    names = [f"p_{m.name}" for m in chain]
    known = {f: i for i, f in enumerate(sorted({f for m in chain for f in m.weights}))}
    weights = np.zeros((len(chain), max(len(known), 1)))
    for i, m in enumerate(chain):
        for f, w in m.weights.items():
            weights[i, known[f]] = w

    rest = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    kinds = docs.select(*(F.col(f"`{c}`") for c in rest)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                p = score_texts(batch.column("text")[a:b], chain, known, weights)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(p[:, i]) for i in range(len(names)))], names=[*part.schema.names, *names])

    out = kinds
    for n in names:
        out = out.add(n, "double")
    return docs.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, out)


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, reject: str = "toxic", threshold: float = 0.5, rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs(doc_id, text, ...)`` with p_<category> columns and ``rejected``.

    The default chain predicts first "junk" (labels.quality = 0), then "toxic"
    (labels.toxic = 1).  Labels that are null count as 0; repeated labelled rows count each.
    Without labels nothing is rejected.  Every row of ``docs`` comes back, repeated ones too.
    """
    if categories is None:
        categories = {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}
    bounded_batches(docs.sparkSession)
    scored = score(docs.drop("rejected"), train(docs, labels, categories, rows))
    return scored.withColumn("rejected", F.col(f"p_{reject}") >= threshold)
