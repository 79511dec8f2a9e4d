"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates and queries are packed into blocks of bounded size where they are
read, and both sets of blocks lie in the shared folder.  A task holds some files of
candidate blocks against some files of query blocks (a Cartesian product of the
files, so no block is shuffled or broadcast).  For each pair of blocks the postings
(term -> candidate positions and weights) are scattered into a dense score array of
queries x candidates; each query's best scores of the array are selected by
partition and merged with those that the task has found before, and the tasks'
selections are merged.  Postings that few candidates hold are scattered one term at a time; those
that many hold are filled up with zeros and scattered together, as one product of weights and postings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize

#: Rows, and rows x terms, that a block holds; a single longer vector is a block alone.
CANDIDATE_BLOCK = (16384, 1 << 21)
QUERY_BLOCK = (4096, 1 << 19)
#: Candidate blocks and queries that a task holds against each other: fewer tasks find fewer selections to merge.
BLOCKS_PER_TASK = 24
QUERIES_PER_TASK = 1 << 16
#: Queries and candidates of one score array, which fits a core's cache.
TILE = (256, 1024)
#: A posting that a smaller part of the block's candidates holds is scattered by itself.
DENSE_SHARE = 0.125
#: Sums of products below these are exact in the type; beyond them blocks are scored with Python integers.
_KINDS = ((float(1 << 24), np.float32), (float(1 << 53), np.float64), (float(1 << 62), np.int64))
_BLOCK = "ids binary, sizes binary, weights binary"


def _pack(most_rows: int, most_terms: int):
    def block(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """Ids in order, each vector's length and all weights one vector after the other, in 16 bits where they fit."""
        ids, sizes, weights = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(ids, kind="stable")
        starts = np.cumsum(sizes) - sizes
        at = np.repeat(starts[order] - (np.cumsum(sizes[order]) - sizes[order]), sizes[order]) + np.arange(len(weights))
        weights = weights[at]
        if not len(weights) or np.abs(weights).max() < 1 << 15:
            weights = weights.astype(np.int16)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids[order], sizes[order], weights)], names=["ids", "sizes", "weights"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = widest = 0
        for batch in batches:
            ids, terms = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("terms")
            ends = terms.offsets.to_numpy().astype(np.int64)
            weights, ends = terms.flatten().to_numpy(zero_copy_only=False), ends - ends[0]
            sizes, start = np.diff(ends), 0
            for i, size in enumerate(sizes.tolist()):
                if n and (n == most_rows or (n + 1) * max(widest, size) > most_terms):
                    if start < i:
                        held.append((ids[start:i], sizes[start:i], weights[ends[start] : ends[i]]))
                    yield block(held)
                    held, n, widest, start = [], 0, 0, i
                n, widest = n + 1, max(widest, size)
            held.append((ids[start:], sizes[start:], weights[ends[start] :]))
        if n:
            yield block(held)

    return pack


def _unpack(ids: bytes, sizes: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and a row of weights for each; a shorter vector ends in zeros."""
    found, lengths = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
    flat = np.frombuffer(weights, np.int16 if len(weights) == 2 * lengths.sum() else np.float64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return found, flat.reshape(len(found), width)
    rows = np.zeros((len(found), width), flat.dtype)
    rows[np.arange(width) < lengths[:, None]] = flat
    return found, rows


def _norm(rows: np.ndarray) -> float:
    """The largest Euclidean norm, 1 at least: no partial sum of products passes the product of two norms."""
    with np.errstate(over="ignore"):
        return max(1.0, float(np.sqrt(np.square(rows, dtype=np.float64).sum(axis=1).max(initial=0.0))))


def _as(rows: np.ndarray, kind) -> np.ndarray:
    if kind is object:
        return np.array([int(x) for x in rows.ravel()], object).reshape(rows.shape)
    return rows.astype(kind)


class _Best:
    """The best candidates of a block's queries so far: (row, score, vec_id), at most ``k`` of a row, ordered."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.row, self.score, self.vec = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.zeros(len(ids), np.int64)  # the k-th best score, of rows that have k
        self.full = np.zeros(len(ids), bool)

    def merge(self, row: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        touched = np.zeros(len(self.ids), bool)
        touched[row] = True
        old = touched[self.row]
        r, s, v = (np.concatenate(x) for x in ((self.row[old], row), (self.score[old], score), (self.vec[old], vec)))
        order = np.lexsort((v, ~s, r))  # ~s turns the order round without overflow
        r, s, v = r[order], s[order], v[order]
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        place = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
        last = place == self.k - 1
        self.least[r[last]], self.full[r[last]] = s[last], True
        kept = place < self.k
        self.row, self.score, self.vec = (np.concatenate([x[~old], y[kept]]) for x, y in ((self.row, r), (self.score, s), (self.vec, v)))


def _select(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positions of scores that may be among the best: ``least`` of their row or more, and of many only the ``k`` best, ties to smaller positions."""
    alive = np.flatnonzero(scores.max(axis=1) >= least)
    held = scores[alive]
    fit = held >= least[alive, None]
    many = np.flatnonzero(fit.sum(axis=1) > 4 * k)
    if len(many):
        s = held[many]
        cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
        ties = s == cut
        fit[many] &= (s > cut) | (ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= k))
    row, at = np.nonzero(fit)
    return alive[row], at


def _select_object(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    found = [(i, j) for i, s in enumerate(scores) for j in sorted(np.flatnonzero(~own[i]).tolist(), key=lambda j: (-s[j], j))[:k]]
    return tuple(np.array(found, np.int64).reshape(-1, 2).T)


def _score(best: _Best, q_rows: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray) -> None:
    """Score all pairs of two blocks, and merge each query's best."""
    bound = _norm(q_rows) * _norm(c_rows) * (1 + 1e-9)
    kind = next((kind for most, kind in _KINDS if bound < most), object)
    lowest = {np.float32: -np.inf, np.float64: -np.inf, np.int64: np.iinfo(np.int64).min}.get(kind)
    floor = {np.float32: np.finfo(np.float32).min, np.float64: np.finfo(np.float64).min, np.int64: np.iinfo(np.int64).min + 1}.get(kind)
    width = min(q_rows.shape[1], c_rows.shape[1])
    q_rows, postings = _as(q_rows[:, :width], kind), _as(np.ascontiguousarray(c_rows[:, :width].T), kind)
    many = np.count_nonzero(postings, axis=1) >= DENSE_SHARE * len(c_ids)
    few = np.flatnonzero(~many)
    q_many = np.ascontiguousarray(q_rows[:, many])
    room = np.empty(TILE[0] * TILE[1], kind)  # one for all arrays: fresh memory costs more than the sums
    for c in range(0, len(c_ids), TILE[1]):
        ids = c_ids[c : c + TILE[1]]
        dense = np.ascontiguousarray(postings[many, c : c + TILE[1]])
        sparse = [(t, at, postings[t, c + at]) for t in few if len(at := np.flatnonzero(postings[t, c : c + TILE[1]]))]
        found = []
        for q in range(0, len(q_rows), TILE[0]):
            own = best.ids[q : q + TILE[0]]
            scores = room[: len(own) * len(ids)].reshape(len(own), len(ids))
            if len(dense):
                np.matmul(q_many[q : q + TILE[0]], dense, out=scores)
            else:
                scores[:] = 0
            for t, at, weights in sparse:
                asked = np.flatnonzero(q_rows[q : q + TILE[0], t])
                scores[np.ix_(asked, at)] += np.multiply.outer(q_rows[q + asked, t], weights)
            if kind is object:
                row, at = _select_object(scores, own[:, None] == ids, best.k)
                score = np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in scores[row, at]], np.int64)
            else:
                first, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
                for i in np.flatnonzero(first < last):
                    scores[i, first[i] : last[i]] = lowest
                least = np.where(best.full[q : q + TILE[0]], best.least[q : q + TILE[0]].astype(kind), kind(floor))
                row, at = _select(scores, np.maximum(least, kind(floor)), best.k)
                score = scores[row, at].astype(np.int64)
            found.append((q + row, score, ids[at]))
        row, score, vec = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(row):
            best.merge(row, score, vec)


def _score_blocks(k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, _Best] = {}  # by the ids of a query block; no id is in two
        for batch in batches:
            for n in range(batch.num_rows):
                q, c = ([batch.column(f"{side}_{name}")[n].as_py() for name in ("ids", "sizes", "weights")] for side in "qc")
                q_ids, q_rows = _unpack(*q)
                _score(best.setdefault(q[0], _Best(q_ids, k)), q_rows, *_unpack(*c))
        for x in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(x.ids[x.row]), pa.array(x.vec), pa.array(x.score)], names=["query_id", "vec_id", "score"])

    return score


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products.

    ``vectors(vec_id, embedding, ...)``: component x counts as
    floor(scale * x).  Queries are the rows whose vec_id is divisible by
    ``query_every``; candidates are all rows but those with the query's own id;
    ties go to the smaller vec_id.  Vectors that are null or hold null or
    non-finite components take no part, nor do rows without vec_id; a shorter
    vector has no further terms.  Repeated rows each count as a candidate, and
    a repeated query id is asked once, with its largest vector.  Scores
    beyond 64 bits are held at the limits.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    x = F.col("embedding")
    fit = F.coalesce(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf"))), F.lit(False))
    # floor() would give a long; x - pmod keeps a double, exact at any size
    terms = F.transform(x, lambda v: (v.cast("double") * scale) - F.pmod(v.cast("double") * scale, F.lit(1.0)))
    rows = vectors.where(F.col("vec_id").isNotNull() & fit).select(F.col("vec_id").cast("long").alias("vec_id"), terms.alias("terms"))
    asked = materialize(rows.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.max("terms").alias("terms")))
    n_q = max(1, -(-asked.count() // QUERIES_PER_TASK))
    qs = materialize(asked.coalesce(n_q).mapInArrow(_pack(*QUERY_BLOCK), _BLOCK))
    discard(asked)
    cs = materialize(rows.mapInArrow(_pack(*CANDIDATE_BLOCK), _BLOCK))
    n_c = max(2 * spark.sparkContext.defaultParallelism, -(-cs.count() // BLOCKS_PER_TASK))
    q = qs.coalesce(n_q).select(*(F.col(x).alias(f"q_{x}") for x in qs.columns))
    c = cs.coalesce(n_c).select(*(F.col(x).alias(f"c_{x}") for x in cs.columns))
    pairs = c.crossJoin(q.hint("shuffle_replicate_nl"))
    found = pairs.mapInArrow(_score_blocks(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
