"""Substring dedup by recompression.

A text's words are named by 64-bit values, then rounds of recompression name
maximal runs of one word, and pairs of neighbours whose names fall on opposite
sides of a partition of all names (one bit of the name).  Names and sides are
functions of content alone, the same in every task, so equal substrings get
equal symbols inside, away from their ends.  Each symbol carries the stretch of
words on which its formation depends; a window that holds the whole stretch
holds the symbol, wherever the window occurs.

1. Every window chooses one symbol among those it wholly determines, by a rule
   that depends on nothing else: equal windows choose equal symbols.  Runs of
   windows with one choice become one row (symbol, document).
2. Rows meet by symbol and reveal those that documents share.  Each task first
   compares the rows it holds: of a symbol that it sees in several documents,
   one row goes on to meet the other tasks' rows, and the rest are settled.  So a
   symbol of a third of all documents sends as many rows as there are tasks.  Exact copies are
   found on the same way, by whole-document names.
3. Only windows whose symbol is shared are verified: by 128-bit values of their
   whole word sequence, each half from its own half of the words' 128-bit digests, in the same two steps,
   against the smallest document of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, mix, odd_keys, row_key, slices, split_words, word_names

WINDOW = 13
ROUNDS = 3
_TOP = np.uint64(1 << 63)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _runs(name, lo, hi, doc):
    """Name maximal runs of equal words; a run's stretch takes in the words beside it, which bound it."""
    n = len(name)
    new = np.ones(n, bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new).astype(np.int32)
    end = np.append(at[1:], np.int32(n))
    size, named, d = end - at, name[at], doc[at]
    long = np.flatnonzero(size > 1)
    named[long] = mix(named[long] ^ (size[long].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    # -1: nothing bounds the run on one side (a document's edge), so no window determines it
    bounded = np.zeros(len(at), bool)
    bounded[1:-1] = (d[1:-1] == d[:-2]) & (d[1:-1] == d[2:])
    return named, np.where(bounded, at - 1, -1), np.where(bounded, end + 1, -1), d


def _pairs(name, lo, hi, doc, round_no):
    """Name neighbours (left side, right side); what stays alone depends on the neighbour that it did not merge with."""
    n = len(name)
    if n < 2:
        return name, np.full(n, -1, np.int32), np.full(n, -1, np.int32), doc
    side = ((name * np.uint64(0xC2B2AE3D27D4EB4F + 2 * round_no)) >> np.uint64(63)).astype(bool)  # True: right side
    joined = doc[1:] == doc[:-1]  # of each gap: both sides in one document
    merge = joined & ~side[:-1] & side[1:]
    keep = np.ones(n, bool)
    keep[1:] = ~merge
    # the neighbour that decides: to the right for left-side symbols, to the left for right-side ones
    known = np.zeros(n, bool)
    known[:-1] = ~side[:-1] & joined
    known[1:] |= side[1:] & joined
    at = np.flatnonzero(keep)
    other = np.clip(np.where(side[at], at - 1, at + 1), 0, n - 1)
    known = known[at] & (lo[at] >= 0) & (lo[other] >= 0)
    named = name[at]
    pair = np.flatnonzero(np.append(merge, False)[at])
    named[pair] = mix(named[pair] * np.uint64(0xD6E8FEB86659FD93) + name[other[pair]])
    return named, np.where(known, np.minimum(lo[at], lo[other]), -1), np.where(known, np.maximum(hi[at], hi[other]), -1), doc[at]


_BASE = np.uint64(0xA0761D6478BD642F)
_INVERSE = np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))


def _stretches(names: np.ndarray):
    """Value of the words from lo to hi, for arrays of bounds: differences of prefix sums, moved to a common origin."""
    n = len(names)
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(names * up, dtype=np.uint64)])
    return lambda lo, hi: (sums[hi] - sums[lo]) * down[lo]


def window_symbols(names: np.ndarray, offsets: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """The symbol that each window chooses, by the window's first word; all ones where no window starts.

    A symbol is valued together with the words it depends on.  Preferred are symbols
    whose stretch takes about half the window: long enough to be rare, short enough
    that many windows agree; among these the smallest value.  Failing such, longer
    ones, then shorter ones down to a single word.
    """
    n = len(names)
    best = np.full(n, _NONE)
    if n == 0:
        return best
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    at = np.arange(n, dtype=np.int32)
    least, most = window // 2, window // 2 + 2
    klass = np.array([0] + [0 if least <= m <= most else 1 if m > most else 1 + least - m for m in range(1, window + 1)], np.uint64) << np.uint64(60)
    stretch = _stretches(names)
    # table[m - 1, p]: the best symbol whose stretch starts at p and has m words
    table = np.full((window, n), _NONE)
    state = (names, at, at + 1, doc)
    for level in range(rounds + 1):
        if level == 1:
            state = _runs(*state)
        if level:
            state = _pairs(*state, level)
        name, lo, hi, _ = state
        pick = np.flatnonzero((lo >= 0) & (hi - lo <= window))
        name, lo, hi = name[pick], lo[pick], hi[pick]
        value = (mix(stretch(lo, hi) + name + np.uint64(level)) >> np.uint64(4)) | klass[hi - lo]
        np.minimum.at(table.reshape(-1), (hi - lo - 1).astype(np.int64) * n + lo, value)
    np.minimum.accumulate(table, axis=0, out=table)
    for j in range(min(window, n)):  # a stretch that starts j words into the window has at most window - j words
        np.minimum(best[: n - j], table[window - 1 - j, j:], out=best[: n - j])
    best[at + window > offsets[1:][doc]] = _NONE
    return best


def window_values(names: np.ndarray, window: int, seed: int, at: np.ndarray) -> np.ndarray:
    """A 64-bit value of the ``window`` words from each position ``at``."""
    keys = odd_keys(window, seed)
    out = np.zeros(len(at), np.uint64)
    for i in range(window):
        out += mix(names[at + i] + keys[i]) * keys[i]
    return mix(out)


def _whole(names: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values of each document's word sequence, from (words, 2) names."""
    digests = [hashlib.blake2b(names[a:b].tobytes(), digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


#: Rows that a task holds to compare them with each other before it sends any on.
_HELD = 700_000


class _Rows:
    """Columns of numpy arrays with the documents they belong to; a null doc_id is a flag beside a 0."""

    def __init__(self, *kinds):
        self.kinds, self.parts, self.size = kinds, [], 0

    def add(self, ids: pa.Array, rks: pa.Array, rows: np.ndarray, *columns: np.ndarray) -> None:
        known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        did = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        self.parts.append((did[rows], known[rows], rks.to_numpy(zero_copy_only=False)[rows], *columns))
        self.size += len(rows)

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(x).astype(k) for x, k in zip(zip(*self.parts, strict=True), (np.int64, bool, np.int64, *self.kinds), strict=True)]
        self.parts, self.size = [], 0
        return out


def _groups(keys: tuple[np.ndarray, ...], did: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order of (keys, document): group number, and whether the row is of the group's first document, and the groups' starts and ends."""
    new = np.ones(len(did), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    head = at[group]
    return group, (did == did[head]) & (known == known[head]), at, np.append(at[1:], len(did)) - 1


def _doc_array(did: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(did, pa.int64(), mask=~known)


def _route(key: np.ndarray, sure: np.ndarray, did: np.ndarray, rk: np.ndarray) -> np.ndarray:
    """Where a row goes: with its key, or anywhere if what it says is settled."""
    return np.where(sure, mix((did + rk * 31 + np.arange(len(did))).view(np.uint64)).view(np.int64), key)


_SYMBOLS = "route long, sure boolean, many boolean, symbol long, whole long, doc_id long, rk long"


def _emit_symbols(window: int, rounds: int):
    names_ = ["route", "sure", "many", "symbol", "whole", "doc_id", "rk"]

    def flush(rows: _Rows) -> pa.RecordBatch:
        did, known, rk, symbol, whole = rows.take()
        order = np.lexsort((rk, did, known, whole, symbol))
        did, known, rk, symbol, whole = (x[order] for x in (did, known, rk, symbol, whole))
        group, first, at, end = _groups((symbol, whole), did, known)
        many = (~first[end])[group]
        # a symbol of several documents here is shared for certain: one row goes to meet the other tasks' rows
        lead = np.zeros(len(did), bool)
        lead[at] = True
        sure = np.where(whole == 0, many & ~lead, ~first)
        again = np.zeros(len(did), bool)  # one row for each document of a group is enough
        again[1:] = (group[1:] == group[:-1]) & (did[1:] == did[:-1]) & (known[1:] == known[:-1]) & (rk[1:] == rk[:-1])
        # documents known to copy an earlier one send no symbols
        copies = np.unique(np.stack([did, rk], 1)[(whole != 0) & sure], axis=0)
        drop = again
        if len(copies):
            mine = mix(did.view(np.uint64)) ^ rk.view(np.uint64)
            gone = mix(copies[:, 0].copy().view(np.uint64)) ^ copies[:, 1].copy().view(np.uint64)
            drop = again | ((whole == 0) & sure & np.isin(mine, gone))
        keep = ~drop
        did, known, rk, symbol, whole, sure, many = (x[keep] for x in (did, known, rk, symbol, whole, sure, many))
        return pa.RecordBatch.from_arrays([pa.array(_route(symbol, sure, did, rk)), pa.array(sure), pa.array(many), pa.array(symbol), pa.array(whole), _doc_array(did, known), pa.array(rk)], names=names_)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(np.int64, np.int64)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                words, offsets = split_words(batch.column("text")[a:b])
                both = word_names(words)
                best = window_symbols(both[:, 0], offsets, window, rounds)
                doc = np.repeat(np.arange(b - a), np.diff(offsets))
                first = best != _NONE
                first[1:] &= (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(first)
                long = np.flatnonzero(np.diff(offsets) >= window)
                w1, w2 = _whole(both, offsets)
                # a document's own name is a row with the second half of it in "whole", which is 0 for symbols
                symbol = np.concatenate([best[at].view(np.int64), w1[long]])
                whole = np.concatenate([np.zeros(len(at), np.int64), w2[long] | 1])
                rows.add(batch.column("doc_id")[a:b], batch.column("rk")[a:b], np.concatenate([doc[at], long]), symbol, whole)
                if rows.size >= _HELD:
                    yield flush(rows)
        if rows.size:
            yield flush(rows)

    return emit


def _numpy(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    did = batch.column("doc_id")
    return [pc.fill_null(did, 0).to_numpy(zero_copy_only=False), pc.is_valid(did).to_numpy(zero_copy_only=False), *(batch.column(n).to_numpy(zero_copy_only=False) for n in names)]


def _by_key(keys: list[str], judge):
    """Arrow function over a partition sorted by (sure, keys, document): ``judge`` sees whole groups of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            block = table.to_batches()[0]
            cols = [block.column(k).to_numpy(zero_copy_only=False) for k in ["sure", *keys]]
            change = np.zeros(block.num_rows - 1, bool)
            for c in cols:
                change |= c[1:] != c[:-1]
            where = np.flatnonzero(change)
            if not len(where):
                held = block
                continue
            cut = int(where[-1]) + 1
            yield judge(block.slice(0, cut))
            held = block.slice(cut)
        if held is not None and held.num_rows:
            yield judge(held)

    return run


def _shared(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of shared symbols, and of documents that copy an earlier one."""
    did, known, rk, symbol, whole, sure, many = _numpy(batch, "rk", "symbol", "whole", "sure", "many")
    group, first, at, end = _groups((symbol, whole, sure), did, known)
    any_many = np.bitwise_or.reduceat(many, at)[group] if len(at) else many
    shared = sure | np.where(whole == 0, any_many | (~first[end])[group], ~first)
    pick = np.flatnonzero(shared)
    return pa.RecordBatch.from_arrays([_doc_array(did[pick], known[pick]), pa.array(rk[pick]), pa.array(symbol[pick]), pa.array(whole[pick] != 0)], names=["doc_id", "rk", "symbol", "copy"])


_WINDOWS = "route long, sure boolean, v1 long, v2 long, doc_id long, rk long, start int"


def _emit_windows(window: int, rounds: int):
    """Of documents with their shared symbols: the windows that chose one, by the values of their words."""

    def flush(rows: _Rows) -> pa.RecordBatch:
        did, known, rk, v1, v2, start = rows.take()
        order = np.lexsort((did, known, v2, v1))
        did, known, rk, v1, v2, start = (x[order] for x in (did, known, rk, v1, v2, start))
        _, first, _, _ = _groups((v1, v2), did, known)
        sure = ~first  # an earlier document of this task has the window: nothing left to find out
        route = _route(v1, sure, did, rk)
        v1[sure], v2[sure] = 0, 0
        return pa.RecordBatch.from_arrays([pa.array(route), pa.array(sure), pa.array(v1), pa.array(v2), _doc_array(did, known), pa.array(rk), pa.array(start)], names=["route", "sure", "v1", "v2", "doc_id", "rk", "start"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(np.int64, np.int64, np.int32)
        for batch in batches:
            lists = batch.column("symbols")
            for a, b in slices(batch.column("text")):
                words, offsets = split_words(batch.column("text")[a:b])
                both = word_names(words)
                best = window_symbols(both[:, 0], offsets, window, rounds)
                known = best != _NONE
                best = best.view(np.int64)
                pick = np.zeros(len(best), bool)
                for i in range(b - a):
                    p, q = offsets[i], offsets[i + 1]
                    if q - p >= window:
                        pick[p:q] = np.isin(best[p:q], lists[a + i].values.to_numpy(zero_copy_only=False))
                at = np.flatnonzero(pick & known)
                doc = np.repeat(np.arange(b - a), np.diff(offsets))[at]
                v1, v2 = (window_values(both[:, half], window, 11 + half, at).view(np.int64) for half in (0, 1))
                rows.add(batch.column("doc_id")[a:b], batch.column("rk")[a:b], doc, v1, v2, at - offsets[doc])
                if rows.size >= _HELD:
                    yield flush(rows)
        if rows.size:
            yield flush(rows)

    return emit


def _repeated(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Windows that a document with a smaller id has too."""
    did, known, rk, v1, v2, sure, start = _numpy(batch, "rk", "v1", "v2", "sure", "start")
    _, first, _, _ = _groups((v1, v2, sure), did, known)
    pick = np.flatnonzero(sure | ~first)
    return pa.RecordBatch.from_arrays([_doc_array(did[pick], known[pick]), pa.array(rk[pick]), pa.array(start[pick])], names=["doc_id", "rk", "start"])


def _cut(window: int):
    """Documents with what is left of their words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, copy = batch.column("starts"), batch.column("copy")
            for a, b in slices(batch.column("text")):
                words, offsets = split_words(batch.column("text")[a:b])
                counts = np.diff(offsets)
                gone = np.zeros(len(words) + 1, np.int64)
                for i in range(a, b):
                    p, q = offsets[i - a], offsets[i - a + 1]
                    if copy[i].as_py() and q - p >= window:
                        gone[p] += 1
                        gone[q] -= 1
                    elif starts[i].is_valid:
                        s = p + starts[i].values.to_numpy(zero_copy_only=False)
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + window, -1)
                stays = np.cumsum(gone)[:-1] == 0
                left = np.concatenate([[0], np.cumsum(stays)])[offsets]
                kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(stays))), " ")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], batch.column("rk")[a:b], pa.array(counts.astype(np.int64)), pa.array((counts - np.diff(left)).astype(np.int64)), kept], names=["doc_id", "rk", "n_words", "n_removed", "kept"]
                )

    return emit


def substring_dedup(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of ``docs(doc_id, text, ...)``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A word goes when it lies in
    a window of ``window`` consecutive words whose sequence also starts in a
    document with a smaller doc_id; windows are judged on the input.  ``kept`` is
    the rest, joined by single spaces.  A null text has no words; a null doc_id
    is smaller than all others; rows that repeat a doc_id do not remove each
    other's words.  Very long texts are read whole; an empty table gives an empty result.  Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    symbols = slim.mapInArrow(_emit_symbols(window, rounds), _SYMBOLS)
    met = symbols.repartition(parts, "route").sortWithinPartitions("sure", "symbol", "whole", "doc_id")
    shared = materialize(met.mapInArrow(_by_key(["symbol", "whole"], _shared), "doc_id long, rk long, symbol long, copy boolean"))
    # the texts travel by document once: both joins below read one exchange
    by_doc = shared.groupBy(F.col("doc_id").alias("s_doc"), F.col("rk").alias("s_rk")).agg(
        F.bool_or("copy").alias("copy"), F.collect_list(F.when(~F.col("copy"), F.col("symbol"))).alias("symbols")
    )
    held = slim.join(by_doc, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("rk") == F.col("s_rk")), "left")
    windows = held.where("not copy and size(symbols) > 0").select("doc_id", "rk", "text", "symbols").mapInArrow(_emit_windows(window, rounds), _WINDOWS)
    met = windows.repartition(parts, "route").sortWithinPartitions("sure", "v1", "v2", "doc_id")
    repeated = met.mapInArrow(_by_key(["v1", "v2"], _repeated), "doc_id long, rk long, start int")
    starts = repeated.groupBy(F.col("doc_id").alias("w_doc"), F.col("rk").alias("w_rk")).agg(F.collect_list("start").alias("starts"))
    there = F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("rk") == F.col("w_rk"))
    out = held.join(starts, there, "left").select("doc_id", "rk", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts")
    return out.mapInArrow(_cut(window), "doc_id long, rk long, n_words long, n_removed long, kept string").drop("rk")
