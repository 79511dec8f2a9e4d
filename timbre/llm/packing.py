"""Variable-capacity best-fit packing of documents into training sequences.

Documents, cut to chunks no longer than the largest permitted length, are dealt
by hash into shards of bounded size.  In a shard, chunks are taken from the
longest down; each goes into the open bin that it fills best, or opens a new bin of
the permitted length that costs least for such chunks.  The shard is packed once
for each opening rule over all permitted lengths together, the cheapest packing
is kept, and each bin is finally downsized to the least length that holds its contents.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, repeated, row_key
from .mixing import word_count

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a bin of length c: c + BIN_COST.
BIN_COST = 16
SHARD_CHUNKS = 16_384


def _opening(rule: str, capacities: tuple[int, ...], bin_cost: int):
    """For each chunk length the permitted length to open."""

    def choose(n: int) -> int:
        fits = [c for c in capacities if c >= n]
        if rule == "largest":
            return fits[-1]
        if rule == "tight":
            return fits[0]
        return min(fits, key=lambda c: ((c + bin_cost) / (c // n), c))  # cost for each chunk if filled with its like

    memo: dict[int, int] = {}
    return lambda n: memo.setdefault(n, choose(n)) if n not in memo else memo[n]


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...], bin_cost: int, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place in it of each chunk, and the contents of each bin, for lengths in falling order."""
    opening = _opening(rule, capacities, bin_cost)
    rooms: list[int] = []  # distinct free rooms, rising
    bins: dict[int, list[int]] = {}
    used: list[int] = []
    of, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        k = bisect.bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            b = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(k)
        else:
            b, room = len(used), opening(n)
            used.append(0)
        of[i], at[i] = b, used[b]
        used[b] += n
        left = room - n
        if left:
            if left not in bins:
                bins[left] = []
                bisect.insort(rooms, left)
            bins[left].append(b)
    return of, at, np.array(used, np.int64)


def pack_shard(lengths: np.ndarray, capacities: tuple[int, ...], bin_cost: int = BIN_COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, place and the bin's final length of each chunk (in any order), by the cheapest rule."""
    order = np.argsort(-lengths, kind="stable")
    sizes, best = np.array(capacities, np.int64), None
    for rule in ("amortised", "largest", "tight"):
        of, at, used = best_fit(lengths[order], capacities, bin_cost, rule)
        final = sizes[np.searchsorted(sizes, used)] if len(used) else used
        cost = int((final + bin_cost).sum())
        if best is None or cost < best[0]:
            best = cost, of, at, final
    _, of, at, final = best
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return of[back], at[back], final[of[back]] if len(of) else of


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST, shard_chunks: int = SHARD_CHUNKS) -> DataFrame:
    """(doc_id, chunk, start, length, bin_id, place, capacity) of ``docs(doc_id, text, ...)``; lengths are in words.

    Each word of each row is in exactly one chunk: words start .. start + length
    of the document stand at ``place`` of bin ``bin_id``.  A document without words, or
    with a null text, gives one chunk of length 0 in no bin (bin_id null, capacity
    0).  A very long text fills several bins.  Repeated rows, and rows without doc_id, are packed each for itself; of
    chunks of one length the smaller doc_id comes first, rows without one before all.  The result does not depend on the
    order of rows or files.  An empty table gives an empty result.  Other columns are ignored.
    """
    capacities = tuple(sorted(set(capacities)))
    if not capacities or capacities[0] < 1:
        raise ValueError("capacities must be positive")
    top = capacities[-1]
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), word_count(F.col("text")).alias("n"))
    # rows that repeat id and text are alike here: they are counted and numbered, so that any order of rows packs the same
    sized = materialize(sized.groupBy("doc_id", "rk", "n").agg(F.count("*").alias("copies")))
    parts = F.greatest(F.ceil(F.col("n") / top).cast("long"), F.lit(1).cast("long"))
    total = sized.agg(F.sum(parts * F.col("copies"))).first()[0] or 0
    copies = repeated(sized, "copies", "copy")
    chunks = copies.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    chunks = chunks.withColumn("start", F.col("chunk") * top).withColumn("length", F.least(F.lit(top).cast("long"), F.col("n") - F.col("start")))
    shards = max(1, -(-int(total) // shard_chunks))
    dealt = chunks.withColumn("shard", F.pmod(F.xxhash64("doc_id", "rk", "chunk", "copy"), F.lit(shards)))
    empty = chunks.where("length = 0").select("doc_id", "chunk", "start", "length", F.lit(None).cast("long").alias("bin_id"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("capacity"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "known", "doc_id", "rk", "chunk", "copy"], ascending=[False, True, True, True, True, True], kind="stable")
        of, at, final = pack_shard(frame["length"].to_numpy(np.int64), capacities, bin_cost)
        shard = int(frame["shard"].iloc[0])
        return pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "known": frame["known"].to_numpy(), "chunk": frame["chunk"].to_numpy(), "start": frame["start"].to_numpy(), "length": frame["length"].to_numpy(), "bin_id": (shard << 32) + of, "place": at, "capacity": final})

    packed = dealt.where("length > 0").select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.isnotnull("doc_id").alias("known"), "rk", "copy", "chunk", "start", "length", "shard").groupBy("shard").applyInPandas(run, "doc_id long, known boolean, chunk long, start long, length long, bin_id long, place long, capacity long")
    packed = packed.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")
    return packed.unionByName(empty)
