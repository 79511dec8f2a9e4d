"""Exact dedup by deterministic block naming.

Normalised texts are cut into fixed-size blocks.  A distributed sort of all
blocks gives each distinct block its dense rank as an integer name; adjacent
names are then paired and the pairs sorted and named the same way, until one
name is left for each document.  Hashes only deal blocks out; names come from comparisons of
the blocks themselves, and where two different blocks share a hash all are dealt
out anew by their texts.  So equal (round, name) means equal text, whatever collides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_batches, join_groups, materialize, row_key

BLOCK_CHARS = 4096


def _local_ranks(schema: pa.Schema, keys: list[str]):
    """Arrow function over a sorted partition: each row's rank among the partition's distinct keys.

    A last row tells of the partition itself: how many names it has, its outermost keys
    and hashes, and whether one hash stood for several keys.
    """

    def ranks(batches):
        pid, rank, last = TaskContext.get().partitionId(), 0, None
        first, clash = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k) for k in keys]
            new = np.zeros(batch.num_rows, bool)
            for c in cols:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            same = np.zeros(batch.num_rows, bool)
            if "hash" in batch.schema.names:
                hashes = batch.column("hash").to_numpy(zero_copy_only=False)
                same[1:] = hashes[1:] == hashes[:-1]
                here = {"hash": int(hashes[0])}, {"hash": int(hashes[-1])}
            else:
                here = {}, {}
            head, tail = ({k: c[i].as_py() for k, c in zip(keys, cols, strict=True)} | h for i, h in zip((0, -1), here, strict=True))
            if last is None:
                first = head
            new[0] = last is None or any(head[k] != last[k] for k in keys)
            same[0] = last is not None and "hash" in head and head["hash"] == last["hash"]
            clash = clash or bool((new & same).any())
            local = rank + np.cumsum(new)
            rank, last = int(local[-1]), tail
            out = {n: batch.column(n) for n in schema.names if n in batch.schema.names and n not in keys}
            n = batch.num_rows
            out |= {"pid": pa.array(np.full(n, pid), pa.int32()), "local": pa.array(local, pa.int64())}
            yield pa.RecordBatch.from_arrays([out[f.name] if f.name in out else pa.nulls(n, f.type) for f in schema], schema=schema)
        if last is not None:
            ends = {"pid": pid, "local": rank, "clash": clash} | {f"first_{k}": v for k, v in first.items()} | {f"last_{k}": v for k, v in last.items()}
            yield pa.RecordBatch.from_arrays([pa.array([ends.get(f.name)], f.type) for f in schema], schema=schema)

    return ranks


def block_hash(block: Column) -> Column:
    """Where a block is dealt to; any function of the block gives the same names."""
    return F.xxhash64(block)


def _name(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Replace the key columns of ``df(doc_id, rk, pos, *keys)`` by one global integer name.

    Rows are dealt by range of (keys, document), so that a key with very many
    rows spreads over several partitions.  A partition whose first
    key is the last of the partition before goes on with that one's name.
    Blocks are dealt by their hash, which keeps the sample that the driver sees small; if different
    blocks turn out to share a hash, they are dealt by the blocks themselves.
    """
    if keys != ["block"]:
        return _ranked(df, keys, keys, parts)[0]
    named, clash = _ranked(df.withColumn("hash", block_hash(F.col("block"))), keys, ["hash"], parts)
    return _ranked(df, keys, keys, parts)[0] if clash else named


def _ranked(df: DataFrame, keys: list[str], by: list[str], parts: int) -> tuple[DataFrame, bool]:
    """Names of rows dealt by range of ``by``, and whether different keys have equal ``by``."""
    text = keys == ["block"]
    here = ["doc_id", "rk", "pos"]
    order = [*by, *(k for k in keys if k not in by), *here]
    rows = df.repartitionByRange(parts, *by, *here).sortWithinPartitions(*order)
    kinds = [pa.field("doc_id", pa.int64()), pa.field("rk", pa.int64()), pa.field("pos", pa.int32()), pa.field("pid", pa.int32()), pa.field("local", pa.int64()), pa.field("clash", pa.bool_())]
    ends = [(k, "string" if text and k == "block" else "long") for k in dict.fromkeys([*keys, *by])]
    schema = pa.schema(kinds + [pa.field(f"{e}_{k}", pa.string() if t == "string" else pa.int64()) for k, t in ends for e in ("first", "last")])
    out = "doc_id long, rk long, pos int, pid int, local long, clash boolean, " + ", ".join(f"{e}_{k} {t}" for k, t in ends for e in ("first", "last"))
    ranked = materialize(rows.select(*here, *dict.fromkeys([*keys, *by])).mapInArrow(_local_ranks(schema, keys), out))
    w = Window.orderBy("pid")  # one row for each partition of the sort
    bounds = ranked.where("clash is not null")

    def goes_on(columns: list[str]) -> Column:
        same = F.lit(True)
        for k in columns:
            same = same & (F.col(f"first_{k}") == F.lag(f"last_{k}").over(w))
        return F.coalesce(same, F.lit(False))

    bounds = bounds.withColumns({"again": goes_on(keys), "split": goes_on(by)})
    clash = bool(bounds.where("clash or (split and not again)").limit(1).count())
    base = F.coalesce(F.sum("local").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum(F.col("again").cast("long")).over(w)
    bounds = F.broadcast(bounds.select("pid", base.alias("base")))  # as many rows as partitions
    return ranked.where("clash is null").join(bounds, "pid").select(*here, (F.col("base") + F.col("local")).alias("name")), clash


def block_names(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, rk, level, name) for each document: equal (level, name) exactly for equal normalised texts."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    last = F.floor(F.greatest(F.length("norm") - 1, F.lit(0)) / block_chars)
    blocks = docs.select("doc_id", row_key().alias("rk"), norm.alias("norm"))
    blocks = blocks.select("doc_id", "rk", "norm", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("pos"))
    blocks = blocks.select("doc_id", "rk", "pos", F.expr(f"substring(norm, pos * {block_chars} + 1, {block_chars})").alias("block"))
    names, done, level = _name(blocks, ["block"], parts), [], 0
    while True:
        # Names start at 1 and a missing right neighbour counts as 0: (a, 0) at position 0 is a document down to one name.
        pairs = materialize(
            names.groupBy("doc_id", "rk", F.shiftright("pos", 1).alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("b"),
            )
        )
        ended = (F.col("pos") == 0) & (F.col("b") == 0)
        done.append(pairs.where(ended).select("doc_id", "rk", F.lit(level).alias("level"), F.col("a").alias("name")))
        rest = pairs.where(~ended)
        if not rest.limit(1).count():
            break
        names, level = _name(rest, ["a", "b"], parts), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts
    as empty.  Of equal texts the row with the largest doc_id stays; null ids
    are smaller than any other.  Rows that repeat the staying doc_id with the
    same text are all kept.  Very long texts are read whole, in blocks.  Other columns are ignored; an empty table gives an
    empty result.
    """
    bounded_batches(docs.sparkSession)
    names = block_names(docs, block_chars)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", row_key().alias("rk"), F.sha2(ascii_lower(text), 256).alias("text_sha256"))
    named = names.select(F.col("doc_id").alias("n_id"), F.col("rk").alias("n_rk"), "level", "name")
    named = rows.join(named, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("rk") == F.col("n_rk"))).drop("n_id", "n_rk", "rk")
    named = materialize(named)
    groups = materialize(named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    out = join_groups(named, groups, ["level", "name"], "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
