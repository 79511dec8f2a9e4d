"""Blind listening: labels, counterbalanced schedules, completeness and aggregation."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import canonical_sha256


def blind_labels(samples: DataFrame, seed: int, keys: list[str], sample: str = "sample_id") -> DataFrame:
    """Adds blind_id ``sample-%04d`` in the order of md5(seed, id), within ``keys`` (a listening pack)."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), sample))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order, sample))
    return samples.withColumn("blind_id", F.concat(F.lit("sample-"), F.lpad(number.cast("string"), 4, "0")))


def blind_labels_exact(ids: list[str], seed: int) -> dict[str, str]:
    """The same by CPython's own shuffle of the document's order, for packs that must reproduce it; a pack is a short list."""
    shuffled = list(ids)
    random.Random(seed).shuffle(shuffled)
    return {x: f"sample-{i:04d}" for i, x in enumerate(shuffled, 1)}


def rater_seed(schedule_seed: int, rater_id: str) -> int:
    return int(canonical_sha256({"rater_id": rater_id, "schedule_seed": schedule_seed})[:16], 16)


def schedule(items: DataFrame, raters: DataFrame, seed: int) -> DataFrame:
    """(rater_id, position, block, candidate_id): each rater hears each block once in each pass.

    ``items(block, candidate_id, cand)`` with cand counting from 0 in a block of C
    candidates; ``raters(rater_id, rater)``.  A rater's blocks are ordered by
    md5(seed, rater, block); in pass p the candidate is (p + rater + the block's own index) mod C.
    """
    blocks = items.groupBy("block").agg(F.count("*").alias("c"))
    # blocks are a configured list, as short as a listening pack
    blocks = blocks.withColumn("index", F.row_number().over(Window.orderBy("block")) - 1)
    order = Window.partitionBy("rater_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "rater_id", F.col("block").cast("string"))), "block")
    # every rater hears every block: the product is the schedule itself
    placed = raters.crossJoin(blocks).withColumn("place", F.row_number().over(order) - 1)
    turns = placed.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))).withColumn("cand", F.pmod(F.col("p") + F.col("rater") + F.col("index"), F.col("c")).cast("int"))
    turns = turns.join(items, ["block", "cand"])
    number = F.row_number().over(Window.partitionBy("rater_id").orderBy("p", "place")) - 1
    return turns.select("rater_id", number.alias("position"), F.col("p").cast("int").alias("pass"), "block", "candidate_id")


def schedule_exact(blocks: dict[tuple[str, int], dict[str, str]], raters: list[str], seed: int) -> dict[str, list[str]]:
    """Schedules by CPython's shuffle, for packs that must reproduce it: rater -> blind ids in order.

    ``blocks`` maps (prompt, seed) to blind ids by candidate, the same candidates everywhere.  A block's index among
    all sorted blocks, not its shuffled place, turns the candidates.
    """
    names = sorted({c for b in blocks.values() for c in b})
    if len(names) < 2 or any(set(b) != set(names) for b in blocks.values()) or len(set(raters)) < len(raters) or not raters:
        raise ValueError("a schedule needs two candidates, the same in every block, and raters named once")
    index = {b: i for i, b in enumerate(sorted(blocks))}
    out = {}
    for r, rater in enumerate(sorted(raters)):
        order = sorted(blocks)
        random.Random(rater_seed(seed, rater)).shuffle(order)
        out[rater] = [blocks[b][names[(p + r + index[b]) % len(names)]] for p in range(len(names)) for b in order]
    return out


def schedule_audit(sched: DataFrame) -> DataFrame:
    """By rater: items, distinct candidates in each pass, and the least distance of two turns of one block."""
    order = Window.partitionBy("rater_id", "block").orderBy("position")
    apart = sched.withColumn("apart", F.lead("position").over(order) - F.col("position"))
    counts = sched.groupBy("rater_id", "pass", "candidate_id").agg(F.count("*").alias("n")).groupBy("rater_id").agg((F.max("n") - F.min("n")).alias("imbalance"))
    return apart.groupBy("rater_id").agg(F.count("*").alias("items"), F.countDistinct("block").alias("blocks"), F.min("apart").alias("least_apart")).join(counts, "rater_id")


def missing_ratings(expected: DataFrame, ratings: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(ratings.select(*keys).distinct(), keys, "left_anti")


def aggregate(ratings: DataFrame, keys: list[str]) -> DataFrame:
    return ratings.groupBy(*keys).agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.median("score").alias("median"), F.min("score").alias("low"), F.max("score").alias("high"))


def rating_order(packet: pd.DataFrame) -> pd.DataFrame:
    """A packet's rows criterion by criterion, each in the order of presentation."""
    return packet.sort_values(["criterion_order", "position"], kind="stable")
