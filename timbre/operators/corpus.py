"""Corpus audit: duplicates, leakage between splits, and blocking joins over fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(rows: DataFrame, key: str, order: list[str], carry: list[str]) -> DataFrame:
    """Each row with the first row of its key, as first_<column>.

    The first row is a minimum, combined before the shuffle, and joined back: the rows of a very common key meet one row,
    so adaptive execution may split them over tasks.
    """
    head = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *carry)).alias("first"), F.count("*").alias("group_rows"))
    return rows.join(head, key).select(*rows.columns, "group_rows", *(F.col(f"first.{c}").alias(f"first_{c}") for c in dict.fromkeys([*order, *carry])))


def duplicates(rows: DataFrame, key: str, order: list[str], split: str = "split", cross_split_only: bool = False) -> DataFrame:
    """Rows whose key an earlier row has; with ``cross_split_only`` those whose first row is in another split."""
    found = first_seen(rows, key, order, [split])
    later = F.struct(*order) > F.struct(*(F.col(f"first_{c}") for c in order))
    return found.where(later & (F.col(split) != F.col(f"first_{split}")) if cross_split_only else later)


def leakage(rows: DataFrame, group: str, order: list[str], split: str = "split") -> DataFrame:
    """Rows of a group that was first seen in another split."""
    return duplicates(rows, group, order, split, cross_split_only=True)


def split_report(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    return rows.groupBy(split).agg(F.count("*").alias("rows"), F.count_if(F.col("valid")).alias("valid_rows"), F.countDistinct(group).alias("groups"))


def audit_stages(rows: DataFrame) -> DataFrame:
    """The audit's rules in order; a row that fails one registers no key with the later ones.

    ``rows(split, ord, text, path, sha256, group_id)``, any of them null.  Adds ``reason``: null for rows that pass.
    """
    order = ["ord"]
    bad = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "missing_text").when(F.coalesce(F.trim("path"), F.lit("")) == "", "missing_audio_path")
    left = rows.withColumn("reason", bad)
    for column, reason, across in (("path", "duplicate_path", False), ("sha256", "duplicate_content", False), ("group_id", "group_leakage", True)):
        ok = left.where("reason is null")
        found = duplicates(ok, column, order, cross_split_only=across).select(F.col("ord").alias("d_ord"))
        if column == "group_id":
            left = left.withColumn("reason", F.when(F.col("reason").isNull() & F.col("group_id").isNull(), "missing_group").otherwise(F.col("reason")))
        left = left.join(found, F.col("ord") == F.col("d_ord"), "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("d_ord").isNotNull(), reason).otherwise(F.col("reason"))).drop("d_ord")
    return left


def blocking_candidates(prints: DataFrame, least_shared: int = 3) -> DataFrame:
    """(left_id, right_id, shared) of fingerprints in different splits that share ``least_shared`` bands or more.

    ``prints(id, split, bands array<string>)`` with the same number of bands each.  The join is on combinations of
    ``least_shared`` bands, so a band that very many fingerprints have pairs none of them by itself; a pair
    comes once, at the first combination that it shares.
    """
    numbered = prints.select("id", "split", "bands", F.transform("bands", lambda h, b: F.struct(b.alias("b"), h.alias("h"))).alias("at"))
    chosen = numbered.withColumn("key", F.array().cast("array<struct<b:int,h:string>>"))
    for _ in range(least_shared):  # extend each combination by a later band
        rest = F.expr("filter(at, x -> x.b > coalesce(get(key, size(key) - 1).b, -1))")
        chosen = chosen.withColumn("more", F.explode(rest)).withColumn("key", F.concat("key", F.array("more"))).drop("more")
    chosen = chosen.select("id", "split", "bands", F.transform("key", lambda x: x["b"]).alias("places"), F.xxhash64("key").alias("key"))
    left, right = (chosen.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "split", "bands", "places")), "key") for p in ("left", "right"))
    both = left.join(right, "key").where((F.col("left_id") < F.col("right_id")) & (F.col("left_split") != F.col("right_split")) & (F.col("left_places") == F.col("right_places")))
    same = F.expr("filter(sequence(0, size(left_bands) - 1), i -> left_bands[i] = right_bands[i])")
    both = both.withColumn("same", same).where(F.slice("same", 1, least_shared) == F.col("left_places"))
    return both.select("left_id", "right_id", F.size("same").cast("long").alias("shared"))


def capped(rows: DataFrame, cap: int, *order: Column, beyond: bool = False) -> DataFrame:
    """The first ``cap`` rows in order, with the count of all and whether the cap was reached (``beyond``: exceeded)."""
    total = rows.agg(F.count("*").alias("total"))
    first = rows.orderBy(*order).limit(cap)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order))).crossJoin(total).withColumn("reached", F.col("total") > cap if beyond else F.col("total") >= cap)
