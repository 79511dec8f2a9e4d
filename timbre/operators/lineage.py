"""Content-addressed lineage: record digests, role-by-role comparison, disjointness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tree_digest(records: DataFrame, keys: list[str], line: Column) -> DataFrame:
    """(keys, sha256): digest of a tree's newline-terminated records in sorted order.  A tree's records form one digest, so they meet in one row."""
    lines = F.array_sort(F.collect_list(F.concat(line, F.lit("\n"))))
    return records.groupBy(*keys).agg(F.count("*").alias("files"), F.sha2(F.array_join(lines, ""), 256).alias("sha256"))


def compare_roles(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Full-outer comparison by role: missing, unexpected, differs or exact."""
    l = left.select(key, F.struct(*fields).alias("l"))
    r = right.select(key, F.struct(*fields).alias("r"))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "unexpected").when(F.col("l").eqNullSafe(F.col("r")), "exact").otherwise("differs")
    return l.join(r, key, "full_outer").select(key, status.alias("status"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
