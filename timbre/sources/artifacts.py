"""Artifact fingerprints: one file, or a tree of files, by content."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def ascii_json(text: pd.Series) -> pd.Series:
    """A string as JSON with ASCII escapes."""
    return text.map(lambda t: None if t is None else json.dumps(t))


def refuse_links(path: str, kind: str) -> None:
    """Refuse local links; paths with a scheme of another store have none."""
    if "://" in path:
        return
    here = Path(path)
    if here.is_symlink() or (kind == "file" and not here.is_file()) or (kind == "tree" and not here.is_dir()):
        raise ValueError(f"no plain {kind}: {path}")
    if kind == "tree" and any(p.is_symlink() for p in here.rglob("*")):
        raise ValueError(f"a tree with links: {path}")


def file_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes, modified) of each file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def fingerprint(spark: SparkSession, path: str, role: str, kind: str) -> DataFrame:
    """One row (role, kind, sha256, bytes, file_count): a file's own digest, or that of the tree's sorted records.

    A link, or a tree that holds one, is refused where the path is local; so is a tree without files.
    """
    refuse_links(path, kind)
    records = file_records(spark, path)
    if kind == "file":
        return records.select(F.lit(role).alias("role"), F.lit(kind).alias("kind"), "sha256", "bytes", F.lit(None).cast("long").alias("file_count"))
    if kind != "tree":
        raise ValueError(f"unknown artifact kind: {kind}")
    if not records.limit(1).count():
        raise ValueError(f"a tree without files: {path}")
    name = F.substring_index("path", path.rstrip("/") + "/", -1)
    # json.dumps escapes all but ASCII; to_json writes the same for ASCII names, others go through Python
    text = F.when(name.rlike(r"^[\x20-\x7E]*$"), F.regexp_extract(F.to_json(F.struct(name.alias("p"))), r'^\{"p":(.*)\}$', 1)).otherwise(ascii_json(name))
    line = F.concat(F.lit('{"bytes":'), F.col("bytes").cast("string"), F.lit(',"path":'), text, F.lit(',"sha256":"'), F.col("sha256"), F.lit('"}\n'))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(name.alias("name"), line.alias("line")))), lambda x: x["line"])
    tree = records.agg(F.array_join(ordered, "").alias("lines"), F.sum("bytes").alias("bytes"), F.count("*").alias("file_count"))
    return tree.select(F.lit(role).alias("role"), F.lit(kind).alias("kind"), F.sha2("lines", 256).alias("sha256"), "bytes", "file_count")


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose size, time or content differ between two scans; empty when the files held still."""
    a, b = (d.select("path", F.struct("sha256", "bytes", "modified").alias(n)) for d, n in ((before, "a"), (after, "b")))
    return a.join(b, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("path")
