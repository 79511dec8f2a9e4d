"""Corpus audit: manifests of several splits, checked in the order in which a reader would meet their rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dedupe_key, nfkc
from ..functions.vectors import fingerprint_distance
from ..operators import corpus
from ..sources.documents import manifest_rows, read_manifest
from ..sources.fingerprints import LEVELS
from .checks import ContractViolation

#: Fixed order of the usual splits; further ones follow by name.
FIRST = ("train", "validation", "test")
MAX_COMPARISONS, MAX_CANDIDATES, LEAST_RATIO, MOST_DISTANT = 100_000, 1000, 0.92, 0.08
MAX_PATTERN, MAX_PATH = 512, 4096


def _one_group(pattern: str) -> None:
    try:
        groups = re.compile(pattern).groups
    except re.error as e:
        raise ContractViolation(f"the group pattern is invalid: {e}") from e
    if not pattern or len(pattern) > MAX_PATTERN or groups != 1:
        raise ContractViolation(f"the group pattern must have one group and at most {MAX_PATTERN} characters")


def read_splits(spark: SparkSession, paths: dict[str, str], audio: str = "audio", text: str = "text", group: str | None = None, group_pattern: str | None = None) -> DataFrame:
    """Rows of all manifests with ``ord``, their place in the audit's order: split by split, line by line."""
    if not paths:
        raise ContractViolation("no splits")
    if group and group_pattern:
        raise ContractViolation("name a group field or a pattern, not both")
    if group_pattern is not None:
        _one_group(group_pattern)
    out = None
    for i, split in enumerate(sorted(paths, key=lambda s: (FIRST.index(s) if s in FIRST else len(FIRST), s))):
        rows = manifest_rows(read_manifest(spark, paths[split]), audio, text, group)
        rows = rows.withColumn("split", F.lit(split)).withColumn("ord", F.lit(i) * F.lit(1 << 40) + F.col("line"))
        out = rows if out is None else out.unionByName(rows)
    if group_pattern:
        name = F.element_at(F.split("audio_path", "/"), -1)
        out = out.withColumn("group_id", F.when(F.length("audio_path") <= MAX_PATH, F.nullif(F.trim(F.regexp_extract(name, group_pattern, 1)), F.lit(""))))
    return out.withColumn("grouped", F.lit(bool(group or group_pattern)))


def audit(rows: DataFrame, audio: DataFrame | None = None) -> dict[str, DataFrame]:
    """errors, warnings and the split report of manifest ``rows``; ``audio(path, sha256)`` are the files that exist.

    Where groups were asked for (``grouped``, true unless the rows say otherwise), a row without one is an error.
    A row fails at its first broken rule and registers nothing with later ones; a transcript
    first seen in another split is a warning.
    """
    held = rows.select("split", "ord", "line", "error", F.col("transcript").alias("text"), F.col("audio_path").alias("path"), "group_id", *(["grouped"] if "grouped" in rows.columns else [F.lit(True).alias("grouped")]))
    if audio is not None:
        held = held.join(audio.select("path", "sha256").withColumn("exists", F.lit(True)), "path", "left")
    else:
        held = held.withColumns({"sha256": F.lit(None).cast("string"), "exists": F.lit(True)})
    unread = held.where("error is not null or exists is null").withColumn("reason", F.coalesce("error", F.lit("missing_audio")))
    judged = corpus.audit_stages(held.where("error is null and exists").select("split", "ord", "line", "text", "path", "sha256", F.when(F.col("grouped"), F.col("group_id")).otherwise(F.col("path")).alias("group_id")))
    errors = judged.where("reason is not null").select("split", "line", "reason").unionByName(unread.select("split", "line", "reason"))
    texts = held.where("error is null and text is not null and trim(text) != ''").withColumn("key", F.sha2(dedupe_key(nfkc(F.col("text"))), 256))
    warnings = corpus.duplicates(texts, "key", ["ord"], cross_split_only=True).select("split", "line", "first_split", F.lit("duplicate_text").alias("reason"))
    report = corpus.split_report(judged.withColumn("valid", F.col("reason").isNull()), "group_id")
    return {"errors": errors, "warnings": warnings, "splits": report, "reasons": errors.groupBy("reason").agg(F.count("*").alias("n"))}


def similar_audio(prints: DataFrame, threshold: float = MOST_DISTANT) -> dict[str, DataFrame]:
    """Review candidates across splits of ``prints(id, split, seconds, energy, zcr, bands)``: (left_id, right_id, distance), with caps that are reported."""
    shared = corpus.blocking_candidates(prints.where("bands is not null"))
    side = lambda p: prints.select(F.col("id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in ("seconds", "energy", "zcr")))
    both = shared.join(side("left"), "left_id").join(side("right"), "right_id")
    ratio = F.least("left_seconds", "right_seconds") / F.greatest("left_seconds", "right_seconds")
    compared = both.where(ratio >= LEAST_RATIO).withColumn("distance", F.round(fingerprint_distance(F.col("left_energy"), F.col("right_energy"), F.col("left_zcr"), F.col("right_zcr"), LEVELS), 6))
    looked = corpus.capped(compared.select("left_id", "right_id", "shared", "distance"), MAX_COMPARISONS, F.col("right_id"), F.col("left_id"), beyond=True)
    found = corpus.capped(looked.where(F.col("distance") <= threshold).select("left_id", "right_id", "shared", "distance"), MAX_CANDIDATES, F.col("right_id"), F.col("left_id"))
    return {"compared": looked, "candidates": found}
