"""Speaker references: evidence modes, catalogs, assignments and multi-reference similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .rules import Rule


def evidence_mode(legacy: Column, references: Column, bound: Column) -> Column:
    """legacy (one embedding), reference_set (several, bound to a set), unbound (several, not bound), mixed (not allowed) or none."""
    return (
        F.when(legacy.isNotNull() & references.isNotNull(), "mixed").when(legacy.isNotNull(), "legacy").when(references.isNotNull() & bound, "reference_set")
        .when(references.isNotNull(), "unbound").otherwise("none")
    )


def mean_cosine(obs: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, references, similarity): mean cosine of the sample's embedding to each of its references; null if any one has no cosine."""
    r = obs.select(key, "speaker_embedding", F.explode("reference_speaker_embeddings").alias("r"))
    c = r.withColumn("c", cosine(F.col("speaker_embedding"), F.col("r.embedding")))
    return c.groupBy(key).agg(F.array_sort(F.collect_list("r.reference_id")).alias("references"), F.when(F.count("c") == F.count("*"), F.avg("c")).alias("similarity"))


def reference_set_digest(references: Column) -> Column:
    """Canonical digest of (reference_id, sha256) records, in order of the id; ids and digests are plain strings."""
    ordered = F.array_sort(references)
    parts = F.transform(ordered, lambda r: F.concat(F.lit('{"reference_id":"'), r["reference_id"], F.lit('","sha256":"'), r["sha256"], F.lit('"}')))
    return F.sha2(F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")), 256)


def catalog_rules() -> list[Rule]:
    return [Rule.identifier("reference_id"), Rule("audio_sha256_required", F.col("audio_sha256").isNotNull()), Rule.sha256("audio_sha256"), Rule("transcript_sha256_required", F.col("transcript_sha256").isNotNull()), Rule.sha256("transcript_sha256")]


def plan_keys(plan: DataFrame) -> DataFrame:
    return plan.select("prompt_id", "seed").distinct()


def assignment_breaches(assignments: DataFrame, plan: DataFrame, catalog: DataFrame) -> DataFrame:
    """(prompt_id, seed, rule) of ``assignments(prompt_id, seed, reference_ids)``.

    Keys must be the plan's exactly, once; ids sorted, without repeats, and in the catalog.
    """
    keys = ["prompt_id", "seed"]
    say = lambda df, rule: df.select(*keys, F.lit(rule).alias("rule"))
    wanted = plan_keys(plan)
    each = assignments.select(*keys, F.explode("reference_ids").alias("reference_id"))
    ordered = (F.size("reference_ids") > 0) & (F.col("reference_ids") == F.array_sort(F.array_distinct("reference_ids")))
    return (
        say(wanted.join(assignments, keys, "left_anti"), "not_assigned").unionByName(say(assignments.join(wanted, keys, "left_anti"), "not_planned"))
        .unionByName(say(assignments.groupBy(*keys).count().where("count > 1"), "assigned_twice")).unionByName(say(assignments.where(~ordered), "sorted_unique"))
        .unionByName(say(each.join(catalog, "reference_id", "left_anti").select(*keys).distinct(), "unknown_reference"))
    )


def selected_references(assignments: DataFrame, catalog: DataFrame) -> DataFrame:
    """(prompt_id, seed, references): catalog records of each assignment, in order of the id."""
    each = assignments.select("prompt_id", "seed", F.explode("reference_ids").alias("reference_id")).join(catalog, "reference_id")
    return each.groupBy("prompt_id", "seed").agg(F.array_sort(F.collect_list(F.struct("reference_id", F.col("audio_sha256").alias("sha256")))).alias("references"))


def disagreeing_pairs(pairs: DataFrame) -> DataFrame:
    """Matched pairs whose two sides were measured against different reference sets."""
    return pairs.where(~F.col("b_reference_set_sha256").eqNullSafe(F.col("a_reference_set_sha256")))
