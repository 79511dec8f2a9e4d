"""Generation plans, coverage, and listening routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def generation_plan(candidates: DataFrame, prompts: DataFrame, seeds: DataFrame) -> DataFrame:
    """Candidates x prompts x seeds: a plan is this product by definition, and its parts are short lists."""
    plan = candidates.crossJoin(prompts).crossJoin(seeds)
    sample = F.concat_ws("--", "candidate_id", "prompt_id", F.concat(F.lit("seed-"), F.col("seed")))
    return plan.withColumn("sample_id", sample).withColumn("expected_audio_path", F.concat(F.lit("audio/"), F.col("candidate_id"), F.lit("/"), F.col("prompt_id"), F.lit("/seed-"), F.col("seed"), F.lit(".wav")))


def reconcile(plan: DataFrame, obs: DataFrame, fields: list[str]) -> DataFrame:
    """Full-outer reconciliation by sample_id, with a status for each id.

    missing, unexpected, duplicate, mismatched (a planned field differs), invalid, or ok.
    """
    seen = obs.groupBy("sample_id").agg(F.count("*").alias("rows"), F.min("valid").alias("valid"), *(F.min(f).alias(f"o_{f}") for f in fields))
    planned = plan.select("sample_id", *fields, F.lit(True).alias("planned"))
    both = planned.join(seen, "sample_id", "full_outer")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"o_{f}"))
    status = (
        F.when(F.col("rows").isNull(), "missing").when(F.col("planned").isNull(), "unexpected").when(F.col("rows") > 1, "duplicate")
        .when(differs, "mismatched").when(~F.col("valid"), "invalid").otherwise("ok")
    )
    return both.select("sample_id", *(F.coalesce(f, f"o_{f}").alias(f) for f in fields), status.alias("status"))


def route(plan: DataFrame, routes: DataFrame) -> DataFrame:
    """Plan rows with the criteria that listeners rate them by.

    A route selects all samples, categories (``wanted``), samples with lexical anchors (``anchored``), or either of these two.
    """
    r = routes.alias("r")
    match = F.expr(
        "r.selector = 'all_samples' or (r.selector in ('categories', 'categories_or_lexical_anchors') and array_contains(r.wanted, category))"
        " or (r.selector in ('lexical_anchors', 'categories_or_lexical_anchors') and anchored)"
    )
    return plan.join(F.broadcast(r), match).select("sample_id", "candidate_id", "prompt_id", "criterion")
