"""Blind listening from assignment to aggregated ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import listening, plan, stats
from .checks import ContractViolation, require_empty

#: What a route may select by, and which way a criterion is better.
SELECTORS = ("all_samples", "categories", "lexical_anchors", "categories_or_lexical_anchors")
BY_CATEGORY = ("categories", "categories_or_lexical_anchors")
DIRECTIONS = ("higher_is_better", "lower_is_better")
_LABELS = ("review_prompt", "low_label", "high_label")


def routes_frame(spark: SparkSession, routing: dict) -> DataFrame:
    """(place, criterion, selector, direction, review_prompt, low_label, high_label, wanted) of a routing document, or its first breach."""
    raw = routing.get("routes") if isinstance(routing, dict) else None
    if not isinstance(raw, list) or not raw:
        raise ContractViolation("routing holds no routes")
    rows = []
    for i, r in enumerate(raw):
        texts = [r.get(k) for k in ("criterion", *_LABELS)] if isinstance(r, dict) else [None]
        if any(not isinstance(t, str) or not t.strip() for t in texts) or r.get("selector") not in SELECTORS or r.get("direction") not in DIRECTIONS:
            raise ContractViolation(f"route {i} lacks a criterion, label, selector or direction")
        wanted = r.get("categories")
        by_category = r["selector"] in BY_CATEGORY
        if by_category != bool(wanted) or (wanted is not None and not by_category) or (by_category and (any(not isinstance(c, str) or not c.strip() for c in wanted) or len({c.strip() for c in wanted}) < len(wanted))):
            raise ContractViolation(f"route {i}: categories go with the selectors by category, each once")
        rows.append((i, texts[0].strip(), r["selector"], r["direction"], *(t.strip() for t in texts[1:]), [c.strip() for c in wanted or []]))
    if len({r[1] for r in rows}) < len(rows):
        raise ContractViolation("criteria routed twice")
    return spark.createDataFrame(rows, "place int, criterion string, selector string, direction string, review_prompt string, low_label string, high_label string, wanted array<string>")


def assignment(generation_plan: DataFrame, routes: DataFrame, allow_unmatched: bool = False) -> DataFrame:
    """(criterion, sample_id, candidate_id, prompt_id) by the routes.

    Each route must match samples (unless ``allow_unmatched``), for every candidate those of the same prompts and seeds; each
    sample must have a criterion; all candidates must be planned for the same prompts and seeds, whose category and text do not change.
    ``routes`` is a short configured list; the plan may have a column lexical_anchors.
    """
    require_empty(routes.where(~F.col("selector").isin(*SELECTORS)).select("criterion", "selector"), "unknown selectors")
    require_empty(routes.groupBy("criterion").count().where("count > 1"), "criteria routed twice")
    keys = ["candidate_id", "prompt_id", "seed"]
    require_empty(generation_plan.groupBy(*keys).count().where("count > 1"), "planned twice")
    shape = [c for c in ("category", "text", "instruction") if c in generation_plan.columns]
    if shape:
        require_empty(generation_plan.groupBy("prompt_id").agg(F.countDistinct(F.struct(*shape)).alias("shapes")).where("shapes > 1"), "prompts that change across candidates or seeds")
    anchored = F.coalesce(F.size("lexical_anchors") > 0, F.lit(False)) if "lexical_anchors" in generation_plan.columns else F.lit(False)
    out = plan.route(generation_plan.withColumn("anchored", anchored), routes)
    if not allow_unmatched:
        require_empty(routes.join(out, "criterion", "left_anti").select("criterion"), "criteria without samples")
    require_empty(generation_plan.join(out, "sample_id", "left_anti").select("sample_id"), "samples without a criterion")
    per = out.join(generation_plan.select("sample_id", "seed"), "sample_id").unionByName(generation_plan.select("sample_id", "candidate_id", "prompt_id", "seed", F.lit(None).cast("string").alias("criterion")))
    per = per.groupBy("criterion", "candidate_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64("prompt_id", "seed").cast("decimal(38,0)")).alias("keys"))
    candidates = generation_plan.agg(F.countDistinct("candidate_id").alias("all"))
    kinds = per.groupBy("criterion").agg(F.countDistinct("n", "keys").alias("kinds"), F.count("*").alias("candidates")).crossJoin(F.broadcast(candidates))
    require_empty(kinds.where("kinds > 1 or candidates < all").select("criterion"), "candidates with different prompts")
    return out


def blind_pack(assigned: DataFrame, pack_id: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(review, reveal): what raters see, and what tells candidates apart, kept in separate tables."""
    samples = assigned.groupBy("sample_id", "candidate_id", "prompt_id").agg(F.array_sort(F.collect_set("criterion")).alias("criteria")).withColumn("pack_id", F.lit(pack_id))
    labelled = listening.blind_labels(samples, seed, ["pack_id"])
    return labelled.select("pack_id", "blind_id", "prompt_id", "criteria"), labelled.select("pack_id", "blind_id", "sample_id", "candidate_id")


def rater_packet(schedule: DataFrame, review: DataFrame, rater_id: str, criteria: list[str]) -> DataFrame:
    """One rater's tasks in order: criterion by criterion, each in the order of presentation."""
    own = schedule.where(F.col("rater_id") == rater_id).join(review, "blind_id").select("rater_id", "position", "blind_id", F.explode("criteria").alias("criterion"))
    place = F.array_position(F.array(*(F.lit(c) for c in criteria)), F.col("criterion"))
    task = F.row_number().over(Window.partitionBy("rater_id").orderBy(place, "position"))
    return own.where(place > 0).select("rater_id", task.alias("task"), "criterion", "position", "blind_id")


def submission(packet: DataFrame, scores: DataFrame, low: float, high: float, allow_incomplete: bool = False) -> DataFrame:
    """A rater's scores bound to the packet: (rater_id, task, criterion, blind_id, score).

    Scores must be finite and within the scale, name tasks of the packet once each, and cover them in order
    from the first; all of them unless ``allow_incomplete``.
    """
    keys = ["rater_id", "criterion", "blind_id"]
    require_empty(scores.where(F.col("score").isNull() | F.isnan("score") | (F.col("score") < low) | (F.col("score") > high)).select(*keys), "scores off the scale")
    require_empty(scores.groupBy(*keys).count().where("count > 1"), "rated twice")
    require_empty(scores.join(packet, keys, "left_anti").select(*keys), "ratings of nothing in the packet")
    out = packet.join(scores.select(*keys, "score"), keys)
    gaps = out.groupBy("rater_id").agg(F.max("task").alias("last"), F.count("*").alias("n")).where("last <> n")
    require_empty(gaps, "ratings that skip earlier tasks")
    if not allow_incomplete:
        require_empty(packet.join(scores, keys, "left_anti").select(*keys), "tasks without a rating")
    return out.select("rater_id", "task", "criterion", "blind_id", "score")


def results(ratings: DataFrame, reveal: DataFrame, expected: DataFrame) -> dict[str, DataFrame]:
    """Aggregates by candidate and by sample, agreement by criterion, and what is missing.

    ``ratings(rater_id, criterion, blind_id, score)``; ``expected(rater_id, criterion, blind_id)``.
    """
    require_empty(ratings.join(reveal, "blind_id", "left_anti").select("blind_id"), "ratings of unknown samples")
    named = ratings.join(reveal.select("blind_id", "candidate_id"), "blind_id")
    return {
        "candidates": listening.aggregate(named, ["candidate_id", "criterion"]), "samples": listening.aggregate(ratings, ["blind_id", "criterion"]),
        "agreement": stats.krippendorff_interval(ratings, "blind_id", "score", ["criterion"]), "missing": listening.missing_ratings(expected, ratings, ["rater_id", "criterion", "blind_id"]),
    }
