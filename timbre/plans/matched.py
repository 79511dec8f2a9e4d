"""Matched comparison of two candidates over a frozen generation plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import match, score, stats
from .checks import ContractViolation, require_empty
from .extraction import PROSODY


def bind_to_plan(obs: DataFrame, plan: DataFrame, candidates: list[str]) -> DataFrame:
    """Observations of ``candidates``, after checking that they cover the plan exactly, once, with its ids and texts (stripped)."""
    own = obs.where(F.col("candidate_id").isin(candidates))
    planned = plan.where(F.col("candidate_id").isin(candidates))
    require_empty(own.groupBy("sample_id").count().where("count > 1"), "sample ids repeat")
    require_empty(planned.join(own, "sample_id", "left_anti").select("sample_id"), "planned samples without an observation")
    require_empty(own.join(planned, "sample_id", "left_anti").select("sample_id"), "observations that are not planned")
    p = planned.select("sample_id", *(F.col(c).alias(f"p_{c}") for c in ("candidate_id", "prompt_id", "seed", "text")), *(["category"] if "category" in planned.columns and "category" not in own.columns else []))
    both = own.join(p, "sample_id")
    same = F.col("candidate_id").eqNullSafe(F.col("p_candidate_id")) & F.col("prompt_id").eqNullSafe(F.col("p_prompt_id")) & F.col("seed").eqNullSafe(F.col("p_seed")) & F.trim("requested_text").eqNullSafe(F.trim("p_text"))
    require_empty(both.where(~same).select("sample_id"), "observations that differ from the plan")
    return both.drop("p_candidate_id", "p_prompt_id", "p_seed", "p_text")


def one_signature(obs: DataFrame, kind: str) -> None:
    """All evidence of ``kind`` must come from one extractor in one revision."""
    e = obs.select(F.try_element_at("evidence", F.lit(kind)).alias("e")).where("e is not null")
    require_empty(e.agg(F.countDistinct("e.extractor", "e.revision").alias("signatures")).where("signatures > 1"), f"{kind} evidence of several extractors")


def compare_matched(obs: DataFrame, plan: DataFrame, baseline: str, adapted: str, metrics: list[str], required: list[str] | None = None) -> dict[str, DataFrame]:
    """pairs, deltas, summary, category and validity of the matched pairs.

    A metric that the plan requires must be there on both sides of each pair with two valid
    sides; a metric on one side only gives no delta.  Null deltas stay null.
    """
    bound = bind_to_plan(obs, plan, [baseline, adapted])
    require_empty(match.key_difference(bound, baseline, adapted), "pairs that one side lacks")
    if "evidence" in bound.columns:
        for kind in ("asr", "speaker_encoder", "audio_probe", "runtime"):
            one_signature(bound, kind)
    long = score.long_form(score.real_time_factor(bound), metrics)
    delta = match.deltas(long, baseline, adapted, ["category"])
    pair = match.pairs(bound, baseline, adapted, ["valid"])
    whole = pair.where("b_valid and a_valid")
    for m in required or []:
        require_empty(whole.join(delta.where(F.col("metric") == m), match.PAIR, "left_anti").select(*match.PAIR), f"pairs without the required metric {m}")
    return {"pairs": pair, "deltas": delta, "summary": match.delta_summary(delta, []), "category": match.delta_summary(delta, ["category"]), "validity": match.validity(pair)}


def intervals(deltas: DataFrame, keys: list[str], seed: int = 0, draws: int = stats.DRAWS) -> DataFrame:
    """Bootstrap intervals of a comparison's deltas, in the order of (prompt, seed)."""
    rank = deltas.withColumn("place", F.concat_ws("\u0001", "prompt_id", F.lpad(F.col("seed").cast("string"), 20, "0")))
    return stats.bootstrap_exact(rank, [*keys, "metric"], "delta", "place", seed, draws)


def compare_prosody(obs: DataFrame, plan: DataFrame, baseline: str, adapted: str, fields: list[str] | None = None) -> dict[str, DataFrame]:
    """Deltas of waveform proxies by pair, with a status for each, and their summary without any direction."""
    fields = fields or [f for f in PROSODY if f in obs.columns]
    if not fields:
        raise ContractViolation("the observations hold no prosody fields")
    bound = bind_to_plan(obs, plan, [baseline, adapted])
    require_empty(match.key_difference(bound, baseline, adapted), "pairs that one side lacks")
    pair = match.pairs(bound, baseline, adapted, ["valid", *fields])
    status = F.when(~F.col("b_valid") | ~F.col("a_valid"), "invalid_side").otherwise("compared")
    parts = ", ".join(f"'{f}', cast(b_{f} as double), cast(a_{f} as double)" for f in fields)
    long = pair.withColumn("status", status).select(*match.PAIR, "status", F.expr(f"stack({len(fields)}, {parts}) as (proxy, b_value, a_value)"))
    long = long.withColumn("delta", F.when(F.col("status") == "compared", F.col("a_value") - F.col("b_value")))
    summary = long.groupBy("proxy").agg(F.count("delta").alias("n"), F.count_if(F.col("delta").isNull()).alias("null_pairs"), F.avg("delta").alias("mean"), F.median("delta").alias("median"))
    return {"pairs": long, "summary": summary}


def compare_runtimes(obs: DataFrame, plan: DataFrame, baseline: str, adapted: str, metrics: list[str]) -> dict[str, DataFrame]:
    """The matched comparison of one model in two runtimes: each candidate must have exactly one runtime, and they must differ."""
    own = obs.where(F.col("candidate_id").isin(baseline, adapted))
    kinds = own.groupBy("candidate_id").agg(F.countDistinct("runtime_id").alias("runtimes"), F.count_if(F.col("runtime_id").isNull()).alias("without"))
    require_empty(kinds.where("runtimes <> 1 or without > 0"), "candidates without exactly one runtime")
    require_empty(own.agg(F.countDistinct("runtime_id").alias("runtimes")).where("runtimes < 2"), "both candidates in one runtime")
    return compare_matched(obs, plan, baseline, adapted, metrics)
