"""Scoring, planning and matched-comparison queries over events as observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match, plan, rules, score, stats
from ..operators.extract import apply_results
from .views import LONG_SQL, OBS_SQL, long_metrics, observations, rounded, table

STATS = ("mean", "median", "low", "high")
BASE, ADAPTED = "click", "view"
DRAWS = 200


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.metric_summary(long_metrics(spark, sf_dir), ["candidate_id", "metric"]), *STATS)


def metric_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.coverage(long_metrics(spark, sf_dir), ["candidate_id"]), "rate")


def invalid_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.invalid_rate(observations(spark, sf_dir), ["candidate_id"]), "rate")


def rtf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.metric_summary(long_metrics(spark, sf_dir).where("metric = 'real_time_factor'"), ["candidate_id", "category"]), *STATS)


def category_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.strata(long_metrics(spark, sf_dir)), *STATS)


def provenance_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractor and revision read off the event's payload."""
    o = observations(spark, sf_dir).select("candidate_id", "category", F.concat(F.lit("x"), (F.col("k") % 4).cast("string")).alias("extractor"), F.concat(F.lit("r"), (F.col("k") % 3).cast("string")).alias("revision"), (F.col("k") % 5 > 0).alias("bound"))
    return score.provenance(o, ["candidate_id", "category"], ["extractor", "revision"])


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "region").select(F.lower("r_name").alias("candidate_id"))
    prompts = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("prompt_id"), F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("category"))
    seeds = spark.range(1, 4).select(F.col("id").cast("string").alias("seed"))
    return plan.generation_plan(candidates, prompts, seeds)


PLAN_SQL = """plan as (select lower(r_name) candidate_id, lower(n_name) prompt_id, 'g' || n_regionkey category, cast(s as varchar) seed, lower(r_name) || '--' || lower(n_name) || '--seed-' || s sample_id,
  'audio/' || lower(r_name) || '/' || lower(n_name) || '/seed-' || s || '.wav' expected_audio_path from region, nation, range(1, 4) t(s))"""


def generation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The baseline's keys planned for both candidates, against what was observed of both."""
    obs = observations(spark, sf_dir).where(F.col("candidate_id").isin(BASE, ADAPTED))
    keys = obs.where(F.col("candidate_id") == BASE).select("prompt_id", "seed", "category")
    both = keys.withColumn("candidate_id", F.explode(F.array(F.lit(BASE), F.lit(ADAPTED))))
    return both.withColumn("sample_id", F.concat_ws("--", "candidate_id", "prompt_id", F.col("seed").cast("string"))), obs


_COVER_SQL = f"""with {OBS_SQL}, two as (select * from obs where candidate_id in ('{BASE}', '{ADAPTED}')),
planned as (select c candidate_id, prompt_id, seed, category, c || '--' || prompt_id || '--' || seed sample_id from two, (values ('{BASE}'), ('{ADAPTED}')) t(c) where candidate_id = '{BASE}'),
both_ as (select coalesce(p.sample_id, o.sample_id) sample_id, coalesce(p.candidate_id, o.candidate_id) candidate_id, coalesce(p.category, o.category) category,
  case when o.sample_id is null then 'missing' when p.sample_id is null then 'unexpected' when p.category is distinct from o.category then 'mismatched' when not o.valid then 'invalid' else 'ok' end status
  from planned p full join two o on o.sample_id = p.sample_id)"""


def suite_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o = _planned(spark, sf_dir)
    return plan.reconcile(p, o, ["candidate_id", "category"])


def coverage_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o = _planned(spark, sf_dir)
    r = plan.reconcile(p, o, ["candidate_id", "category"])
    return r.groupBy("candidate_id", "category").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "missing", "unexpected", "invalid")), F.count("*").alias("total"))


def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = match.deltas(long_metrics(spark, sf_dir), BASE, ADAPTED, ["category"])
    return rounded(d.select("prompt_id", "seed", "metric", "category", "b_value", "a_value", "delta"), "b_value", "a_value", "delta")


def matched_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(match.delta_summary(match.deltas(long_metrics(spark, sf_dir), BASE, ADAPTED), []), "mean", "median", "improvement")


def matched_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(match.delta_summary(match.deltas(long_metrics(spark, sf_dir), BASE, ADAPTED, ["category"]), ["category"]), "mean", "median", "improvement")


def matched_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(match.validity(match.pairs(observations(spark, sf_dir), BASE, ADAPTED, ["valid"])), "b_rate", "a_rate", "delta")


def pair_symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.key_difference(observations(spark, sf_dir), BASE, ADAPTED)


def metrics_in_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics with a value on both sides, by category: an INTERSECT."""
    long = long_metrics(spark, sf_dir).where("value is not null")
    sides = [long.where(F.col("candidate_id") == c).select("category", "metric") for c in (BASE, ADAPTED)]
    return sides[0].intersect(sides[1])


def matched_anchor_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates of both sides of the pairs and their difference, by category and in all (null category)."""
    p = match.pairs(observations(spark, sf_dir), BASE, ADAPTED, ["valid", "k", "category"]).where("b_valid and a_valid")
    p = p.select(F.col("b_category").alias("category"), (F.col("b_k") >= 50).cast("double").alias("b"), (F.col("a_k") >= 50).cast("double").alias("a"))
    out = p.rollup("category").agg(F.count("*").alias("pairs"), F.avg("b").alias("b_rate"), F.avg("a").alias("a_rate"))
    return rounded(out.withColumn("delta", F.col("a_rate") - F.col("b_rate")), "b_rate", "a_rate", "delta")


def _pair_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = match.deltas(long_metrics(spark, sf_dir), BASE, ADAPTED)
    return d.withColumn("place", F.concat_ws(":", "prompt_id", F.lpad(F.col("seed").cast("string"), 4, "0")))


def bootstrap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap_exact(_pair_deltas(spark, sf_dir), ["metric"], "delta", "place")


def bootstrap_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.bootstrap_hash(_pair_deltas(spark, sf_dir), ["metric"], "delta", "place", DRAWS), "low", "high", digits=4)


def observation_rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults put into the observations by their payload, found again by the rules."""
    k = F.col("k")
    o = observations(spark, sf_dir).select(
        "sample_id", F.when(k % 11 == 0, F.upper("candidate_id")).otherwise(F.col("candidate_id")).alias("candidate_id"), "prompt_id", F.when(k % 13 == 0, "  ").otherwise("said").alias("requested_text"),
        "valid", F.when(k % 17 == 0, -F.col("seed")).otherwise(F.col("seed")).alias("seed"), F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(F.col("generation_seconds")).alias("generation_seconds"),
        "audio_duration_seconds", "peak_memory_bytes", (k / 90).alias("silence_fraction"), F.lit(None).cast("double").alias("clipping_fraction"), F.when(k % 5 == 0, "abc").otherwise(F.sha2("sample_id", 256)).alias("audio_sha256"),
        F.when(k % 3 == 0, "set").alias("artifact_set_id"), F.when(k % 6 == 0, "digest").alias("artifact_set_sha256"),
    )
    return rules.failures(o, rules.observation_rules(), "sample_id")


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat_ws("--", "event_type", F.col("user_id").cast("string"), F.dayofyear("ts").cast("string")).alias("sample_id"))
    return rules.repeats(e, "sample_id")


def apply_results_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results made from the other candidates' rows: outcomes by candidate."""
    o = observations(spark, sf_dir)
    results = o.where("k % 4 > 0").select("sample_id", (F.col("k") / 10).alias("score"), F.when(F.col("k") % 9 == 0, "failed").otherwise("complete").alias("status"))
    held = o.withColumn("score", F.when(F.col("k") % 10 == 0, F.lit(1.0)))
    return rounded(apply_results(held, results, "score").groupBy("candidate_id", "outcome").agg(F.count("*").alias("n"), F.sum("score").alias("score")), "score")


def historical_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    return o.groupBy("candidate_id").agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in ("audio_duration_seconds", "generation_seconds", "k")), F.count_if(F.col("valid")).alias("valid"))


QUERIES = {f.__name__: f for f in (
    metric_summary, metric_coverage, invalid_rate, rtf_summary, category_strata, provenance_signatures, generation_plan, suite_coverage, coverage_by_category, matched_pairs, matched_summary, matched_category,
    matched_validity, pair_symmetric_difference, metrics_in_common, matched_anchor_delta, bootstrap_exact, bootstrap_hash, observation_rule_errors, duplicate_ids, apply_results_merge, historical_null_counts,
)}

_SUMMARY = "count(value) n, round(avg(value), 6) mean, round(median(value), 6) median, round(min(value), 6) low, round(max(value), 6) high"
_DELTAS = f"""with {LONG_SQL}, d as (select b.prompt_id, b.seed, b.metric, b.category, b.value b_value, a.value a_value, a.value - b.value delta
  from long b join long a on a.prompt_id = b.prompt_id and a.seed = b.seed and a.metric = b.metric where b.candidate_id = '{BASE}' and a.candidate_id = '{ADAPTED}' and a.value is not null and b.value is not null)"""
_SIGN = "case metric when 'audio_duration_seconds' then null else -1 end"
_DELTA_SUMMARY = f"count(delta) n, round(avg(delta), 6) mean, round(median(delta), 6) median, round(avg(delta) * {_SIGN}, 6) improvement"

SQL = {
    "metric_summary": f"with {LONG_SQL} select candidate_id, metric, {_SUMMARY} from long where value is not null group by all",
    "metric_coverage": f"with {LONG_SQL} select candidate_id, metric, count(value) observed, count(*) filter (valid or metric in ('generation_seconds', 'peak_memory_bytes')) eligible, round(count(value) / nullif(count(*) filter (valid or metric in ('generation_seconds', 'peak_memory_bytes')), 0), 6) rate from long group by all",
    "invalid_rate": f"with {OBS_SQL} select candidate_id, count(*) total, count(*) filter (not valid) invalid, round(avg(case when valid then 0.0 else 1.0 end), 6) rate from obs group by all",
    "rtf_summary": f"with {LONG_SQL} select candidate_id, category, {_SUMMARY} from long where metric = 'real_time_factor' and value is not null group by all",
    "category_strata": f"with {LONG_SQL} select candidate_id, metric, category, {_SUMMARY} from long where value is not null group by grouping sets ((candidate_id, metric), (candidate_id, metric, category))",
    "provenance_signatures": f"with {OBS_SQL} select candidate_id, category, count(distinct ('x' || k % 4, 'r' || k % 3)) signatures, count(*) filter (k % 5 > 0) bound, count(*) filter (k % 5 = 0) unbound, count(distinct ('x' || k % 4, 'r' || k % 3)) = 1 consistent from obs group by all",
    "generation_plan": f"with {PLAN_SQL} select candidate_id, prompt_id, category, seed, sample_id, expected_audio_path from plan",
    "suite_coverage": f"{_COVER_SQL} select sample_id, candidate_id, category, status from both_",
    "coverage_by_category": f"{_COVER_SQL} select candidate_id, category, count(*) filter (status = 'ok') ok, count(*) filter (status = 'missing') missing, count(*) filter (status = 'unexpected') unexpected, count(*) filter (status = 'invalid') invalid, count(*) total from both_ group by all",
    "matched_pairs": f"{_DELTAS} select prompt_id, seed, metric, category, round(b_value, 6) b_value, round(a_value, 6) a_value, round(delta, 6) delta from d",
    "matched_summary": f"{_DELTAS} select metric, {_DELTA_SUMMARY} from d group by metric",
    "matched_category": f"{_DELTAS} select category, metric, {_DELTA_SUMMARY} from d group by category, metric",
    "matched_validity": f"with {OBS_SQL}, p as (select b.valid bv, a.valid av from obs b join obs a using (prompt_id, seed) where b.candidate_id = '{BASE}' and a.candidate_id = '{ADAPTED}') select count(*) pairs, count(*) filter (bv) b_valid, count(*) filter (av) a_valid, round(avg(bv::int), 6) b_rate, round(avg(av::int), 6) a_rate, round(avg(av::int) - avg(bv::int), 6) delta from p",
    "pair_symmetric_difference": f"with {OBS_SQL}, b as (select prompt_id, seed from obs where candidate_id = '{BASE}'), a as (select prompt_id, seed from obs where candidate_id = '{ADAPTED}') select *, '{ADAPTED}' missing from (select * from b except select * from a) union all select *, '{BASE}' from (select * from a except select * from b)",
    "metrics_in_common": f"with {LONG_SQL} select category, metric from long where value is not null and candidate_id = '{BASE}' intersect select category, metric from long where value is not null and candidate_id = '{ADAPTED}'",
    "matched_anchor_delta": f"with {OBS_SQL}, p as (select b.category, (b.k >= 50)::int bh, (a.k >= 50)::int ah from obs b join obs a using (prompt_id, seed) where b.candidate_id = '{BASE}' and a.candidate_id = '{ADAPTED}' and b.valid and a.valid) select category, count(*) pairs, round(avg(bh), 6) b_rate, round(avg(ah), 6) a_rate, round(avg(ah) - avg(bh), 6) delta from p group by rollup (category)",
    "bootstrap_hash": f"""{_DELTAS}, v as (select metric, delta, prompt_id || ':' || lpad(seed::varchar, 4, '0') place from d),
h as (select metric, delta, b, md5('0:' || b || ':' || place) h from v, range(0, {DRAWS} // 4) t(b)),
p as (select metric, delta, b * 4 + q draw, ('0x' || substr(h, cast(q * 8 + 1 as int), 8))::bigint / 4294967296.0::double u from h, range(0, 4) t(q)),
w as (select metric, delta, draw, {' + '.join(f'(u >= {x!r}::double)::int' for x in stats.POISSON)} w from p),
m as (select metric, draw, count(*) n, sum(w * delta) / nullif(sum(w), 0) m from w group by all)
select metric, n, round(quantile_cont(m, 0.025), 4) low, round(quantile_cont(m, 0.975), 4) high from m group by metric, n""",
    "observation_rule_errors": f"""with {OBS_SQL}, r as (select sample_id, unnest([
  case when k % 11 = 0 then 'candidate_id_identifier' end, case when k % 13 = 0 then 'requested_text_required' end, case when k % 17 = 0 then 'seed_nonnegative' end, case when k % 7 = 0 then 'generation_seconds_range' end,
  case when k / 90 > 1 then 'silence_fraction_range' end, case when k % 5 = 0 then 'audio_sha256_sha256' end, case when k % 3 = 0 and k % 6 <> 0 then 'artifact_set_id_artifact_set_sha256_together' end]) as rule from obs)
select sample_id, rule from r where rule is not null""",
    "duplicate_ids": "select event_type || '--' || user_id || '--' || dayofyear(ts) sample_id, count(*) n from events group by 1 having count(*) > 1",
    "apply_results_merge": f"""with {OBS_SQL}, o as (select candidate_id, case when k % 10 = 0 then 1.0 end score, k / 10 r_value, case when not valid then 'excluded' when k % 4 = 0 then 'uncovered' when k % 10 = 0 then 'conflict' when k % 9 = 0 then 'failed' else 'applied' end outcome from obs)
select candidate_id, outcome, count(*) n, round(sum(case when outcome = 'applied' then r_value else score end), 6) score from o group by all""",
    "historical_null_counts": f"with {OBS_SQL} select candidate_id, count(*) as rows, count(*) filter (audio_duration_seconds is null) audio_duration_seconds_null, count(*) filter (generation_seconds is null) generation_seconds_null, count(*) filter (k is null) k_null, count(*) filter (valid) as valid from obs group by all",
}
