"""The objective report: nine metrics by sample, candidate and category, with provenance, plan bindings and lexical anchors.

Samples become one long metric table; every part of the report is a grouping of it.  The report is
built whole or not at all: rows that break the contract stop it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.identity import canonical_sha256
from ..functions.vectors import cosine
from ..operators import rules, score, stats
from ..operators.rules import Rule
from .checks import ContractViolation, require_empty
from .packs import VERSIONS, anchor_breaches

# Metrics in the order of their seeds, and what evidence each asks for.
METRICS = (
    "asr_word_error_rate", "speaker_embedding_similarity", "real_time_factor", "generation_seconds", "audio_duration_seconds", "peak_memory_bytes", "sample_rate_hz", "silence_fraction", "clipping_fraction",
)
EVIDENCE_OF = {"asr": ("hypothesis_text",), "speaker_encoder": ("reference_speaker_embedding", "reference_speaker_embeddings", "speaker_embedding"), "runtime": ("generation_seconds", "audio_duration_seconds", "peak_memory_bytes"), "audio_probe": ("sample_rate_hz", "silence_fraction", "clipping_fraction")}
REFERENCE_FIELDS = (
    "reference_id", "reference_audio_sha256", "reference_transcript_sha256", "reference_aggregation", "reference_set_sha256", "references", "reference_catalog_sha256", "reference_assignment_plan_sha256",
    "reference_assignment_sha256",
)
SIGNATURE = ("extractor", "revision", "extractor_artifact_set_sha256", "reference_id", "reference_audio_sha256", "reference_transcript_sha256", "reference_aggregation")
MEAN_OF_REFERENCES = "mean_cosine_v1"
SEED, CATEGORY_SEED = 20260812, 100_000
BOUND = ("candidate_id", "prompt_id", "seed", "requested_text")
STATUSES = ("hit", "miss", "asr_unavailable", "invalid_output")


def _evidence(kind: str):
    return F.try_element_at("evidence", F.lit(kind))


def scoring_rules() -> list[Rule]:
    """What an observation must keep to be scored, beside the observation rules."""
    out = rules.observation_rules()
    out += [
        Rule("one_kind_of_reference", F.col("reference_speaker_embedding").isNull() | F.col("reference_speaker_embeddings").isNull()),
        Rule("both_embeddings", F.col("speaker_embedding").isNotNull() == (F.col("reference_speaker_embedding").isNotNull() | F.col("reference_speaker_embeddings").isNotNull())),
        Rule("positive_duration", F.col("audio_duration_seconds").isNull() | (F.col("audio_duration_seconds") > 0)),
        Rule("whole_sample_rate", F.col("sample_rate_hz").isNull() | ((F.col("sample_rate_hz") > 0) & (F.col("sample_rate_hz") == F.floor("sample_rate_hz")))),
    ]
    for kind, fields in EVIDENCE_OF.items():
        e = _evidence(kind)
        asked = F.lit(False)
        for f in fields:
            asked = asked | F.col(f).isNotNull()
        named = (F.length(F.trim(e["extractor"])) > 0) & (F.length(F.trim(e["revision"])) > 0)
        out.append(Rule(f"evidence_{kind}", ~asked | F.coalesce(named, F.lit(False))))
        artifacts, heard = e["extractor_artifact_set_sha256"], e["input_audio_sha256"]
        out.append(Rule(f"evidence_{kind}_artifacts", artifacts.isNull() | artifacts.rlike(rules.SHA256)))
        if kind != "runtime":
            out.append(Rule(f"evidence_{kind}_audio", heard.isNull() | F.coalesce(heard == F.col("audio_sha256"), F.lit(False))))
        if kind != "speaker_encoder":
            none = F.lit(True)
            for f in REFERENCE_FIELDS:
                none = none & e[f].isNull()
            out.append(Rule(f"evidence_{kind}_without_reference", none))
    return out


def _embedding_similarity():
    """Cosine to the one reference, or the mean over several; null if any has none."""
    each = F.transform("reference_speaker_embeddings", lambda r: cosine(F.col("speaker_embedding"), r["embedding"]))
    several = F.when((F.size(each) > 0) & ~F.exists(each, lambda c: c.isNull()), F.aggregate(each, F.lit(0.0), lambda s, c: s + c) / F.size(each))
    return F.when(F.col("reference_speaker_embeddings").isNotNull(), several).otherwise(cosine(F.col("reference_speaker_embedding"), F.col("speaker_embedding")))


def with_metrics(obs: DataFrame) -> DataFrame:
    """Observations with all of ``METRICS`` as columns; a metric that was not observed is null."""
    toks = obs.withColumns({"_r": T.tokens(F.trim("requested_text")), "_h": T.tokens(F.col("hypothesis_text"))})
    out = T.with_word_errors(toks, "_r", "_h").withColumn("asr_word_error_rate", F.when(F.col("hypothesis_text").isNotNull(), F.col("wer"))).drop("_r", "_h", "edits", "wer")
    return score.real_time_factor(out.withColumn("speaker_embedding_similarity", _embedding_similarity()))


def _planned(obs: DataFrame, plan: DataFrame, what: str) -> DataFrame:
    """Observations with their planned row as ``p``; all must be planned, with the same candidate, prompt, seed and text."""
    require_empty(plan.groupBy("sample_id").count().where("count > 1"), f"{what} plan repeats samples")
    both = obs.join(plan.select("sample_id", F.struct("*").alias("p")), "sample_id", "left")
    require_empty(both.where("p is null").select("sample_id"), f"observations absent from the {what} plan")
    differs = F.lit(False)
    for c in BOUND:
        differs = differs | ~F.col(c).eqNullSafe(F.col("p")["text" if c == "requested_text" else c])
    require_empty(both.where(differs).select("sample_id"), f"observations that differ from the {what} plan")
    return both


def reference_text(obs: DataFrame, plan: DataFrame | None, plan_sha256: str | None) -> dict:
    """Whether requested texts come from the plan or only from the observations."""
    heard = obs.where("hypothesis_text is not null")
    n = heard.agg(F.count("*").alias("observed"), F.count_if(F.col("valid")).alias("scored")).first()
    if plan is not None:
        _planned(heard, plan, "reference text")
    bound = n["scored"] if plan is not None else 0
    return {
        "mode": "declared_observation" if plan is None else "generation_plan", "generation_plan_sha256": plan_sha256, "observed_reference_count": n["observed"], "scored_reference_count": n["scored"],
        "plan_bound_reference_count": bound, "all_scored_references_plan_bound": (plan is not None) if n["scored"] else None,
    }


def bind_categories(obs: DataFrame, plan: DataFrame | None, plan_sha256: str | None) -> tuple[DataFrame, dict]:
    """Observations with the plan's category (trimmed, or null), and how far the binding reaches."""
    if plan is None:
        total = obs.count()
        return obs.withColumn("category", F.lit(None).cast("string")), {
            "mode": "unavailable", "generation_plan_sha256": None, "planned_sample_count": None, "planned_categorized_sample_count": None, "planned_uncategorized_sample_count": None,
            "categorized_sample_count": 0, "uncategorized_sample_count": total,
        }
    require_empty(plan.where("category is not null and trim(category) = ''").select("sample_id"), "planned categories must not be blank")
    trimmed = plan.withColumn("category", F.trim("category"))
    kinds = trimmed.groupBy("prompt_id").agg(F.countDistinct(F.coalesce("category", F.lit(""))).alias("kinds"))
    require_empty(kinds.where("kinds > 1").select("prompt_id"), "prompts of several categories")
    both = _planned(obs.drop("category"), trimmed, "category").withColumn("category", F.col("p.category")).drop("p")
    p = trimmed.agg(F.count("*").alias("n"), F.count("category").alias("with")).first()
    o = both.agg(F.count("*").alias("n"), F.count("category").alias("with")).first()
    return both, {
        "mode": "generation_plan" if p["n"] == p["with"] and o["n"] == o["with"] else "partial_generation_plan", "generation_plan_sha256": plan_sha256, "planned_sample_count": p["n"],
        "planned_categorized_sample_count": p["with"], "planned_uncategorized_sample_count": p["n"] - p["with"], "categorized_sample_count": o["with"], "uncategorized_sample_count": o["n"] - o["with"],
    }


def anchors_of(plan: DataFrame) -> DataFrame:
    """(sample_id, prompt_id, anchor_id, surface, forms): planned anchors as folded phrases, after checking their rules.

    Anchors belong to prompts, which are few; their rules are checked there.
    """
    held = plan.where("lexical_anchors is not null").select("prompt_id", "text", F.to_json("lexical_anchors").alias("a")).distinct()
    require_empty(plan.groupBy("prompt_id").agg(F.countDistinct(F.coalesce(F.to_json("lexical_anchors"), F.lit(""))).alias("sets")).where("sets > 1").select("prompt_id"), "prompts with several anchor sets")
    # as many rows as a pack has prompts with anchors
    found = [(r["prompt_id"], p, rule) for r in held.toLocalIterator() for p, rule in anchor_breaches(json.loads(r["a"]), r["text"], "lexical_anchors")]
    if found:
        raise ContractViolation("lexical anchors: " + "; ".join(f"{x} {p}: {rule}" for x, p, rule in found[:5]))
    each = plan.select("sample_id", "prompt_id", F.explode("lexical_anchors").alias("x"))
    forms = F.array_sort(F.transform("x.accepted_asr_forms", lambda f: T.phrase(f)))
    return each.select("sample_id", "prompt_id", F.col("x.anchor_id").alias("anchor_id"), T.phrase(F.col("x.surface")).alias("surface"), forms.alias("forms"))


def anchor_results(obs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each planned anchor of each observation with its status and the first accepted form that was heard."""
    heard = obs.select("sample_id", "candidate_id", "valid", F.col("hypothesis_text").isNull().alias("unheard"), T.tokens(F.coalesce("hypothesis_text", F.lit(""))).alias("toks"))
    both = heard.join(anchors, "sample_id").withColumn("said", F.concat(F.lit(" "), F.array_join("toks", " "), F.lit(" ")))
    form = F.get(F.filter("forms", lambda f: F.contains(F.col("said"), F.concat(F.lit(" "), f, F.lit(" ")))), F.lit(0))
    status = F.when(~F.col("valid"), "invalid_output").when(F.col("unheard"), "asr_unavailable").when(form.isNotNull(), "hit").otherwise("miss")
    out = both.withColumn("status", status)
    return out.select("sample_id", "candidate_id", "prompt_id", "anchor_id", "surface", "forms", "status", F.when(F.col("status") == "hit", form).alias("matched_form"))


def anchor_summary(results: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    out = results.groupBy("candidate_id", "prompt_id", "anchor_id").agg(F.min("surface").alias("surface"), F.count("*").alias("planned"), *counts)
    return out.withColumn("evaluable", F.col("hit") + F.col("miss")).withColumn("hit_rate", F.try_divide("hit", "evaluable"))


def provenance(obs: DataFrame) -> DataFrame:
    """(kind, signature fields, rows, content_bound): distinct evidence of the kinds that the observations need.

    Content-bound: heard audio and extractor artifacts are named; a speaker measurement also names its references and itself,
    a runtime its attempt.
    """
    parts = None
    for kind, fields in EVIDENCE_OF.items():
        asked = F.lit(False)
        for f in fields:
            asked = asked | F.col(f).isNotNull()
        e = obs.where(asked).select(F.lit(kind).alias("kind"), _evidence(kind).alias("e"))
        parts = e if parts is None else parts.unionByName(e)
    bound = F.when(F.col("kind") == "runtime", F.col("e.attempt_sha256").isNotNull() & F.col("e.generation_plan_sha256").isNotNull() & F.col("e.planned_sample_sha256").isNotNull() & F.col("e.source_generation_observation_sha256").isNotNull()).otherwise(
        F.col("e.input_audio_sha256").isNotNull() & F.col("e.extractor_artifact_set_sha256").isNotNull() & ((F.col("kind") != "speaker_encoder") | (F.col("e.speaker_measurement_sha256").isNotNull() & F.coalesce("e.reference_set_sha256", "e.reference_audio_sha256").isNotNull()))
    )
    fields = [F.trim(F.col(f"e.{c}")).alias(c) if c in SIGNATURE[:2] else F.col(f"e.{c}").alias(c) for c in SIGNATURE]
    return parts.select("kind", *fields, F.col("e.reference_set_sha256").alias("reference_set"), bound.alias("bound")).groupBy("kind", *SIGNATURE).agg(F.count("*").alias("rows"), F.count_if("bound").alias("content_bound"), F.array_sort(F.collect_set("reference_set")).alias("reference_sets"))


def _intervals(long: DataFrame, keys: list[str], base: int, step: int, first: int) -> DataFrame:
    """Summaries of ``long`` with intervals; the k-th key, in order, has the seeds base + k * step + first + number of the metric."""
    places = long.select(*keys).distinct().withColumn("k", F.row_number().over(Window.orderBy(*keys)) - 1)
    number = F.array_position(F.array(*(F.lit(m) for m in METRICS)), F.col("metric")) - 1
    held = long.where("value is not null").join(F.broadcast(places), keys).withColumn("seed_", F.lit(base) + F.col("k") * step + first + number)
    ends = stats.bootstrap_exact(held, [*keys, "metric"], "value", "_ord", "seed_").select(*keys, "metric", F.col("low").alias("ci_low"), F.col("high").alias("ci_high"))
    return score.metric_summary(held, [*keys, "metric"]).join(ends, [*keys, "metric"])


def score_objective(obs: DataFrame, plan: DataFrame | None = None, plan_sha256: str | None = None, seed: int = SEED) -> dict:
    """Parts of the report: DataFrames samples (long), candidates, coverage, validity, categories, category_coverage, provenance and anchors, and the bindings as dicts.

    ``obs`` has the columns of ``documents.FULL_OBSERVATION`` and ``_ord``, its place in the document.
    """
    require_empty(obs.groupBy("sample_id").count().where("count > 1"), "sample ids repeat")
    require_empty(rules.failures(obs, scoring_rules(), "sample_id"), "observations break the contract")
    texts = reference_text(obs, plan, plan_sha256)
    bound, categories = bind_categories(obs, plan, plan_sha256)
    measured = with_metrics(bound)
    require_empty(measured.where("speaker_embedding is not null and speaker_embedding_similarity is null").select("sample_id"), "speaker embeddings without a cosine")
    long = score.long_form(measured, list(METRICS), ["_ord"])
    shaped = long.where("category is not null")
    results = anchor_results(obs, anchors_of(plan)) if plan is not None and "lexical_anchors" in plan.columns else None
    return {
        "reference_text": texts, "category_binding": categories, "seed": seed, "samples": long, "candidates": _intervals(long, ["candidate_id"], seed, 1000, 1), "coverage": score.coverage(long, ["candidate_id"]),
        "validity": score.invalid_rate(obs, ["candidate_id"]), "categories": _intervals(shaped, ["candidate_id", "category"], seed + CATEGORY_SEED, 100, 0),
        "category_coverage": score.coverage(shaped, ["candidate_id", "category"]), "provenance": provenance(obs), "anchor_results": results, "anchors": None if results is None else anchor_summary(results),
    }


def plan_digest(plan: dict) -> str:
    """Digest of a plan document that may be scored against."""
    if not isinstance(plan, dict) or plan.get("schema_version") not in VERSIONS or not plan.get("samples"):
        raise ContractViolation("the plan must be of a known version and have samples")
    return canonical_sha256(plan)
