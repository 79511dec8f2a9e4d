"""Content-faithfulness report: transcripts held against what was asked for, against instructions and against reference recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .checks import ContractViolation, require_empty

#: Cells of edit-distance work, tokens of all references and of all instructions, references of a sample, that one report may take; hits that it shows.
MAX_CELLS, MAX_REFERENCE_TOKENS, MAX_INSTRUCTION_TOKENS, MAX_REFERENCES, HITS_SHOWN = 20_000_000, 50_000, 50_000, 32, 100
FLAGS = ("high_word_error_rate", "repetition_excess", "reference_transcript_overlap", "spoken_instruction_overlap")
KEY = ["report_id", "sample_id"]


def _tokens(column: str) -> Column:
    return T.tokens(T.nfkc(F.coalesce(column, F.lit(""))))


def _within(samples: DataFrame) -> None:
    """Refuse texts and totals beyond the limits: a report is built whole or not at all."""
    for c in ("requested", "hypothesis", "instruction"):
        require_empty(samples.where((F.octet_length(F.coalesce(c, F.lit(""))) > T.MAX_BYTES) | (F.size(f"t_{c}") > T.MAX_TOKENS)).select("sample_id"), f"{c} texts beyond {T.MAX_BYTES} bytes or {T.MAX_TOKENS} tokens")
    require_empty(samples.where((F.size("t_requested") == 0) | (F.col("instruction").isNotNull() & (F.size("t_instruction") == 0))).select("sample_id"), "requested texts or instructions without a token")
    require_empty(samples.where(F.size("references") > MAX_REFERENCES).select("sample_id"), f"more than {MAX_REFERENCES} references")
    cells = F.size("t_requested").cast("long") * F.greatest(F.lit(1), F.size("t_hypothesis"))
    used = samples.groupBy("report_id").agg(F.sum(cells).alias("cells"), F.sum(F.when(F.col("instruction").isNotNull(), F.size("t_instruction")).otherwise(0)).alias("told"))
    require_empty(used.where((F.col("cells") > MAX_CELLS) | (F.col("told") > MAX_INSTRUCTION_TOKENS)), "reports beyond the work limits")


def _counted(samples: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """(report_id, sample_id, g, <name>): how often each n-gram occurs."""
    return samples.select(*KEY, F.explode(T.ngrams(F.col(f"t_{column}"), n)).alias("g")).groupBy(*KEY, "g").agg(F.count("*").alias(name))


def _overlap(hypothesis: DataFrame, requested: DataFrame, told: DataFrame, name: str) -> DataFrame:
    """By sample: n-grams of ``told`` that were not requested, how many of them were said, and digests of the first in order."""
    own = told.select(*KEY, "g").distinct().join(requested, [*KEY, "g"], "left_anti")
    said = own.join(hypothesis.select(*KEY, "g", F.lit(True).alias("said")), [*KEY, "g"], "left")
    out = said.groupBy(*KEY).agg(F.count("*").alias(f"{name}_exclusive"), F.count("said").alias(f"{name}_hits"), F.array_sort(F.collect_list(F.when(F.col("said"), F.col("g")))).alias("hits"))
    digests = F.transform(F.slice("hits", 1, HITS_SHOWN), lambda g: F.sha2(g, 256))
    return out.select(*KEY, f"{name}_exclusive", f"{name}_hits", digests.alias(f"{name}_digests"), (F.size("hits") > HITS_SHOWN).alias(f"{name}_truncated"))


def diagnostics(samples: DataFrame, references: DataFrame, n: int = 4, instruction_n: int = 2, max_repeats: float = 0.05, min_reference_hits: int = 2, min_instruction_hits: int = 1, max_wer: float = 0.1) -> DataFrame:
    """Status, measures and flags of each sample.

    ``samples(report_id, sample_id, candidate_id, valid, requested, hypothesis, instruction, references array<string>)``: hypothesis
    and instruction may be null, ``references`` names the reference recordings; ``references(reference_id, transcript)``.
    An invalid sample is "failed", one without a hypothesis "not_evaluable".  N-grams are exploded and counted, so
    the work grows with the length of the texts.
    """
    if not 2 <= n <= 12 or not 1 <= instruction_n <= 12 or min(min_reference_hits, min_instruction_hits) < 1 or not 0 <= max_repeats <= 1 or not 0 <= max_wer <= 10:
        raise ContractViolation("n-gram sizes, hits or thresholds out of range")
    known = references.select("reference_id", _tokens("transcript").alias("t_reference"))
    require_empty(known.agg(F.sum(F.size("t_reference")).alias("tokens")).where(F.col("tokens") > MAX_REFERENCE_TOKENS), "reference transcripts beyond the limit")
    require_empty(known.where(F.size("t_reference") == 0).select("reference_id"), "reference transcripts without a token")
    able = samples.where(F.col("valid") & F.col("hypothesis").isNotNull()).withColumns({f"t_{c}": _tokens(c) for c in ("requested", "hypothesis", "instruction")})
    _within(able)
    named = able.select(*KEY, F.explode("references").alias("reference_id"))
    require_empty(named.join(known, "reference_id", "left_anti").select("reference_id").distinct(), "unknown references")
    hyp, req = _counted(able, "hypothesis", n, "c"), _counted(able, "requested", n, "r")
    excess = F.greatest(F.lit(0), F.col("c") - F.greatest(F.lit(1), F.coalesce("r", F.lit(0))))
    repeats = hyp.join(req, [*KEY, "g"], "left").groupBy(*KEY).agg(F.sum("c").alias("windows"), F.sum(excess).alias("excess"))
    heard = named.join(known, "reference_id")
    by_reference = _overlap(hyp, req, _counted(heard, "reference", n, "x"), "reference")
    told = able.where("instruction is not null")
    by_instruction = _overlap(_counted(told, "hypothesis", instruction_n, "c"), _counted(told, "requested", instruction_n, "r"), _counted(told, "instruction", instruction_n, "x"), "instruction")
    wer = T.with_word_errors(able, "t_requested", "t_hypothesis").select(*KEY, F.col("wer").alias("word_error_rate"), F.size("t_requested").alias("requested_words"), F.size("t_hypothesis").alias("hypothesis_words"))
    out = samples
    for part in (wer, repeats, by_reference, by_instruction):
        out = out.join(part, KEY, "left")
    seen = F.col("word_error_rate").isNotNull()
    zero = {c: F.when(seen, F.coalesce(c, F.lit(0))) for c in ("windows", "excess", "reference_exclusive", "reference_hits", "instruction_exclusive", "instruction_hits")}
    out = out.withColumns(zero).withColumn("repeat_fraction", F.when(seen, F.coalesce(F.try_divide("excess", "windows"), F.lit(0.0))))
    out = out.withColumn("instruction_status", F.when(seen, F.when(F.col("instruction").isNull(), "not_applicable").when(F.col("instruction_exclusive") > 0, "evaluated").otherwise("no_exclusive_ngrams")))
    flags = dict(zip(FLAGS, (F.col("word_error_rate") > max_wer, F.col("repeat_fraction") > max_repeats, F.col("reference_hits") >= min_reference_hits, F.col("instruction_hits") >= min_instruction_hits), strict=True))
    out = out.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    flagged = F.lit(False)
    for f in FLAGS:
        flagged = flagged | F.col(f)
    status = F.when(~F.col("valid"), "failed").when(~seen, "not_evaluable").when(flagged, "failed").otherwise("not_flagged")
    rate = lambda kind: F.try_divide(f"{kind}_hits", f"{kind}_exclusive").alias(f"{kind}_hit_rate")
    return out.select(
        *KEY, "candidate_id", status.alias("status"), "word_error_rate", "requested_words", "hypothesis_words", F.try_divide("hypothesis_words", "requested_words").alias("word_ratio"), "windows", "excess",
        "repeat_fraction", "reference_exclusive", "reference_hits", rate("reference"), "reference_digests", "reference_truncated", "instruction_status", "instruction_exclusive", "instruction_hits",
        rate("instruction"), "instruction_digests", "instruction_truncated", *FLAGS,
    )


def candidate_summary(diagnosed: DataFrame) -> DataFrame:
    """By candidate: counts of each status and flag, mean rates, and the verdict: failed above incomplete above not_flagged."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("failed", "not_evaluable", "not_flagged")]
    flags = [F.count_if(f).alias(f"{f}_count") for f in FLAGS]
    told = [F.count_if(F.col("instruction_status") == s).alias(f"instruction_{s}") for s in ("evaluated", "no_exclusive_ngrams", "not_applicable")]
    out = diagnosed.groupBy("report_id", "candidate_id").agg(
        F.count("*").alias("samples"), F.count("word_error_rate").alias("evaluable"), *counts, *flags, *told, F.avg("word_error_rate").alias("mean_wer"), F.avg("repeat_fraction").alias("mean_repeat_fraction"),
        F.coalesce(F.sum("reference_hits"), F.lit(0)).alias("reference_hits"), F.coalesce(F.sum("instruction_hits"), F.lit(0)).alias("instruction_hits"),
    )
    return out.withColumn("verdict", F.when(F.col("failed") > 0, "failed").when(F.col("not_evaluable") > 0, "incomplete").otherwise("not_flagged"))
