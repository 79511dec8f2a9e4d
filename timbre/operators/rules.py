"""Validators as rule tables: a rule is a name and a condition that must hold; failures become rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTIFIER = r"^[a-z0-9][a-z0-9._-]*$"
SHA256 = r"^[0-9a-f]{64}$"
GIT_SHA = r"^[0-9a-f]{40}$"
#: Revisions that name no fixed content.
MUTABLE = ("latest", "main", "master", "head", "unknown", "unversioned")


@dataclass(frozen=True)
class Rule:
    name: str
    ok: Column

    @staticmethod
    def identifier(field: str) -> Rule:
        return Rule(f"{field}_identifier", F.col(field).rlike(IDENTIFIER))

    @staticmethod
    def text(field: str) -> Rule:
        return Rule(f"{field}_required", F.length(F.trim(F.col(field))) > 0)

    @staticmethod
    def sha256(field: str) -> Rule:
        return Rule(f"{field}_sha256", F.col(field).isNull() | F.col(field).rlike(SHA256))

    @staticmethod
    def number(field: str, low: float | None = None, high: float | None = None) -> Rule:
        """A finite number in range, or null."""
        x = F.col(field).cast("double")
        ok = ~F.isnan(x) & (F.abs(x) != float("inf"))
        ok = ok & (x >= low) if low is not None else ok
        ok = ok & (x <= high) if high is not None else ok
        return Rule(f"{field}_range", F.col(field).isNull() | ok)

    @staticmethod
    def one_of(field: str, *values: str) -> Rule:
        return Rule(f"{field}_allowed", F.col(field).isin(*values))

    @staticmethod
    def immutable(field: str) -> Rule:
        return Rule(f"{field}_immutable", (F.length(F.trim(F.col(field))) > 0) & ~F.lower(F.trim(F.col(field))).isin(*MUTABLE))

    @staticmethod
    def together(*fields: str) -> Rule:
        """All present or all absent."""
        present = F.array(*(F.col(f).isNotNull() for f in fields))
        return Rule("_".join(fields) + "_together", F.size(F.array_distinct(present)) == 1)

    @staticmethod
    def sorted_unique(field: str) -> Rule:
        return Rule(f"{field}_sorted_unique", F.col(field) == F.array_sort(F.array_distinct(field)))

    @staticmethod
    def all_different(*fields: str) -> Rule:
        return Rule("_".join(fields) + "_different", F.size(F.array_distinct(F.array(*fields))) == len(fields))


def failures(rows: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a condition that is null counts as broken."""
    names = F.array_compact(F.array(*(F.when(~F.coalesce(r.ok, F.lit(False)), F.lit(r.name)) for r in rules)))
    return rows.select(key, F.explode(names).alias("rule"))


def repeats(rows: DataFrame, key: str) -> DataFrame:
    """Keys on several rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


#: Objective observations.
def observation_rules() -> list[Rule]:
    return [
        Rule.identifier("sample_id"), Rule.identifier("candidate_id"), Rule.identifier("prompt_id"), Rule.text("requested_text"), Rule("valid_boolean", F.col("valid").isNotNull()),
        Rule("seed_nonnegative", F.col("seed").isNull() | (F.col("seed") >= 0)), Rule.number("generation_seconds", 0), Rule.number("audio_duration_seconds", 0), Rule.number("peak_memory_bytes", 0),
        Rule.number("silence_fraction", 0, 1), Rule.number("clipping_fraction", 0, 1), Rule.sha256("audio_sha256"), Rule.together("artifact_set_id", "artifact_set_sha256"),
    ]


def gate_rules(columns: list[str], version: bool = False, seed: bool = False, runtime: bool = False) -> list[Rule]:
    """Observation rules with what a content-bound report asks for beside them: version, seed and runtime stated, artifact and prosody fields in form.

    Rules of columns that ``columns`` does not name are left out, unless a field is asked for.
    """
    out = observation_rules()

    def stated(field: str, ok: Column, needed: bool) -> None:
        if field in columns:
            out.append(Rule(f"{field}_stated", F.coalesce(ok, F.lit(False)) if needed else F.col(field).isNull() | ok))
        elif needed:
            out.append(Rule(f"{field}_stated", F.lit(False)))

    stated("observation_schema_version", F.col("observation_schema_version") == "1.0.0", version)
    stated("seed", F.col("seed") >= 0, seed)
    stated("runtime_id", F.col("runtime_id").rlike(IDENTIFIER), runtime)
    stated("artifact_set_id", F.col("artifact_set_id").rlike(IDENTIFIER), False)
    stated("artifact_set_sha256", F.col("artifact_set_sha256").rlike(SHA256), False)
    for field in columns:
        if field.startswith("prosody_") and field != "prosody_eligible_for_long_form":
            out.append(Rule.number(field, 0, 1 if field in ("prosody_active_frame_fraction", "prosody_pause_fraction") else None))
    return out
