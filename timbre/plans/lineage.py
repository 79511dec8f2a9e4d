"""Receipts of artifacts: built from live files, verified by building them again."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import canonical_sha256
from ..operators.lineage import compare_roles, repeated
from ..operators.rules import GIT_SHA, IDENTIFIER
from ..sources.artifacts import fingerprint
from .checks import ContractViolation, require_empty

FIELDS = ["kind", "sha256", "bytes", "file_count"]


def declarations(texts: list[str]) -> list[tuple[str, str, str]]:
    """``ROLE=file|tree=PATH`` texts as (role, kind, path)."""
    out = []
    for t in texts:
        parts = t.split("=", 2)
        if len(parts) != 3 or not all(parts) or parts[1] not in ("file", "tree"):
            raise ContractViolation(f"not ROLE=file|tree=PATH: {t}")
        out.append((parts[0], parts[1], parts[2]))
    return out


def artifact_records(spark: SparkSession, declared: list[tuple[str, str, str]]) -> DataFrame:
    """(role, kind, sha256, bytes, file_count); a role may be declared once."""
    if not declared:
        raise ContractViolation("no artifacts declared")
    out = None
    for role, kind, path in declared:
        one = fingerprint(spark, path, role, kind)
        out = one if out is None else out.unionByName(one)
    require_empty(repeated(out, "role"), "roles declared twice")
    return out


def git_revision(revision: object) -> str:
    if not isinstance(revision, str) or not re.match(GIT_SHA, revision):
        raise ContractViolation(f"a revision is 40 lower-case hexadecimal digits: {revision!r}")
    return revision


def identifier(text: object, what: str) -> str:
    if not isinstance(text, str) or not re.match(IDENTIFIER, text):
        raise ContractViolation(f"{what} must be a lower-case identifier: {text!r}")
    return text


def held_records(spark: SparkSession, declared: list[tuple[str, str, str]]) -> list[dict]:
    """Records of a few declared artifacts, in order of the role; none may be empty.  Files have no file_count."""
    for role, _, _ in declared:
        identifier(role, "a role")
    records = [{k: v for k, v in r.asDict().items() if v is not None} for r in artifact_records(spark, declared).orderBy("role").collect()]
    # the file source passes over empty files
    if empty := sorted({role for role, _, _ in declared} - {r["role"] for r in records if r["bytes"] > 0}):
        raise ContractViolation(f"missing or empty artifacts: {', '.join(empty)}")
    return records


def build_receipt(spark: SparkSession, receipt_id: str, revision: str, inputs: list[str], outputs: list[str], repository: str = "local") -> dict:
    """A lineage receipt with its own digest; a receipt lists a few artifacts, whose records the driver holds."""
    body = {"schema_version": "1.0.0", "lineage_id": identifier(receipt_id, "the lineage id"), "producer": {"repository": repository, "revision": git_revision(revision)}}
    for name, texts in (("inputs", inputs), ("outputs", outputs)):
        body[name] = held_records(spark, declarations(texts))
    if {r["role"] for r in body["inputs"]} & {r["role"] for r in body["outputs"]}:
        raise ContractViolation("a role is both input and output")
    return body | {"receipt_sha256": canonical_sha256(body)}


def verify_receipt(spark: SparkSession, receipt: dict, inputs: list[str], outputs: list[str]) -> DataFrame:
    """(role, status) of the recorded against the current artifacts: exact, differs, missing or unexpected."""
    body = {k: v for k, v in receipt.items() if k != "receipt_sha256"}
    if canonical_sha256(body) != receipt.get("receipt_sha256"):
        raise ContractViolation("the receipt does not match its own digest")
    schema = "role string, kind string, sha256 string, bytes long, file_count long"
    was = spark.createDataFrame([tuple(r.get(c) for c in ("role", *FIELDS)) for k in ("inputs", "outputs") for r in receipt[k]], schema)
    return compare_roles(was, artifact_records(spark, declarations([*inputs, *outputs])), "role", FIELDS)


def compare_runs(spark: SparkSession, uninterrupted: list[str], resumed: list[str]) -> DataFrame:
    """(role, byte_exact) of the final artifacts of two independent runs."""
    out = compare_roles(artifact_records(spark, declarations(uninterrupted)), artifact_records(spark, declarations(resumed)), "role", FIELDS)
    return out.select("role", (F.col("status") == "exact").alias("byte_exact"), "status")
