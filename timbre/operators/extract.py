"""Extractor results: applied to valid observations by an exact-cover join, failures kept as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_extractor(rows: DataFrame, extract: Callable[[dict], dict], fields: dict[str, str], key: str = "sample_id") -> DataFrame:
    """Apply ``extract`` (row as a dict -> values) in the executors.

    Returns (key, status, <fields>, error_type, error): an exception gives a row with
    status "failed", never a lost row.
    """
    schema = f"{key} string, status string, " + "".join(f"{n} {t}, " for n, t in fields.items()) + "error_type string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    got = extract(row)
                    out.append({key: row[key], "status": "complete", **{n: got.get(n) for n in fields}, "error_type": None, "error": None})
                except Exception as e:
                    out.append({key: row[key], "status": "failed", **dict.fromkeys(fields), "error_type": type(e).__name__, "error": str(e)[:500]})
            yield pd.DataFrame(out, columns=[key, "status", *fields, "error_type", "error"])

    return rows.mapInPandas(run, schema)


def cover(obs: DataFrame, results: DataFrame, key: str = "sample_id") -> DataFrame:
    """Breaches of exact cover: (key, problem) with missing_result, unexpected_result or repeated_result."""
    valid = obs.where("valid").select(key)
    return (
        valid.join(results, key, "left_anti").select(key, F.lit("missing_result").alias("problem"))
        .unionByName(results.select(key).distinct().join(valid, key, "left_anti").select(key, F.lit("unexpected_result").alias("problem")))
        .unionByName(results.groupBy(key).count().where("count > 1").select(key, F.lit("repeated_result").alias("problem")))
    )


def apply_results(obs: DataFrame, results: DataFrame, field: str, key: str = "sample_id") -> DataFrame:
    """Observations with ``field`` from the results and ``outcome``: applied, failed, conflict, uncovered or excluded.

    A field that is already set is never overwritten; invalid observations take no result.
    """
    r = results.select(key, F.col(field).alias("r_value"), F.col("status").alias("r_status"))
    out = obs.join(r, key, "left")
    outcome = (
        F.when(~F.col("valid"), "excluded").when(F.col("r_status").isNull(), "uncovered").when(F.col(field).isNotNull(), "conflict")
        .when(F.col("r_status") == "failed", "failed").otherwise("applied")
    )
    out = out.withColumn("outcome", outcome)
    return out.withColumn(field, F.when(F.col("outcome") == "applied", F.col("r_value")).otherwise(F.col(field))).drop("r_value", "r_status")
