"""Canonical JSON and content digests."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_json(value: Any) -> str:
    """Sorted keys, no spaces, no ASCII escapes."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canonical_sha256(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


@F.pandas_udf(StringType())
def digest_json(document: pd.Series) -> pd.Series:
    """Canonical digest of a JSON text (numbers as Python prints them, nulls kept)."""
    return document.map(lambda t: None if t is None else canonical_sha256(json.loads(t)))


def digest_strings(**columns: Column) -> Column:
    """Canonical digest of an object whose values are plain strings, without leaving the JVM.

    Only for values that JSON prints as they are: no quotes, backslashes or control characters.
    """
    parts: list[Column] = []
    for i, name in enumerate(sorted(columns)):
        parts += [F.lit(("," if i else "") + f'"{name}":"'), columns[name], F.lit('"')]
    return F.sha2(F.concat(F.lit("{"), *parts, F.lit("}")), 256)
