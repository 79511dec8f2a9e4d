"""Comparison of a Spark result with DuckDB SQL over the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        con.sql(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)

    def one(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v

    return sorted((tuple(one(v) for v in row) for row in df[cols].astype(object).itertuples(index=False)), key=repr)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b, strict=True):
        assert x == y or all(p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) <= 2e-6 * max(1, abs(p))) for p, q in zip(x, y, strict=True)), (x, y)
