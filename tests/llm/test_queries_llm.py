"""The corpus queries against DuckDB on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import compare, connect

from timbre.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, name):
    compare(QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).sql(SQL[name]).df())
