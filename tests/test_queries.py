"""Every registered query that has SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from oracle import compare, connect

from timbre.queries import audio, audits, scoring, text

ALL = text.QUERIES | scoring.QUERIES | audits.QUERIES | audio.QUERIES
SQL = text.SQL | scoring.SQL | audits.SQL


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, sf_dir, name):
    got = ALL[name](spark, sf_dir).toPandas()
    if name in SQL:
        compare(got, connect(sf_dir).sql(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_audit_stages_keeps_texts_that_start_with_a_blank(spark, tmp_path):
    docs = [(3, "  lead"), (13, "  lead"), (23, "   "), (33, None), (43, ""), (53, "plain")]
    spark.createDataFrame([(i, t, "en", "web", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["split"], r["reason"]): r["n"] for r in audits.audit_stages(spark, str(tmp_path)).collect()}
    assert got == {("train", "valid"): 2, ("train", "duplicate_content"): 1, ("train", "missing_text"): 3}


def test_bootstrap_exact_takes_the_reference_s_draws(spark, monkeypatch):
    values = [0.0, 1.0, 5.0, 2.0, 9.0, 4.0, 7.0]
    rows = [("m", v, i) for i, v in enumerate(values)]
    monkeypatch.setattr(scoring, "_pair_deltas", lambda spark, sf_dir: spark.createDataFrame(rows, "metric string, delta double, place long"))
    rng = random.Random(0)
    means = sorted(sum(rng.choices(values, k=7)) / 7 for _ in range(2000))
    low, high = (means[int(p * 1999)] * (1 - p * 1999 % 1) + means[int(p * 1999) + 1] * (p * 1999 % 1) for p in (0.025, 0.975))
    got = scoring.bootstrap_exact(spark, "").first()
    assert (got["low"], got["high"]) == pytest.approx((low, high), abs=1e-9)
