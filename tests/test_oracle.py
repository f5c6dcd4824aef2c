"""Every query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from vantarow import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind; the driver's own comparison runs them all.
CHECKED = ("attach_dims_overlap", "window_features", "detect_ewma_residual", "event_outcomes", "detection_curve", "split_summary", "bm25_topk", "hybrid_rrf", "groundedness_report", "risk_rule_eval", "audit_chain_verify", "stage_latency_percentiles")


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    cur = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(str([canonical(dict(zip(names, r))[c]) for c in cols]) for r in cur.fetchall())
    assert sorted(str([canonical(r[c]) for c in cols]) for r in df.collect()) == want


def test_registries_agree():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
