"""Every SQL-expressible query against its DuckDB oracle (small scale)."""

import math

import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import SMALL

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


def _norm(v):
    if v is None or (not isinstance(v, (list, tuple, dict)) and pd.isna(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False)), key=repr)


def test_every_query_has_callable():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 90


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, key):
    s = QUERIES[key](spark, SMALL).toPandas()
    d = duck.execute(ORACLES[key]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert len(s) == len(d)
    for c in s.columns:
        if len(s):
            assert s[c].dtype.kind == d[c].dtype.kind or (s[c].isna().all() and d[c].isna().all()), c
    assert _rows(s) == _rows(d)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert [f.name for f in df.schema.fields] == ["bin", "n", "lower_q", "median", "upper_q"]
    assert all(r.lower_q <= r.median <= r.upper_q for r in rows)
    assert not math.isnan(rows[0].median)
