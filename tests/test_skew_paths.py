"""Registered queries with every group treated as hot (range-partitioned
paths) still equal their DuckDB oracles."""

import pytest

import __spark_entry__ as entry
from tracklake.operators import running
from test_oracle import _rows

SKEW_KEYS = ["median_band_x", "median_band_y", "resolution_band", "log_sigma_width", "cumulative_losses",
             "checkpoints", "edge_energies", "muon_energies", "interacting_neutrino", "interaction_products"]


@pytest.mark.parametrize("key", SKEW_KEYS)
def test_hot_path_matches_oracle(spark, duck, key, monkeypatch):
    from conftest import SMALL
    monkeypatch.setattr(running, "HOT_ROWS", 1)
    s = entry.queries()[key](spark, SMALL).toPandas()
    d = duck.execute(entry.oracle_sql()[key]).df()
    assert sorted(s.columns) == sorted(d.columns) and len(s) == len(d)
    assert _rows(s) == _rows(d)
