"""Queries against DuckDB on the smallest data."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
from check import DATA, compare, duck

FOLDER = str(DATA / "sf0.001")
FAST = [
    "build_bars",
    "ffill_limited",
    "feature_panel",
    "build_graph",
    "best_first_neighbourhood",
    "masked_softmax",
    "trajectory_gae",
    "run_metrics",
    "paired_bootstrap",
    "tost",
    "read_ledger",
    "table_fingerprint",
    "flagship",
]


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    ok, text = compare(spark, duck(FOLDER), name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert ok, text


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
