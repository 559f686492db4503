"""Queries against SQL. BARLOOM_ALL=1 checks every query, otherwise a quick selection."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from barloom.plans import load_catalogue

BASE = os.environ.get("BARLOOM_TEST_DATA", "/root/testdata/sf0.001")
QUICK = ["bars_from_ticks", "ema", "rsi", "asof_higher_timeframe", "gap_filled_bars", "trade_statistics", "streaks", "return_metrics", "triple_barrier",
         "spaced_signals", "regime_vote", "price_latches", "halt_carry_over", "liquidity_monitor", "governance", "decision_score", "asset_correlations",
         "roc_auc", "similar_states", "stream_bars", "stream_limits", "managed_exits", "chained_sweep", "series_files", "joined_streams", "stream_confirmed_signals", "halt_windows"]
CATALOGUE = load_catalogue()
NAMES = [n for n, q in CATALOGUE.items() if q.sql and (os.environ.get("BARLOOM_ALL") or n in QUICK)]

pytestmark = pytest.mark.skipif(not Path(BASE).exists(), reason="test tables are not here")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in Path(BASE).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None:
        return (1, 0)
    if isinstance(v, (bool, int, float)):
        return (0, "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 4))
    return (0, str(v))


def table(rows, have, want):
    at = [have.index(c) for c in want]
    return sorted([tuple(plain(r[i]) for i in at) for r in rows], key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = CATALOGUE[name].run(spark, BASE)
    cur = duck.execute(CATALOGUE[name].sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    left, right = table(df.collect(), df.columns, sorted(cols)), table(cur.fetchall(), cols, sorted(cols))
    assert len(left) == len(right)
    for a, b in zip(left, right):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x[1], float) and isinstance(y[1], float) and math.isclose(x[1], y[1], rel_tol=1e-6, abs_tol=2e-4))


def test_entry_has_rows(spark):
    import __spark_entry__ as e
    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
