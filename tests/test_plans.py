"""Shapes of the plans that matter at scale."""

from barloom.operators.bars import ohlcv
from barloom.plans import load_catalogue
from barloom.plans.trades import trades
from barloom.sources.tables import event_ticks, line_ticks
from tests.test_catalogue import BASE, pytestmark  # noqa: F401


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_are_hash_aggregated_before_the_shuffle(spark):
    for ticks, tf in ((event_ticks(spark, BASE), "1h"), (line_ticks(spark, BASE), "1d")):
        text = plan(ohlcv(ticks, tf))
        assert "SortAggregate" not in text and "partial_min_by" in text and text.count("Exchange") == 1


def test_bars_read_only_their_columns(spark):
    text = plan(ohlcv(event_ticks(spark, BASE), "1h"))
    assert "props" not in text and "user_id" not in text


def test_filters_reach_the_scan(spark):
    text = plan(event_ticks(spark, BASE).where("symbol = 'click'"))
    assert "EqualTo(event_type,click)" in text


def test_windows_run_on_chunks(spark):
    text = plan(load_catalogue()["rsi"].run(spark, BASE))
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert windows and all("chunk#" in line or "_block#" in line or "_c" in line for line in windows)
    assert "CartesianProduct" not in text


def test_ledger_statistics_shuffle_aggregates_only(spark):
    text = plan(load_catalogue()["trade_statistics"].run(spark, BASE))
    assert "partial_count" in text and "l_partkey" not in text
    assert trades(spark, BASE).columns


def small_events(spark, folder):
    """Three events of one hour, one of the next, two with one id in different series, one without an id."""
    from datetime import datetime

    rows = [(1, 0, 5, "a", 10.0), (2, 0, 20, "a", 12.0), (3, 0, 40, "a", 11.0), (4, 1, 0, "a", 13.0), (5, 3, 0, "a", 9.0), (5, 1, 10, "b", 4.0), (5, 2, 10, "b", 5.0), (None, 2, 30, "b", 6.0)]
    rows += [(3, 0, 40, "a", 11.0)]
    made = [(i, datetime(2024, 1, 1, h, m), 1, k, v, "{}") for i, h, m, k, v in rows]
    spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    spark.read.parquet(f"{BASE}/lineitem.parquet").limit(50).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_outcomes_of_events_that_share_a_bar(spark, tmp_path):
    """Against the full snapshots, a row for each event and bar, also for ids that come again; windows are made once a bar."""
    from pyspark.sql import functions as F

    from barloom.plans import patterns as pt

    base = small_events(spark, tmp_path)
    full = pt.snapshots(spark, base).collect()
    got = {(r.symbol, r.event_id): r for r in load_catalogue()["snapshot_outcomes"].run(spark, base).collect()}
    assert set(got) == {(r.symbol, r.event_id) for r in full if r.event_id is not None}
    for (symbol, event), r in got.items():
        prices = [x.close for x in full if x.event_id == event and x.bar_position == 0]
        later = [x for x in full if (x.symbol, x.event_id) == (symbol, event) and x.bar_position > 0]
        tops = [x.bar_position for x in later if x.high >= min(prices) * 1.02]
        assert r.future_bars == len(later) * len(prices) and r.first_tp == (min(tops) if tops else None)
        assert r.max_profit_pct == (round((max(x.high for x in later) / max(prices) - 1) * 100, 4) if later else None)
        assert r.max_drawdown_pct == (round((1 - min(x.low for x in later) / max(prices)) * 100, 4) if later else None)
    events, windows = pt.snapshot_windows(spark, base)
    assert events.count() == 9 and windows.groupBy("symbol", "center", "bar_idx").count().where("count > 1").isEmpty()
    assert windows.count() < len(full)


def test_stored_windows_give_the_snapshots_of_all_events(spark, tmp_path):
    from barloom.plans import patterns as pt
    from barloom.sources import files

    base = small_events(spark, tmp_path / "in")
    events, windows = pt.snapshot_windows(spark, base)
    files.write_patterns(spark.createDataFrame([("{}",)], "document string"), windows, str(tmp_path / "out"), events)
    full = pt.snapshots(spark, base)
    again = files.read_snapshots(spark, str(tmp_path / "out")).select(*full.columns)
    def plain(df):
        return sorted(map(str, (tuple(r) for r in df.collect())))
    assert plain(again) == plain(full)
    got = {r.symbol: r for r in load_catalogue()["stored_snapshots"].run(spark, base).collect()}
    rows = full.collect()
    assert set(got) == {"a", "b"}
    for symbol, r in got.items():
        own = [x for x in rows if x.symbol == symbol]
        assert (r.events, r.bars, r.close_sum) == (len({x.event_id for x in own} - {None}), len(own), sum(x.close for x in own))
