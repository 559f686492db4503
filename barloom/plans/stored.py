"""Queries over stored tables: what is written by the sinks and read again by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import rounded
from barloom.operators import indicators as ind
from barloom.operators.bars import ohlcv
from barloom.operators.chunks import over_chunks
from barloom.operators.lineage import new_folder
from barloom.plans import sql as q
from barloom.plans.base import indexed_bars, shown
from barloom.plans.indicators import RSI_STAGES
from barloom.plans.outcomes import BOX_SQL
from barloom.plans.patterns import SNAP, documents, snapshot_windows
from barloom.plans.registry import query
from barloom.sources import files
from barloom.sources.tables import event_ticks, read_table

c = F.col
FEATURE_SQL = q.with_stages(RSI_STAGES, ("fe", "avgs", f"{q.rsi()} AS rsi, {q.sma('close', 20)} AS mid, {q.sma('volume', 20)} AS v20"))


def stored_features(spark, base):
    """Feature table of all series, a folder for each timeframe and symbol; the place it was written to."""
    def cols(d, w):
        return ind.add_bollinger(ind.add_rsi(d, w), w).withColumn("v20", F.avg("volume").over(w.rowsBetween(-19, 0)))
    path = new_folder(spark)
    files.write_bars(over_chunks(indexed_bars(spark, base), cols, before=64).drop("chunk"), path)
    return path


@query("feature_columns", "S6 S7", FEATURE_SQL + f" SELECT symbol, tf, bar_idx, {q.r('rsi')} AS rsi, {q.r('mid', 9)} AS bb_middle FROM fe WHERE symbol IN ('click', 'view', 'NO') AND bar_idx >= 30")
def _(spark, base):
    """A few columns and series of a stored feature table: other columns and folders are not read."""
    wanted = files.read_columns(spark, stored_features(spark, base), ["symbol", "tf", "bar_idx", "rsi", "bb_middle"])
    return shown(wanted.where(c("symbol").isin("click", "view", "NO") & (c("bar_idx") >= 30)), "rsi", "bb_middle", places={"bb_middle": 9})


@query("feature_gaps", "S7 S8", FEATURE_SQL + """ SELECT symbol, tf, count(*) AS bars, count(*) FILTER (rsi IS NULL) AS no_rsi, count(*) FILTER (mid IS NULL) AS no_middle FROM fe GROUP BY symbol, tf""")
def _(spark, base):
    """Rows and missing values of each series of a stored multi-series feature table."""
    rows = files.read_columns(spark, stored_features(spark, base), ["symbol", "tf", "rsi", "bb_middle"])
    return rows.groupBy("symbol", "tf").agg(F.count(F.lit(1)).alias("bars"), F.count_if(c("rsi").isNull()).alias("no_rsi"), F.count_if(c("bb_middle").isNull()).alias("no_middle"))


HABITS = {"click": "CLICKUSDT", "view": "VIEW_USDT", "error": "ERRORUSDT"}


@query("series_files", "S12", q.bars_of(q.event_bars("1h", 3600)) + f""" SELECT upper(symbol) AS symbol, tf, count(*) AS bars, min(ts_s) AS first_s, max(ts_s) AS last_s, {q.r('sum(close)', 4)} AS close_sum
 FROM bars WHERE symbol IN ('click', 'view', 'error') GROUP BY symbol, tf""")
def _(spark, base):
    """Series stored under both naming habits, told apart by name alone when they are read."""
    folder, bars = new_folder(spark), ohlcv(event_ticks(spark, base), "1h").select("symbol", "ts_s", "open", "high", "low", "close", "volume")
    for symbol, name in HABITS.items():
        bars.where(c("symbol") == symbol).drop("symbol").write.parquet(f"{folder}/{name}_1h.parquet")
    return files.read_series_files(spark, folder).groupBy("symbol", "tf").agg(
        F.count(F.lit(1)).alias("bars"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"), rounded(F.sum("close"), 4).alias("close_sum"))


STORE_SQL = BOX_SQL + """,
dc AS (SELECT symbol, tf, count(*) AS documents, sum(coalesce(i_rsi, 1) * coalesce(i_volatility, 1) * coalesce(i_volume, 1) * i_touches) AS w FROM wb WHERE bar_idx >= 2 GROUP BY symbol, tf)"""


@query("pattern_store", "S14 S15", STORE_SQL + f" SELECT symbol, tf, 'long' AS direction, '2.0' AS version, documents, {q.r('w', 4)} AS w_box FROM dc")
def _(spark, base):
    """Pattern documents and snapshots written as a knowledge folder, its documents scanned as JSON."""
    folder = new_folder(spark)
    events, windows = snapshot_windows(spark, base)
    files.write_patterns(documents(spark, base), windows, folder, events)
    known = files.read_knowledge(spark, f"{folder}/documents")
    return known.groupBy("meta.symbol", "meta.tf", "meta.direction", "version").agg(
        F.count("id").alias("documents"), rounded(F.sum("w_box.w_box"), 4).alias("w_box"))


@query("stored_snapshots", "S14 J8", SNAP + f""" SELECT symbol, count(DISTINCT event_id) AS events, count(*) AS bars, {q.r('sum(close)', 4)} AS close_sum FROM sn GROUP BY symbol""")
def _(spark, base):
    """Snapshot table of a knowledge folder, read by symbol: windows of bars, each stored once, and the events that lie in their middle."""
    folder = new_folder(spark)
    events, windows = snapshot_windows(spark, base)
    files.write_patterns(documents(spark, base).limit(0), windows, folder, events)
    # events that share a window count it each, so it is summed up once and then goes to them
    per = files.read_windows(spark, folder).groupBy("symbol", "series", "center").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("s"))
    rows = files.read_window_events(spark, folder).join(per, ["series", "center"])
    return rows.groupBy("symbol").agg(F.countDistinct("event_id").alias("events"), F.sum("n").alias("bars"), rounded(F.sum("s"), 4).alias("close_sum"))


@query("asset_snapshot_files", "S16 S13", """SELECT c_mktsegment AS symbol, count(*) AS n, min(c_custkey)::INT AS best_rank, round(max(c_acctbal), 2) AS top_price, round(sum(c_acctbal * 1000), 0) AS market_cap,
 count(*) FILTER (c_nationkey >= 12) AS risen FROM customer GROUP BY 1""")
def _(spark, base):
    """Asset snapshot written as CSV files with a header and scanned with its schema."""
    path = new_folder(spark)
    rows = read_table(spark, base, "customer").select(
        c("c_mktsegment").alias("symbol"), c("c_name").alias("name"), c("c_acctbal").alias("price"), (c("c_acctbal") * 1000).alias("market_cap"), c("c_custkey").cast("int").alias("rank"),
        (c("c_nationkey") - 12.0).alias("change_24h"), F.lit(None).cast("double").alias("change_7d"), F.lit(0.5).alias("change_30d"))
    files.write_table(rows, path, "csv")
    got = files.read_asset_snapshot(spark, path)
    return got.groupBy("symbol").agg(F.count("name").alias("n"), F.min("rank").alias("best_rank"), F.round(F.max("price"), 2).alias("top_price"), F.round(F.sum("market_cap"), 0).alias("market_cap"),
                                     F.count_if(c("change_24h") >= 0).alias("risen"))
