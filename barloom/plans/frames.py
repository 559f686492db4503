"""Scans, coverage, quality and multi-timeframe queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import rounded
from barloom.operators import quality as ql
from barloom.operators.asof import asof_join
from barloom.operators.bars import coarser, ohlcv, slots
from barloom.operators.chunks import running, with_bar_index
from barloom.operators.features import FEATURES_31, features_31, HIGHER, HIGHER_FEATURES, BASE_FEATURES
from barloom.plans import sql as q
from barloom.plans.base import indexed_bars, market_bars, shown
from barloom.plans.registry import query
from barloom.sources.tables import event_ticks, read_table

OHLC = ("open", "high", "low", "close")
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
LINE_SYMBOLS = ["AF", "AO", "NF", "NO", "RF", "RO"]
_OHLCV_SQL = ", ".join(f"{q.r(c)} AS {c}" for c in (*OHLC, "volume"))


@query("bars_from_ticks", "S18", q.BARS + f" SELECT symbol, tf, bar_idx, ts_s, n_ticks, {_OHLCV_SQL} FROM bars")
def _(spark, base):
    return shown(indexed_bars(spark, base), "ts_s", "n_ticks", *OHLC, "volume")


@query("coarser_bars", "S18", q.bars_of(q.event_bars("4h", 14400) + " UNION ALL " + q.event_bars("1d", 86400))
       + f" SELECT symbol, tf, bar_idx, ts_s, n_ticks, {_OHLCV_SQL} FROM bars")
def _(spark, base):
    hourly = ohlcv(event_ticks(spark, base), "1h")
    both = coarser(hourly, "4h").unionByName(coarser(hourly, "1d"))
    return shown(with_bar_index(both), "ts_s", "n_ticks", *OHLC, "volume")


@query("bars_in_range", "S1 S2", q.BARS + """
SELECT symbol, tf, ts_s, close FROM bars WHERE tf = '1h' AND symbol IN ('click', 'view')
 AND ts_s BETWEEN epoch(TIMESTAMP '2024-01-05') AND epoch(TIMESTAMP '2024-01-20')""")
def _(spark, base):
    ticks = event_ticks(spark, base, "2024-01-05 00:00:00", "2024-01-20 01:00:00").where(F.col("symbol").isin("click", "view"))
    return ohlcv(ticks, "1h").select("symbol", "tf", "ts_s", "close")


_EXPECTED = "(VALUES " + ", ".join(
    f"('{s}', '{t}')" for s in EVENT_TYPES + LINE_SYMBOLS + ["refund"] for t in ("1h", "1d")) + ") v(symbol, tf)"


@query("series_coverage", "S2 S3", f"""WITH raw_bars AS ({q.event_bars('1h', 3600)} UNION ALL {q.LINE_BARS})
SELECT symbol, tf, n_bars, first_s, last_s, CASE WHEN n_bars IS NULL THEN 0 ELSE 1 END AS present FROM {_EXPECTED}
LEFT JOIN (SELECT symbol, tf, count(*) AS n_bars, min(ts_s) AS first_s, max(ts_s) AS last_s FROM raw_bars GROUP BY ALL) USING (symbol, tf)""")
def _(spark, base):
    expected = ql.catalogue(spark, EVENT_TYPES + LINE_SYMBOLS + ["refund"], ["1h", "1d"])
    return ql.coverage(market_bars(spark, base), expected)


@query("unknown_series", "S4", f"""WITH raw_bars AS ({q.event_bars('1h', 3600)} UNION ALL {q.LINE_BARS})
SELECT DISTINCT symbol, tf FROM raw_bars WHERE NOT (tf = '1h' AND symbol IN ('click', 'view', 'error'))
 AND NOT (tf = '1d' AND symbol IN ('NO', 'AF'))""")
def _(spark, base):
    known = ql.catalogue(spark, ["click", "view", "error"], ["1h"]).unionByName(ql.catalogue(spark, ["NO", "AF"], ["1d"]))
    return ql.unknown_series(market_bars(spark, base), known)


@query("bars_per_year", "S5", f"""WITH raw_bars AS ({q.event_bars('1h', 3600)} UNION ALL {q.LINE_BARS})
SELECT symbol, tf, CASE tf WHEN '15m' THEN 35040 WHEN '1h' THEN 8760 WHEN '4h' THEN 2190 WHEN '1d' THEN 365 ELSE 365 END AS bars_per_year,
 round(count(*) / (CASE tf WHEN '15m' THEN 35040 WHEN '1h' THEN 8760 WHEN '4h' THEN 2190 ELSE 365 END), 6) AS years FROM raw_bars GROUP BY symbol, tf""")
def _(spark, base):
    return market_bars(spark, base).groupBy("symbol", "tf").agg(F.count(F.lit(1)).alias("n")).select(
        "symbol", "tf", ql.bars_per_year(F.col("tf")).alias("bars_per_year"),
        F.round(F.col("n") / ql.bars_per_year(F.col("tf")), 6).alias("years"))


_QI = {"null_rate": "avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END)",
       **{f"neg_{p}": f"count(*) FILTER ({p} <= 0)" for p in OHLC}, "crossed": "count(*) FILTER (high < low)"}


@query("quality_issues", "S8", f"WITH raw_bars AS ({q.event_bars('1h', 3600)} UNION ALL {q.LINE_BARS}) " + " UNION ALL ".join(
    f"SELECT symbol, tf, '{k}' AS issue, {e}::DOUBLE AS amount, CASE WHEN {e} > {0.01 if k == 'null_rate' else 0} THEN 1 ELSE 0 END AS flagged "
    f"FROM raw_bars GROUP BY ALL" for k, e in _QI.items()))
def _(spark, base):
    return ql.quality_issues(market_bars(spark, base))


_RULES = {"high_below_body": "high < greatest(open, close)", "low_above_body": "low > least(open, close)",
          "high_below_low": "high < low", "not_positive": "least(open, high, low, close) <= 0", "negative_volume": "volume < 0"}


@query("bar_integrity", "S9", f"WITH raw_bars AS ({q.event_bars('1h', 3600)} UNION ALL {q.LINE_BARS}) " + " UNION ALL ".join(
    f"SELECT symbol, tf, count(*) AS n, '{k}' AS rule, count(*) FILTER ({e}) AS broken FROM raw_bars GROUP BY ALL" for k, e in _RULES.items()))
def _(spark, base):
    return ql.integrity(market_bars(spark, base))


@query("scan_profile", "S10", """SELECT 'events' AS source, count(*) AS n_rows, 6 AS n_columns, epoch(min(ts))::BIGINT AS first_s, epoch(max(ts))::BIGINT AS last_s,
 count(*) FILTER (value IS NULL) + count(*) FILTER (event_type IS NULL) AS n_null FROM events UNION ALL
SELECT 'lineitem', count(*), 11, epoch(min(l_shipdate))::BIGINT, epoch(max(l_shipdate))::BIGINT, count(*) FILTER (l_extendedprice IS NULL) + count(*) FILTER (l_returnflag IS NULL) FROM lineitem""")
def _(spark, base):
    def profile(name, ts, *checked):
        df = read_table(spark, base, name)
        when = F.col(ts).cast("timestamp")
        nulls = sum((F.count_if(F.col(c).isNull()) for c in checked[1:]), F.count_if(F.col(checked[0]).isNull()))
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
                      F.unix_seconds(F.min(when)).alias("first_s"), F.unix_seconds(F.max(when)).alias("last_s"),
                      nulls.alias("n_null")).withColumn("source", F.lit(name))
    return profile("events", "ts", "value", "event_type").unionByName(
        profile("lineitem", "l_shipdate", "l_extendedprice", "l_returnflag"), allowMissingColumns=True)


@query("event_props_json", "F30", """SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k_sum,
 max('{"kind":"' || event_type || '","k":' || json_extract(props, '$.k')::VARCHAR || '}') AS doc FROM events GROUP BY event_type""")
def _(spark, base):
    ev = read_table(spark, base, "events").withColumn("p", F.from_json("props", "k BIGINT", {"mode": "PERMISSIVE"}))
    doc = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("p.k").alias("k")))
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k_sum"), F.max(doc).alias("doc"))


@query("asset_snapshot_csv", "F29", """SELECT c_mktsegment AS symbol, count(*) AS n, round(max(c_acctbal), 2) AS top_price
 FROM customer GROUP BY 1""")
def _(spark, base):
    """CSV text derived from customer, read back with an explicit schema."""
    line = F.to_csv(F.struct("c_mktsegment", "c_name", "c_acctbal"))
    rows = read_table(spark, base, "customer").select(
        F.from_csv(line, "symbol STRING, name STRING, price DOUBLE").alias("r")).select("r.*")
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("price"), 2).alias("top_price"))


ASOF_SQL = f"""WITH h AS ({q.event_bars('1h', 3600)}), d AS ({q.event_bars('1d', 86400)}), f AS ({q.event_bars('4h', 14400)})
SELECT h.symbol, h.ts_s, round(h.close, 6) AS close, round(f.close, 6) AS close_4h, round(d.close, 6) AS close_1d
FROM h ASOF LEFT JOIN f ON h.symbol = f.symbol AND h.ts_s + 3600 >= f.ts_s + 14400
ASOF LEFT JOIN d ON h.symbol = d.symbol AND h.ts_s + 3600 >= d.ts_s + 86400"""


@query("asof_higher_timeframe", "J1 J5", ASOF_SQL)
def _(spark, base):
    hourly = ohlcv(event_ticks(spark, base), "1h")
    at = (F.col("ts_s") + F.col("step_s")).alias("at_s")
    high = {f"h{tf}": coarser(hourly, tf).select("symbol", at, "close") for tf in ("4h", "1d")}
    out = asof_join(hourly.select("symbol", at, "ts_s", "close"), high, ["symbol"], "at_s", 3600 * 4096)
    return out.select("symbol", "ts_s", *[F.round(c, 6).alias(n) for c, n in (
        ("close", "close"), ("h4h.close", "close_4h"), ("h1d.close", "close_1d"))])


@query("gap_filled_bars", "J2", f"""WITH h AS ({q.event_bars('1h', 3600)}),
sp AS (SELECT symbol, unnest(range(lo, hi + 1, 3600)) AS ts_s FROM (SELECT symbol, min(ts_s) lo, max(ts_s) hi FROM h GROUP BY 1))
SELECT sp.symbol, sp.ts_s, round(last_value(close IGNORE NULLS) OVER w, 6) AS close, round(last_value(volume IGNORE NULLS) OVER w, 6) AS volume,
 CASE WHEN h.ts_s IS NULL THEN 1 ELSE 0 END AS filled FROM sp LEFT JOIN h USING (symbol, ts_s)
WINDOW w AS (PARTITION BY sp.symbol ORDER BY sp.ts_s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(spark, base):
    hourly = ohlcv(event_ticks(spark, base), "1h")
    spine = slots(hourly).join(hourly.select("symbol", "ts_s", "close", "volume"), ["symbol", "ts_s"], "left").withColumn(
        "filled", F.col("close").isNull().cast("int")).withColumn("_b", F.floor(F.col("ts_s") / (3600 * 4096)))
    done = running(spine, ["symbol"], ["_b"], ["ts_s"], {"c": ("last", F.col("close")), "v": ("last", F.col("volume"))})
    return done.select("symbol", "ts_s", F.round("c", 6).alias("close"), F.round("v", 6).alias("volume"), "filled")


def _tf_sql(tf: str, step: int) -> str:
    name = f"t{tf}"
    b = f"""raw_{name} AS ({q.event_bars(tf, step)}),
b_{name} AS (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY ts_s) - 1 AS bar_idx FROM raw_{name}),
g_{name} AS (SELECT *, {q.GAIN_LOSS}, {q.TR}, {q.ema('close', 9)} AS e9, {q.ema('close', 21)} AS e21, {q.sma('close', 50)} AS s50,
 {q.sma('close', 20)} AS s20, {q.std('close', 20)} AS d20 FROM b_{name}),
a_{name} AS (SELECT *, {q.sma('gain', 14)} AS ag, {q.sma('loss', 14)} AS al, {q.sma('tr', 14)} AS atr FROM g_{name}),
f_{name} AS (SELECT symbol, tf, ts_s, bar_idx, ts_s + step_s AS at_s, {q.rsi()} AS "RSI_14", (close - e9) / e9 AS "price_to_EMA9",
 (close - e21) / e21 AS "price_to_EMA21", (close - s50) / s50 AS "price_to_SMA50", d20 * 2 / s20 AS "BB_width_pct", atr / close AS "ATR_pct",
 {q.pct('close', 5)} AS returns_5, {q.pct('close', 10)} AS returns_10, volume / {q.sma('volume', 5)} AS volume_ratio_5,
 volume / {q.sma('volume', 10)} AS volume_ratio_10 FROM a_{name})"""
    return b


def _features_sql() -> str:
    steps = {"15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}
    ctes = ",\n".join(_tf_sql(tf, s) for tf, s in steps.items())
    own = [f'b."{f.removesuffix("_dup")}" AS "15m_{f}"' for f in BASE_FEATURES]
    high = [f'h{tf}."{f}" AS "{tf}_{f}"' for tf in HIGHER for f in HIGHER_FEATURES]
    joins = " ".join(f"ASOF LEFT JOIN f_t{tf} h{tf} ON b.symbol = h{tf}.symbol AND b.at_s >= h{tf}.at_s" for tf in HIGHER)
    w = "(PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    out = ", ".join(f"""{q.r(f'coalesce(last_value("{f}" IGNORE NULLS) OVER {w}, 0)')} AS "{f}" """ for f in FEATURES_31)
    return f"WITH {ctes},\nj AS (SELECT b.symbol, b.tf, b.bar_idx, {', '.join(own + high)} FROM f_t15m b {joins})\nSELECT symbol, tf, bar_idx, {out} FROM j"


@query("features_31", "J1 J5 P1", _features_sql())
def _(spark, base):
    return shown(features_31(ohlcv(event_ticks(spark, base), "15m")), *FEATURES_31)
