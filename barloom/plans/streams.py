"""Streaming queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import rounded
from barloom.plans import sql as q
from barloom.plans.registry import query
from barloom.streaming.bars import stream_bars, stream_bursts, tick_stream
from barloom.streaming.run import drain
from barloom.streaming.states import stream_hysteresis, stream_limits, stream_trailing, stream_watch

c = F.col
_OHLC = ("open", "high", "low", "close")
_R = ", ".join(f"{q.r(x)} AS {x}" for x in _OHLC)
_AGG = "first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS n_ticks"
_WM = "(SELECT max(epoch_ms(ts)) - 600000 FROM events)"


def _out(df):
    return df.select("symbol", "ts_s", "n_ticks", *[rounded(x).alias(x) for x in _OHLC])


@query("stream_bars", "T15 S18", f"""WITH b AS (SELECT event_type AS symbol, epoch_us(ts) // 3600000000 * 3600 AS ts_s, {_AGG} FROM events GROUP BY 1, 2)
SELECT symbol, ts_s, n_ticks, {_R} FROM b WHERE (ts_s + 3600) * 1000 <= {_WM}""")
def _(spark, base):
    return _out(drain(spark, stream_bars(tick_stream(spark, base))))


@query("stream_sliding_bars", "T15", f"""WITH e AS (SELECT *, unnest([0, 1, 2, 3]) AS k FROM events), b AS (SELECT event_type AS symbol, (epoch_us(ts) // 3600000000 - k) * 3600 AS ts_s, {_AGG} FROM e GROUP BY 1, 2)
SELECT symbol, ts_s, n_ticks, {_R} FROM b WHERE (ts_s + 14400) * 1000 <= {_WM}""")
def _(spark, base):
    return _out(drain(spark, stream_bars(tick_stream(spark, base), "4 hours", "1 hour")))


@query("stream_bursts", "T15", f"""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS n FROM events),
h AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS burst FROM g), b AS (SELECT event_type AS symbol, burst, min(epoch_us(ts)) // 1000000 AS ts_s, max(epoch_us(ts)) AS last_us, {_AGG} FROM h GROUP BY 1, 2)
SELECT symbol, ts_s, n_ticks, {_R} FROM b WHERE last_us / 1000 + 1800000 <= {_WM}""")
def _(spark, base):
    return _out(drain(spark, stream_bursts(tick_stream(spark, base))))


_REG = "CASE WHEN value > 60 THEN 'BULL' WHEN value < 20 THEN 'BEAR' ELSE 'SIDEWAYS' END"


@query("stream_hysteresis", "T2", f"""WITH e AS (SELECT event_type AS symbol, event_id, ts, {_REG} AS regime FROM events), s AS (SELECT *, CASE WHEN regime = lag(regime) OVER w OR row_number() OVER w = 1 THEN regime END AS seen FROM e WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id))
SELECT symbol, event_id, regime, last_value(seen IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS confirmed FROM s""")
def _(spark, base):
    regime = F.when(c("price") > 60, "BULL").when(c("price") < 20, "BEAR").otherwise("SIDEWAYS")
    return drain(spark, stream_hysteresis(tick_stream(spark, base).select("symbol", "ts", "event_id", regime.alias("regime"))))


@query("stream_limits", "T6", """WITH e AS (SELECT event_type AS symbol, event_id, ts, value - 49 AS pnl FROM events), r AS (SELECT *, 10000 + sum(pnl) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS value, sum(pnl) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts, event_id) AS day_pnl FROM e),
p AS (SELECT *, greatest(10000, max(value) OVER (PARTITION BY symbol ORDER BY ts, event_id)) AS peak FROM r)
SELECT symbol, event_id, round(value, 4) AS value, CASE WHEN value <= 0 OR -day_pnl / value >= 0.05 THEN 1 ELSE 0 END AS day_hit, max(CASE WHEN (peak - value) / peak >= 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS latched FROM p""")
def _(spark, base):
    out = drain(spark, stream_limits(tick_stream(spark, base).select("symbol", "ts", "event_id", (c("price") - 49).alias("pnl")), 0.05))
    return out.select("symbol", "event_id", F.round("value", 4).alias("value"), c("day_hit").cast("int").alias("day_hit"), c("latched").cast("int").alias("latched"))


TRAIL_SQL = """WITH RECURSIVE t AS (SELECT event_type AS symbol, event_id, value AS p, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT symbol, event_id, n, p AS entry, p - 15.0 AS stop, 0.02::DOUBLE AS af, 0 AS hit FROM t WHERE n = 1
 UNION ALL SELECT t.symbol, t.event_id, t.n, CASE WHEN f.entry IS NULL THEN t.p WHEN t.p <= f.stop THEN NULL ELSE f.entry END,
  CASE WHEN f.entry IS NULL THEN t.p - 15.0 WHEN t.p > f.stop AND (t.p - f.entry) / f.entry >= 0.02 THEN greatest(f.stop, least(f.stop + (t.p - f.stop) * f.af, t.p * 0.99)) ELSE f.stop END,
  CASE WHEN f.entry IS NULL THEN 0.02 WHEN t.p > f.stop AND (t.p - f.entry) / f.entry >= 0.02 THEN least(f.af + 0.02, 0.2) ELSE f.af END,
  CASE WHEN f.entry IS NOT NULL AND t.p <= f.stop THEN 1 ELSE 0 END FROM f JOIN t ON t.symbol = f.symbol AND t.n = f.n + 1)
SELECT symbol, event_id, """ + q.r("stop") + " AS stop, hit FROM f"


@query("stream_trailing_stop", "T14", TRAIL_SQL)
def _(spark, base):
    out = drain(spark, stream_trailing(tick_stream(spark, base).select("symbol", "ts", "event_id", "price"), atr=5.0))
    return out.select("symbol", "event_id", rounded("stop").alias("stop"), c("hit").cast("int").alias("hit"))


WATCH_SQL = f"""WITH e AS (SELECT event_type AS symbol, epoch_us(ts) // 21600000000 AS trade_id, epoch_ms(ts) AS ms, value, row_number() OVER w AS rn, first_value(value) OVER w AS entry, epoch_ms(first_value(ts) OVER w) AS t0
  FROM events WINDOW w AS (PARTITION BY event_type, epoch_us(ts) // 21600000000 ORDER BY ts, event_id)),
m AS (SELECT *, rn - 1 AS n, value / entry - 1 AS move FROM e WHERE rn > 1 AND ms - t0 < 7200000),
b AS (SELECT *, greatest(0, max(move) OVER (PARTITION BY symbol, trade_id ORDER BY n)) AS best FROM m),
r AS (SELECT *, CASE WHEN best > 0.05 AND move < best * 0.5 THEN 'bull_trap' WHEN n >= 2 AND best <= 0.005 AND move <= -0.003 THEN 'false_breakout' WHEN n >= 4 AND move < -0.02 THEN 'adverse_move' WHEN n >= 4 AND move > 0.1 THEN 'too_good' END AS reason FROM b),
d AS (SELECT symbol, trade_id, min_by(reason, n) AS outcome, min(n) AS ticks FROM r WHERE reason IS NOT NULL GROUP BY symbol, trade_id)
SELECT symbol, trade_id, outcome, ticks FROM d UNION ALL
SELECT symbol, trade_id, 'confirmed', 0 FROM (SELECT DISTINCT symbol, trade_id, t0 FROM e) WHERE (symbol, trade_id) NOT IN (SELECT (symbol, trade_id) FROM d) AND t0 + 7200000 < {_WM}"""


@query("stream_watch", "T7", WATCH_SQL)
def _(spark, base):
    """Every six-hour slot of a series is watched as one trade."""
    slot = F.floor(F.unix_seconds("ts") / 21600)
    return drain(spark, stream_watch(tick_stream(spark, base).withColumn("trade_id", slot)))
