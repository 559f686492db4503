"""Feature-family, pattern-document and nearest-state queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barloom.functions.columns import ratio, rounded
from barloom.operators import families as fam
from barloom.operators import labels as lb
from barloom.operators import ml
from barloom.operators.asof import around, nearest_join
from barloom.operators.bars import ohlcv
from barloom.operators.chunks import over_chunks, running_bars, with_bar_index
from barloom.operators.lineage import attach, cut
from barloom.operators.nearest import nearest
from barloom.plans import sql as q
from barloom.plans.base import indexed_bars, shown
from barloom.plans.conditions import T9_SQL
from barloom.plans.indicators import RSI_STAGES, _sel
from barloom.plans.outcomes import add_box, BOX_SQL
from barloom.plans.registry import query
from barloom.schema import SERIES
from barloom.sources.tables import event_ticks, read_table

c = F.col
K = "symbol, tf, bar_idx"


def _places(name: str) -> int:
    """MACD crosses zero, so its rates of change lose digits; fifths and ratios of prices may end with a 5 after six places."""
    return 2 if name.startswith("deriv_macd_roc") else 9 if name in ("deriv_close_velocity", "momentum_10") else 6


def _sql_74() -> str:
    n = fam.N
    st = q.with_stages(
        RSI_STAGES, ("w0", "avgs", f"{q.rsi()} AS rsi, {q.TR}, {q.ema('close', 12)} - {q.ema('close', 26)} AS macd, {q.sma('close', 20)} AS mid, {q.std('close', 20)} AS sd, volume / nullif({q.sma('volume', 20)}, 0) AS volume_ratio, "
                     f"CASE WHEN bar_idx >= 13 THEN (close - min(low) OVER {q.frame(-13)}) / nullif(max(high) OVER {q.frame(-13)} - min(low) OVER {q.frame(-13)}, 0) * 100 END AS stoch_k"),
        ("w1", "w0", f"{q.sma('tr', 14)} AS atr, 4 * sd / nullif(mid, 0) AS bb_width"))
    out = {}
    for x in fam.BASES:
        out[f"norm_{x}_zscore"] = f"({x} - {q.sma(x, n)}) / nullif({q.std(x, n)}, 0)"
        lst = f"list({x}) FILTER ({x} IS NOT NULL) OVER {q.frame(-(n - 1))}"
        out[f"norm_{x}_pctile"] = f"CASE WHEN len({lst}) >= {n} THEN len(list_filter({lst}, lambda v: v <= {x})) / {n}.0 END"
    for x in ("close", "rsi", "macd", "volume"):
        out |= {f"deriv_{x}_diff1": f"{x} - {q.lag(x)}", f"deriv_{x}_diff2": f"{x} - {q.lag(x, 2)}", f"deriv_{x}_roc5": q.pct(x, 5), f"deriv_{x}_roc20": q.pct(x, 20), f"deriv_{x}_velocity": f"({x} - {q.lag(x, 5)}) / 5"}
    for x in ("rsi", "atr", "bb_width", "volume_ratio"):
        lo, hi = ("rsi < 30", "rsi > 70") if x == "rsi" else (f"{x} < {q.sma(x, n)} - {q.std(x, n)}", f"{x} > {q.sma(x, n)} + {q.std(x, n)}")
        out |= {f"regime_{x}_low": f"CASE WHEN {lo} THEN 1 ELSE 0 END", f"regime_{x}_mid": f"CASE WHEN {x} IS NOT NULL AND NOT coalesce({lo}, false) AND NOT coalesce({hi}, false) THEN 1 ELSE 0 END", f"regime_{x}_high": f"CASE WHEN {hi} THEN 1 ELSE 0 END"}
    for a, b in fam.CROSSES:
        f = q.frame(-(n - 1))
        out |= {f"cross_{a}_{b}_ratio": f"{a} / nullif({b}, 0)", f"cross_{a}_{b}_corr50": f"CASE WHEN count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) OVER {f} >= {n} THEN corr({a}, {b}) OVER {f} END", f"cross_{a}_{b}_diff": f"{a} - {b}"}
    for x in ("rsi", "macd", "stoch_k"):
        p, m = f"close - {q.lag('close', 14)}", f"{x} - {q.lag(x, 14)}"
        out |= {f"div_{x}_bullish": f"CASE WHEN {p} < 0 AND {m} > 0 THEN 1 ELSE 0 END", f"div_{x}_bearish": f"CASE WHEN {p} > 0 AND {m} < 0 THEN 1 ELSE 0 END"}
    h, d = "(ts_s // 3600 % 24)", "((ts_s // 86400 + 3) % 7)"
    out |= {"time_hour": h, "time_asian": f"CASE WHEN {h} < 8 THEN 1 ELSE 0 END", "time_european": f"CASE WHEN {h} BETWEEN 8 AND 15 THEN 1 ELSE 0 END", "time_american": f"CASE WHEN {h} >= 16 THEN 1 ELSE 0 END",
            "time_dayofweek": d, "time_is_monday": f"CASE WHEN {d} = 0 THEN 1 ELSE 0 END", "time_is_friday": f"CASE WHEN {d} = 4 THEN 1 ELSE 0 END"}
    cols = ", ".join(f"{q.r(out[n], _places(n))} AS {n}" for n in fam.feature_names_74())
    return f"{st} SELECT {K}, {cols} FROM w1"


@query("features_74", "W32 F28", _sql_74())
def _(spark, base):
    names = fam.feature_names_74()
    df = over_chunks(indexed_bars(spark, base), fam.add_features_74)
    return df.select(*SERIES, "bar_idx", *[rounded(n, _places(n)).alias(n) for n in names])


SV = ["sv_last", "sv_mean", "sv_vol", "sv_trend", "sv_relative", "sv_low", "sv_mid", "sv_high"]
SV_SQL = q.with_stages(q.BARS, ("r0", "bars", f"{q.pct('close')} AS ret"), ("r1", "r0", f"stddev_samp(ret) OVER {q.frame(-19)} AS sd"))


def _kept(x):
    return f"coalesce(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, -10), 10) END, 0)"


@query("state_vector", "W33", _sel(SV_SQL, {
    "sv_last": _kept("ret"), "sv_mean": _kept(f"avg(ret) OVER {q.frame(-19)}"), "sv_vol": _kept("sd"), "sv_trend": _kept(f"(close / first_value(close) OVER {q.frame(-20)} - 1)"),
    "sv_relative": f"CASE WHEN bar_idx >= 1 THEN {_kept(f'(close / avg(close) OVER {q.frame(-20)} - 1)')} ELSE 0 END", "sv_low": "CASE WHEN bar_idx >= 1 AND sd < 0.015 THEN 1 ELSE 0 END",
    "sv_mid": "CASE WHEN bar_idx < 1 OR (sd >= 0.015 AND sd < 0.03) THEN 1 ELSE 0 END", "sv_high": "CASE WHEN bar_idx >= 1 AND (sd IS NULL OR sd >= 0.03) THEN 1 ELSE 0 END"}, "r1"))
def _(spark, base):
    return shown(over_chunks(indexed_bars(spark, base), fam.add_state_vector, before=64), *SV)


def _fold(n):
    a = 2.0 / (n + 1)
    lst = f"list(close) OVER {q.frame(-n)}"
    return f"list_reduce({lst}, lambda s, x: s * {1 - a!r} + x * {a!r})"


_FB = {
    "rsi": "rsi", "rsi_scaled": "rsi / 100", "rsi_mean": f"avg(rsi) OVER {q.frame(-10)}", "rsi_dev": f"rsi - avg(rsi) OVER {q.frame(-10)}", "rsi_slope": f"rsi - {q.lag('rsi', 5)}", "close": "close",
    "volume_ratio": f"volume / avg(volume) OVER {q.frame(-20, -1)}", "atr_ratio": "atr / close", "ret_5": q.pct("close", 5), "ret_20": q.pct("close", 20), "to_ma20": "close / ma20", "to_ma50": "close / ma50", "ma20_ma50": "ma20 / ma50",
    "to_ema9": "close / e9s", "ema9_ema21": "e9s / e21s", "vol_20": "vs", "vol_50": "vl", "vol_share": "vs / (vl + 1e-8)", "above_low": "(close - l20) / (h20 - l20 + 1e-8)", "below_high": "(h20 - close) / (h20 - l20 + 1e-8)",
    "regime_code": "CASE trend_regime WHEN 'BULL_TREND' THEN 1 WHEN 'BEAR_MARKET' THEN -1 WHEN 'CRISIS' THEN -2 ELSE 0 END", "drawdown_50": f"(close - max(high) OVER {q.frame(-50)}) / max(high) OVER {q.frame(-50)}", "momentum_10": q.pct("close", 10), "momentum_30": q.pct("close", 30),
    "momentum_gap": f"{q.pct('close', 10)} - {q.pct('close', 30)}", "body": "abs(close - open) / open", "bar_place": "(close - low) / (high - low + 1e-8)", "volume_trend": f"avg(volume) OVER {q.frame(-5)} / (avg(volume) OVER {q.frame(-20)} + 1e-8)",
    "to_ma200": f"CASE WHEN bar_idx >= 200 THEN close / avg(close) OVER {q.frame(-200)} ELSE 1 END", "trend_100": f"CASE WHEN bar_idx >= 100 THEN {q.pct('close', 100)} ELSE 0 END",
    "down_run": "CASE WHEN NOT d1 THEN 0 WHEN NOT d2 THEN 1 WHEN NOT d3 THEN 2 WHEN NOT d4 THEN 3 WHEN NOT d5 THEN 4 ELSE 5 END"}
FB_SQL = q.with_stages(T9_SQL, ("fb0", "t4", f"{q.pct('close')} AS ret, close < open AS red, avg(close) OVER {q.frame(-20)} AS ma20, avg(close) OVER {q.frame(-50)} AS ma50, {_fold(9)} AS e9s, {_fold(21)} AS e21s, max(high) OVER {q.frame(-20)} AS h20, min(low) OVER {q.frame(-20)} AS l20"),
                       ("fb1", "fb0", f"stddev_samp(ret) OVER {q.frame(-19)} AS vs, stddev_samp(ret) OVER {q.frame(-49)} AS vl, " + ", ".join(f"{q.lag('red', i)} AS d{i}" for i in range(1, 6))))


@query("fallback_features", "W34 P15", q.with_stages(FB_SQL, ("fb2", "fb1", ", ".join(f"coalesce({_FB[n]}, 0) AS f_{n}" for n in fam.FALLBACK))) + f" SELECT {K}, " + ", ".join(f"{q.r(f'f_{n}', _places(n))} AS {n}" for n in fam.FALLBACK) + " FROM fb2 WHERE bar_idx >= 50")
def _(spark, base):
    bars = running_bars(indexed_bars(spark, base), {"first_close": ("first", c("close"))})
    return shown(over_chunks(bars, fam.add_fallback_31, before=1024).where("bar_idx >= 50"), *fam.FALLBACK, places={n: _places(n) for n in fam.FALLBACK})


# ------------------------------------------------------------------ events around bars

REQ = "SELECT event_type AS symbol, event_id, epoch_us(ts) // 1000000 AS want FROM events"


def marks(spark, base):
    """Every event is a moment that patterns are cut around."""
    return event_ticks(spark, base).select("symbol", c("tick_id").alias("event_id"), F.floor(c("us") / 1_000_000).alias("ts_s"))


@query("nearest_bar", "J3", q.bars_of(q.event_bars("1h", 3600)) + f""", rq AS ({REQ}), n AS (SELECT rq.symbol, event_id, want, ts_s, bar_idx, row_number() OVER (PARTITION BY event_id ORDER BY abs(ts_s - want), ts_s) AS rn FROM rq JOIN bars b ON b.symbol = rq.symbol AND abs(ts_s - want) <= 1800)
SELECT symbol, event_id, want, ts_s, bar_idx FROM n WHERE rn = 1""")
def _(spark, base):
    bars = with_bar_index(ohlcv(event_ticks(spark, base), "1h")).select("symbol", "ts_s", "bar_idx")
    hit = nearest_join(marks(spark, base), bars, ["symbol"], "ts_s", "event_id", F.lit(1800), 1800)
    return hit.select("symbol", "event_id", "want", c("match.ts_s").alias("ts_s"), c("match.bar_idx").alias("bar_idx"))


SNAP = q.bars_of(q.event_bars("1h", 3600)) + f""", rq AS ({REQ}), ev AS (SELECT rq.symbol, event_id, bar_idx AS at FROM rq JOIN bars b ON b.symbol = rq.symbol AND b.ts_s = want // 3600 * 3600),
sn AS (SELECT ev.symbol, event_id, b.bar_idx - at AS bar_position, b.high, b.low, b.close, b.volume FROM ev JOIN bars b ON b.symbol = ev.symbol AND b.bar_idx BETWEEN at - 100 AND at + 50)""".replace(" at ", " at_ ").replace("AS at ", "AS at_ ").replace("- at,", "- at_,").replace("bar_idx - at ", "bar_idx - at_ ").replace("at - 100 AND at + 50", "at_ - 100 AND at_ + 50")


def _centered(spark, base):
    """events(symbol, event_id, center) with the number of the bar that each lies in, and the bars."""
    bars = cut(with_bar_index(ohlcv(event_ticks(spark, base), "1h")))
    at = marks(spark, base).withColumn("ts_s", (F.floor(c("ts_s") / 3600) * 3600).cast("long"))
    ev = at.join(bars.select("symbol", "ts_s", c("bar_idx").alias("center")), ["symbol", "ts_s"]).select("symbol", "event_id", "center")
    return ev, bars.select("symbol", "bar_idx", "ts_s", "open", "high", "low", "close", "volume")


def snapshots(spark, base):
    ev, bars = _centered(spark, base)
    return around(ev, bars, ["symbol"], "center", 100, 50)


def snapshot_windows(spark, base):
    """events(symbol, event_id, center) and the bars around each center, once however many events share it: together what `snapshots` gives for every event."""
    ev, bars = _centered(spark, base)
    return ev, around(ev.select("symbol", "center").distinct(), bars, ["symbol"], "center", 100, 50)


@query("pattern_snapshots", "J8 J9", SNAP + f""" SELECT symbol, event_id, bar_position, {q.r('close')} AS close, {q.r('volume')} AS volume FROM sn""")
def _(spark, base):
    return shown(snapshots(spark, base), "close", "volume", keys=["symbol", "event_id", "bar_position"])


@query("snapshot_outcomes", "J9 L6 L19", SNAP + f""" SELECT symbol, event_id, count(*) FILTER (bar_position > 0) AS future_bars, {q.r('(max(high) FILTER (bar_position > 0) / max(close) FILTER (bar_position = 0) - 1) * 100', 4)} AS max_profit_pct,
 {q.r('(1 - min(low) FILTER (bar_position > 0) / max(close) FILTER (bar_position = 0)) * 100', 4)} AS max_drawdown_pct, min(bar_position) FILTER (bar_position > 0 AND high >= c0 * 1.02) AS first_tp FROM (SELECT *, max(CASE WHEN bar_position = 0 THEN close END) OVER (PARTITION BY event_id) AS c0 FROM sn) GROUP BY symbol, event_id""")
def _(spark, base):
    """A snapshot is a matter of its center, so what follows is summed up once a center; only an event's own price and number of records come from the events."""
    ev, windows = snapshot_windows(spark, base)
    later = c("bar_position") > 0
    paths = cut(windows.groupBy("symbol", "center").agg(
        F.max(F.when(c("bar_position") == 0, c("close"))).alias("c0"), F.count_if(later).alias("future"), F.max(F.when(later, c("high"))).alias("top"), F.min(F.when(later, c("low"))).alias("bottom"),
        F.sort_array(F.collect_list(F.when(later, F.struct("bar_position", "high")))).alias("path")))
    one = Window.partitionBy("event_id")
    s = ev.where("event_id IS NOT NULL").join(paths.select("symbol", "center", "c0"), ["symbol", "center"]).withColumns(
        {"records": F.count(F.lit(1)).over(one), "base": F.max("c0").over(one), "least": F.min("c0").over(one)}).drop("c0").join(paths, ["symbol", "center"])
    reached = F.filter("path", lambda p: p["high"] >= c("least") * 1.02)
    return s.withColumn("tp", F.get(reached, F.lit(0))["bar_position"]).groupBy("symbol", "event_id").agg(
        F.sum(c("future") * c("records")).alias("future_bars"), rounded((F.max("top") / F.max("base") - 1) * 100, 4).alias("max_profit_pct"),
        rounded((1 - F.min("bottom") / F.max("base")) * 100, 4).alias("max_drawdown_pct"), F.min("tp").alias("first_tp"))


@query("pattern_documents", "L17 L18 L19 F25 F30")
def _(spark, base):
    return documents(spark, base)


def documents(spark, base):
    """Nested pattern documents as JSON: setup bar, breakout bar, box, weight and forward path per candidate."""
    def cols(d, w):
        d = add_box(d, w)
        d = d.withColumn("setup_bar", F.lag(F.struct("open", "high", "low", "close", "volume"), 1).over(w))
        d = lb.add_path(d, w, 50, "high", "low", "close").where("box_bars >= 10 AND bar_idx >= 2")
        sims = F.transform(F.array(*[F.struct(F.lit(t).alias("tp"), F.lit(s).alias("sl")) for t in (1.0, 1.5, 2.0, 2.5, 3.0) for s in (0.5, 1.0, 1.5, 2.0)]), lambda g: F.struct(
            g["tp"].alias("tp"), g["sl"].alias("sl"), lb.barrier(c("close"), g["tp"] / 100, g["sl"] / 100, 50).alias("outcome")))
        doc = F.struct(
            F.concat_ws("_", "symbol", "tf", F.date_format(F.timestamp_seconds("ts_s"), "yyyyMMdd_HHmm")).alias("id"), F.lit("2.0").alias("version"),
            F.struct("symbol", "tf", F.lit("long").alias("direction")).alias("meta"), F.struct(c("ts_s").alias("breakout_s"), (c("ts_s") - c("step_s")).alias("setup_s")).alias("timing"),
            F.struct("support", "resistance", "box_range_pct", "touches_support", "touches_resistance", "atr_box", "box_bars").alias("box"),
            F.struct("open", "high", "low", "close", "volume").alias("breakout_bar"), c("setup_bar"),
            F.struct("i_rsi", "i_volatility", "i_volume", "i_touches", "w_box").alias("w_box"),
            F.struct(F.size("_p_close").alias("future_bars"), (F.array_max("_p_high") / c("close") - 1).alias("max_profit"), sims.alias("simulations")).alias("future_path"))
        return d.select(*SERIES, "bar_idx", "chunk", doc["id"].alias("pattern_id"), F.to_json(doc).alias("document"))
    return over_chunks(indexed_bars(spark, base), cols, before=128, after=50)


# ------------------------------------------------------------------ vectors

@query("mahalanobis", "W31")
def _(spark, base):
    """Distance of every embedding to the distribution of labels 0-4."""
    e = read_table(spark, base, "embeddings")
    mean, inv = ml.gaussian_fit(e.where("label < 5"), "embedding")
    d = e.withColumn("distance", ml.mahalanobis(c("embedding"), mean, inv))
    return d.select("vec_id", "label", rounded("distance").alias("distance"), (c("distance") / 3 > 2).cast("int").alias("ood"))


NEAR = """WITH m AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), qy AS (SELECT * FROM m WHERE vec_id % 100 = 0),
p AS (SELECT qy.vec_id AS query_id, m.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: pow(qy.v[i] - m.v[i], 2))), 8) AS d2 FROM qy JOIN m ON m.vec_id <> qy.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS place FROM p) SELECT query_id, vec_id, place, round(d2, 6) AS d2 FROM k WHERE place <= 5"""


@query("similar_states", "O8", NEAR)
def _(spark, base):
    """Five nearest states of every query state (ids divisible by 100)."""
    found = nearest(read_table(spark, base, "embeddings"), "vec_id", "embedding", "vec_id % 100 = 0", 5)
    return found.withColumn("d2", F.round("d2", 6))
