"""Indicator queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barloom.functions.columns import (
    clip, diff, flag, pct_change, ratio, rolling_quantile, rolling_std, sma,
)
from barloom.operators import indicators as ind
from barloom.operators.chunks import drop_halo, over_chunks, running_bars
from barloom.operators.lineage import cut
from barloom.operators.quantiles import exact_quantiles
from barloom.plans import sql as q
from barloom.plans.base import indexed_bars, shown
from barloom.plans.registry import query
from barloom.schema import SERIES

K = "symbol, tf, bar_idx"


def _sel(stages: str, cols: dict[str, str], src: str, where: str = "", places: dict[str, int] = {}) -> str:
    body = ", ".join(f"{q.r(e, places.get(n, 6))} AS {n}" for n, e in cols.items())
    return f"{stages}\nSELECT {K}, {body} FROM {src} {where}"


SMAS = (5, 9, 10, 14, 21, 50)


@query("sma", "W1", _sel(q.BARS, {f"sma_{n}": q.sma("close", n) for n in SMAS}, "bars"))
def _(spark, base):
    df = over_chunks(indexed_bars(spark, base),
                     lambda d, w: d.withColumns({f"sma_{n}": sma("close", n, w) for n in SMAS}), before=64)
    return shown(df, *[f"sma_{n}" for n in SMAS])


EMAS = {"ema_9": 9, "ema_12": 12, "ema_21": 21, "ema_26": 26, "ema_50": 50}


@query("ema", "W2", _sel(q.BARS, {n: q.ema("close", s) for n, s in EMAS.items()}, "bars"))
def _(spark, base):
    return shown(over_chunks(indexed_bars(spark, base), lambda d, w: ind.add_ema(d, EMAS)), *EMAS)


@query("ema_adjusted", "W3", _sel(q.BARS, {n: q.ema_adjusted("close", s) for n, s in EMAS.items()}, "bars"))
def _(spark, base):
    return shown(over_chunks(indexed_bars(spark, base), lambda d, w: ind.add_ema_adjusted(d, EMAS)), *EMAS)


RSI_STAGES = q.with_stages(q.BARS, ("gl", "bars", q.GAIN_LOSS),
                           ("avgs", "gl", f"{q.sma('gain', 14)} AS ag, {q.sma('loss', 14)} AS al"))


@query("rsi", "W4 W5 W6", _sel(RSI_STAGES, {
    "rsi": q.rsi(), "rsi_floor": q.rsi(variant="floor"), "rsi_inverse": q.rsi(variant="inverse")}, "avgs"))
def _(spark, base):
    def cols(d, w):
        d = ind.add_gain_loss(d, w).withColumns({"ag": sma("_gain", 14, w), "al": sma("_loss", 14, w)})
        return d.withColumns({
            "rsi": ind.rsi_value(F.col("ag"), F.col("al")),
            "rsi_floor": ind.rsi_value(F.col("ag"), F.col("al"), "floor"),
            "rsi_inverse": ind.rsi_value(F.col("ag"), F.col("al"), "inverse")})
    return shown(over_chunks(indexed_bars(spark, base), cols, before=64), "rsi", "rsi_floor", "rsi_inverse")


_D = 13 / 14
WILDER = q.BARS + f""",
gl AS (SELECT *, {q.GAIN_LOSS} FROM bars),
seed AS (SELECT symbol, tf, sum(gain) / 14 AS su, sum(loss) / 14 AS sd FROM gl WHERE bar_idx BETWEEN 1 AND 15 GROUP BY ALL),
uv AS (SELECT gl.*, su, sd,
   CASE WHEN bar_idx = 13 THEN su WHEN bar_idx > 13 THEN gain / 14 ELSE 0 END AS u,
   CASE WHEN bar_idx = 13 THEN sd WHEN bar_idx > 13 THEN loss / 14 ELSE 0 END AS v FROM gl JOIN seed USING (symbol, tf)),
rec AS (SELECT *, CASE WHEN bar_idx < 14 THEN su ELSE pow({_D!r}, bar_idx) * sum(u * pow({_D!r}, -bar_idx)) OVER {q.past()} END AS up,
   CASE WHEN bar_idx < 14 THEN sd ELSE pow({_D!r}, bar_idx) * sum(v * pow({_D!r}, -bar_idx)) OVER {q.past()} END AS dn FROM uv)"""


@query("rsi_wilder", "W7", _sel(WILDER, {
    "rsi_wilder": "100 - 100 / (1 + CASE WHEN dn = 0 THEN 0 ELSE up / nullif(dn, 0) END)"}, "rec"))
def _(spark, base):
    df = over_chunks(indexed_bars(spark, base), lambda d, w: ind.add_rsi_wilder(d, w), after=32)
    return shown(df, "rsi_wilder")


@query("atr", "W8 W9", _sel(q.with_stages(q.BARS, ("t", "bars", q.TR)), {
    "tr": "tr", "atr": q.sma("tr", 14),
    "range_atr_pct": f"max(high - low) OVER {q.frame(-14, -1)} / nullif(avg(close) OVER {q.frame(-14, -1)}, 0)"}, "t"))
def _(spark, base):
    def cols(d, w):
        return ind.add_atr(ind.add_true_range(d, w), w).withColumn("range_atr_pct", ind.range_atr_pct(w))
    return shown(over_chunks(indexed_bars(spark, base), cols, before=64), "tr", "atr", "range_atr_pct")


BB_STAGES = q.with_stages(
    q.BARS, ("bb0", "bars", f"{q.sma('close', 20)} AS mid, {q.std('close', 20)} AS sd"),
    ("bb1", "bb0", "mid + 2 * sd AS up, mid - 2 * sd AS lo"),
    ("bb2", "bb1", "(close - lo) / nullif(up - lo, 0) AS pos, (up - lo) / nullif(mid, 0) AS width"),
    ("bb3", "bb2", f"{q.roll('quantile_cont', 'width', 20, arg=', 0.2')} AS q20"))


@query("bollinger", "W10", _sel(BB_STAGES, {
    "bb_middle": "mid", "bb_std": "sd", "bb_upper": "up", "bb_lower": "lo", "bb_position": "pos", "bb_width": "width",
    "bb_squeeze": "CASE WHEN width < q20 THEN 1 ELSE 0 END"}, "bb3"))
def _(spark, base):
    def cols(d, w):
        d = ind.add_bollinger(d, w)
        return d.withColumn("_q20", rolling_quantile("bb_width", 0.2, 20, w)).withColumn(
            "bb_squeeze", flag(F.col("bb_width") < F.col("_q20")).cast("double"))
    return shown(over_chunks(indexed_bars(spark, base), cols, before=64),
                 "bb_middle", "bb_std", "bb_upper", "bb_lower", "bb_position", "bb_width", "bb_squeeze")


@query("changes", "W11", _sel(q.BARS, {
    "ret_1": q.pct("close"), "ret_5": q.pct("close", 5), "ret_10": q.pct("close", 10), "ret_20": q.pct("close", 20),
    "diff_1": f"close - {q.lag('close')}", "volume_momentum": q.pct("volume", 5)}, "bars"))
def _(spark, base):
    def cols(d, w):
        return d.withColumns({
            **{f"ret_{n}": pct_change("close", n, w) for n in (1, 5, 10, 20)},
            "diff_1": diff("close", 1, w), "volume_momentum": pct_change("volume", 5, w)})
    return shown(over_chunks(indexed_bars(spark, base), cols, before=64),
                 "ret_1", "ret_5", "ret_10", "ret_20", "diff_1", "volume_momentum")


@query("price_to_average", "W12", _sel(
    q.with_stages(q.BARS, ("m", "bars", f"{q.ema('close', 9)} AS e9, {q.ema('close', 21)} AS e21, {q.sma('close', 50)} AS s50")),
    {"to_ema9": "(close - e9) / e9", "to_ema21": "(close - e21) / e21", "to_sma50": "(close - s50) / s50",
     "over_ema9": "close / e9", "over_ema21": "close / e21", "over_sma50": "close / s50"}, "m"))
def _(spark, base):
    def cols(d, w):
        d = ind.add_ema(d, {"e9": 9, "e21": 21}).withColumn("s50", sma("close", 50, w))
        out = {}
        for name, m in (("ema9", "e9"), ("ema21", "e21"), ("sma50", "s50")):
            out[f"over_{name}"] = ratio("close", m)
            out[f"to_{name}"] = ratio(F.col("close") - F.col(m), m)
        return d.withColumns(out)
    return shown(over_chunks(indexed_bars(spark, base), cols),
                 "to_ema9", "to_ema21", "to_sma50", "over_ema9", "over_ema21", "over_sma50")


VOLS = (5, 10, 14, 20)


@query("volume_ratio", "W13", _sel(q.BARS, {
    f"volume_ratio_{n}": f"volume / nullif({q.sma('volume', n)}, 0)" for n in VOLS}, "bars"))
def _(spark, base):
    df = over_chunks(indexed_bars(spark, base), lambda d, w: d.withColumns(
        {f"volume_ratio_{n}": ratio("volume", sma("volume", n, w)) for n in VOLS}), before=64)
    return shown(df, *[f"volume_ratio_{n}" for n in VOLS])


RET = q.with_stages(q.BARS, ("rt", "bars", f"{q.pct('close')} AS ret, {q.pct('close', 5)} AS ret5"))


def with_returns(d, w):
    return d.withColumns({"ret": pct_change("close", 1, w), "ret5": pct_change("close", 5, w)})


@query("rolling_volatility", "W14", _sel(RET, {
    "vol_20": q.std("ret", 20), "vol_std": q.std("ret5", 20), "vol_50": q.std("ret", 50)}, "rt"))
def _(spark, base):
    def cols(d, w):
        d = with_returns(d, w)
        return d.withColumns({"vol_20": rolling_std("ret", 20, w), "vol_std": rolling_std("ret5", 20, w),
                              "vol_50": rolling_std("ret", 50, w)})
    return shown(over_chunks(indexed_bars(spark, base), cols, before=128), "vol_20", "vol_std", "vol_50")


LONG_SQL = q.with_stages(
    RET,
    ("l0", "rt", f"{q.sma('close', 200, 50)} AS ma, {q.std('ret', 288, 100)} AS v3, {q.std('ret', 672, 200)} AS v7, "
     f"{q.std('ret', 1344, 400)} AS v14, {q.roll('min', 'low', 2880, 100)} AS lo, {q.roll('max', 'high', 2880, 100)} AS hi, "
     f"max(high) OVER {q.frame(-672)} AS h7"),
) + f""",
med AS (SELECT symbol, tf, quantile_cont(v3, 0.5) m3, quantile_cont(v7, 0.5) m7, quantile_cont(v14, 0.5) m14 FROM l0 GROUP BY ALL),
hi7 AS (SELECT a.symbol, a.tf, a.bar_idx, min(b.bar_idx) AS hi_at FROM l0 a JOIN bars b
   ON a.symbol = b.symbol AND a.tf = b.tf AND b.bar_idx BETWEEN a.bar_idx - 672 AND a.bar_idx AND b.high = a.h7
   WHERE a.bar_idx >= 672 GROUP BY ALL),
l1 AS (SELECT l0.*, coalesce(v3, m3) f3, coalesce(v7, m7) f7, coalesce(v14, m14) f14, m7, hi_at
   FROM l0 JOIN med USING (symbol, tf) LEFT JOIN hi7 USING (symbol, tf, bar_idx))"""


@query("long_memory", "W14 W15 W16 W17 W18", _sel(LONG_SQL, {
    "distance_from_200ma": "coalesce((close - ma) / ma, 0)", "volatility_3d": "f3", "volatility_7d": "f7",
    "volatility_14d": "f14", "vol_regime": "CASE WHEN f7 > m7 * 1.5 THEN 1 WHEN f7 < m7 * 0.7 THEN -1 ELSE 0 END",
    "bars_since_7d_high": "CASE WHEN bar_idx < 672 THEN bar_idx ELSE least(bar_idx - hi_at, 672) END",
    "price_position_30d": "CASE WHEN hi IS NULL OR hi = lo THEN 0.5 ELSE greatest(least((close - lo) / nullif(hi - lo, 0), 1), 0) END"}, "l1"))
def _(spark, base):
    return shown(long_memory(indexed_bars(spark, base)), *LONG_COLUMNS)


LONG_COLUMNS = ("distance_from_200ma", "volatility_3d", "volatility_7d", "volatility_14d", "vol_regime",
                "bars_since_7d_high", "price_position_30d")


def long_memory(bars, rows: int = 8192):
    """The seven long-horizon columns; frames of up to 2,880 bars at constant cost per row."""
    def cols(d, w):
        d = d.withColumns({"ret": pct_change("close", 1, w), "_ma": sma("close", 200, w, 50),
                           "_peak": F.struct("high", (-F.col("bar_idx")).alias("neg"))})
        d = ind.add_rolling_moments(d, "ret", {"_v3": (288, 100), "_v7": (672, 200), "_v14": (1344, 400)})
        d = ind.add_rolling_extremes(d, {
            "_lo": ("min", "low", 2880), "_hi": ("max", "high", 2880), "_at": ("max", "_peak", 673)})
        i = F.col("bar_idx")
        span = ratio(F.col("close") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
        return d.withColumns({
            "distance_from_200ma": F.coalesce(ratio(F.col("close") - F.col("_ma"), "_ma"), F.lit(0.0)),
            "bars_since_7d_high": F.when(i < 672, i).otherwise(F.least(i + F.col("_at.neg"), F.lit(672))).cast("double"),
            "price_position_30d": F.coalesce(F.when(i >= 99, clip(span, 0, 1)), F.lit(0.5)),
        }).select(*bars.columns, "chunk", "_v3", "_v7", "_v14", "distance_from_200ma", "bars_since_7d_high",
                  "price_position_30d")
    df = cut(over_chunks(bars, cols, before=4096, rows=rows))
    vols = {"_v3": "_m3", "_v7": "_m7", "_v14": "_m14"}
    long = df.select(*SERIES, F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.col(v).alias("v")) for v, m in vols.items()])).alias("x"))
    med = exact_quantiles(long.select(*SERIES, "x.*"), [*SERIES, "name"], "v", [0.5])
    med = med.groupBy(*SERIES).agg(*[F.max(F.when(F.col("name") == m, F.col("value"))).alias(m) for m in vols.values()])
    df = df.join(med, SERIES, "left")
    df = df.withColumns({"volatility_3d": F.coalesce("_v3", "_m3"), "volatility_7d": F.coalesce("_v7", "_m7"),
                         "volatility_14d": F.coalesce("_v14", "_m14")})
    v7, m7 = F.col("volatility_7d"), F.col("_m7")
    return df.withColumn("vol_regime", F.when(v7 > m7 * 1.5, 1.0).when(v7 < m7 * 0.7, -1.0).otherwise(0.0))


TREND_SQL = q.with_stages(
    q.BARS, ("m", "bars", f"{q.ema('close', 9)} AS e9, {q.ema('close', 21)} AS e21, {q.sma('close', 50)} AS s50"),
    ("x", "m", "CASE WHEN e9 > e21 THEN 1.0 ELSE 0.0 END AS cross_up"))


@query("trend", "W19", _sel(TREND_SQL, {
    "trend_strength": "(e9 - e21) / close", "price_vs_sma50": "(close - s50) / s50", "ema_cross": "cross_up",
    "trend_consistency": q.sma("cross_up", 20),
    "market_regime": "CASE WHEN e9 > e21 AND close > s50 THEN 1 WHEN e9 < e21 AND close < s50 THEN -1 ELSE 0 END"}, "x"))
def _(spark, base):
    return shown(over_chunks(indexed_bars(spark, base), add_trend),
                 "trend_strength", "price_vs_sma50", "ema_cross", "trend_consistency", "market_regime")


def add_trend(d, w):
    d = ind.add_ema(d, {"ema_9": 9, "ema_21": 21}).withColumn("sma_50", sma("close", 50, w))
    d = d.withColumn("ema_cross", flag(F.col("ema_9") > F.col("ema_21")).cast("double"))
    up = (F.col("ema_9") > F.col("ema_21")) & (F.col("close") > F.col("sma_50"))
    down = (F.col("ema_9") < F.col("ema_21")) & (F.col("close") < F.col("sma_50"))
    return d.withColumns({
        "trend_strength": ratio(F.col("ema_9") - F.col("ema_21"), "close"),
        "price_vs_sma50": ratio(F.col("close") - F.col("sma_50"), "sma_50"),
        "trend_consistency": sma("ema_cross", 20, w),
        "market_regime": F.when(up, 1.0).when(down, -1.0).otherwise(0.0)})


VOLUME_SQL = q.with_stages(q.BARS, ("v", "bars",
    f"{q.sma('volume', 5)} AS v5, {q.sma('volume', 20)} AS v20, {q.roll('quantile_cont', 'volume', 20, arg=', 0.8')} AS q80"))


@query("volume_dynamics", "W20", _sel(VOLUME_SQL, {
    "volume_momentum": q.pct("volume", 5), "volume_imbalance": "(v5 - v20) / nullif(v20, 0)",
    "high_volume": "CASE WHEN volume > q80 THEN 1 ELSE 0 END"}, "v"))
def _(spark, base):
    def cols(d, w):
        d = d.withColumns({"_v5": sma("volume", 5, w), "_v20": sma("volume", 20, w),
                           "_q80": rolling_quantile("volume", 0.8, 20, w)})
        return d.withColumns({
            "volume_momentum": pct_change("volume", 5, w),
            "volume_imbalance": ratio(F.col("_v5") - F.col("_v20"), "_v20"),
            "high_volume": flag(F.col("volume") > F.col("_q80")).cast("double")})
    return shown(over_chunks(indexed_bars(spark, base), cols, before=64),
                 "volume_momentum", "volume_imbalance", "high_volume")


MOM_SQL = q.with_stages(RSI_STAGES, ("m", "avgs",
    f"{q.rsi()} AS rsi, {q.pct('close', 5)} AS r5, {q.pct('close', 20)} AS r20, "
    f"{q.roll('max', 'high', 50)} AS hh, {q.roll('min', 'low', 50)} AS ll"))


@query("momentum", "W21", _sel(MOM_SQL, {
    "rsi_divergence": f"rsi - {q.lag('rsi', 5)} - r5 * 100", "momentum_acceleration": "r5 - r20",
    "dist_from_high": "(hh - close) / hh", "dist_from_low": "(close - ll) / nullif(hh - ll, 0)"}, "m"))
def _(spark, base):
    def cols(d, w):
        d = ind.add_rsi(d, w).withColumns({
            "_r5": pct_change("close", 5, w), "_r20": pct_change("close", 20, w),
            "_hh": F.when(F.count("high").over(w.rowsBetween(-49, 0)) >= 50, F.max("high").over(w.rowsBetween(-49, 0))),
            "_ll": F.when(F.count("low").over(w.rowsBetween(-49, 0)) >= 50, F.min("low").over(w.rowsBetween(-49, 0)))})
        return d.withColumns({
            "rsi_divergence": diff("rsi", 5, w) - F.col("_r5") * 100,
            "momentum_acceleration": F.col("_r5") - F.col("_r20"),
            "dist_from_high": ratio(F.col("_hh") - F.col("close"), "_hh"),
            "dist_from_low": ratio(F.col("close") - F.col("_ll"), F.col("_hh") - F.col("_ll"))})
    return shown(over_chunks(indexed_bars(spark, base), cols, before=128),
                 "rsi_divergence", "momentum_acceleration", "dist_from_high", "dist_from_low")


@query("candles", "W22", _sel(q.BARS, {
    "candle_body": "abs(close - open) / open", "candle_direction": "sign(close - open)",
    "upper_shadow": "(high - greatest(open, close)) / open", "lower_shadow": "(least(open, close) - low) / open"}, "bars"))
def _(spark, base):
    cols = ind.candle_columns()
    return shown(indexed_bars(spark, base).withColumns(cols), *cols)


RUN_SQL = q.with_stages(
    q.BARS, ("d", "bars", "sign(close - open) AS dir"),
    ("ch", "d", f"CASE WHEN dir IS DISTINCT FROM {q.lag('dir')} THEN 1 ELSE 0 END AS changed"),
    ("isl", "ch", f"sum(changed) OVER {q.past()} AS island"),
    ("n", "isl", "row_number() OVER (PARTITION BY symbol, tf, island ORDER BY bar_idx) AS len"))


@query("candle_runs", "W23", _sel(RUN_SQL, {
    "consecutive_up": "CASE WHEN dir = 1 THEN len ELSE 0 END",
    "consecutive_down": "CASE WHEN dir = -1 THEN len ELSE 0 END"}, "n"))
def _(spark, base):
    def mark(d, w):
        d = d.withColumn("_dir", F.signum(F.col("close") - F.col("open")))
        changed = ~F.col("_dir").eqNullSafe(F.lag("_dir", 1).over(w))
        return d.withColumn("_start", F.when(changed, F.col("bar_idx")))
    df = over_chunks(indexed_bars(spark, base), mark, before=1)
    df = running_bars(df, {"_from": ("last", F.col("_start"))})
    n = (F.col("bar_idx") - F.col("_from") + 1).cast("double")
    return shown(df.withColumns({
        "consecutive_up": F.when(F.col("_dir") == 1, n).otherwise(0.0),
        "consecutive_down": F.when(F.col("_dir") == -1, n).otherwise(0.0)}), "consecutive_up", "consecutive_down")


CROSS_SQL = q.with_stages(
    q.BARS, ("m", "bars", f"{q.sma('close', 9)} AS f, {q.sma('close', 21)} AS s, "
             f"{q.ema_adjusted('close', 12)} - {q.ema_adjusted('close', 26)} AS macd, {q.ema_adjusted('close', 9)} AS sig"),
    ("p", "m", f"{q.lag('f')} AS pf, {q.lag('s')} AS ps"))


@query("crossovers", "W24 W25", _sel(CROSS_SQL, {
    "golden": "CASE WHEN s IS NOT NULL AND bar_idx > 0 AND NOT coalesce(pf > ps, false) AND f > s THEN 1 ELSE 0 END",
    "death": "CASE WHEN s IS NOT NULL AND pf > ps AND NOT f > s THEN 1 ELSE 0 END",
    "macd": "macd", "macd_signal": "sig"}, "p"))
def _(spark, base):
    def cols(d, w):
        d = ind.add_macd(d).withColumns({"_f": sma("close", 9, w), "_s": sma("close", 21, w)})
        d = d.withColumn("_above", F.coalesce(F.col("_f") > F.col("_s"), F.lit(False)))
        was = F.coalesce(F.lag("_above", 1).over(w), F.lit(False))
        ready = F.col("_s").isNotNull() & (F.col("bar_idx") > 0)
        return d.withColumns({"golden": flag(ready & ~was & F.col("_above")).cast("double"),
                              "death": flag(ready & was & ~F.col("_above")).cast("double")})
    return shown(over_chunks(indexed_bars(spark, base), cols), "golden", "death", "macd", "macd_signal")


@query("running_drawdown", "W26 W27", _sel(q.BARS, {
    "peak": f"max(close) OVER {q.past()}", "drawdown": f"close / max(close) OVER {q.past()} - 1",
    "volume_to_date": f"sum(volume) OVER {q.past()}",
    "indexed": f"close / first_value(close) OVER {q.past()} * 100"}, "bars"))
def _(spark, base):
    df = running_bars(indexed_bars(spark, base), {
        "peak": ("max", F.col("close")), "volume_to_date": ("sum", F.col("volume")), "_first": ("first", F.col("close"))})
    return shown(df.withColumns({"drawdown": ratio("close", "peak") - 1,
                                 "indexed": ratio("close", "_first") * 100}), "peak", "drawdown", "volume_to_date", "indexed")


AUTO_SQL = q.with_stages(RET, ("a", "rt", f"{q.lag('ret')} AS prev, ret * ret AS sq"))


@query("autocorrelation", "W28 W29", _sel(AUTO_SQL, {
    "autocorr_100": f"CASE WHEN count(prev) OVER {q.frame(-98)} >= 99 THEN corr(ret, prev) OVER {q.frame(-98)} END",
    "realized_vol": f"sqrt({q.sma('sq', 24)}) * sqrt(8760)"}, "a"))
def _(spark, base):
    def cols(d, w):
        d = with_returns(d, w).withColumn("_prev", F.lag("ret", 1).over(w))
        span = w.rowsBetween(-98, 0)
        return d.withColumns({
            "autocorr_100": F.when(F.count("_prev").over(span) >= 99, F.corr("ret", "_prev").over(span)),
            "realized_vol": F.sqrt(sma(F.col("ret") * F.col("ret"), 24, w)) * (8760 ** 0.5)})
    return shown(over_chunks(indexed_bars(spark, base), cols, before=128), "autocorr_100", "realized_vol")


GARCH_SQL = q.with_stages(RET, ("g", "rt",
    "0.0001 + 0.05 * coalesce(ret, 0) * coalesce(ret, 0) + CASE WHEN bar_idx = 0 THEN 0.9 * (0.0001 / (1 - 0.05 - 0.9)) ELSE 0 END AS u")
) + f""",
blk AS (SELECT *, bar_idx // 1000 AS b, bar_idx % 1000 AS j FROM g),
z AS (SELECT *, pow(0.9, j) * sum(u * pow(0.9, -j)) OVER (PARTITION BY symbol, tf, b ORDER BY bar_idx) AS z FROM blk),
e AS (SELECT symbol, tf, b + 1 AS b, z AS ze FROM z WHERE j = 999),
gv AS (SELECT z.*, z + coalesce(ze, 0) * pow(0.9, j + 1) AS v FROM z LEFT JOIN e USING (symbol, tf, b))"""


@query("garch_variance", "W30", _sel(GARCH_SQL, {"garch_vol": "sqrt(v)"}, "gv"))
def _(spark, base):
    df = over_chunks(indexed_bars(spark, base), lambda d, w: ind.add_garch(with_returns(d, w)))
    return shown(df.withColumn("garch_vol", F.sqrt("garch_var")), "garch_vol")
