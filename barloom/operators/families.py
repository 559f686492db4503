"""Wide feature families: the 74 model columns, the state vector and the fallback set.

Window lengths of the 74 columns are our choice: z-scores and rank shares over 50
bars, stochastic over 14, divergences over 14, correlations over 50.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from barloom.functions.columns import clip, diff, flag, pct_change, ratio, rolling_std, sma
from barloom.operators import indicators as ind
from barloom.operators import states

N = 50
BASES = {"close": "close", "volume": "volume", "rsi": "rsi", "macd": "macd", "atr": "atr", "bb_width": "bb_width"}
CUTS = {"rsi": (30.0, 70.0)}


def add_inputs(df: DataFrame, w: WindowSpec) -> DataFrame:
    df = ind.add_bollinger(ind.add_atr(ind.add_rsi(ind.add_ema(df, {"_e12": 12, "_e26": 26}), w), w), w)
    lo, hi = F.min("low").over(w.rowsBetween(-13, 0)), F.max("high").over(w.rowsBetween(-13, 0))
    return df.withColumns({
        "macd": F.col("_e12") - F.col("_e26"), "volume_ratio": ratio("volume", sma("volume", 20, w)),
        "stoch_k": F.when(F.col("bar_idx") >= 13, ratio(F.col("close") - lo, hi - lo) * 100)}).drop("_e12", "_e26")


def _zscore(x: str, w: WindowSpec) -> Column:
    return ratio(F.col(x) - sma(x, N, w), rolling_std(x, N, w))


def add_norm(df: DataFrame, w: WindowSpec) -> DataFrame:
    """z-score and share of the last N values not above the current one."""
    past = w.rowsBetween(-(N - 1), 0)
    df = df.withColumns({f"norm_{n}_zscore": _zscore(x, w) for n, x in BASES.items()})
    df = df.withColumns({f"_w_{n}": F.collect_list(x).over(past) for n, x in BASES.items()})
    def not_above(n, x):
        return F.size(F.filter(f"_w_{n}", lambda v: v <= F.col(x)))
    share = {f"norm_{n}_pctile": F.when(F.size(f"_w_{n}") >= N, not_above(n, x) / F.lit(float(N))) for n, x in BASES.items()}
    return df.withColumns(share).drop(*[f"_w_{n}" for n in BASES])


def add_derivatives(df: DataFrame, w: WindowSpec) -> DataFrame:
    out = {}
    for n in ("close", "rsi", "macd", "volume"):
        out[f"deriv_{n}_diff1"] = diff(n, 1, w)
        out[f"deriv_{n}_diff2"] = diff(n, 2, w)
        out[f"deriv_{n}_roc5"] = pct_change(n, 5, w)
        out[f"deriv_{n}_roc20"] = pct_change(n, 20, w)
        out[f"deriv_{n}_velocity"] = (F.col(n) - F.lag(n, 5).over(w)) / 5.0
    return df.withColumns(out)


def add_levels(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Low, mid and high flags: fixed cuts for RSI, one deviation around the mean for the others."""
    out = {}
    for n in ("rsi", "atr", "bb_width", "volume_ratio"):
        if n in CUTS:
            low, high = F.col(n) < CUTS[n][0], F.col(n) > CUTS[n][1]
        else:
            m, s = sma(n, N, w), rolling_std(n, N, w)
            low, high = F.col(n) < m - s, F.col(n) > m + s
        out[f"regime_{n}_low"], out[f"regime_{n}_high"] = flag(low), flag(high)
    df = df.withColumns(out)
    return df.withColumns({f"regime_{n}_mid": flag((F.col(f"regime_{n}_low") == 0) & (F.col(f"regime_{n}_high") == 0) & F.col(n).isNotNull())
                           for n in ("rsi", "atr", "bb_width", "volume_ratio")})


CROSSES = [("rsi", "volume_ratio"), ("macd", "atr"), ("bb_width", "volume_ratio"), ("stoch_k", "rsi")]


def add_crosses(df: DataFrame, w: WindowSpec) -> DataFrame:
    out, span = {}, w.rowsBetween(-(N - 1), 0)
    for a, b in CROSSES:
        both = F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).over(span)
        out[f"cross_{a}_{b}_ratio"] = ratio(a, b)
        out[f"cross_{a}_{b}_corr50"] = F.when(both >= N, F.corr(a, b).over(span))
        out[f"cross_{a}_{b}_diff"] = F.col(a) - F.col(b)
    return df.withColumns(out)


def add_divergences(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Price and oscillator moving apart over 14 bars."""
    out, price = {}, F.col("close") - F.lag("close", 14).over(w)
    for n in ("rsi", "macd", "stoch_k"):
        move = F.col(n) - F.lag(n, 14).over(w)
        out[f"div_{n}_bullish"], out[f"div_{n}_bearish"] = flag((price < 0) & (move > 0)), flag((price > 0) & (move < 0))
    return df.withColumns(out)


def time_columns(ts_s: Column) -> dict[str, Column]:
    """UTC sessions: Asian 0-7, European 8-15, American 16-23; Monday is 0."""
    at = F.timestamp_seconds(ts_s)
    h, d = F.hour(at), F.weekday(at)
    return {"time_hour": h, "time_asian": flag(h < 8), "time_european": flag((h >= 8) & (h < 16)), "time_american": flag(h >= 16),
            "time_dayofweek": d, "time_is_monday": flag(d == 0), "time_is_friday": flag(d == 4)}


def feature_names_74() -> list[str]:
    return (
        [f"norm_{n}_{k}" for n in BASES for k in ("zscore", "pctile")]
        + [f"deriv_{n}_{k}" for n in ("close", "rsi", "macd", "volume") for k in ("diff1", "diff2", "roc5", "roc20", "velocity")]
        + [f"regime_{n}_{k}" for n in ("rsi", "atr", "bb_width", "volume_ratio") for k in ("low", "mid", "high")]
        + [f"cross_{a}_{b}_{k}" for a, b in CROSSES for k in ("ratio", "corr50", "diff")]
        + [f"div_{n}_{k}" for n in ("rsi", "macd", "stoch_k") for k in ("bullish", "bearish")]
        + ["time_hour", "time_asian", "time_european", "time_american", "time_dayofweek", "time_is_monday", "time_is_friday"])


def add_features_74(df: DataFrame, w: WindowSpec) -> DataFrame:
    for step in (add_inputs, add_norm, add_derivatives, add_levels, add_crosses, add_divergences):
        df = step(df, w)
    return df.withColumns(time_columns(F.col("ts_s")))


def add_state_vector(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Features over the last 21 closes with a one-hot of their volatility."""
    span = w.rowsBetween(-20, 0)
    df = df.withColumn("_r", pct_change("close", 1, w))
    df = df.withColumn("_in", F.when(F.col("bar_idx") > 0, F.col("_r")))
    tail = w.rowsBetween(-19, 0)
    df = df.withColumn("_sd", F.stddev_samp("_in").over(tail))
    zero = F.lit(0.0)
    def kept(x):
        return F.coalesce(clip(x, -10, 10), zero)
    sd = F.col("_sd")
    known = F.col("bar_idx") >= 1
    return df.withColumns({
        "sv_last": kept(F.col("_r")), "sv_mean": kept(F.avg("_in").over(tail)), "sv_vol": kept(sd),
        "sv_trend": kept(ratio("close", F.first("close").over(span)) - 1), "sv_relative": F.when(known, kept(ratio("close", F.avg("close").over(span)) - 1)).otherwise(zero),
        "sv_low": F.when(known, F.when(sd < 0.015, 1.0).otherwise(0.0)).otherwise(zero),
        "sv_mid": F.when(known, F.when((sd >= 0.015) & (sd < 0.03), 1.0).otherwise(0.0)).otherwise(1.0),
        "sv_high": F.when(known, F.when(sd.isNull() | (sd >= 0.03), 1.0).otherwise(0.0)).otherwise(zero),
    }).drop("_r", "_in", "_sd")


FALLBACK = ["rsi", "rsi_scaled", "rsi_mean", "rsi_dev", "rsi_slope", "close", "volume_ratio", "atr_ratio", "ret_5", "ret_20", "to_ma20", "to_ma50",
            "ma20_ma50", "to_ema9", "ema9_ema21", "vol_20", "vol_50", "vol_share", "above_low", "below_high", "regime_code", "drawdown_50",
            "momentum_10", "momentum_30", "momentum_gap", "body", "bar_place", "volume_trend", "to_ma200", "down_run", "trend_100"]


def add_fallback_31(df: DataFrame, w: WindowSpec) -> DataFrame:
    """The 31 ad-hoc features; needs first_close. Defined from bar 50 on."""
    c = F.col
    df = ind.add_atr(ind.add_rsi(states.add_trend_regime(df, w), w), w)
    def upto(n):
        return w.rowsBetween(-n, 0)
    def move(n):
        past = F.lag("close", n).over(w)
        return ratio(c("close") - past, past)
    def short_ema(n):
        """EMA seeded n bars back: a fold over n + 1 closes."""
        a = 2.0 / (n + 1)
        xs = F.collect_list("close").over(upto(n))
        return F.aggregate(F.slice(xs, 2, n), F.try_element_at(xs, F.lit(1)), lambda s, x: s * (1 - a) + x * a)
    df = df.withColumns({"_r": pct_change("close", 1, w), "_red": c("close") < c("open")})
    df = df.withColumns({
        "rsi_mean": F.avg("rsi").over(upto(10)), "_m20": F.avg("close").over(upto(20)), "_m50": F.avg("close").over(upto(50)),
        "_e9": short_ema(9), "_e21": short_ema(21), "vol_20": F.stddev_samp("_r").over(upto(19)), "vol_50": F.stddev_samp("_r").over(upto(49)),
        "_hi": F.max("high").over(upto(20)), "_lo": F.min("low").over(upto(20)), "_h50": F.max("high").over(upto(50)),
        "_reds": F.collect_list("_red").over(w.rowsBetween(-5, -1))})
    span = c("_hi") - c("_lo") + 1e-8
    run = F.array_position(F.reverse("_reds"), False)
    out = {
        "rsi_scaled": c("rsi") / 100.0, "rsi_dev": c("rsi") - c("rsi_mean"), "rsi_slope": c("rsi") - F.lag("rsi", 5).over(w),
        "volume_ratio": ratio("volume", F.avg("volume").over(w.rowsBetween(-20, -1))), "atr_ratio": ratio("atr", "close"), "ret_5": move(5), "ret_20": move(20),
        "to_ma20": ratio("close", "_m20"), "to_ma50": ratio("close", "_m50"), "ma20_ma50": ratio("_m20", "_m50"), "to_ema9": ratio("close", "_e9"), "ema9_ema21": ratio("_e9", "_e21"),
        "vol_share": c("vol_20") / (c("vol_50") + 1e-8), "above_low": (c("close") - c("_lo")) / span, "below_high": (c("_hi") - c("close")) / span,
        "regime_code": F.when(c("trend_regime") == "BULL_TREND", 1.0).when(c("trend_regime") == "BEAR_MARKET", -1.0).when(c("trend_regime") == "CRISIS", -2.0).otherwise(0.0),
        "drawdown_50": ratio(c("close") - c("_h50"), "_h50"), "momentum_10": move(10), "momentum_30": move(30), "momentum_gap": move(10) - move(30),
        "body": ratio(F.abs(c("close") - c("open")), "open"), "bar_place": (c("close") - c("low")) / (c("high") - c("low") + 1e-8),
        "volume_trend": F.avg("volume").over(upto(5)) / (F.avg("volume").over(upto(20)) + 1e-8),
        "to_ma200": F.when(c("bar_idx") >= 200, ratio("close", F.avg("close").over(upto(200)))).otherwise(1.0),
        "down_run": F.when(run == 0, F.size("_reds")).otherwise(run - 1).cast("double"),
        "trend_100": F.when(c("bar_idx") >= 100, move(100)).otherwise(0.0)}
    return df.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in out.items()}).withColumns(
        {k: F.coalesce(c(k), F.lit(0.0)) for k in ("rsi", "rsi_mean", "vol_20", "vol_50")})
