"""Regime, crisis, recovery, liquidity and latch states in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barloom.functions.columns import flag, pct_change, ratio, rolling_std, sma
from barloom.operators import indicators as ind
from barloom.operators.chunks import over_chunks, running_bars
from barloom.schema import SERIES

# Windows in bars and thresholds.
VOTE_WINDOWS = {"1d": 96, "7d": 672, "30d": 2880}
BULL_CUT, BEAR_CUT = 0.02, -0.02
ALERT_1H, HALT_1H, CRISIS_24H, ALERT_7D, CRISIS_7D = -0.10, -0.25, -0.20, -0.12, -0.25


def window_return(w: WindowSpec, n: int) -> Column:
    """Return over n rows, both ends counted; 0 while fewer rows exist."""
    past = F.lag("close", n - 1).over(w)
    return F.when(F.col("bar_idx") >= n - 1, F.coalesce(ratio(F.col("close") - past, past), F.lit(0.0))).otherwise(0.0)


def add_regime_vote(df: DataFrame, w: WindowSpec, windows: dict[str, int] = VOTE_WINDOWS) -> DataFrame:
    df = df.withColumns({f"ret_{k}": window_return(w, n) for k, n in windows.items()})
    kinds = [F.when(F.col(f"ret_{k}") > BULL_CUT, "BULL").when(F.col(f"ret_{k}") < BEAR_CUT, "BEAR").otherwise("SIDEWAYS")
             for k in windows]
    votes = {r: sum((flag(k == r) for k in kinds[1:]), flag(kinds[0] == r)) for r in ("BULL", "BEAR", "SIDEWAYS")}
    df = df.withColumns({f"_v_{r}": v for r, v in votes.items()})
    top = F.greatest(*[F.col(f"_v_{r}") for r in votes])
    df = df.withColumn("votes", top)
    return df.withColumn("regime", F.when(top <= 1, "UNKNOWN").when(F.col("_v_BULL") == top, "BULL").when(
        F.col("_v_BEAR") == top, "BEAR").otherwise("SIDEWAYS")).drop(*[f"_v_{r}" for r in votes])


def hysteresis(df: DataFrame, regime: str = "regime", periods: int = 2) -> DataFrame:
    """A new regime counts once it was seen max(periods, 2) times in a row.

    Adds ``confirmed`` and ``changed_at`` (bar of the last switch, null before one)."""
    need = max(periods, 2)
    def mark(d, w):
        same = F.col(regime).eqNullSafe(F.lag(regime, 1).over(w))
        for k in range(2, need):
            same = same & F.col(regime).eqNullSafe(F.lag(regime, k).over(w))
        return d.withColumn("_seen", F.when(same | (F.col("bar_idx") == 0), F.col(regime)))
    df = running_bars(over_chunks(df, mark, before=need), {"confirmed": ("last", F.col("_seen"))})
    def switches(d, w):
        moved = ~F.col("confirmed").eqNullSafe(F.lag("confirmed", 1).over(w)) & (F.col("bar_idx") > 0)
        return d.withColumns({"_moved": F.when(moved, F.col("bar_idx")), "was": F.lag("confirmed", 1).over(w)})
    return running_bars(over_chunks(df, switches, before=1), {"changed_at": ("last", F.col("_moved"))}).drop("_seen", "_moved")


def crisis_rules(r1: Column, r24: Column, r7: Column) -> Column:
    """Names of the rules that fired; ``first_close`` must be present."""
    i = F.col("bar_idx")
    since = ratio(F.col("close") - F.col("first_close"), "first_close")
    early = (i >= 95) & (i < 671)
    return F.array_compact(F.array(
        F.when((i >= 3) & (r1 <= HALT_1H), "EMERGENCY_1H").when((i >= 3) & (r1 <= ALERT_1H), "WARNING_1H"),
        F.when((i >= 95) & (r24 <= CRISIS_24H), "CRISIS_24H"),
        F.when((i >= 671) & (r7 <= CRISIS_7D), "CRISIS_7D").when((i >= 671) & (r7 <= ALERT_7D), "WARNING_7D")
        .when(early & (since <= CRISIS_7D), "CRISIS_SINCE_START").when(early & (since <= ALERT_7D), "WARNING_SINCE_START")))


def alert_level(rules: Column) -> Column:
    def any_of(prefix):
        return F.exists(rules, lambda x: x.startswith(prefix))
    return F.when(any_of("EMERGENCY"), "HALT").when(any_of("CRISIS"), "CRISIS").when(any_of("WARNING"), "ALERT").otherwise("NORMAL")


def add_resume(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Window parts of the five-factor recovery check."""
    i = F.col("bar_idx")
    df = df.withColumns({"_ret": pct_change("close", 1, w), "sma_20": sma("close", 20, w)})
    df = df.withColumn("_vol", rolling_std("_ret", 20, w))
    day = w.rowsBetween(-95, 0)
    high = F.max("close").over(day)
    vol_now, vol_base = F.avg("_vol").over(w.rowsBetween(-20, 0)), F.percentile("_vol", F.lit(0.5)).over(w.rowsBetween(-200, 0))
    v_now, v_base = F.avg("volume").over(w.rowsBetween(-20, 0)), F.percentile("volume", F.lit(0.5)).over(w.rowsBetween(-100, 0))
    df = df.withColumns({"_high": high, "_vn": vol_now, "_vb": vol_base, "_un": v_now, "_ub": v_base, "_s9": F.lag("sma_20", 9).over(w)})
    def yes(c):
        return F.coalesce(c, F.lit(False))
    return df.withColumns({
        "price_stable": yes((i >= 95) & (ratio(F.col("_high") - F.col("close"), "_high") < 0.05)),
        "vol_normal": yes((i >= 200) & (ratio("_vn", "_vb") < 1.3)),
        "volume_healthy": yes((i >= 100) & (ratio("_un", "_ub") >= 0.6)),
        "trend_strong": yes((i >= 29) & (F.col("close") > F.col("sma_20")) & (F.col("sma_20") > F.col("_s9") * 1.02)),
    }).drop("_ret", "_vol", "_high", "_vn", "_vb", "_un", "_ub", "_s9")


def recovery_event(ready: Column, deep: Column) -> dict[str, Column]:
    """``recovering`` flag and the event it raises. An episode ends when the 7-day
    drawdown is above -10%; its reference is fixed at its first recovering bar."""
    rec = F.coalesce(ready & deep & (F.col("close") > F.col("low_7d.close") * 1.03), F.lit(False))
    return {"recovering": rec, "_event": F.when(ready & ~deep, "reset").when(rec, "recovering")}


def market_state(bars: DataFrame) -> DataFrame:
    """Vote, hysteresis, crisis score, recovery check and the recommendation per bar.

    Two rounds of (bounded windows, running pass): everything the first round marks is
    carried along the series in one pass, and the same for the second."""
    def first_round(d, w):
        d = add_resume(add_regime_vote(d, w), w)
        d = d.withColumn("_low", F.struct((-F.col("close")).alias("m"), (-F.col("bar_idx")).alias("neg_idx")))
        d = ind.add_rolling_extremes(d, {"_high7": ("max", "close", 672), "_low7": ("max", "_low", 672)})
        d = d.withColumns({
            "drawdown_7d": ratio(F.col("close") - F.col("_high7"), "_high7"),
            "low_7d": F.struct((-F.col("_low7.m")).alias("close"), F.col("_low7.neg_idx").alias("neg_idx")),
            "_seen": F.when(F.col("regime").eqNullSafe(F.lag("regime", 1).over(w)) | (F.col("bar_idx") == 0), F.col("regime")),
            **{f"_r{n}": window_return(w, n) for n in (4, 96, 672)}})
        return d.withColumns(recovery_event(F.col("bar_idx") >= 287, F.col("drawdown_7d") < -0.10)).drop("_low", "_high7", "_low7")

    def second_round(d, w):
        d = d.withColumns({"was": F.lag("confirmed", 1).over(w), "_before": F.lag("_last", 1).over(w)})
        moved = ~F.col("confirmed").eqNullSafe(F.col("was")) & (F.col("bar_idx") > 0)
        starts = (F.col("_event") == "recovering") & F.coalesce(F.col("_before") == "reset", F.lit(True))
        return d.withColumns({
            "_moved": F.when(moved, F.col("bar_idx")),
            "_mark": F.when(F.col("_event") == "reset", F.lit(-1).cast("long")).when(starts, -F.col("low_7d.neg_idx"))})

    df = running_bars(over_chunks(bars, first_round, before=4096), {
        "confirmed": ("last", F.col("_seen")), "_last": ("last", F.col("_event")), "first_close": ("first", F.col("close"))})
    df = running_bars(over_chunks(df, second_round, before=1), {"changed_at": ("last", F.col("_moved")), "_ref": ("last", F.col("_mark"))})
    df = df.withColumns({"recovery_bar": F.when(F.col("_ref") >= 0, F.col("_ref")), "rules": crisis_rules(F.col("_r4"), F.col("_r96"), F.col("_r672"))})
    df = df.withColumn("alert", alert_level(F.col("rules")))
    from_bear = (F.col("was") == "BEAR") & F.col("confirmed").isin("SIDEWAYS", "BULL")
    checked = F.coalesce(from_bear, F.lit(False)) | F.col("recovering")
    ref = F.coalesce("recovery_bar", "changed_at")
    sustained = ref.isNull() | (F.col("bar_idx") - ref >= 192)
    score = sum((c.cast("int") for c in (F.col("vol_normal"), F.col("volume_healthy"), sustained, F.col("trend_strong"))),
                F.col("price_stable").cast("int"))
    df = df.withColumn("resume_score", F.when(checked & (F.col("bar_idx") >= 96), score))
    level = F.when(~checked, F.lit(None)).when(F.col("bar_idx") < 96, "CAUTIOUS").when(F.col("resume_score") >= 4, "NORMAL").when(
        F.col("resume_score") >= 3, "CAUTIOUS").otherwise("HALT")
    df = df.withColumn("resume", level)
    return df.withColumn("recommendation", F.when(F.col("alert").isin("HALT", "CRISIS"), "HALT").when(F.col("alert") == "ALERT", "CAUTION").when(
        F.col("resume") == "HALT", "HALT").when(F.col("resume") == "CAUTIOUS", "CAUTION").otherwise("CONTINUE"))


def add_trend_regime(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Average/return/drawdown regime with confidence; frames of 21, 201 and up to 721 rows."""
    i, c = F.col("bar_idx"), F.col("close")
    df = ind.add_rolling_extremes(df, {"_high": ("max", "close", 721)})
    far = F.coalesce(F.lag("close", 720).over(w), F.col("first_close"))
    df = df.withColumns({
        "_ms": F.avg("close").over(w.rowsBetween(-20, 0)), "_ml": F.avg("close").over(w.rowsBetween(-200, 0)),
        "_far": far, "_sd21": F.stddev_samp("close").over(w.rowsBetween(-20, 0)),
        "_sd180": F.stddev_samp("close").over(w.rowsBetween(-200, -21)), "_mid": F.lag("close", 100).over(w)})
    df = df.withColumns({"_r": ratio(c - F.col("_far"), "_far"), "_dd": ratio(c - F.col("_high"), "_high"),
                         "_now": ratio("_sd21", c), "_was": ratio("_sd180", "_mid")})
    sharp, r = F.col("_dd") < -0.30, F.col("_r")
    regime = (
        F.when(i < 200, "SIDEWAYS").when(sharp & (F.col("_now") > F.col("_was") * 1.5), "CRISIS").when(sharp & (r < -0.10), "BEAR_MARKET")
        .when((F.col("_ms") > F.col("_ml") * 1.02) & (r > 0.10), "BULL_TREND")
        .when((F.col("_ms") < F.col("_ml") * 0.98) & (r < -0.10), "BEAR_MARKET").otherwise("SIDEWAYS"))
    df = df.withColumn("trend_regime", regime)
    apart = F.least(F.lit(1.0), F.abs(F.col("_ms") - F.col("_ml")) / F.col("_ml") / 0.05)
    moved = F.least(F.lit(1.0), F.abs(r) / 0.20)
    conf = F.when(F.col("trend_regime") == "CRISIS", F.least(F.lit(1.0), F.abs(F.col("_dd")) / 0.30)).when(
        F.col("trend_regime") == "SIDEWAYS", 0.5).otherwise((apart + moved) / 2)
    return df.withColumn("trend_confidence", conf).drop("_high", "_ms", "_ml", "_far", "_sd21", "_sd180", "_mid", "_r", "_dd", "_now", "_was")


def add_regime_gate(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Gate with a recovering-bear state; needs rsi and atr."""
    i = F.col("bar_idx")
    past = F.lag("close", 719).over(w)
    df = df.withColumns({"_m20": sma("close", 20, w), "_m200": sma("close", 200, w), "_v20": sma("volume", 20, w), "_a100": sma("atr", 100, w),
                         "_mom": F.when(i >= 719, ratio(F.col("close") - past, past)).otherwise(0.0)})
    vr = F.when(F.col("_a100") > 0, ratio("atr", "_a100")).otherwise(1.0)
    m20, m200, mom = F.col("_m20"), F.col("_m200"), F.col("_mom")
    gate = (
        F.when(i < 199, "SIDEWAYS").when((m20 > m200 * 1.05) & (mom > 0.15) & (vr < 2.0), "BULL_TREND")
        .when((m20 < m200) & (F.col("rsi") < 25) & (F.col("volume") > F.col("_v20") * 1.5) & (mom > -0.20), "RECOVERING_BEAR")
        .when(vr > 3.0, "VOLATILE").when((m20 < m200 * 0.95) & (mom < -0.10), "BEAR_TREND").otherwise("SIDEWAYS"))
    df = df.withColumn("gate", gate).drop("_m20", "_m200", "_v20", "_a100", "_mom")
    return df.withColumn("gate_confidence", F.when(F.col("gate") == "BULL_TREND", 1.0).when(F.col("gate") == "RECOVERING_BEAR", 0.5).otherwise(0.0))


def previous_rows_regime(w: WindowSpec) -> dict[str, Column]:
    """SMA50/200 regime and range crisis flag, from earlier rows only."""
    i, c = F.col("bar_idx"), F.col("close")
    s50, s200 = F.avg("close").over(w.rowsBetween(-50, -1)), F.avg("close").over(w.rowsBetween(-200, -1))
    return {
        "sma_regime": F.when(i < 200, "sideways").when((c > s50) & (s50 > s200), "bull").when((c < s50) & (s50 < s200), "bear").otherwise("sideways"),
        "range_crisis": F.coalesce((i >= 20) & (ind.range_atr_pct(w) > 0.04), F.lit(False)).cast("int")}


def latch(df: DataFrame, enter: Column, leave: Column, name: str = "signal") -> DataFrame:
    """In/out latch with exclusive events: 1 on entering, -1 on leaving, else 0."""
    mark = F.when(enter, 1).when(leave, 0)
    df = running_bars(df, {"_in": ("last", mark)})
    def emit(d, w):
        now, was = F.coalesce(F.col("_in"), F.lit(0)), F.coalesce(F.lag("_in", 1).over(w), F.lit(0))
        return d.withColumn(name, (now - was).cast("int"))
    return over_chunks(df, emit, before=1).drop("_in")


def liquidity_factors(spread: Column, depth: Column, volume: Column, trades: Column, depth_med: Column, volume_med: Column) -> dict[str, Column]:
    """Four flags and the alert level of a book snapshot."""
    flags = {
        "wide_spread": flag(spread.isNull() | (spread >= 0.01)),
        "thin_depth": flag(depth.isNull() | (F.when(depth_med > 0, depth / depth_med).when(depth_med.isNotNull(), 0.0).otherwise(
            F.when(depth < 10000, 0.0).otherwise(1.0)) < 0.30)),
        "low_volume": flag(F.when(volume_med > 0, volume / volume_med).when(volume_med.isNotNull(), 0.0).otherwise(1.0) < 0.20),
        "few_trades": flag(trades / 15.0 < 1.0)}
    n = sum(list(flags.values())[1:], flags["wide_spread"])
    level = F.when(n >= 4, "FROZEN").when(n >= 3, "CRISIS").when(n >= 1, "WARNING").otherwise("NORMAL")
    return {**flags, "n_triggered": n, "liquidity": level}
