"""Forward returns, barrier outcomes, parameter grids and pattern geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barloom.functions.columns import ratio
from barloom.schema import SERIES


def forward_return(w: WindowSpec, horizon: int, cost: float = (0.001 + 0.0005) * 2) -> dict[str, Column]:
    """Enter at the next open, leave at the close ``horizon`` bars on; null in the cut tail."""
    entry = F.lead("open", 1).over(w)
    raw = ratio(F.lead("close", horizon).over(w) - entry, entry)
    return {"raw_ret": raw, "fee_ret": raw - cost, "target_fee": (raw - cost > 0).cast("int"), "target_raw": (raw > 0).cast("int")}


def next_open_trade(w: WindowSpec, slippage: float = 0.0005, commission: float = 0.001) -> Column:
    """Buy the next open, sell the one after, costs inside both prices."""
    buy = F.lead("open", 1).over(w) * (1 + slippage) * (1 + commission)
    sell = F.lead("open", 2).over(w) * (1 - slippage) * (1 - commission)
    return ratio(sell, buy) - 1


def add_path(df: DataFrame, w: WindowSpec, horizon: int, *columns: str) -> DataFrame:
    """The next ``horizon`` bars of each column as an array ``_p_<column>``."""
    ahead = w.rowsBetween(1, horizon)
    return df.withColumns({f"_p_{c}": F.collect_list(c).over(ahead) for c in columns})


def first_where(path: Column, test) -> Column:
    """1-based place of the first element passing ``test``, null if none."""
    return F.nullif(F.array_position(F.transform(path, test), True).cast("int"), F.lit(0))


def barrier(entry: Column, tp: Column, sl: Column, horizon: int, high="_p_high", low="_p_low", close="_p_close") -> Column:
    """Triple barrier: take-profit on a high, else stop on a low, else time; take-profit wins
    a shared bar. STRUCT(reason, bars, exit_price); OPEN when the data ends first."""
    up = first_where(F.col(high), lambda h: h >= entry * (1 + tp))
    down = first_where(F.col(low), lambda l: l <= entry * (1 - sl))
    n = F.size(close)
    tp_hit = up.isNotNull() & (down.isNull() | (up <= down))
    return (
        F.when(tp_hit, F.struct(F.lit("tp").alias("reason"), up.alias("bars"), (entry * (1 + tp)).alias("exit_price")))
        .when(down.isNotNull(), F.struct(F.lit("sl").alias("reason"), down.alias("bars"), (entry * (1 - sl)).alias("exit_price")))
        .when(n >= horizon, F.struct(F.lit("time").alias("reason"), n.alias("bars"), F.try_element_at(F.col(close), n).alias("exit_price")))
        .otherwise(F.struct(F.lit("open").alias("reason"), n.alias("bars"), F.try_element_at(F.col(close), F.greatest(n, F.lit(1))).alias("exit_price")))
    )


def close_barrier(entry: Column, tp: float, sl: float) -> Column:
    """Barrier seen on closes, filled at the bar's extreme when that is further:
    STRUCT(reason, bars, exit_price)."""
    i_tp = first_where(F.col("_p_close"), lambda c: (c - entry) / entry >= tp)
    i_sl = first_where(F.col("_p_close"), lambda c: (c - entry) / entry <= -sl)
    n = F.size("_p_close")
    def at(name, i):
        return F.try_element_at(F.col(f"_p_{name}"), i)
    return (
        F.when(i_tp.isNotNull() & (i_sl.isNull() | (i_tp < i_sl)), F.struct(
            F.lit("tp").alias("reason"), i_tp.alias("bars"), F.greatest(at("open", i_tp), at("high", i_tp), entry * (1 + tp)).alias("exit_price")))
        .when(i_sl.isNotNull(), F.struct(
            F.lit("sl").alias("reason"), i_sl.alias("bars"), F.least(at("open", i_sl), at("low", i_sl), entry * (1 - sl)).alias("exit_price")))
        .otherwise(F.struct(F.lit("time").alias("reason"), n.alias("bars"), F.try_element_at(F.col("_p_close"), F.greatest(n, F.lit(1))).alias("exit_price")))
    )


def grid(df: DataFrame, tps: Sequence[float], sls: Sequence[float]) -> DataFrame:
    """One row per (row, tp, sl): a generated array, not a join."""
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("tp"), F.lit(float(s)).alias("sl")) for t in tps for s in sls])
    return df.withColumn("_g", F.explode(pairs)).select("*", "_g.tp", "_g.sl").drop("_g")


def add_support(df: DataFrame, w: WindowSpec, lookback: int = 100) -> DataFrame:
    """Highest local low (lower than two neighbours on each side) under the close among
    the ``lookback`` bars before this one. Minima need the two bars after them."""
    low = F.col("low")
    def low_at(k):
        return F.lag("low", k).over(w) if k > 0 else F.lead("low", -k).over(w)
    is_min = (low < low_at(1)) & (low < low_at(2)) & (low < low_at(-1)) & (low < low_at(-2))
    df = df.withColumn("_min", F.when(is_min, low))
    seen = F.collect_list("_min").over(w.rowsBetween(-(lookback - 2), -3))
    below = F.array_max(F.filter(seen, lambda s: s < F.col("close")))
    return df.withColumn("support", F.when(F.col("bar_idx") >= lookback, below)).drop("_min")


def adaptive_stop(entry: Column, atr: Column, rsi: Column, support: Column, news: Column, lo: float = 0.01, hi: float = 0.05) -> Column:
    """Long stop: ATR multiple by RSI and news, a nearby support when it is close enough,
    otherwise clamped to lo..hi of the entry."""
    mult = F.lit(2.0) * F.when(rsi > 70, 0.8).when(rsi < 30, 1.2).otherwise(1.0) * F.when(news, 1.5).otherwise(1.0)
    raw = entry - atr * mult
    gap, sup_gap = (entry - raw) / entry, (entry - support) / entry
    use_support = support.isNotNull() & (support != 0) & sup_gap.between(lo, hi) & (sup_gap < gap * 1.2)
    return F.when(use_support, support).when(F.abs(gap) > hi, entry * (1 - hi)).when(F.abs(gap) < lo, entry * (1 - lo)).otherwise(raw)


def trailing_stop(entry: Column, atr: Column, closes: Column, initial: float = 3.0, step: float = 0.02, cap: float = 0.2,
                  start_at: float = 0.02) -> Column:
    """Parabolic trailing stop of a long trade folded over its path:
    STRUCT(stop, af, n, exit_bar, exit_price)."""
    def ratchet(s, c):
        live = s["exit_bar"].isNull()
        hit = live & (c <= s["stop"])
        moves = live & ~hit & ((c - entry) / entry >= start_at)
        tighter = F.least(F.greatest(s["stop"] + (c - s["stop"]) * s["af"], s["stop"]), c * 0.99)
        n = s["n"] + 1
        return F.struct(
            F.when(moves, F.greatest(tighter, s["stop"])).otherwise(s["stop"]).alias("stop"),
            F.when(moves, F.least(s["af"] + step, F.lit(cap))).otherwise(s["af"]).alias("af"),
            n.alias("n"), F.when(hit, n).otherwise(s["exit_bar"]).alias("exit_bar"))
    zero = F.struct((entry - atr * initial).alias("stop"), F.lit(step).alias("af"), F.lit(0).alias("n"),
                    F.lit(None).cast("int").alias("exit_bar"))
    return F.aggregate(closes, zero, ratchet)


def box_metrics(df: DataFrame, w: WindowSpec, lookback: int = 48, tol: float = 0.003) -> DataFrame:
    """Range of the ``lookback`` bars before this one; fewer than 10 give nulls."""
    before = w.rowsBetween(-lookback, -1)
    hl = F.collect_list(F.struct("high", "low")).over(before)
    df = df.withColumns({
        "_n": F.count("close").over(before), "support": F.min("low").over(before), "resistance": F.max("high").over(before),
        "_box": hl, "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.lag("close", 1).over(w)),
                                      F.abs(F.col("low") - F.lag("close", 1).over(w))),
        "_hl": F.col("high") - F.col("low")})
    enough = F.col("_n") >= 10
    # the first bar of the box has no earlier close inside it
    inner = F.coalesce(F.sum("_tr").over(w.rowsBetween(-(lookback - 1), -1)), F.lit(0.0))
    first = F.first("_hl").over(before)
    short = F.coalesce(F.sum("_tr").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    atr = F.when(F.col("_n") >= lookback, (inner + first) / F.col("_n")).otherwise(short / F.nullif(F.col("_n"), F.lit(0)))
    sup, res = F.col("support"), F.col("resistance")
    out = {
        "touches_support": F.size(F.filter("_box", lambda b: (b["low"] <= sup * (1 + tol)) & (b["low"] >= sup * (1 - tol)))),
        "touches_resistance": F.size(F.filter("_box", lambda b: (b["high"] >= res * (1 - tol)) & (b["high"] <= res * (1 + tol)))),
        "box_range_pct": F.when(sup > 0, (res - sup) / sup * 100).otherwise(0.0), "atr_box": atr,
        "support": sup, "resistance": res}
    df = df.withColumns({k: F.when(enough, v) for k, v in out.items()})
    return df.withColumnRenamed("_n", "box_bars").drop("_box", "_tr", "_hl")


def box_weight(rsi_z: Column, atr_z: Column, vol_z: Column, ts: Column, tr: Column) -> dict[str, Column]:
    i_rsi = F.when(F.abs(rsi_z) <= 0.5, 1.0).when(F.abs(rsi_z) <= 1.0, 0.7).when(F.abs(rsi_z) <= 1.5, 0.3).when(rsi_z.isNotNull(), 0.0)
    i_atr = F.when(atr_z < -0.5, 1.0).when(atr_z < 0, 0.8).when(atr_z < 0.5, 0.5).when(atr_z.isNotNull(), 0.0)
    i_vol = F.when(vol_z > 1.0, 1.0).when(vol_z > 0.5, 0.8).when(vol_z > 0, 0.5).when(vol_z.isNotNull(), 0.3)
    i_touch = F.when((ts >= 3) & (tr >= 3), 1.0).when((ts >= 2) & (tr >= 2), 0.7).when(ts.isNotNull() & tr.isNotNull(), 0.3)
    parts = {"i_rsi": i_rsi, "i_volatility": i_atr, "i_volume": i_vol, "i_touches": i_touch}
    product = F.lit(1.0)
    for p in parts.values():
        product = product * F.coalesce(p, F.lit(1.0))
    return {**parts, "w_box": F.when(F.coalesce(*parts.values()).isNotNull(), product)}
