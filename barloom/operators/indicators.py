"""Technical indicators over chunked series.

Functions named ``add_*`` take a frame that already carries ``chunk`` and the
chunk window ``w`` (see ``chunks.over_chunks``) and return it with new columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barloom.functions.columns import (
    E, clip, col, diff, flag, pct_change, ratio, roll, rolling_quantile, rolling_std, sma,
)
from barloom.operators.chunks import BLOCK
from barloom.schema import SERIES


# ---------------------------------------------------------------- recursions

def add_recurrence(df: DataFrame, outputs: dict[str, tuple[Column, float]]) -> DataFrame:
    """y[t] = decay * y[t-1] + u[t], exact to double precision, without a fold.

    Inside a block of BLOCK bars the recursion is a running sum of u * decay^-j;
    the value at the end of the earlier block(s) is then carried in. A decay of
    0.55..0.96 forgets a whole block below double precision, so one carry is
    enough; slower ones take more carries (and a longer halo).
    """
    j = F.pmod(F.col("bar_idx"), F.lit(BLOCK)).cast("double")
    df = df.withColumn("_j", j).withColumn("_b", F.floor(F.col("bar_idx") / BLOCK))
    inside = Window.partitionBy(*SERIES, "chunk", "_b").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    by_block = Window.partitionBy(*SERIES, "chunk").orderBy("_b")
    for name, (u, decay) in outputs.items():
        if BLOCK * -math.log(decay) > 650:
            raise ValueError(f"decay {decay} is too fast for one block")
        df = df.withColumn(f"_u_{name}", u)
    local = {
        name: F.coalesce(F.sum(F.col(f"_u_{name}") * F.pow(F.lit(decay), -F.col("_j"))).over(inside), F.lit(0.0))
        for name, (_, decay) in outputs.items()
    }
    df = df.withColumns({f"_z_{n}": z * F.pow(F.lit(outputs[n][1]), F.col("_j")) for n, z in local.items()})
    final = {}
    for name, (_, decay) in outputs.items():
        end = F.when(F.col("_j") == BLOCK - 1, F.col(f"_z_{name}"))
        carry = F.lit(0.0)
        for k in range(1, carries_needed(decay) + 1):
            before = F.max(end).over(by_block.rangeBetween(-k, -k))
            carry = carry + F.coalesce(before, F.lit(0.0)) * (decay ** (BLOCK * (k - 1)))
        final[name] = F.col(f"_z_{name}") + F.pow(F.lit(decay), F.col("_j") + 1) * carry
    return df.withColumns(final).drop("_j", "_b", *[f"_u_{n}" for n in outputs], *[f"_z_{n}" for n in outputs])


def carries_needed(decay: float) -> int:
    return max(1, math.ceil(38.0 / (BLOCK * -math.log(decay))))


def add_ema(df: DataFrame, spans: dict[str, int], x: str = "close") -> DataFrame:
    """EMA seeded with the first value (weights not normalised)."""
    out = {}
    for name, span in spans.items():
        a = 2.0 / (span + 1)
        out[name] = (F.when(F.col("bar_idx") == 0, col(x)).otherwise(col(x) * a), 1 - a)
    return add_recurrence(df, out)


def add_ema_adjusted(df: DataFrame, spans: dict[str, int], x: str = "close") -> DataFrame:
    """EMA with normalised weights."""
    parts = {}
    for name, span in spans.items():
        d = 1 - 2.0 / (span + 1)
        parts[f"_n_{name}"] = (col(x), d)
        parts[f"_d_{name}"] = (F.lit(1.0), d)
    df = add_recurrence(df, parts)
    return df.withColumns({n: F.col(f"_n_{n}") / F.col(f"_d_{n}") for n in spans}).drop(*parts)


def add_garch(df: DataFrame, r: str = "ret", omega: float = 0.0001, alpha: float = 0.05, beta: float = 0.90,
              out: str = "garch_var") -> DataFrame:
    """Variance recursion seeded with the long-run variance."""
    seed = omega / (1 - alpha - beta)
    shock = F.lit(omega) + F.lit(alpha) * F.coalesce(col(r), F.lit(0.0)) ** 2
    first = F.col("bar_idx") == 0
    return add_recurrence(df, {out: (F.when(first, shock + beta * seed).otherwise(shock), beta)})


# ---------------------------------------------------------------- momentum

def add_gain_loss(df: DataFrame, w: WindowSpec, x: str = "close") -> DataFrame:
    d = diff(x, 1, w)
    return df.withColumn("_delta", d).withColumns({
        "_gain": F.when(F.col("_delta") > 0, F.col("_delta")).otherwise(0.0),
        "_loss": F.when(F.col("_delta") < 0, -F.col("_delta")).otherwise(0.0),
    })


def rsi_value(gain: Column, loss: Column, variant: str = "plain") -> Column:
    """From mean gain and loss. plain: no loss -> 100, nothing at all -> null;
    floor: loss + 1e-10; inverse: no loss -> 0."""
    known = gain.isNotNull() & loss.isNotNull()
    if variant == "floor":
        return F.when(known, 100 - 100 / (1 + gain / (loss + E)))
    plain = 100 - 100 / (1 + ratio(gain, loss))
    if variant == "inverse":
        return F.when(known, F.when(loss == 0, 0.0).otherwise(plain))
    return F.when(known, F.when((loss == 0) & (gain == 0), F.lit(None)).when(loss == 0, 100.0).otherwise(plain))


def add_rsi(df: DataFrame, w: WindowSpec, n: int = 14, variant: str = "plain", out: str = "rsi") -> DataFrame:
    df = add_gain_loss(df, w).withColumns({"_ag": sma("_gain", n, w), "_al": sma("_loss", n, w)})
    return df.withColumn(out, rsi_value(F.col("_ag"), F.col("_al"), variant)).drop(
        "_delta", "_gain", "_loss", "_ag", "_al")


def add_rsi_wilder(df: DataFrame, w: WindowSpec, n: int = 14, out: str = "rsi_wilder") -> DataFrame:
    """Wilder smoothing, seeded from the first n + 1 moves; the bars before the
    seed show the seed's value. Needs a halo of 2 * n rows ahead."""
    df = add_gain_loss(df, w)
    seed_frame = w.rowsBetween(-(n - 2), 2)
    at_seed = F.col("bar_idx") == n - 1
    df = df.withColumns({
        "_su": F.when(at_seed, F.sum("_gain").over(seed_frame) / n),
        "_sd": F.when(at_seed, F.sum("_loss").over(seed_frame) / n),
    })
    d = (n - 1) / n
    later = F.col("bar_idx") >= n
    df = add_recurrence(df, {
        "_up": (F.when(at_seed, F.col("_su")).when(later, F.col("_gain") / n), d),
        "_dn": (F.when(at_seed, F.col("_sd")).when(later, F.col("_loss") / n), d),
    })
    ahead = w.rowsBetween(0, n)
    early = F.col("bar_idx") < n
    df = df.withColumns({
        "_up": F.when(early, F.first("_su", ignorenulls=True).over(ahead)).otherwise(F.col("_up")),
        "_dn": F.when(early, F.first("_sd", ignorenulls=True).over(ahead)).otherwise(F.col("_dn")),
    })
    rs = F.when(F.col("_dn") == 0, 0.0).otherwise(ratio("_up", "_dn"))
    return df.withColumn(out, 100 - 100 / (1 + rs)).drop("_delta", "_gain", "_loss", "_su", "_sd", "_up", "_dn")


def add_macd(df: DataFrame) -> DataFrame:
    """EMA12 - EMA26 with normalised weights; the signal line is the EMA9 of close."""
    df = add_ema_adjusted(df, {"_e12": 12, "_e26": 26, "macd_signal": 9})
    return df.withColumn("macd", F.col("_e12") - F.col("_e26")).drop("_e12", "_e26")


# ---------------------------------------------------------------- volatility

def add_true_range(df: DataFrame, w: WindowSpec, out: str = "tr") -> DataFrame:
    prev = F.lag("close", 1).over(w)
    return df.withColumn(out, F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def add_atr(df: DataFrame, w: WindowSpec, n: int = 14, out: str = "atr") -> DataFrame:
    return add_true_range(df, w, "_tr").withColumn(out, sma("_tr", n, w)).drop("_tr")


def range_atr_pct(w: WindowSpec, n: int = 14) -> Column:
    """Largest high-low of the n bars before this one over their mean close."""
    past = w.rowsBetween(-n, -1)
    return ratio(F.max(F.col("high") - F.col("low")).over(past), F.avg("close").over(past))


def add_bollinger(df: DataFrame, w: WindowSpec, n: int = 20, k: float = 2.0) -> DataFrame:
    df = df.withColumns({"bb_middle": sma("close", n, w), "bb_std": rolling_std("close", n, w)})
    df = df.withColumns({
        "bb_upper": F.col("bb_middle") + k * F.col("bb_std"),
        "bb_lower": F.col("bb_middle") - k * F.col("bb_std"),
    })
    return df.withColumns({
        "bb_position": ratio(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")),
        "bb_width": ratio(F.col("bb_upper") - F.col("bb_lower"), "bb_middle"),
    })


# ---------------------------------------------------------------- long frames

def add_rolling_extremes(df: DataFrame, specs: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Rolling max/min over long frames at constant cost per row: any n rows are
    the tail of one n-block and the head of the next. ``specs``: out -> (max|min, column, n)."""
    w = Window.partitionBy(*SERIES, "chunk").orderBy("bar_idx")
    for out, (kind, x, n) in specs.items():
        agg = F.max if kind == "max" else F.min
        pick = F.greatest if kind == "max" else F.least
        df = df.withColumn("_nb", F.floor(F.col("bar_idx") / n))
        block = Window.partitionBy(*SERIES, "chunk", "_nb")
        df = df.withColumns({
            "_head": agg(x).over(block.orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)),
            "_tail": agg(x).over(block.orderBy(F.col("bar_idx").desc()).rowsBetween(Window.unboundedPreceding, 0)),
        })
        df = df.withColumn(out, pick(F.col("_head"), F.lag("_tail", n - 1).over(w))).drop("_nb", "_head", "_tail")
    return df


def add_rolling_moments(df: DataFrame, x: str, specs: dict[str, tuple[int, int]]) -> DataFrame:
    """Sample deviation over long frames from running sums. ``specs``: out -> (n, minimum count).
    Meant for returns: values near zero, so the sums do not cancel badly."""
    w = Window.partitionBy(*SERIES, "chunk").orderBy("bar_idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.coalesce(col(x), F.lit(0.0))
    df = df.withColumns({
        "_s1": F.sum(v).over(so_far), "_s2": F.sum(v * v).over(so_far), "_s0": F.count(col(x)).over(so_far)})
    for out, (n, need) in specs.items():
        s1, s2, s0 = [F.col(c) - F.coalesce(F.lag(c, n).over(w), F.lit(0)) for c in ("_s1", "_s2", "_s0")]
        df = df.withColumns({"_m1": s1, "_m2": s2, "_m0": s0})
        var = (F.col("_m2") - F.col("_m1") * F.col("_m1") / F.nullif(F.col("_m0"), F.lit(0))) / F.nullif(
            F.col("_m0") - 1, F.lit(0))
        df = df.withColumn(out, F.when(F.col("_m0") >= need, F.sqrt(F.greatest(var, F.lit(0.0))))).drop(
            "_m0", "_m1", "_m2")
    return df.drop("_s0", "_s1", "_s2")


# ---------------------------------------------------------------- candles

def candle_columns() -> dict[str, Column]:
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return {
        "candle_body": ratio(F.abs(F.col("close") - F.col("open")), "open"),
        "candle_direction": F.signum(F.col("close") - F.col("open")),
        "upper_shadow": ratio(F.col("high") - top, "open"),
        "lower_shadow": ratio(bottom - F.col("low"), "open"),
    }
