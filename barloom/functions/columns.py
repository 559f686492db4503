"""Small column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F

E = 1e-10


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a, b) -> Column:
    """Null on a zero divisor; ANSI mode would raise."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def rounded(x, places: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(col(x).cast("double"), places) + F.lit(0.0)


def flag(cond: Column) -> Column:
    """1 when true, 0 when false or unknown."""
    return F.when(cond, 1).otherwise(0)


def clip(x, lo: float, hi: float) -> Column:
    """Clip that keeps nulls null."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def roll(agg, x, n: int, w: WindowSpec, need: int | None = None) -> Column:
    """``agg`` over the last ``n`` rows, null until ``need`` (default n) values were seen."""
    frame = w.rowsBetween(-(n - 1), 0)
    x = col(x)
    return F.when(F.count(x).over(frame) >= (n if need is None else need), agg(x).over(frame))


def sma(x, n, w, need=None) -> Column:
    return roll(F.avg, x, n, w, need)


def rolling_std(x, n, w, need=None) -> Column:
    return roll(F.stddev_samp, x, n, w, need)


def rolling_quantile(x, q: float, n, w, need=None) -> Column:
    return roll(lambda c: F.percentile(c, F.lit(q)), x, n, w, need)


def pct_change(x, n, w) -> Column:
    x = col(x)
    return ratio(x, F.lag(x, n).over(w)) - 1


def diff(x, n, w) -> Column:
    x = col(x)
    return x - F.lag(x, n).over(w)
