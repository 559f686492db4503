"""Exits of held positions: what touches first on a trade's path, with the size that is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from barloom.functions.columns import ratio
from barloom.operators.labels import first_where

# How far the first stop is kept by the regime at entry, and the regime that only trails.
STOP_KEPT = {"BEAR_MARKET": 0.75, "CRISIS": 0.5}
TRAIL_ONLY = "BULL_TREND"
# Reward multiples and shares of what is left that the profit levels close.
LEVELS = (("TP1", 1.5, 0.4), ("TP2", 3.0, 0.3), ("TP3", 5.0, 0.2))


def locked_stop(entry: Column, stop: Column, regime: Column) -> Column:
    """First stop of a long position, nearer to the entry in the regimes of STOP_KEPT. It is set once: later regimes change nothing."""
    kept = F.lit(1.0)
    for name, share in STOP_KEPT.items():
        kept = F.when(regime == name, share).otherwise(kept)
    return entry - F.abs(entry - stop) * kept


def stop_touch(entry: Column, stop: Column, atr: Column, closes: Column, start_at: float = 0.02, initial: float = 3.0, step: float = 0.02, cap: float = 0.2) -> Column:
    """Walks the closes: STRUCT(stop in force at last, bar of the touch or null). From a profit of start_at on a parabolic trail follows the
    close, each move a step faster; the stop only rises. A bar is compared with the stop from before it."""
    def walk(s, c):
        live = s["bar"].isNull()
        hit = live & (c <= s["stop"])
        moves = live & ~hit & (ratio(c - entry, entry) >= start_at)
        trail = F.when(moves, F.greatest(F.least(F.greatest(s["trail"] + (c - s["trail"]) * s["af"], s["trail"]), c * 0.99), s["trail"])).otherwise(s["trail"])
        n = s["n"] + 1
        return F.struct(
            F.when(moves, F.greatest(s["stop"], trail)).otherwise(s["stop"]).alias("stop"), trail.alias("trail"),
            F.when(moves, F.least(s["af"] + step, F.lit(cap))).otherwise(s["af"]).alias("af"), n.alias("n"), F.when(hit, n).otherwise(s["bar"]).alias("bar"))
    begin = F.struct(stop.alias("stop"), (entry - atr * initial).alias("trail"), F.lit(step).alias("af"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bar"))
    return F.aggregate(closes, begin, walk)


def first_from(closes: Column, price: Column) -> Column:
    return first_where(closes, lambda c: c >= price)


def exits(entry: Column, stop: Column, atr: Column, regime: Column, closes: Column, horizon: int, levels: Sequence[tuple[str, float, float]] = LEVELS) -> Column:
    """Exits of a long position entered at `entry` as ARRAY<STRUCT(label, bar, price, size)>, in order; sizes are shares of the first size and add to 1.

    Touch events are looked up on the path by themselves: the stop (see ``stop_touch``), the last bar of the horizon, and each
    profit level, reward multiples of the first risk away. They are then resolved by (bar, precedence): a stop goes before the time stop and both
    before profit levels of their bar, so levels count up to the bar before the position is closed. Each level closes its share of
    what is left, the close the rest. The regime TRAIL_ONLY has no levels. A path that ends before the
    horizon leaves the rest OPEN at its last close; an empty path has no exits.
    """
    touch, n = stop_touch(entry, locked_stop(entry, stop, regime), atr, closes), F.size(closes)
    risk, at_end = F.abs(entry - stop), F.try_element_at(closes, F.greatest(n, F.lit(1)))
    parts = []
    for label, reward, share in levels:
        price = entry + risk * reward
        parts.append(F.struct(F.lit(label).alias("label"), first_from(closes, price).alias("bar"), price.alias("price"), F.lit(share).alias("share")))
    timed = F.when(n >= horizon, F.struct(F.lit("TIME_STOP").alias("label"), F.lit(horizon).alias("bar"), at_end.alias("price"), F.lit(1.0).alias("share")))
    stopped = F.when(touch["bar"].isNotNull(), F.struct(F.lit("STOP").alias("label"), touch["bar"].alias("bar"), touch["stop"].alias("price"), F.lit(1.0).alias("share")))
    last = F.coalesce(stopped, timed, F.struct(F.lit("OPEN").alias("label"), (n + 1).alias("bar"), at_end.alias("price"), F.lit(1.0).alias("share")))
    taken = F.filter(F.array(*parts), lambda p: p["bar"].isNotNull() & (p["bar"] < last["bar"]) & ~regime.eqNullSafe(F.lit(TRAIL_ONLY)))

    def sized(s, p):
        own = F.struct(p["label"].alias("label"), p["bar"].alias("bar"), p["price"].alias("price"), (s["left"] * p["share"]).alias("size"))
        return F.struct((s["left"] * (1 - p["share"])).alias("left"), F.concat(s["out"], F.array(own)).alias("out"))
    begin = F.struct(F.lit(1.0).alias("left"), F.array().cast("array<struct<label:string,bar:int,price:double,size:double>>").alias("out"))
    every = F.aggregate(F.concat(taken, F.array(last)), begin, sized)["out"]
    return F.when(n > 0, F.transform(every, lambda x: F.struct(x["label"].alias("label"), F.least(x["bar"], n).alias("bar"), x["price"].alias("price"), x["size"].alias("size"))))
