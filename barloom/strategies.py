"""User strategies: a strategy is a function from bars to bars with a ``signal`` column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def strategy(name: str):
    def wrap(fn):
        STRATEGIES[name] = fn
        return fn
    return wrap


def run_strategy(name: str, bars: DataFrame) -> DataFrame:
    """(symbol, tf, bar_idx, strategy, signal) of a registered strategy; signal is -1, 0 or 1."""
    out = STRATEGIES[name](bars)
    if "signal" not in out.columns:
        raise ValueError(f"strategy {name} returns no signal column")
    return out.select("symbol", "tf", "bar_idx", F.lit(name).alias("strategy"), F.col("signal").cast("int").alias("signal"))
