"""Multi-timeframe feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions.columns import pct_change, ratio, rolling_std, sma
from barloom.operators import indicators as ind
from barloom.operators.asof import asof_join
from barloom.operators.bars import coarser
from barloom.operators.lineage import cut
from barloom.operators.chunks import over_chunks, running_bars, with_bar_index
from barloom.operators.quality import require_columns
from barloom.schema import SERIES

HIGHER = ("1h", "4h", "1d")

# The feature row, in the order models expect.
BASE_FEATURES = ["RSI_14", "price_to_EMA9", "price_to_EMA21", "price_to_SMA50", "BB_width_pct", "ATR_pct", "returns_5",
                 "returns_10", "volume_ratio_5", "volume_ratio_10", "price_to_EMA9_dup", "price_to_EMA21_dup",
                 "price_to_SMA50_dup"]
HIGHER_FEATURES = ["RSI_14", "returns_5", "price_to_EMA9", "price_to_EMA21", "price_to_SMA50", "ATR_pct"]
FEATURES_31 = [f"15m_{f}" for f in BASE_FEATURES] + [f"{tf}_{f}" for tf in HIGHER for f in HIGHER_FEATURES]


def timeframe_features(bars: DataFrame) -> DataFrame:
    """Ratios of one timeframe; bars must carry bar_idx."""
    def cols(d, w):
        d = ind.add_rsi(d, w, out="RSI_14")
        d = ind.add_atr(ind.add_ema(d, {"_e9": 9, "_e21": 21}), w, out="_atr")
        d = d.withColumns({"_s50": sma("close", 50, w), "_s20": sma("close", 20, w), "_d20": rolling_std("close", 20, w)})
        near = {n: ratio(F.col("close") - F.col(m), m) for n, m in
                (("price_to_EMA9", "_e9"), ("price_to_EMA21", "_e21"), ("price_to_SMA50", "_s50"))}
        return d.withColumns({
            **near, **{f"{n}_dup": c for n, c in near.items()},
            "BB_width_pct": ratio(F.col("_d20") * 2, "_s20"), "ATR_pct": ratio("_atr", "close"),
            "returns_5": pct_change("close", 5, w), "returns_10": pct_change("close", 10, w),
            "volume_ratio_5": ratio("volume", sma("volume", 5, w)),
            "volume_ratio_10": ratio("volume", sma("volume", 10, w))})
    return over_chunks(bars, cols).select("symbol", "tf", "step_s", "ts_s", "bar_idx", "close", *BASE_FEATURES)


def features_31(base_bars: DataFrame, label_time: bool = False) -> DataFrame:
    """31 columns per 15m bar: its own 13 and six of each higher timeframe.

    A higher bar is visible from its close on, not from its label time, which
    would show a bar its own future; ``label_time=True`` gives the other reading."""
    at = F.col("ts_s") if label_time else F.col("ts_s") + F.col("step_s")
    # all timeframes are one long frame, so indicators run once over all of them
    base_bars = cut(base_bars)
    every = base_bars
    for tf in HIGHER:
        every = every.unionByName(coarser(base_bars, tf))
    every = cut(timeframe_features(with_bar_index(every)).withColumn("at_s", at))
    base = every.where(F.col("tf") == "15m")
    rights = {f"h{tf}": every.where(F.col("tf") == tf).select("symbol", "at_s", *HIGHER_FEATURES) for tf in HIGHER}
    own = base.select("symbol", "at_s", "tf", "ts_s", "bar_idx", *[F.col(f).alias(f"15m_{f}") for f in BASE_FEATURES])
    wide = asof_join(own, rights, ["symbol"], "at_s", 900 * 4096)
    wide = wide.select("symbol", "tf", "ts_s", "bar_idx", *[f"`15m_{f}`" for f in BASE_FEATURES],
                       *[F.col(f"h{tf}.{f}").alias(f"{tf}_{f}") for tf in HIGHER for f in HIGHER_FEATURES])
    seen = running_bars(wide, {f"_f{i}": ("last", F.col(f)) for i, f in enumerate(FEATURES_31)})
    filled = seen.select("symbol", "tf", "ts_s", "bar_idx", *[
        F.coalesce(F.col(f"_f{i}"), F.lit(0.0)).alias(f) for i, f in enumerate(FEATURES_31)])
    return require_columns(filled, ["symbol", "tf", "ts_s", "bar_idx", *FEATURES_31])
