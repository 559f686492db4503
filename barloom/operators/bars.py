"""Ticks to bars, bars to coarser bars, gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.schema import SERIES, STEP_SECONDS


def ohlcv(ticks: DataFrame, tf: str) -> DataFrame:
    """One bar per (symbol, slot). All aggregates combine map-side, so a symbol
    holding a third of the ticks shuffles one row per slot and input task."""
    step = STEP_SECONDS[tf]
    slot = (F.floor(F.col("us") / F.lit(step * 1_000_000)) * step).cast("long")
    return (
        ticks.groupBy("symbol", slot.alias("ts_s"))
        .agg(
            F.min_by("price", "tie").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "tie").alias("close"),
            F.sum("size").alias("volume"),
            F.count(F.lit(1)).alias("n_ticks"),
        )
        .select("symbol", F.lit(tf).alias("tf"), F.lit(step).cast("long").alias("step_s"), "ts_s",
                "open", "high", "low", "close", "volume", "n_ticks")
    )


def coarser(bars: DataFrame, tf: str) -> DataFrame:
    """Roll bars up to a longer timeframe that their own step divides."""
    step = STEP_SECONDS[tf]
    slot = (F.floor(F.col("ts_s") / step) * step).cast("long")
    return (
        bars.groupBy("symbol", slot.alias("slot"))
        .agg(
            F.min_by("open", "ts_s").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "ts_s").alias("close"), F.sum("volume").alias("volume"),
            F.sum("n_ticks").alias("n_ticks"),
        )
        .select("symbol", F.lit(tf).alias("tf"), F.lit(step).cast("long").alias("step_s"),
                F.col("slot").alias("ts_s"), "open", "high", "low", "close", "volume", "n_ticks")
    )


def from_timestamps(bars: DataFrame) -> DataFrame:
    """Adopt a stored bars table with a ``ts`` column: adds step_s and ts_s."""
    steps = F.create_map(*[F.lit(v) for kv in STEP_SECONDS.items() for v in kv])
    return bars.withColumn("step_s", F.element_at(steps, F.col("tf")).cast("long")).withColumn(
        "ts_s", F.unix_seconds(F.col("ts").cast("timestamp")))


def slots(bars: DataFrame, step: Column | None = None, block: int = 4096) -> DataFrame:
    """Every slot between the first and last bar of each series.

    The slots are produced from blocks of a fixed number of slots, so the row
    that explodes never carries an array longer than ``block``."""
    ends = bars.groupBy(*SERIES, "step_s").agg(F.min("ts_s").alias("lo"), F.max("ts_s").alias("hi"))
    if step is not None:
        ends = ends.withColumn("step_s", step)
    span = F.col("step_s") * block
    blocks = ends.withColumn("b", F.explode(F.sequence("lo", "hi", span)))
    return blocks.select(
        *SERIES, "step_s",
        F.explode(F.sequence("b", F.least(F.col("hi"), F.col("b") + span - F.col("step_s")), F.col("step_s"))).alias("ts_s"),
    )
