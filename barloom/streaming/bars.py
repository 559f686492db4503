"""Bars on a stream: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.sources.tables import packed


def tick_stream(spark: SparkSession, base_dir: str, files_per_trigger: int = 64) -> DataFrame:
    """events as a stream of ticks; the trigger size bounds what one micro-batch holds."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{base_dir}/events.parquet").schema
    ev = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
          .option("maxFilesPerTrigger", files_per_trigger).parquet(base_dir))
    return ev.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))


def _bar(window: Column, ticks: DataFrame) -> DataFrame:
    tie = packed(F.unix_micros("ts"), (F.col("event_id"), 19))
    out = ticks.groupBy("symbol", window.alias("w")).agg(
        F.min_by("price", tie).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", tie).alias("close"),
        F.count(F.lit(1)).alias("n_ticks"))
    return out.select("symbol", F.unix_seconds("w.start").alias("ts_s"), F.unix_seconds("w.end").alias("end_s"), "open", "high", "low", "close", "n_ticks")


def stream_bars(ticks: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling (or sliding) bars. A tick later than the watermark is dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return _bar(window, ticks.withWatermark("ts", late))


def stream_bursts(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bars over bursts of activity separated by a gap."""
    return _bar(F.session_window("ts", gap), ticks.withWatermark("ts", late))
