"""Stored inputs and outputs: bars, features, snapshots, knowledge, ledgers, patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

from barloom.schema import ASSET_SNAPSHOT, BARS

PATTERN = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("meta", T.StructType([T.StructField("symbol", T.StringType()), T.StructField("tf", T.StringType()), T.StructField("direction", T.StringType())])),
    T.StructField("w_box", T.StructType([T.StructField("w_box", T.DoubleType())])),
])


def read_bars(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, tf: str | None = None,
              start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars table written by ``write_bars``: series filters prune directories, the
    inclusive date range is pushed to the parquet scan."""
    df = spark.read.schema(BARS).parquet(path)
    if tf:
        df = df.where(F.col("tf") == tf)
    if symbols:
        df = df.where(F.col("symbol").isin(list(symbols)))
    if start:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return df


def read_series_files(spark: SparkSession, directory: str) -> DataFrame:
    """One file, or one folder of part files, per series under either naming habit (BTCUSDT_15m, BTC_USDT_15m); symbol and tf come from the name."""
    out = None
    for pattern in ("*[A-Z0-9]USDT_*.parquet", "*_USDT_*.parquet"):
        try:
            df = spark.read.parquet(f"{directory}/{pattern}")
        except AnalysisException as missing:  # no file under this habit
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            continue
        name = r"([A-Z0-9]+?)_?USDT_([0-9a-z]+)\.parquet(?:/[^/]*)?$"
        df = df.withColumns({c: F.regexp_extract(F.col("_metadata.file_path"), name, i) for i, c in ((1, "symbol"), (2, "tf"))})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no series files in {directory}")
    return out


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Feature scan of exactly these columns."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def read_asset_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ASSET_SNAPSHOT).option("header", True).csv(path)


def read_knowledge(spark: SparkSession, path: str, schema: T.StructType = PATTERN) -> DataFrame:
    """JSON documents; a broken one becomes a row of nulls instead of failing the scan."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_bars(bars: DataFrame, path: str) -> None:
    bars.write.mode("overwrite").partitionBy("tf", "symbol").parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = (), places: int | None = None) -> None:
    """Ledger, equity and metrics sink: parquet, csv or json, partitioned, doubles rounded on request."""
    if places is not None:
        df = df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    writer = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    writer = writer.option("header", True) if kind == "csv" else writer
    writer.format(kind).save(path)


def write_patterns(documents: DataFrame, snapshots: DataFrame, path: str, events: DataFrame | None = None) -> None:
    """One JSON document per line and a partitioned snapshot table next to it.

    With ``events(symbol, event_id, center)``, ``snapshots`` are windows of bars around a center, stored once each, and the events are stored as a table of
    their own: an event's snapshot is the window around its center, see ``read_snapshots``."""
    documents.select("document").write.mode("overwrite").text(f"{path}/documents")
    if events is not None:
        # the folder's symbol may be read as another type; series is the symbol as it was
        snapshots = snapshots.withColumn("series", F.col("symbol"))
        events.withColumnRenamed("symbol", "series").write.mode("overwrite").parquet(f"{path}/events")
    snapshots.write.mode("overwrite").partitionBy("symbol").parquet(f"{path}/snapshots")


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Windows of a knowledge folder, a row for each center and bar."""
    return spark.read.parquet(f"{path}/snapshots")


def read_window_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a knowledge folder: series, event_id and the center of their window."""
    return spark.read.parquet(f"{path}/events")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of a knowledge folder written with its events, a row for each event and bar."""
    return read_window_events(spark, path).join(read_windows(spark, path), ["series", "center"]).drop("series")
