"""Schemas and catalogue constants."""

from __future__ import annotations

from pyspark.sql import types as T

# Series catalogue and bars per year.
SYMBOLS = ["ALGO", "AVAX", "BTC", "DOT", "ENA", "ETH", "HBAR", "LDO", "LINK", "LTC", "ONDO", "SOL", "SUI", "UNI"]
TIMEFRAMES = ["15m", "1h", "4h", "1d"]
BARS_PER_YEAR = {"15m": 35040, "1h": 8760, "4h": 2190, "1d": 365}
DEFAULT_BARS_PER_YEAR = 365
STEP_SECONDS = {"1m": 60, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}

SERIES = ["symbol", "tf"]

BARS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("tf", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

ASSET_SNAPSHOT = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("market_cap", T.DoubleType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("change_24h", T.DoubleType()),
    T.StructField("change_7d", T.DoubleType()),
    T.StructField("change_30d", T.DoubleType()),
])
