"""Frames most queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.functions.columns import rounded
from barloom.operators.bars import ohlcv
from barloom.operators.chunks import with_bar_index
from barloom.sources.tables import event_ticks, line_ticks


def market_bars(spark: SparkSession, base: str) -> DataFrame:
    """Hourly bars of events and daily bars of lineitem, long format."""
    return ohlcv(event_ticks(spark, base), "1h").unionByName(ohlcv(line_ticks(spark, base), "1d"))


def indexed_bars(spark: SparkSession, base: str) -> DataFrame:
    return with_bar_index(market_bars(spark, base))


KEYS = ["symbol", "tf", "bar_idx"]


def shown(df: DataFrame, *cols: str, keys=KEYS, places: int | dict[str, int] = 6) -> DataFrame:
    """Keys plus rounded doubles, the form results are compared in. Columns whose exact values end with a 5
    after six places are given nine, since there the last bit of a product would decide."""
    kinds = dict(df.dtypes)
    return df.select(*keys, *[rounded(c, places.get(c, 6) if isinstance(places, dict) else places).alias(c) if kinds[c] in ("double", "float") else c for c in cols])
