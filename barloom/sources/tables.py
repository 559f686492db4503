"""Scans of the input tables and their mapping onto ticks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, base_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet scan; column choice is left to Catalyst unless given."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{base_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def packed(first: Column, *rest: tuple[Column, int]) -> Column:
    """Whole numbers as one exact decimal that sorts like the tuple; each of ``rest`` comes with its digits,
    38 in all. A fixed-width key keeps first/last aggregates on hash aggregation; a struct key would sort the ticks."""
    key = first.cast("decimal(38,0)")
    for x, digits in rest:
        key = (key * F.lit(Decimal(10) ** digits)).cast("decimal(38,0)") + x.cast("decimal(38,0)")
    return key.cast("decimal(38,0)")


def event_ticks(spark: SparkSession, base_dir: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """events -> ticks(symbol, us, price, size, tie); [since, until) is tested on the stored time, so that the scan can skip row groups."""
    ev = read_table(spark, base_dir, "events")
    kind = dict(ev.dtypes)["ts"]
    if since is not None:
        ev = ev.where(F.col("ts") >= F.lit(since).cast(kind))
    if until is not None:
        ev = ev.where(F.col("ts") < F.lit(until).cast(kind))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return ev.select(
        F.col("event_type").alias("symbol"),
        us.alias("us"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("size"),
        packed(us, (F.col("event_id"), 19)).alias("tie"),
        F.col("event_id").alias("tick_id"),
    )


def line_ticks(spark: SparkSession, base_dir: str) -> DataFrame:
    """lineitem -> ticks; price is the unit price, size the quantity."""
    li = read_table(spark, base_dir, "lineitem")
    us = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        us.alias("us"),
        price.alias("price"),
        F.col("l_quantity").alias("size"),
        # time first; equal keys carry equal prices (to a thousandth), so first and last stay well defined
        packed(us, (F.col("l_orderkey") * 16 + F.col("l_linenumber"), 13), (F.round(price * 1000), 9)).alias("tie"),
    )
