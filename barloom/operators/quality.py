"""Coverage, contract and integrity checks over bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.schema import BARS_PER_YEAR, DEFAULT_BARS_PER_YEAR, SERIES

PRICES = ("open", "high", "low", "close")


def catalogue(spark: SparkSession, symbols: Sequence[str], tfs: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(s, t) for s in symbols for t in tfs], "symbol string, tf string")


def coverage(bars: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per expected series; series without bars keep nulls."""
    have = bars.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_bars"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"))
    return expected.join(have, SERIES, "left").withColumn("present", F.col("n_bars").isNotNull().cast("int"))


def unknown_series(bars: DataFrame, expected: DataFrame) -> DataFrame:
    return bars.select(*SERIES).distinct().join(expected, SERIES, "left_anti")


def bars_per_year(tf: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in BARS_PER_YEAR.items() for v in kv])
    return F.coalesce(F.try_element_at(table, tf), F.lit(DEFAULT_BARS_PER_YEAR))


def violations() -> dict[str, Column]:
    c = F.col
    return {
        "high_below_body": c("high") < F.greatest("open", "close"),
        "low_above_body": c("low") > F.least("open", "close"),
        "high_below_low": c("high") < c("low"),
        "not_positive": F.least(*PRICES) <= 0,
        "negative_volume": c("volume") < 0,
    }


def integrity(bars: DataFrame) -> DataFrame:
    """Counts of broken rows per series and rule."""
    rules = violations()
    counts = bars.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(r).alias(k) for k, r in rules.items()])
    return counts.unpivot([*SERIES, "n"], list(rules), "rule", "broken")


def quality_issues(bars: DataFrame, null_limit: float = 0.01) -> DataFrame:
    """Long table of issues per series: null rate of close, non-positive prices, high < low."""
    one = bars.groupBy(*SERIES).agg(
        F.avg(F.col("close").isNull().cast("double")).alias("null_rate"),
        *[F.count_if(F.col(p) <= 0).cast("double").alias(f"neg_{p}") for p in PRICES],
        F.count_if(F.col("high") < F.col("low")).cast("double").alias("crossed"))
    names = ["null_rate", *[f"neg_{p}" for p in PRICES], "crossed"]
    long = one.unpivot(SERIES, names, "issue", "amount")
    bad = F.when(F.col("issue") == "null_rate", F.col("amount") > null_limit).otherwise(F.col("amount") > 0)
    return long.withColumn("flagged", bad.cast("int"))


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order; extra ones are dropped, missing ones fail."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*names)


def contract_report(df: DataFrame, names: Sequence[str]) -> dict:
    have = list(df.columns)
    common = [c for c in have if c in names]
    return {
        "missing": [n for n in names if n not in have],
        "extra": [c for c in have if c not in names],
        "reordered": common != [n for n in names if n in have],
    }


def finite(*columns: str) -> Column:
    """True when every column is a finite number."""
    ok = F.lit(True)
    for c in columns:
        v = F.col(c).cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return ok


def drop_non_finite(df: DataFrame, columns: Sequence[str], max_bad_ratio: float = 1.0) -> DataFrame:
    """Rows with null, NaN or infinite values are dropped; a bad share strictly
    above the limit fails the job from inside the plan, without a driver round trip."""
    good = finite(*columns)
    share = df.agg(F.avg((~good).cast("double")).alias("_bad"))
    checked = share.select(F.when(
        F.coalesce(F.col("_bad"), F.lit(0.0)) > max_bad_ratio,
        F.raise_error(F.format_string("bad row ratio %f is above the limit", F.col("_bad"))).cast("int"),
    ).otherwise(F.lit(0)).alias("_ok"))
    return df.where(good).join(F.broadcast(checked), F.col("_ok") == 0).drop("_ok")
