"""Exact interpolated quantiles without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from barloom.operators.lineage import attach

# a sketch of this accuracy misses a rank by at most n / ACCURACY, well inside the bracket
MARGIN = 5e-5
ACCURACY = 100_000
# groups this small are ranked whole: below it the bracket would be narrower than a rank
SMALL = 50_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], x: str, qs: Sequence[float], small: int = SMALL) -> DataFrame:
    """(keys, q, value): linear interpolation between the two middle ranks.

    A mergeable sketch brackets each quantile by values whose rank error is
    known; only the distinct values inside the bracket are then counted and
    ranked, which makes the answer exact however large the group is.
    """
    keys = list(keys)
    src = df.where(F.col(x).isNotNull() & ~F.isnan(x)).select(*keys, F.col(x).cast("double").alias("_x"))
    probe = [p for q in qs for p in (max(q - MARGIN, 0.0), min(q + MARGIN, 1.0))]
    sketch = src.groupBy(*keys).agg(
        F.percentile_approx("_x", probe, ACCURACY).alias("p"), F.count("_x").alias("n"),
        F.min("_x").alias("lo_all"), F.max("_x").alias("hi_all"))
    bands = sketch.select(*keys, "n", F.array(*[
        F.struct(
            F.lit(float(q)).alias("q"),
            F.when((F.col("n") <= small) | F.lit(q <= MARGIN), F.col("lo_all")).otherwise(F.col("p")[2 * i]).alias("lo"),
            F.when((F.col("n") <= small) | F.lit(q >= 1 - MARGIN), F.col("hi_all")).otherwise(F.col("p")[2 * i + 1]).alias("hi"))
        for i, q in enumerate(qs)]).alias("_bands"))
    placed = (src.join(bands, keys) if keys else src.transform(attach, bands)).select(
        *keys, "_x", "n", F.explode("_bands").alias("b")).select(*keys, "_x", "n", "b.*")
    # everything under the bracket collapses to one counted row, values inside to one row each
    spot = F.when(F.col("_x") >= F.col("lo"), F.col("_x"))
    counted = (
        placed.where(F.col("_x") <= F.col("hi"))
        .groupBy(*keys, "q", "n", spot.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    )
    upto = Window.partitionBy(*keys, "q").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    pos = F.col("q") * (F.col("n") - 1)
    ranked = counted.withColumn("upto", F.sum("c").over(upto)).where(F.col("v").isNotNull())
    low = F.min(F.when(F.col("upto") > F.floor(pos), F.col("v")))
    high = F.min(F.when(F.col("upto") > F.ceil(pos), F.col("v")))
    return (
        ranked.groupBy(*keys, "q", "n").agg(low.alias("a"), high.alias("b"))
        .select(*keys, "q", (F.col("a") + (F.col("b") - F.col("a")) * (pos - F.floor(pos))).alias("value"))
    )


def quantile_columns(df: DataFrame, keys: Sequence[str], x: str, named: dict[str, float]) -> DataFrame:
    """One row per group with one column per named quantile."""
    out = exact_quantiles(df, keys, x, list(dict.fromkeys(named.values())))
    pick = [F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(n) for n, q in named.items()]
    return out.groupBy(*keys).agg(*pick) if keys else out.agg(*pick)


def sliced(df: DataFrame, x: str, name: str = "_slice", rows: int = 500_000) -> DataFrame:
    """Number contiguous value ranges of ``x`` that hold about ``rows`` rows each.

    The cut points (one number for each range) are sketched once; a row finds its range
    by binary search. ``df`` should be cheap to read again (see ``lineage.cut``)."""
    k = -(-df.count() // rows)
    if k <= 1:
        return df.withColumn(name, F.lit(0.0))
    cuts = df.agg(F.percentile_approx(x, [i / k for i in range(1, k)], 10 * k)).first()[0]
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    return Bucketizer(splits=splits, inputCol=x, outputCol=name, handleInvalid="keep").transform(df)
