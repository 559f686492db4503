"""Tables of time intervals: merging those that touch, and overlaps of two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.operators.chunks import running


def merged(rows: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", width: int = 86400 * 64) -> DataFrame:
    """keys, start, end of the unions of intervals [start, end) that overlap or touch, by key.

    An interval opens a union if no earlier one reaches it: its start is after the running maximum of the ends before it. Running values
    go over blocks of `width` and never hold a key in one task. Intervals that are empty or have a null end vanish.
    """
    keys = list(keys)
    rows = rows.where(F.col(end) > F.col(start)).groupBy(*keys, F.col(start).alias("start")).agg(F.max(end).alias("end"))
    rows = rows.withColumn("_block", F.floor(F.col("start") / width))
    reach = running(rows, keys, ["_block"], ["start"], {"_reach": ("max", F.col("end"))})
    # the reach before a row is the reach at the row's predecessor: a row opens a union if it is beyond every end of those before
    before = running(reach.withColumn("_order", F.col("start")), keys, ["_block"], ["_order"], {"_count": ("sum", F.lit(1))})
    prior = before.select(*keys, (F.col("_count") + 1).alias("_count"), F.col("_reach").alias("_prior"))
    opened = before.join(prior, [*keys, "_count"], "left").withColumn("_opens", F.when(F.col("_prior").isNull() | (F.col("start") > F.col("_prior")), F.col("start")))
    named = running(opened, keys, ["_block"], ["_order"], {"_first": ("max", F.col("_opens"))})
    return named.groupBy(*keys, F.col("_first").alias("start")).agg(F.max("end").alias("end"))


def buckets(start: Column, end: Column, width: int) -> Column:
    """Buckets of `width` that [start, end) lies in."""
    return F.sequence(F.floor(start / width), F.floor((end - 1) / width))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int, how: str = "inner") -> DataFrame:
    """Pairs of rows of left(keys, start, end, ...) and right(keys, r_start, r_end, ...) whose half-open intervals of whole numbers overlap.

    Both sides stand in every bucket of `width` they touch, so the join is one on (keys, bucket) and a key with most rows is dealt out over its buckets. A pair
    that shares several buckets counts in the first of them. `width` near the usual length keeps the copies few.
    """
    a = left.withColumn("_bucket", F.explode(buckets(F.col("start"), F.col("end"), width)))
    b = right.withColumn("_bucket", F.explode(buckets(F.col("r_start"), F.col("r_end"), width)))
    first = F.floor(F.greatest("start", "r_start") / width)
    meets = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    return a.join(b, [*keys, "_bucket"]).where(meets & (F.col("_bucket") == first)).drop("_bucket")
