"""As-of, nearest and range joins on ordered keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.operators.chunks import running


def asof_join(
    left: DataFrame,
    rights: dict[str, DataFrame],
    keys: Sequence[str],
    at: str,
    block: int,
) -> DataFrame:
    """Attach to each left row the latest row of every right side with
    ``right.at <= left.at``, as one struct column per right side.

    All sides are stacked once and one running "last seen" pass serves them all;
    blocks of ``block`` units of ``at`` bound what a task sorts.
    """
    left_cols = [c for c in left.columns if c not in (*keys, at)]
    row_type = F.struct(*left_cols)
    stacked = left.select(*keys, at, F.lit(1).alias("_side"), row_type.alias("_row"))
    for name, right in rights.items():
        body = F.struct(*[c for c in right.columns if c not in keys])
        stacked = stacked.unionByName(
            right.select(*keys, at, F.lit(0).alias("_side"), body.alias(name)), allowMissingColumns=True)
    stacked = stacked.withColumn("_block", F.floor(F.col(at) / block))
    seen = running(stacked, keys, ["_block"], [at, "_side"], {n: ("last", F.col(n)) for n in rights})
    return seen.where(F.col("_side") == 1).select(*keys, at, "_row.*", *rights)


def nearest_join(
    requests: DataFrame, rows: DataFrame, keys: Sequence[str], at: str, request_id: str, tolerance: Column, width: int,
) -> DataFrame:
    """Nearest row within ``tolerance`` of each request, the earlier one on a tie.

    ``width`` bounds the tolerance. A request looks at its own bucket and its two
    neighbours, so the join key stays an equality."""
    bucket = F.floor(F.col(at) / width)
    req = requests.withColumn("_tol", tolerance).withColumn(
        "_bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1))).withColumnRenamed(at, "_want")
    hit = req.join(rows.withColumn("_bucket", bucket), [*keys, "_bucket"]).withColumn(
        "_gap", F.abs(F.col(at) - F.col("_want"))).where(F.col("_gap") <= F.col("_tol"))
    body = F.struct(*[c for c in rows.columns if c not in keys])
    return hit.groupBy(*keys, request_id).agg(
        F.first("_want").alias("want"),
        F.min_by(body, F.struct(F.col("_gap"), F.col(at))).alias("match"))


def around(events: DataFrame, bars: DataFrame, keys: Sequence[str], center: str, before: int, after: int) -> DataFrame:
    """Range join: bars numbered center-before .. center+after for every event.

    The bar number is cut into buckets as long as the span, so an event touches
    at most two and the residual range condition trims the rest."""
    width = before + after + 1
    ev = events.withColumn("_bucket", F.explode(F.array_distinct(F.array(
        F.floor((F.col(center) - before) / width), F.floor((F.col(center) + after) / width)))))
    return ev.join(bars.withColumn("_bucket", F.floor(F.col("bar_idx") / width)), [*keys, "_bucket"]).where(
        F.col("bar_idx").between(F.col(center) - before, F.col(center) + after)
    ).drop("_bucket").withColumn("bar_position", F.col("bar_idx") - F.col(center))
