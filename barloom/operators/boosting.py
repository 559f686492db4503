"""Gradient boosted trees of many series at once, on binned columns.

A tree is complete: 2 ** depth - 1 splits in heap order and 2 ** depth leaves. A split (column, cut) sends rows with a bin above the cut to
the right; column -1 sends all to the left. Both ways of fitting below share `best_splits`, so they differ only in where
gradients are summed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from barloom.operators.lineage import cut

BINS = 32
#: rows of a series that one task may hold; longer series are summed over tasks
TASK_ROWS = 250_000
TREES = "array<struct<col:array<int>,at:array<int>,leaf:array<double>,gain:array<double>>>"


def binned(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], fit_on: str = "true", bins: int = BINS) -> DataFrame:
    """rows + bins, an array of one number below `bins` for each column: how many of the series' quantile edges, taken from rows where fit_on
    holds, are below the value. Null and NaN are in bin 0. Series without such rows are left out."""
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]
    edges = rows.where(fit_on).groupBy(*keys).agg(F.array(*[F.coalesce(F.percentile_approx(x, probs, 10_000), F.array().cast("array<double>")) for x in clean]).alias("_edges"))
    places = [F.when(x.isNull(), 0).otherwise(above(F.col("_edges")[i], x)) for i, x in enumerate(clean)]
    return rows.join(edges, list(keys)).withColumn("bins", F.array(*places)).drop("_edges")


def above(edges, x):
    return F.aggregate(edges, F.lit(0), lambda n, e: n + (x > e).cast("int"))


def gradients(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    if kind == "squared":
        return weight * (margin - y), weight
    p = 1 / (1 + np.exp(-margin))
    return weight * (p - y), weight * p * (1 - p)


def start(total: float, weight: float, kind: str) -> float:
    """Margin before the first tree: the mean, or its log-odds kept finite."""
    mean = total / weight
    return float(mean if kind == "squared" else np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6))))


def best_splits(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """g, h: (nodes, columns, bins) sums -> (column, cut, gain) of each node's best split; -1 if none helps. Of equal gains the first column and cut win."""
    total_g, total_h = g.sum(2)[:, :1, None], h.sum(2)[:, :1, None]
    left_g, left_h = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
    right_g, right_h = total_g - left_g, total_h - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - total_g**2 / (total_h + ridge)
    gain = np.round(np.where((left_h >= least) & (right_h >= least), gain, 0), 9).reshape(len(g), -1)
    best = gain.argmax(1)
    value = gain[np.arange(len(g)), best]
    return np.where(value > 0, best // left_g.shape[2], -1), np.where(value > 0, best % left_g.shape[2], 0), np.maximum(value, 0)


def moved(node: np.ndarray, bins: np.ndarray, col: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Next level's place of each row; node counts from 0 within its level, col and at are that level's splits."""
    own = col[node]
    return 2 * node + ((own >= 0) & (bins[np.arange(len(node)), np.maximum(own, 0)] > at[node]))


def histogram(node: np.ndarray, bins: np.ndarray, values: np.ndarray, nodes: int, width: int) -> np.ndarray:
    d = bins.shape[1]
    place = (node[:, None] * d + np.arange(d)) * width + bins
    return np.bincount(place.ravel(), np.repeat(values, d), nodes * d * width).reshape(nodes, d, width)


def fitted(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, kind: str, trees: int, depth: int, rate: float, ridge: float, least: float, width: int) -> tuple[float, list[dict]]:
    """One series in memory: (start margin, trees)."""
    base = start(float((weight * y).sum()), float(weight.sum()), kind)
    margin, out = np.full(len(y), base), []
    for _ in range(trees):
        g, h = gradients(margin, y, weight, kind)
        node, cols, ats, gains = np.zeros(len(y), np.int64), [], [], []
        for level in range(depth):
            c, a, gain = best_splits(histogram(node, bins, g, 2**level, width), histogram(node, bins, h, 2**level, width), ridge, least)
            node = moved(node, bins, c, a)
            cols, ats, gains = [*cols, *c.tolist()], [*ats, *a.tolist()], [*gains, *gain.tolist()]
        leaf = -rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + ridge)
        margin = margin + leaf[node]
        out.append({"col": cols, "at": ats, "leaf": leaf.tolist(), "gain": gains})
    return base, out


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), -1)


def boosted_by_key(rows: DataFrame, keys: Sequence[str], label: str = "label", weight: str | None = None, kind: str = "logistic", trees: int = 100, depth: int = 3,
                   rate: float = 0.1, ridge: float = 1.0, least: float = 1.0, bins: int = BINS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(keys, base, trees): a boosted model for each series of `rows` (with `bins` from ``binned``), all in the same passes.

    kind "logistic" takes labels 0 and 1, "squared" any number; rows with a null label are left out. A series of at most task_rows rows
    is fitted by the task that gathers it; the sums of longer ones are made by (series, node, column, bin) over all tasks, a pass for each level of
    each tree, and only those sums and one row a series for the tree so far meet. A series with one class gets trees without splits.
    """
    keys = list(keys)
    slim = rows.where(F.col(label).isNotNull()).select(*keys, "bins", F.col(label).cast("double").alias("_y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"))
    sized = cut(slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_w") * F.col("_y")).alias("_t"), F.sum("_w").alias("_tw")))
    types = dict(rows.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)

    def whole(key, pdf):
        base, found = fitted(matrix(pdf["bins"]), pdf["_y"].to_numpy(), pdf["_w"].to_numpy(), kind, trees, depth, rate, ridge, least, bins)
        return pd.DataFrame([[*key, base, found]], columns=[*keys, "base", "trees"])

    small = slim.join(sized.where(F.col("_n") <= task_rows).select(*keys), keys).groupBy(*keys).applyInPandas(whole, f"{head}, base double, trees {TREES}")
    large = sized.where(F.col("_n") > task_rows)
    if large.isEmpty():
        return small
    return small.unionByName(summed(slim, large, keys, head, kind, trees, depth, rate, ridge, least, bins))


def node_at(level: int):
    """Place of a row within its level, from bins and the splits `col`, `at` in heap order."""
    node = F.lit(0)
    for k in range(level):
        heap = node + (2**k - 1)
        own = F.element_at("col", heap + 1)
        node = 2 * node + F.when((own >= 0) & (F.element_at("bins", F.greatest(own, F.lit(0)) + 1) > F.element_at("at", heap + 1)), 1).otherwise(0)
    return node


def summed(slim: DataFrame, large: DataFrame, keys: list[str], head: str, kind: str, trees: int, depth: int, rate: float, ridge: float, least: float, width: int) -> DataFrame:
    """The same trees for series that no task holds."""
    begun = F.col("_t") / F.col("_tw")
    kept = F.least(F.greatest(begun, F.lit(1e-6)), F.lit(1 - 1e-6))
    begun = begun if kind == "squared" else F.log(kept / (1 - kept))
    models = cut(large.select(*keys, begun.alias("base"), F.array().cast(TREES).alias("trees")))
    rows = cut(slim.join(models.select(*keys, F.col("base").alias("_m")), keys))
    p = 1 / (1 + F.exp(-F.col("_m")))
    g, h = (F.col("_w") * (F.col("_m") - F.col("_y")), F.col("_w")) if kind == "squared" else (F.col("_w") * (p - F.col("_y")), F.col("_w") * p * (1 - p))
    empty = models.select(*keys, F.array().cast("array<int>").alias("col"), F.array().cast("array<int>").alias("at"), F.array().cast("array<double>").alias("gain"))

    def chosen(key, pdf):
        level = int(key[-1])
        d = int(pdf["c"].max()) + 1
        sums = np.zeros((2, 2**level, d, width))
        at = (pdf["node"].to_numpy(), pdf["c"].to_numpy(), pdf["b"].to_numpy())
        sums[0][at], sums[1][at] = pdf["g"].to_numpy(), pdf["h"].to_numpy()
        col, place, gain = best_splits(sums[0], sums[1], ridge, least)
        return pd.DataFrame([[*key[:-1], col.tolist(), place.tolist(), gain.tolist()]], columns=[*keys, "c2", "a2", "g2"])

    for _ in range(trees):
        tree = empty
        for level in range(depth):
            placed = rows.join(tree, keys).select(*keys, node_at(level).alias("node"), g.alias("g"), h.alias("h"), F.posexplode("bins").alias("c", "b"))
            sums = placed.groupBy(*keys, "node", "c", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).withColumn("level", F.lit(level))
            splits = sums.groupBy(*keys, "level").applyInPandas(chosen, f"{head}, c2 array<int>, a2 array<int>, g2 array<double>")
            tree = cut(tree.join(splits, keys).select(*keys, F.concat("col", "c2").alias("col"), F.concat("at", "a2").alias("at"), F.concat("gain", "g2").alias("gain")))
        leaves = rows.join(tree, keys).select(*keys, node_at(depth).alias("node"), g.alias("g"), h.alias("h")).groupBy(*keys, "node").agg(
            (-rate * F.sum("g") / (F.sum("h") + ridge)).alias("v")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("node", "v"))).alias("v"))
        value = F.transform(F.sequence(F.lit(0), F.lit(2**depth - 1)), lambda i: F.coalesce(F.try_element_at("v", i), F.lit(0.0)))
        tree = cut(tree.join(leaves, keys).select(*keys, "col", "at", value.alias("leaf"), "gain"))
        models = cut(models.join(tree, keys).select(*keys, "base", F.concat("trees", F.array(F.struct("col", "at", "leaf", "gain"))).cast(TREES).alias("trees")))
        step = rows.join(tree, keys)
        rows = cut(step.select(*keys, "bins", "_y", "_w", (F.col("_m") + F.element_at("leaf", node_at(depth) + 1)).alias("_m")))
    return models


def scored(rows: DataFrame, models: DataFrame, keys: Sequence[str], kind: str = "logistic", slice_rows: int = TASK_ROWS) -> DataFrame:
    """rows of series with a model + score, a probability or a number. Every task takes a slice of a series, at most about slice_rows rows, and its model once."""
    keys = list(keys)
    sized = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / slice_rows).alias("_slices"))
    sliced = rows.join(cut(sized), keys).withColumn("_slice", F.pmod(F.monotonically_increasing_id(), "_slices")).drop("_slices")
    every = models.join(cut(sized), keys).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))).drop("_slices")
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", score double"

    def run(own, model):
        if own.empty or model.empty:
            return own.assign(score=pd.Series(dtype=float)).iloc[:0].drop(columns="_slice")
        bins, margin = matrix(own["bins"]), np.full(len(own), model["base"].iloc[0])
        for tree in model["trees"].iloc[0]:
            col, at, node = np.array(tree["col"]), np.array(tree["at"]), np.zeros(len(own), np.int64)
            level = 0
            while 2**level <= len(col):
                lo = 2**level - 1
                node, level = moved(node, bins, col[lo:2 * lo + 1], at[lo:2 * lo + 1]), level + 1
            margin = margin + np.array(tree["leaf"])[node]
        return own.assign(score=margin if kind == "squared" else 1 / (1 + np.exp(-margin))).drop(columns="_slice")

    return sliced.groupBy(*keys, "_slice").cogroup(every.groupBy(*keys, "_slice")).applyInPandas(run, schema)


def gains(models: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """keys, feature, gain, splits: what each column's splits gained over all trees of a series."""
    pairs = F.flatten(F.transform("trees", lambda t: F.arrays_zip(t["col"].alias("col"), t["gain"].alias("gain"))))
    out = models.select(*keys, F.explode(pairs).alias("p")).where("p.col >= 0").groupBy(*keys, F.col("p.col").alias("col")).agg(F.sum("p.gain").alias("gain"), F.count(F.lit(1)).alias("splits"))
    return out.withColumn("feature", F.element_at(F.array(*map(F.lit, names)), F.col("col") + 1)).drop("col")
