"""Connected components of an edge table too large for one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import staged

#: edges that one union-find sees; larger partitions are contracted slice by slice
SLICE = 500_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over one slice of edges: (node, smallest node of its component in the slice)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(at[:len(a)].tolist(), at[len(a):].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]]


def contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for i in range(0, len(f), SLICE):
            part = f.iloc[i:i + SLICE]
            node, root = roots(part["a"].to_numpy(), part["b"].to_numpy())
            keep = node != root
            yield pd.DataFrame({"node": node[keep], "root": root[keep]})


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (node, root): every node of an edge with the smallest node it reaches.

    Each partition contracts its edges with a union-find to (node, local root). Where a node
    has several roots, they are tied to the smallest one; roots that have a smaller root
    themselves are followed. Rounds repeat until each node has one root that is its own,
    about log(diameter) of them. Loops and repeated edges change nothing; nulls are dropped;
    no edges give no rows.
    """
    now = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"))
    for _ in range(most_rounds):
        forest = now.mapInPandas(contract, "node long, root long")
        forest = staged(forest.distinct())
        low = forest.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        low = staged(low)
        up = low.select(F.col("node").alias("root"), F.col("low").alias("above"))
        if low.where("low <> high").isEmpty() and low.select(F.col("low").alias("root")).join(up, "root", "left_semi").isEmpty():
            own = low.select(F.col("low").alias("node")).distinct().withColumn("root", F.col("node"))
            return low.select("node", F.col("low").alias("root")).unionByName(own)
        followed = low.withColumnRenamed("low", "root").join(up, "root", "left")
        kept = followed.select(F.coalesce("above", "root").alias("a"), F.col("node").alias("b"))
        tied = forest.join(low.where("low <> high"), "node").where("root <> low").select(F.col("low").alias("a"), F.col("root").alias("b"))
        now = staged(kept.unionByName(tied).where("a <> b").distinct())
    raise RuntimeError("components did not settle")
