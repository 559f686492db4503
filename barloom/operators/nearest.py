"""Exact nearest neighbours of many query vectors, in tiles chosen by norm bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barloom.operators.lineage import cut

#: rows, or queries, that one side of a tile holds
BLOCK = 4096
#: ranges of the norm; their bounds are the only table that is broadcast
CELLS = 1024
#: places to which squared distances are compared, so that ties don't hang on the last bit
PLACES = 8


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def best_of(ids: np.ndarray, v: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the k nearest rows with another id, by distance and then id."""
    apart = v - query
    d2 = np.round(np.einsum("ij,ij->i", apart, apart), PLACES)
    at = np.flatnonzero(ids != query_id)
    if len(at) > k:
        at = at[d2[at] <= np.partition(d2[at], k - 1)[k - 1]]
    at = at[np.lexsort((ids[at], d2[at]))][:k]
    return ids[at], d2[at]


def nearest(vectors: DataFrame, id_col: str, vector_col: str, is_query: str, k: int) -> DataFrame:
    """(query_id, vec_id, place, d2): the k nearest vectors of every row that meets the SQL condition is_query, by squared distance
    (to eight places) and then id; the row itself doesn't count.

    Vectors are ordered by norm into cells. A query first finds its k-th distance within its own block; by the triangle inequality only
    cells whose norms are within that distance of its own norm can hold a nearer one. Cells are compared with the queries that reach
    them in tiles of BLOCK by BLOCK rows, and k rows a query leave a tile. Equal norms are split by id, so a cell's size doesn't
    depend on ties, and a cell above BLOCK rows has several blocks.

    Vectors have one length. Rows without id or vector, and vectors with null components, are left out; an empty table gives no rows, a query with fewer
    than k others has fewer rows. Extra columns are ignored.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"))
    base = base.where("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    cells = max(1, min(CELLS, -(-base.count() // BLOCK)))
    placed = cut(base.withColumn("norm", norm).repartitionByRange(cells, "norm", "id").withColumn("cell", F.spark_partition_id()))
    bounds = placed.groupBy("cell").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    rows = placed.join(F.broadcast(bounds.select("cell", "blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))

    def reach(table: pa.Table) -> pa.Table:
        ids, v = table.column("id").to_numpy(), matrix(table.column("v"))
        asks = np.flatnonzero(np.array(table.column("asks").to_pylist(), bool))
        kth = [d2[-1] if len(d2) == k else np.inf for d2 in (best_of(ids, v, ids[r], v[r], k)[1] for r in asks)]
        # a little more than the distance, for the rounding of norms and distances
        return table.select(["id", "v", "norm"]).take(pa.array(asks)).append_column("reach", pa.array(np.sqrt(np.array(kth, float) + 1e-7) * (1 + 1e-9), pa.float64()))

    def best(queries: pa.Table, others: pa.Table) -> pa.Table:
        found = []
        if len(queries) and len(others):
            ids, v = others.column("id").to_numpy(), matrix(others.column("v"))
            for q, x in zip(queries.column("query_id").to_pylist(), matrix(queries.column("query")), strict=True):
                near, d2 = best_of(ids, v, q, x, k)
                found.append((np.full(len(near), q), near, d2))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0)] * 3
        return pa.table({n: pa.array(x, t, safe=False) for n, x, t in zip(("query_id", "vec_id", "d2"), parts, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    queries = cut(rows.groupBy("cell", "block").applyInArrow(reach, "id long, v array<double>, norm double, reach double"))
    met = queries.join(F.broadcast(bounds), (F.col("lo") - F.col("reach") <= F.col("norm")) & (F.col("norm") <= F.col("hi") + F.col("reach")))
    met = cut(met.select(F.col("cell").alias("at"), F.col("blocks").alias("upto"), F.col("id").alias("query_id"), F.col("v").alias("query")))
    load = F.broadcast(met.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")))
    first = F.lit(0).cast("long")
    asked = met.join(load, "at").select("at", F.explode(F.sequence(first, F.col("upto") - 1)).alias("of"), F.pmod(F.xxhash64("query_id"), "parts").alias("piece"), "query_id", "query")
    held = rows.join(load, F.col("cell") == F.col("at")).select("cell", "block", F.explode(F.sequence(first, F.col("parts") - 1)).alias("part"), "id", "v")
    kept = asked.groupBy("at", "of", "piece").cogroup(held.groupBy("cell", "block", "part")).applyInArrow(best, "query_id long, vec_id long, d2 double")
    order = Window.partitionBy("query_id").orderBy("d2", "vec_id")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "vec_id", "place", "d2")
