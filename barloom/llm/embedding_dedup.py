"""Exact metric range join of embeddings: pivots, boundary replication by the triangle inequality, independent cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import staged
from barloom.llm.graph import components

#: vectors of a cell that a pivot stands for, about; and the most pivots (what is broadcast stays below this many vectors)
CELL, MOST_PIVOTS = 4096, 1024
#: rows of one side of a unit of work
TILE = 4096
#: cosines this close to the threshold are computed anew from the raw components
DOUBT = 1e-9


def rows_of(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(node, first_id, copies, v, size): usable vectors, copies as one node."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    usable = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(usable)
    nodes = rows.groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("size", F.size("v"))


def placed(nodes: DataFrame, pivots: np.ndarray, size: int, reach: float) -> DataFrame:
    """(cell, home, node, copies, v): each vector in the cell of its nearest pivot and, as a replica, in every cell
    before it that can hold a partner: with a partner y at most `reach` away in cell q, d(x, q) <= d(x, own) + 2 reach."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                x = unit(rows_of(part.column(2), size))
                d = np.sqrt(np.maximum(0, 2 - 2 * x @ p.T))
                home = d.argmin(1)
                near = d <= d[np.arange(len(d)), home][:, None] + 2 * reach + 1e-6
                near &= np.arange(len(p)) <= home[:, None]
                at, cell = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(home[at] == cell), *(part.column(k).take(pa.array(at)) for k in range(3))], ["cell", "home", "node", "copies", "v"])

    return nodes.select("node", "copies", "v").mapInArrow(run, "cell int, home boolean, node long, copies long, v array<double>")


def tiled(cells: DataFrame) -> DataFrame:
    """Units (cell, i, j): home tile i against tile j of home vectors (j >= i) or of replicas. Each pair of a cell is in one unit, and
    no unit has more than about two tiles of rows, however large the cell."""
    sizes = cells.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests"))
    tiles = sizes.select("cell", F.ceil(F.col("homes") / TILE).cast("int").alias("h"), F.ceil(F.col("guests") / TILE).cast("int").alias("g"))
    rows = cells.join(F.broadcast(tiles), "cell").where("h > 0")  # one row for each pivot at most
    own = F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("h")).otherwise(F.col("g"))).cast("int")
    rows = rows.withColumn("t", own)
    unit_of = F.when(F.col("home"), F.concat(
        F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda o: F.struct(F.least("t", o).alias("i"), F.greatest("t", o).alias("j"), (F.col("t") <= o).alias("left"), (F.col("t") >= o).alias("right"))),
        F.when(F.col("g") > 0, F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.struct(F.col("t").alias("i"), (F.col("h") + o).alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right")))).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean,right:boolean>>")),
    )).otherwise(F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda o: F.struct(o.alias("i"), (F.col("h") + F.col("t")).alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"))))
    return rows.select("cell", F.explode(unit_of).alias("u"), "node", "copies", "v").select("cell", "u.i", "u.j", "u.left", "u.right", "node", "copies", "v")


def joined(units: DataFrame, size: int, cosine: float) -> DataFrame:
    """(node, n, root): vectors that each node links with inside one unit, and the smallest node of its component there."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        raw = rows_of(table.column("v").combine_chunks() if table.num_rows else table.column("v"), size)
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        a, b = np.flatnonzero(table.column("left").to_numpy(zero_copy_only=False)), np.flatnonzero(table.column("right").to_numpy(zero_copy_only=False))
        x, y = unit(raw[a]), unit(raw[b])
        same = len(a) == len(b) and bool((a == b).all())
        count, label = np.zeros(len(node), np.int64), node.copy()
        masks = []
        for s in range(0, len(a), 512):
            c = x[s:s + 512] @ y.T
            doubt = np.argwhere(np.abs(c - cosine) < DOUBT)
            for i, j in doubt.tolist():
                p, q = raw[a[s + i]], raw[b[j]]
                c[i, j] = p @ q / np.sqrt((p @ p) * (q @ q))
            link = c >= cosine
            if same:
                link[np.arange(len(link)), np.arange(len(link)) + s] = False
            rows, cols = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
            if len(rows):
                link = link[np.ix_(rows, cols)]
                masks.append((a[s + rows], b[cols], link))
                count[a[s + rows]] += link @ copies[b[cols]]
                if not same:
                    count[b[cols]] += link.T @ copies[a[s + rows]]
        changed = bool(masks)
        while changed:
            changed = False
            for rows, cols, link in masks:
                low = np.minimum(label[rows], np.where(link, label[cols], np.iinfo(np.int64).max).min(1))
                high = np.minimum(label[cols], np.where(link, low[:, None], np.iinfo(np.int64).max).min(0))
                changed |= bool((low < label[rows]).any() or (high < label[cols]).any())
                label[rows] = np.minimum(label[rows], low)
                label[cols] = np.minimum(label[cols], high)
        kept = np.flatnonzero(count > 0)
        return pa.table({"node": node[kept], "n": count[kept], "root": label[kept]})

    return units.groupBy("cell", "i", "j").applyInArrow(run, "node long, n long, root long")


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors at cosine >= `cosine`), component_id (smallest vec_id reachable), kept.

    On unit vectors the cosine bound is a Euclidean distance of reach = sqrt(2 - 2 cosine). Pivots, at most 1,024,
    split the vectors; the triangle inequality says which vectors a cell needs from later cells; each cell is
    compared on its own, in tiles of bounded size, in double precision. Pairs never leave a unit: only link counts and
    component labels do, and a union-find over those joins the units. Copies of a vector are compared once.

    Vectors that are null, empty, all zero, or hold a null or non-finite component link with nothing and are their own component.
    Vectors of different lengths don't link. Rows that repeat a vec_id are vectors of their own; a null vec_id names a component
    only if all are null. Extra columns are ignored, an empty table gives no rows.
    """
    spark = vectors.sparkSession
    reach = float(np.sqrt(2 - 2 * cosine))
    nodes = staged(distinct_vectors(vectors, id_col, vector_col))
    found = None
    for r in nodes.groupBy("size").count().orderBy("size").collect():  # one row for each length of vectors
        own = nodes.where(F.col("size") == r["size"])
        k = int(min(MOST_PIVOTS, -(-r["count"] // CELL)))
        ids = [x[0] for x in own.select("node").orderBy(F.xxhash64("node"), "node").limit(k).collect()]
        sample = own.where(F.col("node").isin(ids)).orderBy("node").select("v").toArrow()
        pivots = unit(np.array(sample.column("v").to_pylist(), float).reshape(k, r["size"]))
        part = joined(tiled(staged(placed(own, pivots, r["size"], reach))), r["size"], cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "node long, n long, root long")
    found = staged(found)
    tree = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = nodes.join(counts, "node", "left").join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = staged(named.join(names, "root").select(F.col("v").alias("key"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    out = rows.join(named, F.col("v") == F.col("key"), "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
