"""Merkle manifest of a dataset: one tree for each group of rows, one above the groups, proofs by a butterfly exchange."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import staged

#: columns that a leaf hashes, in order
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: a block holds fanout ** LEVELS leaves at most
LEVELS = 12
OUT = "doc_id long, leaf string, subroot string, root string, siblings array<string>, folded_root string, verified boolean"


def framed(value: Column) -> Column:
    """"-" for null, else the value's UTF-8 byte count, ":" and the value, so that no two rows give one string."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def named(group: Column) -> Column:
    """A key that is never null and sorts null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def numbered(nodes: DataFrame, size: int) -> DataFrame:
    """nodes(tree, place, hash, claim) -> + index among the nodes of its tree by (place, hash), n nodes of the tree, block of `size` indexes.

    A range sort deals the rows out, so a tree with most rows lies on many partitions and rows that are equal throughout are
    split by their row number. Each partition's rows of a tree are counted, a running sum over partitions (one row for each
    partition and tree in it) gives the index where they begin.
    """
    order = ["tree", "place", "hash", "row"]
    rows = staged(nodes.withColumn("row", F.monotonically_increasing_id()))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = staged(rows.withColumn("part", F.shiftright("at", 33)).drop("row"))
    spans = rows.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("many"))
    tree = Window.partitionBy("tree")
    before = F.sum("many").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = staged(spans.withColumns({"before": F.coalesce(before, F.lit(0)), "n": F.sum("many").over(tree)}).drop("many"))
    index = F.col("at") - F.col("first") + F.col("before")
    return rows.join(spans, ["tree", "part"]).withColumn("index", index).withColumn("block", F.floor(index / size)).select("tree", "block", "n", "index", "place", "hash", "claim")


def parent(members: list[str]) -> str:
    return sha256("".join(members).encode()).hexdigest()


def layers(leaves: list[str], several: bool, fanout: int, levels: int) -> list[list[str]]:
    """All nodes of one block by level, leaves first. A block that is its whole tree ends with one node; one among several is
    `levels` high, so that its top lines up with those of the other blocks."""
    out = [leaves]
    while len(out) <= levels and (several or len(out[-1]) > 1):
        out.append([parent(out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def fold(node: str, siblings: Iterator[str], index: int, n: int, fanout: int) -> str:
    """The top of a tree of n leaves from one leaf's hash and its siblings, taken from the iterator level by level."""
    while n > 1:
        first = index // fanout * fanout
        node = parent([node if i == index else next(siblings) for i in range(first, min(first + fanout, n))])
        index, n = index // fanout, -(-n // fanout)
    return node


def block_tops(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, block, width, root, siblings): the top of each block, width blocks in its tree, and no siblings yet."""
    size = fanout**levels

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("index")
        n = t["n"][0].as_py()
        top = layers(t["hash"].to_pylist(), n > size, fanout, levels)[-1][0]
        return pa.table([t["tree"][:1], t["block"][:1], pa.array([-(-n // size)], pa.int64()), pa.array([top]), pa.array([[]], pa.list_(pa.string()))], ["tree", "block", "width", "root", "siblings"])

    return nodes.select("tree", "block", "n", "index", "hash").groupBy("tree", "block").applyInArrow(run, "tree string, block long, width long, root string, siblings array<string>")


def targets(span: int, fanout: int) -> Column:
    """Blocks to which a block of a subtree of `span` blocks sends its root."""
    digit, o, group = F.floor(F.col("block") / span) % fanout, F.col("block") % span, F.col("block") - F.col("block") % (span * fanout)

    def extent(j: Column) -> Column:
        """Blocks in subtree j of the group."""
        return F.greatest(F.lit(0), F.least(F.lit(span), F.col("width") - group - j * span))

    def receivers(j: Column) -> Column:
        served = F.transform(F.sequence(o, F.greatest(o, extent(j) - 1), extent(digit)), lambda q: group + j * span + q)
        return F.when((j != digit) & (o < extent(j)), served).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), receivers))


def exchanged(blocks: DataFrame, fanout: int) -> DataFrame:
    """Every block with the root of its tree and the siblings on its path there.

    Round r: `fanout` neighbouring subtrees of fanout ** r blocks form an aligned group. The block at place o of a subtree
    sends the subtree's root to the blocks at place o of the others; where the last subtree is smaller than its neighbours,
    its blocks also serve the places o + its size, o + twice its size, ... Every block then hashes the group's roots itself, so all
    blocks know the root after log(width) rounds and nothing has to come down again. A round moves fanout rows a block by (tree,
    block), so each block receives just that many.
    """
    own, span, widest = "struct<width bigint, siblings array<string>>", 1, blocks.agg(F.max("width")).first()[0] or 0
    while span < widest:
        rows = blocks.withColumn("digit", F.floor(F.col("block") / span) % fanout)
        sent = rows.select("tree", F.explode(targets(span, fanout)).alias("block"), "digit", "root", F.lit(None).cast(own).alias("own"))
        met = rows.select("tree", "block", "digit", "root", F.struct("width", "siblings").cast(own).alias("own")).unionByName(sent)
        mine = F.col("own").isNotNull()
        met = met.groupBy("tree", "block").agg(F.max_by("own", mine).alias("own"), F.max_by("root", mine).alias("root"), F.max_by("digit", mine).alias("digit"),
                                               F.sort_array(F.collect_list(F.struct("digit", "root"))).alias("run"))
        others = F.expr("transform(filter(run, x -> x.digit <> digit), x -> x.root)")
        root = F.when(F.col("own.width") > span, F.sha2(F.array_join("run.root", ""), 256)).otherwise(F.col("root"))
        blocks = staged(met.select("tree", "block", F.col("own.width").alias("width"), root.alias("root"), F.concat("own.siblings", others).alias("siblings")))
        span *= fanout
    return blocks


def own_siblings(above: list[list[str]], at: int, fanout: int) -> list[str]:
    """Siblings of the block's leaf `at`, below the block's top, level by level."""
    out = []
    for level in above[:-1]:
        first = at // fanout * fanout
        out += level[first:at] + level[at + 1:first + fanout]
        at //= fanout
    return out


def group_paths(tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """tops(tree, subroot), one row a tree -> (tree, root, top_index, top_n, top_siblings) in the tree above them."""
    nodes = staged(numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("place"), F.col("subroot").alias("hash"), F.lit(None).cast("string").alias("claim")), fanout**levels))
    blocks = exchanged(staged(block_tops(nodes, fanout, levels)), fanout)

    def run(t: pa.Table, b: pa.Table) -> pa.Table:
        t, n = t.sort_by("index"), t["n"][0].as_py()
        above, upper = layers(t["hash"].to_pylist(), n > fanout**levels, fanout, levels), b["siblings"][0].as_py()
        return pa.table([t["place"], pa.array([b["root"][0].as_py()] * len(t)), t["index"], t["n"], pa.array([own_siblings(above, i, fanout) + upper for i in range(len(t))], pa.list_(pa.string()))],
                        ["tree", "root", "top_index", "top_n", "top_siblings"])

    both = nodes.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block"))
    return both.applyInArrow(run, "tree string, root string, top_index long, top_n long, top_siblings array<string>")


def manifest(docs: DataFrame, claimed: dict[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS,
             fanout: int = 2, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot (of its group), root (of all), siblings (the proof: hashes level by level from
    leaf to root, left to right within a level), folded_root (what the proof gives for the claimed document), verified.

    A leaf is the SHA-256 of `fields`, each "-" if null, else byte count, ":" and value. In each group leaves go by id, null first, then by hash;
    every `fanout` neighbours, the last ones perhaps fewer, become the hash of their joined hex digests until one node is left. Groups go
    by name, null first, and their subroots make the tree above in the same way; a lone leaf is its own subroot. `claimed` gives other
    values for some fields; the proof is checked with the leaf of those, all else stays.

    Only hashes move: texts are hashed where they are read. Blocks of fanout ** levels leaves are hashed by one task each, block roots
    meet in `exchanged`, and a second pass over the blocks adds what is inside them. A group with most rows has most blocks.
    Nulls in any field, empty and very long texts are hashed like others; repeated rows are leaves of their own; extra columns are
    ignored, also where their names are those used here; an empty table gives no rows.
    """
    said = [F.col(f) for f in fields]
    other = leaf([(claimed or {}).get(f, F.col(f)) for f in fields])
    nodes = docs.select(named(F.col(group_col)).alias("tree"), F.col(id_col).cast("long").alias("place"), leaf(said).alias("hash"), other.alias("claim"))
    nodes = nodes.withColumn("claim", F.nullif("claim", "hash"))
    nodes = staged(numbered(nodes, fanout**levels))
    blocks = exchanged(staged(block_tops(nodes, fanout, levels)), fanout)
    tops = staged(group_paths(staged(blocks.where("block = 0").select("tree", F.col("root").alias("subroot"))), fanout, levels))
    # one row a block meets one row a group, which stands in 32 parts for groups with most of the blocks
    uppers = blocks.select("tree", "block", F.col("root").alias("subroot"), "siblings", (F.col("block") % 32).alias("part"))
    paths = uppers.join(tops.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long")))), ["tree", "part"]).drop("part")

    def run(t: pa.Table, p: pa.Table) -> pa.Table:
        t, n = t.sort_by("index"), t["n"][0].as_py()
        path = {c: p[c][0].as_py() for c in ("subroot", "root", "siblings", "top_index", "top_n", "top_siblings")}
        above = layers(t["hash"].to_pylist(), n > fanout**levels, fanout, levels)
        proofs, tops_found = [], []
        for i, (index, own, claim) in enumerate(zip(t["index"].to_pylist(), above[0], t["claim"].to_pylist(), strict=True)):
            proofs.append(own_siblings(above, i, fanout) + path["siblings"] + path["top_siblings"])
            up = iter(proofs[-1])
            tops_found.append(fold(fold(claim or own, up, index, n, fanout), up, path["top_index"], path["top_n"], fanout))
        return pa.table([t["place"], t["hash"], *(pa.array([path[c]] * len(t)) for c in ("subroot", "root")), pa.array(proofs, pa.list_(pa.string())), pa.array(tops_found, pa.string()),
                         pa.array([x == path["root"] for x in tops_found], pa.bool_())], ["doc_id", "leaf", "subroot", "root", "siblings", "folded_root", "verified"])

    return nodes.groupBy("tree", "block").cogroup(staged(paths).groupBy("tree", "block")).applyInArrow(run, OUT)
