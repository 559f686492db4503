"""Prefix trie of conversations from vertical bitmaps, one shard of neighbouring conversations at a time."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import by_bytes, staged

#: conversations and turns at which a shard is closed
SHARD_CONVERSATIONS, SHARD_TURNS = 4096, 1 << 18
#: bytes that name a turn in a path
WIDTH = 16
SHARD = "shard long, seq long, conv_ids array<long>, sizes array<int>, path binary, words array<int>, before binary, after binary"
COUNTS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
NODE = "shard long, number int, parent_number int, whole boolean, name binary, parent_name binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, ends_sha256 string"
OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns_of(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turns): the name of each turn's role and text, and the words of its text, in the order of turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    name = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    said = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), name.alias("name"), words.alias("words")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["name"].alias("name"), t["words"].alias("words")))
    return said.where("conv_id IS NOT NULL").groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % every: h is crc32(c) % most, fewer if that one is
    shorter, none if it does not exist; c's own turns after its first h follow."""
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    out = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return out.select("conv_id", F.concat(head, own).alias("turns"))


def shards_of(convs: DataFrame, most: int, most_turns: int) -> DataFrame:
    """Conversations in the order of their paths, cut into shards: neighbours in this order share prefixes, so every node is a run of it.

    The range sort also goes by conv_id, so conversations that many share are split too. A shard knows the paths just
    before and after it; those at a partition's edge come from the neighbouring partitions' first and last ones, one row a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns, seq, before, part = [], 0, 0, None, 0

        def closed(after: bytes | None) -> pa.RecordBatch:
            ids, paths, words = zip(*held, strict=True)
            return pa.RecordBatch.from_pylist([{"shard": (part << 32) + seq, "seq": seq, "conv_ids": ids, "sizes": [len(p) // WIDTH for p in paths], "path": b"".join(paths),
                                                "words": [w for own in words for w in own], "before": before, "after": after}], schema)

        for b in batches:
            for part, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(held) >= most or (held and turns + len(row[2]) > most_turns):
                    yield closed(row[1])
                    before, held, turns, seq = held[-1][1], [], 0, seq + 1
                held.append(row)
                turns += len(row[2])
        if held:
            yield closed(None)

    schema = pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("conv_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("path", pa.binary()),
                        ("words", pa.list_(pa.int32())), ("before", pa.binary()), ("after", pa.binary())])
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["name"])), ""))
    rows = staged(convs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")))
    rows = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    cut = staged(rows.select(F.spark_partition_id().alias("part"), "conv_id", "path", "words").mapInArrow(run, SHARD).withColumn("part", F.shiftright("shard", 32)))
    edge = F.col("path")
    first = F.substring(edge, F.lit(1), F.element_at("sizes", 1) * WIDTH)
    last = F.substring(edge, F.octet_length(edge) - F.element_at("sizes", -1) * WIDTH + 1, F.element_at("sizes", -1) * WIDTH)
    edges = cut.select("part", "seq", first.alias("first"), last.alias("last")).groupBy("part").agg(F.min_by("first", "seq").alias("first"), F.max_by("last", "seq").alias("last"))
    along = Window.orderBy("part")
    edges = staged(edges.select("part", F.lag("last").over(along).alias("part_before"), F.lead("first").over(along).alias("part_after")))
    cut = cut.join(edges, "part", "left")
    before = F.when(F.col("before").isNull(), F.col("part_before")).otherwise(F.col("before"))
    after = F.when(F.col("after").isNull(), F.col("part_after")).otherwise(F.col("after"))
    return cut.select("shard", "conv_ids", "sizes", "path", "words", before.alias("before"), after.alias("after"))


def common(a: bytes, b: bytes | None) -> int:
    """Turns that two paths share from the start on, -1 if there is no other path."""
    if b is None:
        return -1
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(p, np.uint8, n * WIDTH).reshape(n, WIDTH) for p in (a, b))
    differ = np.flatnonzero((x != y).any(1))
    return int(differ[0]) if len(differ) else n


def shard_nodes(shard: int, conv_ids: list[int], sizes: list[int], path: bytes, words: list[int], before: bytes | None, after: bytes | None) -> list[tuple]:
    """Rows of NODE for the nodes that have members in this shard.

    Postings hold a bitset of the shard's conversations for every (place, turn), and one for every length. From the root on, depth
    first, the members that go on are those of the node's bitset that are not of its length; the least of them
    names the next child's turn, whose posting intersected with the bitset is the child.

    A node that began in an earlier shard or goes on in a later one (whole is false) has here its part only. Parts add up because
    each thing is counted in one shard: a child and the one saved occurrence less where the node begins, a leaf where it ends.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    names = [path[i * WIDTH:(i + 1) * WIDTH] for i in range(starts[-1])]
    posting: dict[tuple[int, bytes], int] = {}
    length: dict[int, int] = {}
    slots: dict[tuple[int, bytes], list[int]] = {}
    ends_at: dict[int, list[int]] = {}
    for slot, n in enumerate(sizes):
        ends_at.setdefault(n, []).append(slot)
        for d, name in enumerate(names[starts[slot]:starts[slot + 1]]):
            slots.setdefault((d, name), []).append(slot)

    def bits(found: list[int]) -> int:
        raw = np.zeros(len(sizes), np.uint8)
        raw[found] = 1
        return int.from_bytes(np.packbits(raw, bitorder="little").tobytes(), "little")

    for key, found in slots.items():
        posting[key] = bits(found)
    for n, found in ends_at.items():
        length[n] = bits(found)
    ids = np.array(conv_ids)
    first, last = names[starts[0]:starts[1]], names[starts[-2]:starts[-1]]
    earlier, later = common(b"".join(first), before), common(b"".join(last), after)
    nodes = []  # [bitset, depth, parent, name, words, began here, ends here, children, leaves, saved]
    stack = [((1 << len(sizes)) - 1, 0, -1, b"\0" * WIDTH, 0)]
    while stack:
        here, depth, parent, name, many = stack.pop()
        began, ended = not (here & 1 and depth <= earlier), not (here >> (len(sizes) - 1) & 1 and depth <= later)
        number, n = len(nodes), here.bit_count()
        rest, children = here & ~length.get(depth, 0), []
        while rest:
            slot = (rest & -rest).bit_length() - 1
            turn = names[starts[slot] + depth]
            child = here & posting[depth, turn]
            rest &= ~child
            children.append((child, depth + 1, number, md5(name + turn).digest(), words[starts[slot] + depth]))
        saved = n * many - (many if began else 0)
        nodes.append([here, depth, parent, name, began, ended, 0, int(ended and not children), saved])
        stack += reversed(children)
    for node in reversed(nodes):
        if node[2] >= 0:
            above = nodes[node[2]]
            above[6] += node[4]
            above[7] += node[7]
            above[8] += node[8]
    low = [int(ids[members(node[0], len(sizes))].min()) for node in nodes]
    out = []
    for number, (here, depth, parent, name, began, ended, children, leaves, saved) in enumerate(nodes):
        own = here & length.get(depth, 0)
        ends = ",".join(map(str, sorted(ids[members(own, len(sizes))].tolist()))).encode() if own else b""
        whole = began and ended
        above = nodes[parent] if parent >= 0 else None
        out.append((shard, number, parent if parent >= 0 else None, whole, None if whole else name, above[3] if above and not whole else None, low[number], depth,
                    low[parent] if above and above[4] and above[5] else None, here.bit_count(), children, leaves, saved,
                    None if whole else ends, sha256(ends).hexdigest() if whole else None))
    return out


def members(bitset: int, n: int) -> np.ndarray:
    """Slots of a bitset, ascending."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitset.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little"))


def nodes_of(shards: DataFrame) -> DataFrame:
    schema = pa.schema([("shard", pa.int64()), ("number", pa.int32()), ("parent_number", pa.int32()), ("whole", pa.bool_()), ("name", pa.binary()), ("parent_name", pa.binary()),
                        *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", *COUNTS)), ("ends", pa.binary()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 3, 1 << 22):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                columns = zip(*shard_nodes(*row), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return shards.mapInArrow(run, NODE)


def joined(parts: DataFrame) -> DataFrame:
    """Parts of nodes that lie on several shards -> one row a node: name, parent_name, conv_id, depth, counts, ends_sha256.

    Parts are sorted by (node, shard). Shards follow the order of paths, and conversations that end in one node stand by conv_id
    among themselves, so its ends come in ascending order and go through the digest one part after another; a task
    never holds more than one part.
    """
    schema = pa.schema([("name", pa.binary()), ("parent_name", pa.binary()), *((c, pa.int64()) for c in ("conv_id", "depth", *COUNTS)), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, some, out = None, None, False, []
        for b in batches:
            for name, parent, ends, conv, depth, *counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now[0] != name:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest, some = [name, parent, conv, depth, *counts], sha256(), False
                else:
                    now[2] = min(now[2], conv)
                    now[4:] = [a + c for a, c in zip(now[4:], counts, strict=True)]
                if ends:
                    digest.update(b"," + ends if some else ends)
                    some = True
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)
            out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*now, digest.hexdigest()), schema, strict=True)], schema=schema)

    rows = parts.repartition("name").sortWithinPartitions("name", "shard").select("name", "parent_name", "ends", "conv_id", "depth", *COUNTS)
    return rows.mapInArrow(run, "name binary, parent_name binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def trie(convs: DataFrame, shard_conversations: int = SHARD_CONVERSATIONS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """convs(conv_id, turns array of (name, words)) -> one row per distinct prefix: conv_id (its smallest member), depth, parent_conv_id (null
    for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    (conv_id, depth) names a node. Whole nodes are finished in their shard. Nodes across shards, two paths a shard at most, are put
    together by name; what they are called then goes back to the shards for the parents of whole nodes. A conversation's turns are
    one row; conversations that share their turns, a first turn or all, are dealt out like others. No conversations give no rows.
    """
    nodes = staged(nodes_of(staged(shards_of(convs, shard_conversations, shard_turns))))
    parts = nodes.where("NOT whole")
    several = staged(joined(parts))
    called = several.select("name", F.col("conv_id").alias("called"))
    merged = several.join(called.toDF("parent_name", "parent_conv_id"), "parent_name", "left").select(*[c.split()[0] for c in OUT.split(", ")])
    back = parts.select("name", "shard", F.col("number").alias("parent_number")).join(called, "name").drop("name")
    whole = nodes.where("whole")
    near = whole.where("parent_conv_id IS NOT NULL OR parent_number IS NULL")
    far = whole.where("parent_conv_id IS NULL AND parent_number IS NOT NULL").join(back, ["shard", "parent_number"]).withColumn("parent_conv_id", F.col("called"))
    return merged.unionByName(near.select(merged.columns)).unionByName(far.select(merged.columns))


def rebuilt_trie(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", **sizes: int) -> DataFrame:
    """The trie of rebuilt conversations. Turns go by turn, null first, ties by role and then by a hash of role and text; null roles and texts are empty. Rows
    without a conversation id belong to no conversation and are left out, since members are named by id. Repeated rows are turns of
    their own, extra columns are ignored."""
    return trie(rebuilt(staged(turns_of(rows, conv_col, turn_col, role_col, text_col))), **sizes)
