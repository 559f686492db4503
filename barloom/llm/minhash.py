"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import SPACED, STEP, by_bytes, mixed, staged, text_bytes, word_hashes
from barloom.llm.graph import components

BANDS, ROWS = 36, 7
#: bits of every place that a sketch keeps
BITS = 3
EMPTY = np.uint64(2**64 - 1)
#: added before step 0, 1, ... of an element's sequence
STEPS = STEP * np.arange(1, 2049, dtype=np.uint64)
#: shingles whose permutations are held at once (one byte for each of the signature's places)
CHUNK = 1 << 16
#: bytes of text whose signatures or sets are made at once
PART_BYTES = 1 << 20
#: shingles in a block of a group that is compared in tiles; a member counts for ROW more, so that a block has 4,096 at most or so
TILE, ROW = 1 << 20, 256


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; a shorter text is one shingle, one without words none."""
    flat, counts = word_hashes(texts, SPACED)
    factors = mixed(STEP * np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    whole = np.zeros(max(0, len(flat) - k + 1), np.uint64)
    if len(whole):
        for i in range(k):
            whole += flat[i:len(whole) + i] * factors[i]
    whole = mixed(whole)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            own = np.sort(whole[at:at + n - k + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            out.append(mixed((flat[at:at + n] * factors[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)) if n else whole[:0])
        at += n
    return out


def draw(x: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Step j of each element's random sequence: (signature value with j as its whole part, index to swap with)."""
    z = mixed(x + STEPS[j])
    return (z >> np.uint64(32)) | np.uint64(j << 32), ((z & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64) + j


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash of each set, one row of m unsigned integers; an empty set has the largest value everywhere.

    Every element permutes the m places; in step j it offers j + a random fraction to the
    j-th place of its permutation, and each place keeps the least offer. Offers of step j
    are below those of step j + 1, so a set is finished once no place is empty: later steps
    cannot change it. Steps of all unfinished sets run together as array operations.
    """
    sig = np.full((len(sets), m), EMPTY)
    flat = sig.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return sig
    x, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    for i in range(0, len(x), 1 << 20):
        value, place = draw(x[i:i + (1 << 20)], 0, m)
        np.minimum.at(flat, doc[i:i + (1 << 20)] * m + place, value)
    starts, unfinished = np.concatenate([[0], np.cumsum(sizes)]), np.flatnonzero((sig == EMPTY).any(1) & (sizes > 0))
    upto, i = np.cumsum(sizes[unfinished]), 0
    while i < len(unfinished):
        last = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CHUNK, side="right")))
        part = unfinished[i:last]
        own = np.concatenate([x[starts[d]:starts[d + 1]] for d in part])
        sig[part] = further_steps(sig[part], own, np.repeat(np.arange(len(part)), sizes[part]))
        i = last
    return sig


def further_steps(sig: np.ndarray, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Steps 1, 2, ... of the elements x of sets doc, each set until it has no empty place."""
    m, flat = sig.shape[1], sig.reshape(-1)
    perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(x), 1))
    rows = np.arange(len(x))
    perm[rows, draw(x, 0, m)[1]] = 0  # step 0 exchanged this place with place 0, which is not looked at again
    for j in range(1, m):
        value, swap = draw(x, j, m)
        place = perm[rows, swap].astype(np.int64)
        perm[rows, swap] = perm[rows, j]
        at = doc * m + place
        free = flat[at] >= np.uint64(j << 32)
        np.minimum.at(flat, at[free], value[free])
        keep = (sig == EMPTY).any(1)[doc]
        if not keep.all():
            x, doc, perm = x[keep], doc[keep], perm[keep]
            rows = np.arange(len(x))
        if not len(x):
            break
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of the key."""
    factors = mixed(STEP * np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    keys = (sig.reshape(len(sig), bands, rows) * factors).sum(2, dtype=np.uint64) + STEP * np.arange(bands, dtype=np.uint64)
    return mixed(keys).view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """The lowest bits of every place in 64-bit integers: first the words of the one bit, then of the next."""
    words = -(-sig.shape[1] // 64)
    parts = []
    for bit in range(BITS):
        packed = np.packbits(((sig >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), axis=1)
        parts.append(np.pad(packed, ((0, 0), (0, words * 8 - packed.shape[1]))))
    return np.hstack(parts).view(np.int64)


def most_differing(m: int, percent: int) -> int:
    """Places in which sketches of two sets at the threshold differ: the mean and four standard deviations, passed by 3 such pairs in 1e5."""
    q = (1 - 0.5**BITS) * (100 - percent) / 100
    return round(m * q + 4 * (m * q * (1 - q)) ** 0.5)


def signed(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, band keys, sketch), one row per document, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1, PART_BYTES):
            sets = shingle_sets(text_bytes(b.column(1)), k)
            sig = signatures(sets, bands * rows)
            some = np.array([len(s) > 0 for s in sets], bool)
            lists = [(np.concatenate([[0], np.cumsum(some * x.shape[1])]), x[some].reshape(-1)) for x in (band_keys(sig, bands, rows), sketches(sig))]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                *(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for ends, x in lists)], ["doc_id", "n_shingles", "digest", "keys", "sketch"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>, sketch array<long>")


def sets_of(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """(digest, members): the full shingle set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 0, PART_BYTES):
            sets = shingle_sets(text_bytes(b.column(0)), k)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))], ["digest", "members"])

    return docs.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(run, "digest binary, members array<long>").where("digest IS NOT NULL")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Texts are lower-cased (A-Z) and split at white space; a set holds the distinct shingles of
    `shingle_words` words (a shorter text is one shingle). Documents link if
    100 * |A and B| >= percent * |A or B|.

    1. One pass makes SuperMinHash signatures and band keys; equal sets become one class.
    2. Classes that share a band key are candidates. With 36 bands of 7 rows a pair at exactly 0.8
       shares none with probability 2e-4, at 0.9 with 1e-10. A candidate whose sketches (three bits for each
       place) differ more than four standard deviations beyond the threshold is no link.
    3. The smallest class of a bucket is its leader; buckets with the same leader make one group. The leader is compared
       with all others on full sets, and union-find closes these links.
    4. A group that still has several components is cut into blocks of about `TILE` shingles by a hash, and each two blocks make a
       tile of their own: members outside the leader's component against all others, on full sets, until the tile's members are
       in one component or all their pairs across components have been compared. A second union-find closes these links too.
       Members of the leader's component are not compared with each other.

    A document without words or with a null text has an empty set, links with nothing and is
    its own component. Rows that repeat a doc_id are separate documents with the same name;
    a null doc_id never names a component unless all its members are null. Extra columns are
    ignored, an empty table gives no rows.
    """
    base = staged(signed(docs, id_col, text_col, shingle_words, bands, rows))
    classes = base.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()))
    stars = starred(classes, percent, bands * rows)
    mates = staged(stars.select(F.explode(F.array("lead", "node")).alias("node")).distinct())
    members = staged(member_sets(docs, id_col, text_col, shingle_words, classes, mates))
    tree = staged(components(staged(verified(stars.where("fits").select(F.col("lead").alias("a"), F.col("node").alias("b")), members, percent))))
    more = staged(tiled(stars, tree, members, classes.select("node", "sketch"), percent, bands * rows))
    links = tree.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    rooted = classes.select("digest", "node", "first_id").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(names, "root").select("digest", "component_id")
    out = base.select("doc_id", "n_shingles", "digest").join(staged(named), "digest", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def member_sets(docs: DataFrame, id_col: str, text_col: str, k: int, classes: DataFrame, mates: DataFrame) -> DataFrame:
    """(node, n, members) of the classes that share a bucket, made anew from one document of each."""
    wanted = classes.join(mates, "node", "left_semi").select("digest", "node", "n", "first_id")
    ids = wanted.select(F.col("first_id").alias("wanted_id"))
    chosen = docs.select(F.col(id_col).cast("long").alias("wanted_id"), F.col(text_col).alias("wanted_text")).join(ids.distinct(), "wanted_id", "left_semi")
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("wanted_id"), F.col(text_col).alias("wanted_text"))
    sets = sets_of(chosen.unionByName(nameless), "wanted_text", k)
    return sets.join(wanted.drop("first_id"), "digest").dropDuplicates(["node"]).select("node", "n", "members")


def verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = members.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("members").alias("set_a"))
    right = members.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("members").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    found = pairs.join(left, "a").join(right, "b")
    return found.where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def may_match(percent: int, m: int) -> str:
    """SQL condition on (n, sketch) and (n_lead, sketch_lead): sizes allow a link, and sketches differ in no more places than those of links do."""
    words = -(-m // 64)
    places = (" | ".join(f"(sketch[{b * words + i}] ^ sketch_lead[{b * words + i}])" for b in range(BITS)) for i in range(words))
    return f"100 * least(n, n_lead) >= {percent} * greatest(n, n_lead) AND {' + '.join(f'bit_count({x})' for x in places)} <= {most_differing(m, percent)}"


def starred(classes: DataFrame, percent: int, m: int) -> DataFrame:
    """(lead, node, n, fits): every class that shares a bucket, with the bucket's smallest class; fits, whether the two may link."""
    banded = classes.select("node", F.explode("keys").alias("key"))
    leads = staged(banded.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("many")).where("many > 1").select("key", "lead"))
    pairs = staged(banded.join(leads, "key").where("node <> lead").select("lead", "node").distinct())
    slim = classes.select("node", "n", "sketch")
    first = slim.select(F.col("node").alias("lead"), F.col("n").alias("n_lead"), F.col("sketch").alias("sketch_lead"))
    return staged(pairs.join(slim, "node").join(first, "lead").select("lead", "node", "n", F.expr(may_match(percent, m)).alias("fits")))


def tiles_of(stars: DataFrame, tree: DataFrame) -> DataFrame:
    """(lead, i, j, side, node, comp, outer): members of the groups that have several components, once for each tile they are in.

    Members outside the leader's component are hashed into blocks 0 .. p-1, the others into p .. p+q-1; tiles are (i, j) with i < p and
    i <= j, so no tile has only members of the leader's component. A group below one block's size is one tile.
    """
    first = tree.select(F.col("node").alias("lead"), F.col("root").alias("comp_lead"))
    named = stars.join(tree.withColumnRenamed("root", "comp"), "node", "left").join(first, "lead", "left")
    named = staged(named.select("lead", "node", (F.col("n") + ROW).alias("size"), F.coalesce("comp", "node").alias("comp"), F.coalesce("comp_lead", "lead").alias("comp_lead"))
                   .withColumn("outer", F.col("comp") != F.col("comp_lead")))
    sizes = named.groupBy("lead").agg(F.sum("size").alias("all"), F.sum(F.when(F.col("outer"), F.col("size"))).alias("out"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    small = F.col("all") <= TILE
    sizes = sizes.where("c0 <> c1").select("lead", F.when(small, 1).otherwise(F.ceil(F.col("out") / TILE)).alias("p"), F.when(small, 0).otherwise(F.ceil((F.col("all") - F.col("out")) / TILE)).alias("q"))
    at = named.join(staged(sizes), "lead").withColumn("h", F.xxhash64("node"))
    block = F.when(F.col("q") == 0, F.pmod("h", "p")).when(F.col("outer"), F.pmod("h", "p")).otherwise(F.col("p") + F.pmod("h", F.greatest("q", F.lit(1))))
    at = at.withColumn("block", block.cast("long"))
    lower = F.expr("transform(sequence(0L, least(block, p - 1)), x -> struct(x AS i, block AS j))")
    upper = F.expr("CASE WHEN block < p AND block + 1 < p + q THEN transform(sequence(block + 1, p + q - 1), x -> struct(block AS i, x AS j)) END")
    at = at.withColumn("tile", F.explode(F.concat(lower, F.coalesce(upper, F.array().cast("array<struct<i:bigint,j:bigint>>")))))
    return at.select("lead", "tile.i", "tile.j", (F.col("block") != F.col("tile.i")).alias("side"), "node", "comp", "outer")


def tiled(stars: DataFrame, tree: DataFrame, members: DataFrame, sketched: DataFrame, percent: int, m: int) -> DataFrame:
    """(a, b): links that connect what all links within the tiles connect, given the components of the tree."""
    most = most_differing(m, percent)

    def compare(table: pa.Table) -> pa.Table:
        a, b = tile_links(table, percent, most)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = tiles_of(stars, tree).join(members.join(sketched, "node"), "node")
    return rows.groupBy("lead", "i", "j").applyInArrow(compare, "a long, b long")


def tile_links(table: pa.Table, percent: int, most: int) -> tuple[list[int], list[int]]:
    """Links of one tile: each outer member against the members of other components that come after it (in a tile of two blocks: of the other block)."""
    table = table.combine_chunks()
    column = {c: table.column(c).to_numpy() for c in ("node", "comp", "n")}
    side, outer = (np.array(table.column(c).to_pylist(), bool) for c in ("side", "outer"))
    order = np.lexsort((column["node"], ~outer, side))
    node, n, outer, two = column["node"][order], column["n"][order], outer[order], int((~side).sum()) if side.any() else 0
    comp = np.unique(column["comp"][order], return_inverse=True)[1]
    sets = table.column("members").chunk(0)
    ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
    sketch = np.vstack(table.column("sketch").to_pylist()).astype(np.int64).view(np.uint64)[order].reshape(len(order), BITS, -1)
    a, b = [], []
    for r in np.flatnonzero(outer[:two or None]):
        at = two or r + 1
        other = at + np.flatnonzero((comp[at:] != comp[r]) & (100 * np.minimum(n[at:], n[r]) >= percent * np.maximum(n[at:], n[r])))
        far = np.bitwise_count(np.bitwise_or.reduce(sketch[other] ^ sketch[r], axis=1)).sum(1)
        own = flat[ends[order[r]]:ends[order[r] + 1]]
        for c in other[far <= most]:
            if comp[c] == comp[r]:
                continue
            both = len(np.intersect1d(own, flat[ends[order[c]]:ends[order[c] + 1]], assume_unique=True))
            if 100 * both >= percent * (n[r] + n[c] - both):
                a.append(node[r])
                b.append(node[c])
                comp[comp == comp[c]] = comp[r]
    return a, b
