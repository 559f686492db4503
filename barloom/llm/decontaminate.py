"""Benchmark decontamination: FM-index per training shard, backward search of test windows, removal spans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from barloom.llm.common import ALNUM, by_bytes, keyed, numbered, one_to_one, staged, text_bytes, word_hashes
from barloom.llm.fm_index import FMIndex

WINDOW = 10
#: windows of test items, at most one a word, that one pass over the documents searches for; more make more passes
ITEM_WORDS = 1_000_000
#: windows handed on at once
PACKED = 65_536
#: bytes of text that one index covers
SHARD_BYTES = 4 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Windows:
    """Windows of one block of (window, item) pairs; the same window may come with several items."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, items: list[str], window: int):
        """hashes: the words of all pairs' windows one after another, lengths: words of each."""
        self.names = sorted(set(items))
        number = {name: i for i, name in enumerate(self.names)}
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        rows = np.zeros((len(lengths), window), np.int32)
        rows[np.arange(window) < lengths[:, None]] = ids + 1
        self.patterns, which = np.unique(rows, axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(1)
        order = np.argsort(which.ravel(), kind="stable")
        self.items = np.array([number[i] for i in items], np.int64)[order]
        self.item_ends = np.concatenate([[0], np.cumsum(np.bincount(which.ravel(), minlength=len(self.patterns)))]).astype(np.int64)

    def occurrences(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, start word of each occurrence counted over all texts, its window), by one FM-index over the texts.

        Words that no window holds are separators of the index, and so are text ends; runs shorter than every window are left out.
        """
        flat, counts = word_hashes(texts, ALNUM)
        none = np.zeros(0, np.int64)
        if not len(flat) or not len(self.lengths):
            return counts, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[at] == flat, at + 1, 0)
        first = np.zeros(len(flat), bool)
        first[(np.cumsum(counts) - counts)[counts > 0]] = True
        inside = ids > 0
        begins = inside & (first | ~np.concatenate([[False], inside[:-1]]))
        run_starts = np.flatnonzero(begins)
        ends = inside & np.concatenate([~inside[1:] | first[1:], [True]])
        run_lengths = np.flatnonzero(ends) + 1 - run_starts
        keep = run_lengths >= self.lengths.min()
        run_starts, run_lengths = run_starts[keep], run_lengths[keep]
        if not len(run_starts):
            return counts, none, none
        offsets = np.cumsum(run_lengths + 1) - run_lengths  # in the indexed sequence, after its leading separator
        s = np.zeros(int((run_lengths + 1).sum()) + 1, np.int64)
        source = np.full(len(s), -1, np.int64)
        inner = np.arange(int(run_lengths.sum())) - np.repeat(np.cumsum(run_lengths) - run_lengths, run_lengths)
        place = np.repeat(offsets, run_lengths) + inner
        source[place] = np.repeat(run_starts, run_lengths) + inner
        s[place] = ids[source[place]]
        index = FMIndex(s)
        low, high = index.search(self.patterns, self.lengths)
        many = high - low
        slots = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return counts, source[index.locate(slots)], np.repeat(np.arange(len(low)), many)

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
        """(words, merged hit spans as word numbers [start, end), names of items found), for each text."""
        counts, start, window = self.occurrences(texts)
        ends = np.cumsum(counts)
        depth = np.zeros(int(ends[-1] if len(ends) else 0) + 1, np.int64)
        np.add.at(depth, start, 1)
        np.add.at(depth, start + self.lengths[window], -1)
        hit = np.cumsum(depth[:-1]) > 0
        doc = np.searchsorted(ends, start, side="right")
        many = self.item_ends[window + 1] - self.item_ends[window]
        each = np.repeat(self.item_ends[window], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        pairs = np.unique(np.repeat(doc, many) * max(1, len(self.names)) + self.items[each])
        spans = [np.zeros((0, 2), np.int64)] * len(texts)
        names: list[list[str]] = [[] for _ in texts]
        for p in pairs.tolist():
            names[p // len(self.names)].append(self.names[p % len(self.names)])
        for d in np.unique(doc).tolist():
            own = np.concatenate([[False], hit[ends[d] - counts[d]:ends[d]], [False]])
            spans[d] = np.flatnonzero(own[1:] != own[:-1]).reshape(-1, 2)
        return counts, spans, names


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """g, item: each item's distinct windows, as the 8-byte hashes of their words one after another; made and told apart in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1, SHARD_BYTES):
            names, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1).cast(pa.binary()))
            flat, counts = word_hashes(texts, ALNUM)
            ends = np.cumsum(counts)
            for name, n, end in zip(names, counts.tolist(), ends.tolist(), strict=True):
                own = flat[end - n:end].astype("<u8").tobytes()
                many = max(1, n - window + 1) if n else 0
                for at in range(0, many, PACKED):
                    found = {own[8 * i:8 * (i + window)] for i in range(at, min(many, at + PACKED))}
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([name] * len(found), pa.string())], ["g", "item"])

    named = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, "g binary, item string").distinct()


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> Iterator[Windows]:
    """Blocks of at most `most` (window, item) pairs in the order of windows. The driver holds one block at a time, whatever the size of the
    items or of their table; a window with more items than that goes on in the next block."""
    size = max(1, min(PACKED, most))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                g, items = (batch.column(k).slice(at, size).to_pylist() for k in (0, 1))
                lengths = np.array([len(x) // 8 for x in g], "<i4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(g)], pa.binary()), pa.array([lengths], pa.binary()), pa.array([items], pa.list_(pa.string()))], ["g", "lengths", "items"])

    pairs = item_windows(benchmark, item_col, text_col, window)
    packed = staged(pairs.repartitionByRange("g", "item").sortWithinPartitions("g", "item").mapInArrow(pack, "g binary, lengths binary, items array<string>"))
    hashes, lengths, items, total = [], [], [], 0

    def block() -> Windows:
        return Windows(np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*lengths, np.zeros(0, np.int64)]).astype(np.int64), items, window)

    for r in packed.toLocalIterator():
        if total and total + len(r["items"]) > most:
            yield block()
            hashes, lengths, items, total = [], [], [], 0
        hashes.append(np.frombuffer(bytes(r["g"]), "<u8"))
        lengths.append(np.frombuffer(bytes(r["lengths"]), "<i4"))
        items += r["items"]
        total += len(r["items"])
    yield block()


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])


def merged(a: list, b: list) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted([*map(tuple, a), *map(tuple, b)]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
              window: int = WINDOW, item_words: int = ITEM_WORDS, result: str = "found") -> DataFrame:
    """All columns of docs and a struct `result`: n_words, spans ([start, end) word numbers, merged), items (sorted distinct ids as strings).

    Words are runs of digits, letters and non-ASCII characters after A-Z are lower-cased. A window is `window`
    consecutive words of an item; an item of fewer words is one window, one without words none. Every batch of
    documents becomes an FM-index over whole texts; windows are searched backwards through the wavelet
    tree and located by sampled suffix positions. Windows beyond `item_words` are searched in
    further passes, so what a task or the driver holds stays bounded; the passes' spans and items are merged.

    A null or empty text has no words and no hits; a null item_id counts as the empty string; repeated
    items count once. `result` must not be a column of docs.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(result, FOUND)])
    return passes(docs, benchmark, docs.columns.index(text_col), item_col, item_text_col, window, item_words, schema,
                  lambda columns, rows: pa.RecordBatch.from_arrays([*columns, pa.array(rows, KIND)], schema.names))


def passes(docs: DataFrame, benchmark: DataFrame, text_at: int, item_col: str, item_text_col: str, window: int, item_words: int, schema: T.StructType,
           finish: Callable[[list[pa.Array], list[dict]], pa.RecordBatch]) -> DataFrame:
    """One pass over docs for each block of windows; the last one hands columns and merged findings to `finish`, in the same Python worker.

    Passes before the last write what they find in rows with hits: number of the row, spans and items. Texts are not written again;
    they meet the findings, joined by row number, in the last pass.
    """
    spark, width = docs.sparkSession, len(docs.columns)
    blocks = item_blocks(benchmark, item_col, item_text_col, window, item_words)
    block, later = next(blocks), next(blocks, None)
    if later is None:
        return searched(docs, schema, spark.sparkContext.broadcast(block), text_at, width, finish)
    rows, name = keyed(docs)
    if not one_to_one(rows, name):
        rows = numbered(docs, name)
    slim, found = rows.select(name, F.col(docs.columns[text_at]).alias("text")), None

    def hits_alone(columns: list[pa.Array], rows: list[dict]) -> pa.RecordBatch:
        hit = pa.array([bool(r["spans"]) for r in rows], pa.bool_())
        return pa.RecordBatch.from_arrays([columns[0], pa.array(rows, KIND)], ["n", "earlier"]).filter(hit)

    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("earlier", FOUND)])
    while later is not None:
        shared = spark.sparkContext.broadcast(block)
        part = staged(searched(slim, kind, shared, 1, 2, hits_alone))
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
        block, later = later, next(blocks, None)
    earlier = name + "_earlier"
    spans, items = F.flatten(F.collect_list("earlier.spans")), F.array_distinct(F.flatten(F.collect_list("earlier.items")))
    each = found.groupBy(F.col("n").alias(name)).agg(F.struct(F.max("earlier.n_words").alias("n_words"), spans.alias("spans"), items.alias("items")).alias(earlier))
    joined = rows.join(staged(each), name, "left").select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns], earlier)
    return searched(joined, schema, spark.sparkContext.broadcast(block), text_at, width, finish)


KIND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def searched(docs: DataFrame, schema: T.StructType, shared, text_at: int, width: int, finish: Callable[[list[pa.Array], list[dict]], pa.RecordBatch]) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in by_bytes(batches, text_at, SHARD_BYTES):
            texts = text_bytes(batch.column(text_at).cast(pa.binary()))
            earlier = batch.column(width).to_pylist() if batch.num_columns > width else None
            counts, spans, names = windows.hits(texts)
            rows = [{"n_words": n, "spans": s.tolist(), "items": i} for n, s, i in zip(counts.tolist(), spans, names, strict=True)]
            if earlier:
                rows = [r if e is None else {"n_words": r["n_words"], "spans": merged(e["spans"], r["spans"]), "items": sorted({*e["items"], *r["items"]})} for e, r in zip(earlier, rows, strict=True)]
            yield finish(list(batch.columns[:width]), rows)

    return docs.mapInArrow(run, schema)


def without_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    words = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:words[s][0]])
        at = words[e - 1][1]
    return "".join([*out, text[at:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str = "n_chars", item_col: str = "item_id", item_text_col: str = "text",
            window: int = WINDOW, item_words: int = ITEM_WORDS) -> DataFrame:
    """docs with the removal spans cut out of their texts and the character count renewed; other rows as they are.
    A document of which no word remains goes. Texts are cut in the pass that finds the last spans."""
    at, names = docs.columns.index(text_col), docs.columns
    count_at = names.index(chars_col) if chars_col in names else None

    def cut(columns: list[pa.Array], rows: list[dict]) -> pa.RecordBatch:
        hit, keep = [i for i, r in enumerate(rows) if r["spans"]], np.ones(len(rows), bool)
        if hit:
            texts = columns[at].to_pylist()
            for i in hit:
                texts[i] = without_spans(texts[i], rows[i]["spans"])
                keep[i] = WORD.search(texts[i]) is not None
            columns[at] = pa.array(texts, columns[at].type)
            if count_at is not None:
                counts = columns[count_at].to_pylist()
                for i in hit:
                    counts[i] = len(texts[i])
                columns[count_at] = pa.array(counts, columns[count_at].type)
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return passes(docs, benchmark, at, item_col, item_text_col, window, item_words, docs.schema, cut)


def hit_counts(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans; one row for each row of docs."""
    found = find_hits(docs.select("doc_id", "text"), benchmark, result="found", **options)
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", F.col("found.n_words").alias("n_words"), hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("found.items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.col("found.spans").alias("spans"))
