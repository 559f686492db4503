"""Token-ID files in patched frame-of-reference blocks: written by Spark's text writer, read back as whole files."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.llm.common import by_bytes, shared_folder, staged, text_bytes

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: ids in a block; share of a block's ids that its width has to hold, the others are exceptions
BLOCK, PERCENTILE = 1024, 95
#: a segment is closed once it has so many ids; a file takes so many segments
SEGMENT_IDS, FILE_SEGMENTS = 1 << 20, 16
#: first bytes of a segment, and the bytes between two segments
MAGIC, SYNC = b"PFOR", "PFSYNC\n"
#: segment: magic, partition, number in it, documents, ids, blocks, exceptions, bytes of packed ids
HEAD = struct.Struct("<4sIIIQIIQ")
#: block: byte where its packed ids begin, least id, first exception, width in bits
ENTRY = np.dtype([("start", "<u8"), ("least", "<u4"), ("patch", "<u4"), ("width", "u1")])
#: exception: place in its block, what is added to the least id
PATCH = np.dtype([("place", "<u2"), ("delta", "<u4")])
#: document: id, whether it has one, number of its ids
DOC = np.dtype([("doc_id", "<i8"), ("named", "u1"), ("n", "<u4")])
#: distinct pieces that an encoder remembers
MEMORY = 600_000
#: bytes that separate pieces, besides spaces; bytes after which ASCII punctuation at a word's end is a piece of its own: digits and
#: letters of ASCII, second bytes of Latin-1 letters (first byte C3)
LINE_END = bytes(32 if b == 10 else b for b in range(256))
ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
LATIN = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
STOP = np.array([b in b".,;:!?" for b in range(256)])
PART_BYTES = 1 << 21
#: words of ASCII and Latin-1 letters alone
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def byte_characters() -> dict[int, str]:
    """How byte-level vocabularies write bytes (fixed values): visible Latin-1 characters as they are, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_CHARACTERS = byte_characters()


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(pieces between spaces and line ends, with a punctuation mark that ends a word apart; number of pieces of each text)."""
    raw = np.frombuffer(b" ".join([*texts, b""]).translate(LINE_END), np.uint8)
    after = np.flatnonzero(STOP[raw[2:-1]] & (raw[3:] == 32) & (ALNUM[raw[1:-2]] | LATIN[raw[1:-2]] & (raw[:-3] == 0xC3))) + 2
    spaces = np.flatnonzero(raw == 32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(spaces, ends) + np.searchsorted(after, ends)
    return np.insert(raw, after, 32).tobytes().split(b" ")[:-1], np.diff(np.concatenate([[0], upto]))


class Pieces(dict):
    """Numbers of pieces of text. A piece asked for the first time gets the next number and waits in `fresh`."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number


class Encoder:
    """Ids of texts under a vocabulary file of the tokenizers library.

    This vocabulary drops white space between words and never merges across it, nor between a letter or digit and
    the punctuation that ends a word, so a text's ids are those of its pieces, one after another. Each distinct piece goes through
    the library once and is then remembered; a full memory keeps the pieces seen more than once. Neither changes a result.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.bpe = self.model.model
        self.known, self.seen = Pieces(), np.zeros(0, np.int64)
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces, where each one ends)."""
        sizes = self.size[at]
        upto = np.cumsum(sizes)
        return self.flat[np.repeat(self.start[at] - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)], upto

    def forget(self) -> None:
        often = np.flatnonzero(self.seen > 1)
        if len(often) > MEMORY // 2:
            often = often[:0]
        kept, pieces = Pieces(), list(self.known)
        for i in often.tolist():
            dict.__setitem__(kept, pieces[i], len(kept))
        self.flat, upto = self.gathered(often)
        self.size = self.size[often]
        self.start, self.seen, self.known = upto - self.size, np.zeros(len(often), np.int64), kept

    def learned(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece from the library. Normalizing and pre-tokenizing do nothing to a word of plain letters but
        lower-case it and write its bytes as characters, so those words go to the library's model as they are."""
        out = [[t.id for t in self.bpe.tokenize(p.lower().encode().decode("latin-1").translate(BYTE_CHARACTERS))] if LETTERS.fullmatch(p) else None for p in pieces]
        other = [i for i, ids in enumerate(out) if ids is None]
        for i, x in zip(other, self.model.encode_batch_fast([pieces[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if len(self.known) > MEMORY:
            self.forget()
        pieces, counts = pieces_of(texts)
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        if self.known.fresh:
            found = self.learned([p.decode() for p in self.known.fresh])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])
            self.seen = np.concatenate([self.seen, np.zeros(len(found), np.int64)])
            self.known.fresh = []
        self.seen += np.bincount(at, minlength=len(self.seen))
        ids, upto = self.gathered(at)
        return ids, np.diff(np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(counts)])])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def packed(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers in `width` bits each, most significant bit first."""
    bits = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width:]).tobytes()


def unpacked(raw: np.ndarray, rows: int, width: int) -> np.ndarray:
    """`rows` blocks of packed integers, a row of bytes each -> a row of BLOCK integers each."""
    bits = np.zeros((rows * BLOCK, 32), np.uint8)
    bits[:, 32 - width:] = np.unpackbits(raw, axis=1).reshape(-1, width)
    return np.packbits(bits, axis=1).view(">u4").astype(np.uint32).reshape(rows, BLOCK)


def segment(part: int, number: int, docs: list[tuple[int | None, int]], ids: np.ndarray) -> bytes:
    """Header, index of blocks, exceptions, documents, packed ids.

    Each block of BLOCK ids (the last one filled up with its least id) stores differences to its least id in the width
    that holds PERCENTILE percent of them; the others keep their low bits in place and stand in the exception list.
    """
    n = len(ids)
    rows = -(-n // BLOCK)
    table = np.concatenate([ids, np.full(rows * BLOCK - n, ids[-1] if n else 0, np.uint32)]).reshape(rows, BLOCK)
    least = table.min(1) if rows else np.zeros(0, np.uint32)
    delta = table - least[:, None]
    place = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    limit = np.partition(delta, place, axis=1)[:, place] if rows else least
    width = np.frexp(limit.astype(np.float64))[1].astype(np.uint8)
    outer = delta >> np.minimum(width, 31)[:, None].astype(np.uint32) > 0
    outer[width == 32] = False
    row, at = np.nonzero(outer)
    patches = np.zeros(len(row), PATCH)
    patches["place"], patches["delta"] = at, delta[row, at]
    index = np.zeros(rows, ENTRY)
    size = BLOCK // 8 * width.astype(np.int64)
    index["start"], index["least"], index["width"], index["patch"] = np.cumsum(size) - size, least, width, np.searchsorted(row, np.arange(rows))
    body = bytearray(int(size.sum()))
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        cells = packed(delta[own].reshape(-1), w)
        step = BLOCK // 8 * w
        for i, k in enumerate(own.tolist()):
            body[index["start"][k]:index["start"][k] + step] = cells[i * step:(i + 1) * step]
    known = np.zeros(len(docs), DOC)
    for i, (doc, many) in enumerate(docs):
        known[i] = (doc or 0, doc is not None, many)
    head = HEAD.pack(MAGIC, part, number, len(docs), n, rows, len(patches), len(body))
    return b"".join([head, index.tobytes(), patches.tobytes(), known.tobytes(), body])


def block_ids(index: np.ndarray, patches: np.ndarray, body: np.ndarray, first: int, last: int) -> np.ndarray:
    """Ids of the blocks first .. last - 1, from the index alone: other blocks are not touched."""
    out = np.zeros((last - first, BLOCK), np.uint32)
    width, start = index["width"][first:last], index["start"][first:last].astype(np.int64)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        step = BLOCK // 8 * w
        out[own] = unpacked(body[start[own][:, None] + np.arange(step)], len(own), w)
    ends = np.append(index["patch"], len(patches))[first:last + 1].astype(np.int64)
    row = np.repeat(np.arange(last - first), np.diff(ends))
    out[row, patches["place"][ends[0]:ends[-1]]] = patches["delta"][ends[0]:ends[-1]]
    return (out + index["least"][first:last, None]).reshape(-1)


def segments(content: memoryview | bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(partition, number in it, documents, ids) of each segment of a file."""
    at, raw = 0, np.frombuffer(content, np.uint8)
    while at < len(raw):
        magic, part, number, docs, n, rows, many, size = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("no segment begins here")
        at += HEAD.size
        parts = []
        for kind, count in ((ENTRY, rows), (PATCH, many), (DOC, docs)):
            parts.append(np.frombuffer(content, kind, count, at))
            at += kind.itemsize * count
        index, patches, known = parts
        yield part, number, known, block_ids(index, patches, raw[at:at + size], 0, rows)[:n]
        at += size + len(SYNC)


def written(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, file_segments: int = FILE_SEGMENTS) -> str:
    """Encodes docs(doc_id, text) and writes files below `folder`; gives the folder back.

    Texts are dealt out once, by ranges of (doc_id, hash of the text), null first; rows that are equal throughout are split by their row number.
    Every task encodes its range in order and writes segments of about segment_ids ids, `file_segments` of them in a file. A
    document stays in one segment, its end id is its last id.
    """
    path, order = path or public_path(TOKENIZER), ["doc_id", "tie", "row"]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, docs_in, ids_in, total = 0, 0, [], [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment(part, number, docs_in, np.concatenate(ids_in))], pa.binary())], ["value"])

        for b in by_bytes(batches, 1, PART_BYTES):
            ids, sizes = encoder(path).encode(text_bytes(b.column(1)))
            ids, sizes, at = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1, 0
            part = b.column(2)[0].as_py()
            for doc, n in zip(b.column(0).to_pylist(), sizes.tolist(), strict=True):
                docs_in.append((doc, n))
                ids_in.append(ids[at:at + n])
                at, total = at + n, total + n
                if total >= segment_ids:
                    yield closed()
                    number, docs_in, ids_in, total = number + 1, [], [], 0
        if docs_in:
            yield closed()

    cells = rows.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    cells.write.option("lineSep", SYNC).option("maxRecordsPerFile", file_segments).option("compression", "none").text(folder)
    return folder


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """(part, number, at, doc_id, n_tokens, before, ids): every document in the files, `before` counting the ids before it in its segment.
    ids are little-endian unsigned integers of four bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in b.column(0):
                for part, number, docs, ids in segments(cell.as_buffer()):
                    n = docs["n"].astype(np.int64)
                    raw, ends = ids.astype("<u4"), np.cumsum(n)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([part] * len(n), pa.int32()), pa.array([number] * len(n), pa.int32()), pa.array(range(len(n)), pa.int32()),
                        pa.array([d if k else None for d, k in zip(docs["doc_id"].tolist(), docs["named"].tolist(), strict=True)], pa.int64()), pa.array(n), pa.array(ends - n),
                        pa.array([raw[e - k:e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())], ["part", "number", "at", "doc_id", "n_tokens", "before", "ids"])

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(run, "part int, number int, at int, doc_id long, n_tokens long, before long, ids binary")


def positions(rows: DataFrame) -> DataFrame:
    """rows(part, number, n_tokens, before, ...) + start, the ids in all files before the document. Sums of segments run within a partition
    and sums of partitions over partitions: one row for each of either."""
    sums = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("many"))
    so_far = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = sums.withColumn("inside", F.coalesce(F.sum("many").over(so_far.partitionBy("part").orderBy("number")), F.lit(0)))
    parts = sums.groupBy("part").agg(F.sum("many").alias("many")).select("part", F.coalesce(F.sum("many").over(so_far.orderBy("part")), F.lit(0)).alias("parts"))
    starts = inside.join(parts, "part").select("part", "number", (F.col("inside") + F.col("parts")).alias("first"))
    return rows.join(staged(starts), ["part", "number"]).withColumn("start", F.col("first") + F.col("before")).drop("first")


def tokenized(docs: DataFrame, path: str | None = None, end_id: int = END_ID, folder: str | None = None, **sizes: int) -> DataFrame:
    """Writes the token files of docs(doc_id, text) and reads them back: doc_id, start, n_tokens, ids_crc32, one row per document.

    path names a vocabulary of the tokenizers library whose pre-tokenizer drops white space; every executor has it. A null text is empty and has
    the end id alone; whole texts are encoded. Documents go by doc_id, null first, then by a hash of their text; rows that
    repeat an id are documents of their own. Extra columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = written(docs, folder or shared_folder(spark), path, end_id, **sizes)
    rows = read_back(spark, folder).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return positions(staged(rows)).select("doc_id", "start", "n_tokens", "ids_crc32")
