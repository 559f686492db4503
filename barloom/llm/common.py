"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.utils import AnalysisException

from barloom.operators.lineage import CONF, ensure_checkpoint_dir

#: A-Z lower-cased, all other bytes as they are; UTF-8 keeps multi-byte characters out of its way
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: the same, and every ASCII byte that is neither a digit nor a letter becomes a space
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the session names for checkpoints, which every executor sees."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get(CONF, None) or spark.sparkContext.getConf().get(CONF, None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/barloom-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write once as Parquet into the shared folder and read from there: later branches do
    not compute the frame again, and a lost executor costs no more than a re-read."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, name: str = "__row") -> tuple[DataFrame, str]:
    """(rows with a number each, that column's name), for work on rows whose ids may be null, repeat, or be shared by different rows.

    The number is made of the file and the row's place in it, which every later read of the same files gives again; nothing is
    written. Rows that don't come from files are written once and numbered then; so must rows be that a file's row was multiplied
    into (see `one_to_one`). The name is one that no column has.
    """
    while name in df.columns:
        name += "_"
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias(f"{name}_file"), F.col("_metadata.row_index").alias(name))
        files = df.select(F.col("_metadata.file_path").alias(f"{name}_file")).distinct()
    except AnalysisException:
        return numbered(df, name), name
    files = staged(files.withColumn(f"{name}_number", F.row_number().over(Window.orderBy(f"{name}_file")).cast("long")))  # one row a file
    return placed.join(files, f"{name}_file").withColumn(name, F.shiftleft(f"{name}_number", 36) + F.col(name)).drop(f"{name}_file", f"{name}_number"), name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A written copy with a number for each row."""
    return staged(df.withColumn(name, F.monotonically_increasing_id()))


def one_to_one(rows: DataFrame, name: str) -> bool:
    """Whether no number comes twice."""
    return rows.groupBy(name).count().where("count > 1").isEmpty()


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit mixing generator, on unsigned integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column) -> list[bytes]:
    """Texts of an Arrow binary column; null is empty."""
    return [b"" if t is None else t for t in column.to_pylist()]


#: A-Z lower-cased, ASCII white space becomes a space
SPACED = bytes(32 if b in b"\t\n\x0b\x0c\r " else LOWER[b] for b in range(256))
STEP = np.uint64(0x9E3779B97F4A7C15)
BYTE_CODES = mixed(STEP * np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
BASE, BASE_INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 2**64)
POWERS: dict[str, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2**64, kept for the next call."""
    name = str(base)
    if name not in POWERS or len(POWERS[name]) < n:
        if n > 1 << 23:  # one very long text: not kept
            return np.cumprod(np.concatenate([[1], np.full(n - 1, base)]).astype(np.uint64), dtype=np.uint64)
        size = max(1 << 20, 1 << (n - 1).bit_length())
        POWERS[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
    return POWERS[name][:n]


def ranges(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of items of about `most` bytes; a larger item is a range of its own."""
    out, start, total = [], 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            out.append((start, i))
            start, total = i, 0
        total += size
    return [*out, (start, len(sizes))] if sizes else []


def slices(texts: list[bytes], most: int = 1 << 20) -> list[tuple[int, int]]:
    return ranges([len(t) for t in texts], most)


def by_bytes(batches: Iterator[pa.RecordBatch], at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about `most` bytes of text in column `at`, so that a task's memory follows from bytes instead of rows.
    Texts stay whole; an empty batch gives nothing. Memory that is free afterwards goes back to the machine."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        for a, b in ranges(sizes, most):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def word_hashes(texts: list[bytes], table: bytes, stops: bytes = b"") -> tuple[np.ndarray, ...]:
    """(64-bit hash of every word in order, number of words in each text). `table` maps bytes,
    separators to spaces. A word's hash is a polynomial in its mapped bytes, from differences of
    a running sum over all texts at once. With `stops`, bytes that end a sentence, a third
    array numbers each word's sentence; the numbers rise and differ between texts."""
    counts, found, sentences, last = np.zeros(len(texts), np.int64), [], [], 0
    for a, b in slices(texts):
        raw = np.frombuffer(b" ".join([b"", *(t.translate(table) for t in texts[a:b]), b""]), np.uint8)
        inside = raw != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        run = np.cumsum(np.where(inside, BYTE_CODES[raw], np.uint64(0)) * powers(BASE, len(raw)), dtype=np.uint64)
        found.append(mixed((run[ends - 1] - run[starts - 1]) * powers(BASE_INVERSE, len(raw))[starts]))
        limits = np.cumsum([1 + len(t) for t in texts[a:b]])
        if stops:
            stop = np.isin(np.frombuffer(b" ".join([b"", *texts[a:b], b""]), np.uint8), np.frombuffer(stops, np.uint8))
            stop[limits] = True
            sentences.append(np.cumsum(stop)[starts] + last)
            last += int(stop.sum())
        counts[a:b] = np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))
    hashes = np.concatenate([*found, np.zeros(0, np.uint64)])
    return (hashes, counts, np.concatenate([*sentences, np.zeros(0, np.int64)])) if stops else (hashes, counts)
