"""Token counts as rollups kept by signed deltas."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

from barloom.llm.common import by_bytes

#: bytes of text that are counted at once
PART_BYTES = 1 << 21
#: places of the public tokenizer files; a parameter of everything below
TOKENIZERS = "/opt/tokenizers"
KEYS = ["source", "lang", "tokenizer"]
#: how byte-level vocabularies split text before merging (fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEDGER = "doc_id long, source string, lang string, tokenizer string, sign int, tokens long"


@lru_cache(maxsize=4)
def byte_level(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, tokenizers: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens): one row for each document and tokenizer version, no shuffle.

    A version is "words" (runs of characters other than ASCII white space) or the name of a tiktoken file in `folder`, which
    every executor has. Whole texts are counted; a null text has 0 tokens.
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    models = [t for t in tokenizers if t != "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 3, PART_BYTES):
            texts = b.column(3).to_pylist()
            for name in tokenizers:
                if name == "words":
                    counts = [len(t.encode().split()) for t in texts]
                else:
                    encode = byte_level(f"{folder}/{name}.tiktoken").encode_ordinary
                    counts = [len(encode(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([name] * len(texts)), pa.array(counts, pa.int64())], ["doc_id", "source", "lang", "tokenizer", "tokens"])

    return slim.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long") if models or tokenizers else slim.sparkSession.createDataFrame([], "doc_id long, source string, lang string, tokenizer string, tokens long")


class TokenRollup:
    """Totals by source, language and tokenizer version below one shared folder.

    ledger holds the signed rows of every batch and totals their sums, each try of a commit in folders of its own. Adding a row to the
    log (batch, number, try) is the commit: readers look only at the latest try of each batch in the log, so they see a batch's
    ledger and totals together or not at all, and a broken try leaves nothing behind that counts. A batch keeps the number of its first commit,
    and what it takes back are counts from batches with smaller numbers. So repeating any batch, whenever it comes, gives the same rows again
    and replaces them: commits are idempotent in any order. One writer at a time; totals are plain sums of signed rows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def stored(self, part: str, schema: str) -> DataFrame:
        full = T._parse_datatype_string(schema)
        try:
            return self.spark.read.schema(full).parquet(f"{self.folder}/{part}")
        except AnalysisException:
            return self.spark.createDataFrame([], full)

    def log(self) -> DataFrame:
        """batch, number, attempt, turn: the latest commit of each batch."""
        rows = self.stored("log", "batch string, number long, attempt string, turn long")
        return rows.groupBy("batch").agg(F.max_by(F.struct("number", "attempt", "turn"), "turn").alias("at")).select("batch", "at.*")

    def read(self, part: str, schema: str) -> DataFrame:
        """Committed rows with their batch and its number."""
        return self.stored(part, f"{schema}, batch string, attempt string").join(self.log().drop("turn"), ["batch", "attempt"]).drop("attempt")

    def ledger(self) -> DataFrame:
        return self.read("ledger", LEDGER)

    def number(self, batch: str) -> int:
        """The batch's place in the order of first commits."""
        own, last = self.log().agg(F.max(F.when(F.col("batch") == batch, F.col("number"))), F.max("number")).first()
        return own if own is not None else (last or 0) + 1

    def balance(self, before: int | None = None) -> DataFrame:
        """Counts in force from batches with smaller numbers than `before`: doc_id, source, lang, tokenizer, tokens and copies, the number of
        documents with just this count. Rows of one id with different counts stay apart, so taking them back is exact."""
        rows = self.ledger().where(F.lit(True) if before is None else F.col("number") < before)
        return rows.groupBy("doc_id", *KEYS, "tokens").agg(F.sum("sign").alias("copies")).where("copies <> 0")

    def taken_back(self, batch: str, touched: DataFrame) -> DataFrame:
        """Reversals of what the documents in touched(doc_id, ...) have in force before this batch; null is a value like others."""
        held, keys = self.balance(self.number(batch)), touched.columns
        some = touched.distinct().toDF(*(f"__{k}" for k in keys))
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
        return held.join(some, same, "left_semi").select("doc_id", *KEYS, (-F.col("copies")).alias("sign"), "tokens")

    def commit(self, batch: str, rows: DataFrame) -> None:
        """rows(doc_id, source, lang, tokenizer, sign, tokens): +1 adds a document's count, -1 takes one back. Sums go up by key
        with partial sums in each task, so a source with most rows is no hot spot. Nulls are keys of their own, other columns are ignored, an empty
        table is a batch without rows."""
        attempt, number = uuid.uuid4().hex, self.number(batch)
        name = [F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt")]

        def put(df: DataFrame, part: str) -> None:
            df.select("*", *name).write.partitionBy("batch", "attempt").mode("append").parquet(f"{self.folder}/{part}")

        put(rows.select("doc_id", *KEYS, F.col("sign").cast("int"), F.col("tokens").cast("long")), "ledger")
        own = self.stored("ledger", f"{LEDGER}, batch string, attempt string").where((F.col("batch") == batch) & (F.col("attempt") == attempt))
        put(own.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens")).coalesce(1), "totals")
        turn = (self.log().agg(F.max("turn")).first()[0] or 0) + 1
        self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(number).cast("long").alias("number"), F.lit(attempt).alias("attempt"), F.lit(turn).cast("long").alias("turn")).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def insert(self, batch: str, counts: DataFrame) -> None:
        self.commit(batch, counts.withColumn("sign", F.lit(1)))

    def delete(self, batch: str, ids: DataFrame) -> None:
        """Takes back whatever the documents in ids(doc_id) have in force before this batch. A null id stands for all documents without one."""
        self.commit(batch, self.taken_back(batch, ids.select("doc_id")))

    def revise(self, batch: str, counts: DataFrame) -> None:
        """New counts of documents for their tokenizer versions: what was in force under the same id, null too, is taken back, the new
        is added; unchanged counts add no rows. Ids that repeat are revised together, so all their rows have to be in counts."""
        new = counts.select("doc_id", *KEYS, F.lit(1).alias("sign"), "tokens")
        old = self.taken_back(batch, new.select("doc_id", "tokenizer"))
        both = old.unionByName(new).groupBy("doc_id", *KEYS, "tokens").agg(F.sum("sign").alias("sign"))
        self.commit(batch, both.where("sign <> 0"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches; keys whose documents are all gone are left out."""
        rows = self.read("totals", "source string, lang string, tokenizer string, docs long, tokens long")
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
