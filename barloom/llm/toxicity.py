"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learned from document labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import ALNUM, by_bytes, staged, text_bytes, word_hashes

ENDS = b".!?\n"
#: labelled documents the model is fitted on at most, those with the smallest hashes of their ids
TRAINING_DOCS = 8_000
#: bytes of text that are scored at once
PART_BYTES = 4 << 20


@dataclass
class Model:
    """Log-odds of a sentence: bias + weights of its distinct words; of a document 1 - product of (1 - p)."""

    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def sentences(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence number of each text's first word and behind its last, log-odds of each sentence's known words) over sentences that have any known word."""
        flat, counts, sentence = word_hashes(texts, ALNUM, ENDS)
        at = np.minimum(np.searchsorted(self.words, flat), max(0, len(self.words) - 1))
        known = np.flatnonzero(self.words[at] == flat) if len(self.words) else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([sentence[known], at[known]]), axis=1)
        which, inverse = np.unique(pairs[0], return_inverse=True)
        return counts, sentence, np.stack([which.astype(float), np.bincount(inverse, self.weights[pairs[1]], len(which)) if len(which) else which.astype(float)])

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, float]]]]:
        """(document score, its offending sentences as (number within the document, probability))."""
        counts, sentence, known = self.sentences(texts)
        ends = np.cumsum(counts)
        first = sentence[np.minimum(ends - counts, max(0, len(sentence) - 1))] if len(sentence) else ends
        log_clean = np.zeros(len(texts))
        worst: list[list[tuple[int, float]]] = [[] for _ in texts]
        plain = np.logaddexp(0, self.bias)
        doc = np.searchsorted(sentence[np.maximum(ends - 1, 0)] if len(sentence) else ends, known[0], side="left") if len(known[0]) else np.zeros(0, np.int64)
        z = known[1] + self.bias
        np.add.at(log_clean, doc, -np.logaddexp(0, z))
        # a sentence without known words has the bias alone; one such factor stands for all of them
        for d, s, p in zip(doc.tolist(), known[0].tolist(), (1 / (1 + np.exp(-z))).tolist(), strict=True):
            if p >= 0.5:
                worst[d].append((int(s - first[d]), p))
        return 1 - np.exp(log_clean - plain), worst


def fitted(rows: pd.DataFrame, steps: int = 300, rate: float = 0.1, l2: float = 0.02) -> Model:
    """rows(label, words, sentences): one row per document, words[i] in sentence sentences[i].

    The words' weights maximise the noisy-or likelihood with a Gaussian prior (Adam, full batch).
    """
    y = rows["label"].to_numpy(float)
    size = np.array([len(w) for w in rows["words"]], np.int64)
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if len(y) else -3.0)
    if not size.sum() or not 0 < y.sum() < len(y):
        return empty
    doc = np.repeat(np.arange(len(rows)), size)
    words = np.concatenate(rows["words"].to_list()).astype(np.int64).view(np.uint64)
    sentence = np.concatenate(rows["sentences"].to_list()).astype(np.int64)
    chosen, column = np.unique(words, return_inverse=True)
    triple = np.unique(np.stack([doc, sentence, column]), axis=1)
    starts = np.flatnonzero(np.concatenate([[True], (triple[:2, 1:] != triple[:2, :-1]).any(0)])) if triple.shape[1] else np.zeros(0, np.int64)
    inst = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, triple.shape[1])))
    inst_doc, col = triple[0][starts], triple[2]
    theta = np.zeros(len(chosen) + 1)
    theta[-1] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        s = theta[-1] + np.bincount(inst, theta[col], len(starts))
        # every document also has one sentence without known words
        log_clean = -np.logaddexp(0, theta[-1]) - np.bincount(inst_doc, np.logaddexp(0, s), len(y))
        p_doc = np.clip(1 - np.exp(log_clean), 1e-9, 1)
        pull = np.where(y == 1, (1 - p_doc) / p_doc, -1.0)
        g_inst = pull[inst_doc] / (1 + np.exp(-s))
        g = np.append(np.bincount(col, g_inst[inst], len(chosen)) - l2 * theta[:-1], g_inst.sum() + (pull / (1 + np.exp(-theta[-1]))).sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(chosen, theta[:-1], float(theta[-1]))


def telling_words(rows: DataFrame, least_docs: int = 3, least_z: float = 4.0) -> np.ndarray:
    """Hashes of the words whose shares of documents differ between the classes of rows(label, words) by `least_z`
    standard errors. Documents are counted in Spark; only the words that pass are collected."""
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < n:
        return np.zeros(0, np.uint64)
    counts = rows.select("label", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("label").alias("pos"))
    share = F.col("df") / n
    gap = F.abs(F.col("pos") / toxic - (F.col("df") - F.col("pos")) / (n - toxic))
    passed = counts.where((F.col("df") >= least_docs) & (F.col("df") < n) & (gap >= least_z * F.sqrt(share * (1 - share) * (1 / toxic + 1 / (n - toxic)))))
    return np.sort(passed.select("word").toArrow().column("word").to_numpy().astype(np.int64).view(np.uint64))


def training_rows(docs: DataFrame, labels: DataFrame, most_docs: int, remainder: int = 1, folds: int = 3) -> pd.DataFrame:
    """label, words and sentences of at most `most_docs` labelled documents whose crc32(doc_id as text) modulo `folds` isn't
    `remainder`; of the words only the telling ones, so that little reaches the driver."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != remainder)
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1, PART_BYTES):
            flat, counts, sentence = word_hashes(text_bytes(b.column(1)), ALNUM, ENDS)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(sentence))], ["label", "words", "sentences"])

    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = staged(texts.select(F.col("label").cast("int"), "text").mapInArrow(split, "label int, words array<long>, sentences array<long>"))
    telling = telling_words(rows)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, sentences = b.column(1), b.column(2)
            flat = words.flatten().to_numpy(zero_copy_only=False)
            known = np.isin(flat.view(np.uint64), telling)
            doc = np.repeat(np.arange(b.num_rows), words.value_lengths().to_numpy(zero_copy_only=False))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[known], minlength=b.num_rows))]), pa.int32())
            some = [pa.ListArray.from_arrays(ends, pa.array(x[known])) for x in (flat, sentences.flatten().to_numpy(zero_copy_only=False))]
            yield pa.RecordBatch.from_arrays([b.column(0), *some], b.schema.names)

    return rows.mapInArrow(kept, rows.schema).toArrow().to_pandas()


def learned(docs: DataFrame, labels: DataFrame, most_docs: int = TRAINING_DOCS) -> Model:
    return fitted(training_rows(docs, labels, most_docs))


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, offending (array of sentence number within the text and probability), one row for each row of docs.

    Whole texts are scored; a null or empty text has no sentence with a known word and so the bias's score. A null doc_id is not held out.
    Only the text enters the score. Extra columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("sentence", pa.int64()), ("p", pa.float64())]))
        for b in by_bytes(batches, 1, PART_BYTES):
            score, worst = shared.value.scores(text_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array([[{"sentence": s, "p": p} for s, p in x] for x in worst], kind)], ["doc_id", "score", "offending"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, score double, offending array<struct<sentence:long,p:double>>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")
