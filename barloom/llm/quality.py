"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import ALNUM, staged, text_bytes, word_hashes

STATS = 22
FEATURES = 192
FOLDS = 5
BINS = 512


def statistics(text: bytes, words: np.ndarray) -> list[float]:
    """Counts and shares of one whole text; `words` are the hashes of its words."""
    n, m = len(text), len(words)
    b = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digits, space = b[65:91].sum(), b[97:123].sum(), b[48:58].sum(), b[32] + b[9:14].sum()
    letters, beyond = upper + lower, b[128:].sum()
    ends, symbols = b[[33, 46, 63]].sum(), b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum()
    distinct, times = np.unique(words, return_counts=True)
    pairs = words[1:] * np.uint64(3) + words[:-1] if m > 1 else words[:0]
    lines = [x for x in text.split(b"\n") if x.strip()]
    dots, commas = b[46], b[44]
    size = max(1, n)
    return [
        np.log1p(n), np.log1p(m), n / max(1, m), upper / max(1, letters), letters / size, digits / size, space / size, beyond / size,
        symbols / size, (symbols - dots - commas) / size, b[124] / size, b[33] / size, ends / max(1, m), commas / max(1, m), len(lines) / max(1, m),
        len(distinct) / max(1, m), times.max(initial=0) / max(1, m), float((words[1:] == words[:-1]).mean()) if m > 1 else 0.0,
        len(np.unique(pairs)) / max(1, m - 1), len(set(lines)) / max(1, len(lines)), float((times ** 2).sum()) / max(1, m) ** 2, np.log1p(max(map(len, lines), default=0)),
    ]


def measured(docs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, stats) of every text and the columns named in `also`, one row for each row of docs, no shuffle. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                part = whole.slice(i, 1024)
                texts = text_bytes(part.column(1))
                flat, counts = word_hashes(texts, ALNUM)
                ends = np.cumsum(counts)
                rows = np.array([statistics(t, flat[e - c:e]) for t, e, c in zip(texts, ends.tolist(), counts.tolist(), strict=True)], float).reshape(-1, STATS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * STATS, pa.int32()), pa.array(rows.reshape(-1))), *part.columns[2:]], ["doc_id", "stats", *also])

    schema = ", ".join(["doc_id long, stats array<double>", *(f"{k} {kind}" for k, kind in docs.select(*also).dtypes)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"), *also).mapInArrow(run, schema)


def summed(rows: DataFrame, make, *keys: str) -> dict[tuple, np.ndarray]:
    """Adds up the arrays that make(batch) gives for each batch, {keys: array}, within each partition, then element by element in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for k, v in make(b).items():
                total[k] = total[k] + v if k in total else v
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in k), pa.array([v.tolist()], pa.list_(pa.float64()))], [*keys, "sums"])

    parts = rows.mapInArrow(run, ", ".join([*(f"{k} long" for k in keys), "sums array<double>"]))
    cells = parts.select(*keys, F.posexplode("sums").alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("x"))
    out: dict[tuple, np.ndarray] = {}
    for k, group in cells.toArrow().to_pandas().groupby(list(keys) or (lambda _: 0)):
        out[k if keys else ()] = group.sort_values("at")["x"].to_numpy()
    return out


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # calibration: raw scores and probabilities at them, both rising
    chances: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -5, 5)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases), np.ones((len(z), 1))])

    def scores(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights
        return np.clip(0.995 * np.interp(raw, self.steps, self.chances) + 0.005 * np.clip(raw, 0, 1), 0, 1)


def isotonic(hits: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rising probabilities closest to hits / total: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for h, n in zip(hits.tolist(), total.tolist(), strict=True):
        blocks.append([h, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h1, n1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h1, blocks[-1][1] + n1, blocks[-1][2] + k1]
    return np.repeat([h / n for h, n, _ in blocks], [int(k) for *_, k in blocks])


def learned(stats: DataFrame, labels: DataFrame, width: float = 4.0, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Fits on all labelled rows whose crc32(doc_id as text) modulo 5 isn't 0.

    Statistics are standardised over all documents. Every partition sums the normal equations of its rows, apart
    for each of the four training folds; the total minus a fold gives the weights that score that fold, and
    those out-of-fold scores, in bins, calibrate the model of all folds.
    """
    moments = summed(stats, lambda b: {(): np.concatenate([[b.num_rows], (x := matrix(b.column("stats"))).sum(0), (x * x).sum(0)])})
    rng = np.random.default_rng(seed)
    m = moments.get((), np.zeros(1 + 2 * STATS))
    n = max(1.0, m[0])
    mean = m[1:1 + STATS] / n
    model = Model(mean, np.sqrt(np.maximum(m[1 + STATS:] / n - mean**2, 1e-12)) + 1e-6, rng.normal(0, 1 / width, (STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    rows = staged(stats.join(known.withColumn("fold", fold).where("fold <> 0"), "doc_id").select("fold", "label", "stats"))
    d = FEATURES + 1

    def equations(b: pa.RecordBatch) -> dict[tuple, np.ndarray]:
        x, y, f = model.features(matrix(b.column("stats"))), b.column("label").to_numpy(zero_copy_only=False), b.column("fold").to_numpy(zero_copy_only=False)
        return {(int(k),): np.concatenate([(x[f == k].T @ x[f == k])[np.triu_indices(d)], x[f == k].T @ y[f == k], [(f == k).sum()]]) for k in np.unique(f)}

    parts = summed(rows, equations, "fold")
    if not parts:
        return model

    def solved(e: np.ndarray) -> np.ndarray:
        a = np.zeros((d, d))
        a[np.triu_indices(d)] = e[:-d - 1]
        a += np.triu(a, 1).T
        return np.linalg.solve(a + ridge * max(1.0, e[-1]) * np.eye(d), e[-d - 1:-1])

    total = sum(parts.values())
    apart = {k if isinstance(k, int) else k[0]: solved(total - v) for k, v in parts.items()}
    low, high = -0.5, 1.5

    def binned(b: pa.RecordBatch) -> dict[tuple, np.ndarray]:
        x, y, f = model.features(matrix(b.column("stats"))), b.column("label").to_numpy(zero_copy_only=False), b.column("fold").to_numpy(zero_copy_only=False)
        raw = np.array([row @ apart[int(k)] for row, k in zip(x, f, strict=True)])
        at = np.clip(((raw - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
        return {(): np.concatenate([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])}

    bins = summed(rows, binned)[()]
    hits, many = bins[:BINS], bins[BINS:]
    used = many > 0
    model.weights = solved(total)
    model.steps = (low + (np.arange(BINS) + 0.5) / BINS * (high - low))[used]
    model.chances = isotonic(hits[used], many[used])
    return model


def scored(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each row of stats (see `measured`).

    Empty and null texts get the score of their (zero) statistics. A null doc_id is not held out. Without any label the score is 0.5.
    """
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(matrix(b.column(1))))], ["doc_id", "score"])

    out = stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
