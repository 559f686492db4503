"""Counts, sums and products of vectors as mergeable summaries of blocks, and what follows from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def block_moments(rows: DataFrame, keys: Sequence[str], block: str, columns: Sequence[str]) -> DataFrame:
    """keys, block, n, s (sums), q (sums of products, upper triangle): one row a block, from rows without nulls in the columns. Sums of such rows
    are the moments of the blocks together, so any run of blocks is described without its rows."""
    whole = rows.dropna(subset=list(columns))
    x = [F.col(c).cast("double") for c in columns]
    return whole.groupBy(*keys, block).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs(len(x))]).alias("q"))


def summed(moments: DataFrame, by: Sequence[str], d: int) -> DataFrame:
    """Moments added up by `by`."""
    k = len(pairs(d))
    return moments.groupBy(*by).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(d)]).alias("s"), F.array(*[F.sum(F.col("q")[i]) for i in range(k)]).alias("q"))


def distances(frames: Iterator[pd.DataFrame], ridge: float = 1e-6) -> Iterator[pd.DataFrame]:
    """Adds mean and the inverse of the sample covariance plus ridge; null for fewer than two rows."""
    for f in frames:
        mean, inverse = [], []
        for n, s, q in zip(f["n"], f["s"], f["q"], strict=True):
            d = len(s)
            if n < 2:
                mean.append(None)
                inverse.append(None)
                continue
            m, second = np.array(s) / n, np.zeros((d, d))
            for (i, j), v in zip(pairs(d), q, strict=True):
                second[i, j] = second[j, i] = v
            cov = (second - n * np.outer(m, m)) / (n - 1) + ridge * np.eye(d)
            mean.append(m.tolist())
            inverse.append(np.linalg.inv(cov).ravel().tolist())
        yield f.drop(columns=["n", "s", "q"]).assign(mean=mean, inverse=inverse)


def with_rolling_distance(rows: DataFrame, keys: Sequence[str], block: str, columns: Sequence[str], back: int, name: str = "distance") -> DataFrame:
    """Mahalanobis distance of each row to the rows of the `back` blocks before its own, null where those have fewer than two rows or the row
    has a null. Every block's moments go to the `back` blocks after it and are added there; one matrix a block is inverted."""
    keys, d = list(keys), len(columns)
    blocks = block_moments(rows, keys, block, columns)
    ahead = blocks.withColumn(block, F.explode(F.sequence(F.col(block) + 1, F.col(block) + back)))
    types = dict(rows.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in [*keys, block])
    trained = summed(ahead, [*keys, block], d).mapInPandas(distances, f"{head}, mean array<double>, inverse array<double>")
    off = [F.col(c).cast("double") - F.col("mean")[i] for i, c in enumerate(columns)]
    square = sum((F.col("inverse")[i * d + j] * off[i] * off[j] for i in range(d) for j in range(d)), F.lit(0.0))
    return rows.join(trained, [*keys, block], "left").withColumn(name, F.sqrt(F.when(square > 0, square).when(square <= 0, 0.0))).drop("mean", "inverse")


def fold_fits(moments: DataFrame, keys: Sequence[str], block: str, d: int, train: int, test: int, step: int, ridge: float = 1.0) -> DataFrame:
    """keys, fold, n_train, n_test, intercept, weights, mse: ridge regressions of the last column on the others, walking forward.

    Fold f trains on blocks f * step .. + train - 1 and is tested on the `test` blocks after them. A block's moments count in the few folds it lies in; weights
    come from the normal equations of the training moments and the test error from the test moments alone, so rows are read once however many folds overlap.
    """
    keys = list(keys)
    b = F.col(block)
    lowest = F.greatest(F.lit(0), F.ceil((b - (train + test) + 1) / step))
    placed = moments.withColumn("fold", F.explode(F.sequence(lowest, F.floor(b / step)))).withColumn("tested", b >= F.col("fold") * step + train)
    sides = summed(placed, [*keys, "fold", "tested"], d)
    both = sides.groupBy(*keys, "fold").agg(*[F.max_by(F.struct("n", "s", "q"), F.col("tested") == on).alias(name) for name, on in (("a", False), ("b", True))],
                                            F.bool_or(~F.col("tested")).alias("has_a"), F.bool_or("tested").alias("has_b"))
    types = dict(moments.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def gram(m) -> np.ndarray:
        out = np.zeros((d + 1, d + 1))
        out[0, 0], out[0, 1:], out[1:, 0] = m["n"], m["s"], m["s"]
        for (i, j), v in zip(pairs(d), m["q"], strict=True):
            out[i + 1, j + 1] = out[j + 1, i + 1] = v
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                a = gram(row.a)
                w = np.linalg.solve(a[:d, :d] + ridge * np.diag([0.0] + [1.0] * (d - 1)), a[:d, d])
                b = gram(row.b) if row.has_b else np.zeros((d + 1, d + 1))
                error = b[d, d] - 2 * w @ b[:d, d] + w @ b[:d, :d] @ w
                out.append((*(getattr(row, k) for k in keys), row.fold, int(a[0, 0]), int(b[0, 0]), float(w[0]), w[1:].tolist(), float(error / b[0, 0]) if b[0, 0] else None))
            yield pd.DataFrame(out, columns=[*keys, "fold", "n_train", "n_test", "intercept", "weights", "mse"])

    return both.where("has_a").drop("has_a").mapInPandas(run, f"{head}, fold long, n_train long, n_test long, intercept double, weights array<double>, mse double")

