"""Splits, MLlib fits, scoring and distances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.lineage import attach, cut
from barloom.functions.columns import ratio


def temporal_part(ts: Column, parts: dict[str, tuple[str, str]]) -> Column:
    """Name of the half-open [start, end) range a timestamp lies in."""
    out = F.lit(None).cast("string")
    for name, (lo, hi) in reversed(parts.items()):
        out = F.when((ts >= F.lit(lo).cast("timestamp")) & (ts < F.lit(hi).cast("timestamp")), name).otherwise(out)
    return out


def stratified_part(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42, buckets: int = 1000) -> DataFrame:
    """Deterministic split within each label. Keys are hashed into buckets; the buckets a label
    gives to the test part hold as close to the share as whole buckets allow."""
    b = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(buckets))
    df = df.withColumn("_bucket", b)
    per = df.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label).orderBy("_bucket")  # at most ``buckets`` rows per label
    upto, total = F.sum("_n").over(w), F.sum("_n").over(Window.partitionBy(label))
    pick = per.select(label, "_bucket", F.when(upto <= total * test_share, "test").otherwise("train").alias("part"))
    return df.join(F.broadcast(pick), [label, "_bucket"]).drop("_bucket")  # labels x buckets rows


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Weight negatives / positives on the positive class."""
    n = df.agg(F.count_if(F.col(label) == 0).alias("_neg"), F.count_if(F.col(label) == 1).alias("_pos"))
    return df.transform(attach, n).withColumn("weight", F.when(F.col(label) == 1, F.coalesce(ratio("_neg", "_pos"), F.lit(1.0))).otherwise(1.0)).drop("_neg", "_pos")


def trainable(df: DataFrame, label: str, min_rows: int = 50) -> bool:
    """Enough rows and at least two classes."""
    r = df.agg(F.count(label).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    return r["n"] >= min_rows and r["lo"] != r["hi"]


def fit_standard_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population moments as one row, joined back and applied by ``apply_scaler``."""
    return df.agg(F.array(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")) for c in columns]).alias("fit"))


def apply_scaler(df: DataFrame, fit: DataFrame, columns: Sequence[str]) -> DataFrame:
    df = df.transform(attach, fit)
    return df.withColumns({c: F.coalesce(ratio(F.col(c) - F.col("fit")[i]["m"], F.col("fit")[i]["s"]), F.lit(0.0)) for i, c in enumerate(columns)}).drop("fit")


def assemble(columns: Sequence[str]) -> list:
    names = [f"{c}_filled" for c in columns]
    return [Imputer(inputCols=list(columns), outputCols=names, strategy="median"), VectorAssembler(inputCols=names, outputCol="features")]


def boosted_classifier(label="label", depth=3, rounds=5, weight=None, seed=42) -> GBTClassifier:
    g = GBTClassifier(labelCol=label, featuresCol="features", maxDepth=depth, maxIter=rounds, seed=seed)
    return g.setWeightCol(weight) if weight else g


def forest_classifier(label="label", trees=10, depth=5, seed=42) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)


def boosted_regressor(label="label", depth=3, rounds=5, seed=42) -> GBTRegressor:
    return GBTRegressor(labelCol=label, featuresCol="features", maxDepth=depth, maxIter=rounds, seed=seed)


def logistic(label="label") -> LogisticRegression:
    return LogisticRegression(labelCol=label, featuresCol="features", regParam=0.01, maxIter=50)


def logistic_by_key(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], label: str, reg: float = 0.01, most_passes: int = 60) -> DataFrame:
    """(keys, intercept, weights): one logistic model for each key, fitted for all of them in the same passes over rows.

    Mean log-loss plus reg / 2 times the squared weights of standardised columns, as in ``logistic``. A pass sums loss, gradient and
    Hessian by key with partial sums in each task; a Newton step that would raise the loss is halved. A key with one class
    gets no weights and an intercept that predicts this class. Columns without nulls, label 0 or 1.
    """
    d, keys = len(columns), list(keys)
    moments = cut(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("pos"), F.array(*[F.avg(c).cast("double") for c in columns]).alias("mean"),
        F.array(*[F.coalesce(F.stddev_samp(c), F.lit(0.0)) for c in columns]).alias("scale")))
    x = [F.coalesce(ratio(F.col(c) - F.col("mean")[i], F.col("scale")[i]), F.lit(0.0)).alias(f"x{i + 1}") for i, c in enumerate(columns)]
    z = cut(rows.join(moments.where("pos > 0 AND pos < n"), keys).select(*keys, F.lit(1.0).alias("x0"), *x, F.col(label).cast("double").alias("y")))
    zeros = F.array(*[F.lit(0.0)] * d)
    start = moments.where("pos > 0 AND pos < n").withColumn("at", F.concat(F.array(F.log(F.col("pos") / (F.col("n") - F.col("pos")))), zeros))
    state = cut(start.withColumns({"best": F.col("at"), "best_loss": F.lit(float("inf")), "step": F.concat(F.array(F.lit(0.0)), zeros), "done": F.lit(False)}))
    eta = sum(F.col("at")[i] * F.col(f"x{i}") for i in range(d + 1))
    p = 1 / (1 + F.exp(-F.col("eta")))
    pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    sums = [F.sum(F.greatest("eta", F.lit(0.0)) + F.log1p(F.exp(-F.abs("eta"))) - F.col("y") * F.col("eta")),
            *(F.sum((F.col("p") - F.col("y")) * F.col(f"x{i}")) for i in range(d + 1)), *(F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs)]
    ridge = np.array([0.0] + [reg] * d)

    def stepped(frames):
        for f in frames:
            for r in f.index:
                if f.at[r, "done"]:
                    continue
                s, at = np.array(f.at[r, "sums"]) / f.at[r, "n"], np.array(f.at[r, "at"])
                loss = s[0] + (ridge * at * at).sum() / 2
                if loss <= f.at[r, "best_loss"]:
                    h = np.zeros((d + 1, d + 1))
                    for (i, j), v in zip(pairs, s[d + 2:]):
                        h[i, j] = h[j, i] = v
                    best, step = at, -np.linalg.solve(h + np.diag(ridge) + 1e-12 * np.eye(d + 1), s[1:d + 2] + ridge * at)
                    f.at[r, "best_loss"] = loss
                else:
                    best, step = np.array(f.at[r, "best"]), np.array(f.at[r, "step"]) / 2
                f.at[r, "best"], f.at[r, "step"], f.at[r, "at"] = best.tolist(), step.tolist(), (best + step).tolist()
                f.at[r, "done"] = bool(np.abs(step).max() < 1e-7)
            yield f.drop(columns="sums")

    for _ in range(most_passes):
        parts = z.join(state.select(*keys, "at"), keys).withColumn("eta", eta).withColumn("p", p).groupBy(*keys).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)])
        found = state.join(parts.select(*keys, F.array(*[f"s{i}" for i in range(len(sums))]).alias("sums")), keys)
        state = cut(found.select(*state.columns, "sums").mapInPandas(stepped, state.schema))
        if state.where("NOT done").isEmpty():
            break
    else:
        raise RuntimeError("models did not settle")
    weights = F.array(*[F.coalesce(ratio(F.col("best")[i + 1], F.col("scale")[i]), F.lit(0.0)) for i in range(d)])
    fitted = state.withColumn("weights", weights).withColumn("intercept", F.col("best")[0] - sum(F.col("weights")[i] * F.col("mean")[i] for i in range(d)))
    single = moments.where("pos = 0 OR pos = n").select(*keys, F.when(F.col("pos") > 0, 1.0).otherwise(-1.0).alias("intercept"), zeros.alias("weights"))
    return fitted.select(*keys, "intercept", "weights").unionByName(single)


def tuned_logistic(train: DataFrame, columns: Sequence[str], label: str, folds: int = 3, seed: int = 42):
    lr = logistic(label)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, seed=seed)
    return Pipeline(stages=[*assemble(columns), cv]).fit(train)


def score(model, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    p = vector_to_array("probability")[1]
    return model.transform(df).withColumn("proba", p).withColumn("pred", (F.col("proba") >= threshold).cast("int"))


def importances(spark, model, names: Sequence[str], k: int) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(k)


def gaussian_fit(df: DataFrame, vector: str) -> tuple[list[float], list[list[float]]]:
    """Mean and inverse covariance (ridge 1e-6) of an array column.

    The moments are tree-aggregated by MLlib; only size x size numbers reach the driver."""
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    s = rows.select(Summarizer.metrics("mean", "std").summary(F.col("v")).alias("s")).select("s.*").first()
    mean, std = s["mean"].toArray(), s["std"].toArray()
    corr = np.nan_to_num(Correlation.corr(rows, "v").first()[0].toArray())
    np.fill_diagonal(corr, 1.0)
    inv = np.linalg.inv(corr * np.outer(std, std) + 1e-6 * np.eye(len(mean)))
    return mean.tolist(), inv.tolist()


def mahalanobis(vector: Column, mean: Sequence[float], inv: Sequence[Sequence[float]]) -> Column:
    """Distance of an array column to a fitted distribution."""
    d = F.zip_with(vector, F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a.cast("double") - b)
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in inv])
    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(dot(d, F.transform(rows, lambda r: dot(r, d))))
