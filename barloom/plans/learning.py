"""MLlib queries on embeddings, documents and bars."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window, functions as F

from barloom.functions.columns import clip, ratio, rounded
from barloom.operators import labels as lb
from barloom.operators import boosting as bo
from barloom.operators import ml, stats
from barloom.operators.chunks import over_chunks
from barloom.operators.families import add_state_vector
from barloom.operators.lineage import cut
from barloom.plans.base import indexed_bars
from barloom.plans.registry import query
from barloom.schema import SERIES
from barloom.sources.tables import read_table

c = F.col


def states(spark, base, label):
    """Embeddings with a label column and a stratified split; written once because every fit reads it often."""
    e = read_table(spark, base, "embeddings").withColumn("label", label)
    e = e.withColumn("features", array_to_vector(c("embedding").cast("array<double>"))).select("vec_id", "label", "features")
    return cut(ml.stratified_part(e, "vec_id", "label"))


@query("boosted_classifier", "M1 M7 A34 A35 O2")
def _(spark, base):
    df = ml.class_weight(states(spark, base, (c("label") < 3).cast("double")), "label")
    model = ml.boosted_classifier(weight="weight").fit(df.where("part = 'train'"))
    out = ml.score(model, df.where("part = 'test'")).withColumn("truth", c("label").cast("int"))
    return stats.class_report(cut(out.select("truth", "pred")), "truth", "pred", [0, 1])


@query("feature_importance", "O2 M1")
def _(spark, base):
    df = states(spark, base, (c("label") < 3).cast("double"))
    model = ml.boosted_classifier().fit(df.where("part = 'train'"))
    return ml.importances(spark, model, [f"x{i}" for i in range(model.numFeatures)], 10)


@query("crisis_classifier", "M2 A34")
def _(spark, base):
    df = states(spark, base, (c("label") % 4).cast("double"))
    model = ml.forest_classifier().fit(df.where("part = 'train'"))
    out = model.transform(df.where("part = 'test'")).select(c("label").cast("int").alias("truth"), c("prediction").cast("int").alias("pred"))
    return stats.class_report(cut(out), "truth", "pred", [0, 1, 2, 3])


@query("opportunity_regressor", "M3 A36")
def _(spark, base):
    df = states(spark, base, c("label") / 10.0)
    model = ml.boosted_regressor().fit(df.where("part = 'train'"))
    out = model.transform(df.where("part = 'test'")).withColumn("p", clip("prediction", 0, 1))
    e = c("label") - c("p")
    return out.agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))


@query("tuned_logistic", "M4 M5 A24")
def _(spark, base):
    """Impute, assemble, cross-validated logistic regression on document quality."""
    d = read_table(spark, base, "documents").select("doc_id", c("n_chars").cast("double").alias("n_chars"),
                                                    F.length("source").cast("double").alias("source_len"), (c("lang") == "en").cast("double").alias("english"))
    df = d.join(read_table(spark, base, "labels"), "doc_id").withColumn("label", c("quality").cast("double"))
    df = cut(ml.stratified_part(df, "doc_id", "label"))
    train = df.where("part = 'train'")
    if not ml.trainable(train, "label"):
        raise ValueError("too few rows or a single class")
    model = ml.tuned_logistic(train, ["n_chars", "source_len", "english"], "label")
    out = ml.score(model, df.where("part = 'test'"))
    return stats.average_ranks_auc(out.select(F.round("proba", 9).alias("proba"), c("label").cast("int").alias("label")), "proba", "label")


@query("split_shares", "M6")
def _(spark, base):
    return states(spark, base, c("label").cast("double")).groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))


@query("models_per_series", "M8 M7")
def _(spark, base):
    """One logistic model per (symbol, tf) on the state vector; all are fitted in the same passes."""
    def cols(d, w):
        return add_state_vector(d, w).withColumns(lb.forward_return(w, 4))
    names = ["sv_last", "sv_mean", "sv_vol", "sv_trend", "sv_relative"]
    return series_accuracy(over_chunks(indexed_bars(spark, base), cols, before=64, after=8).select(
        *SERIES, "bar_idx", *names, c("target_fee").cast("double").alias("label")), names)


def series_accuracy(df, names):
    """One row for each series: labelled rows after the first 80 % of bars, and the share of them that the series' model, fitted before, gets
    right. A series whose training rows have one class predicts it; without rows to train on or to predict the accuracy is null."""
    ends = df.where("label IS NOT NULL").groupBy(*SERIES).agg((F.max("bar_idx") * 0.8).cast("long").alias("last_train"))
    df = cut(df.join(ends, SERIES, "left"))
    models = ml.logistic_by_key(df.where("label IS NOT NULL AND bar_idx <= last_train"), SERIES, names, "label")
    pred = (c("intercept") + sum(c("weights")[i] * c(x) for i, x in enumerate(names)) >= 0).cast("double")
    test = c("label").isNotNull() & (c("bar_idx") > c("last_train"))
    return df.join(models, SERIES, "left").groupBy(*SERIES).agg(F.count_if(test).alias("n"), F.avg(F.when(test, (pred == c("label")).cast("double"))).alias("accuracy"))


STATE = ["sv_last", "sv_mean", "sv_vol", "sv_trend", "sv_relative"]


def binned_states(spark, base):
    """State vectors of all bars in bins of their series' first 80 % of labelled bars, with what the next four bars returned; train marks those 80 %."""
    def cols(d, w):
        return add_state_vector(d, w).withColumns(lb.forward_return(w, 4))
    df = over_chunks(indexed_bars(spark, base), cols, before=64, after=8).where("raw_ret IS NOT NULL").select(*SERIES, "bar_idx", "raw_ret", c("target_fee").cast("double").alias("label"), *STATE)
    ends = df.groupBy(*SERIES).agg((F.max("bar_idx") * 0.8).cast("long").alias("last_train"))
    df = df.join(ends, SERIES).withColumn("train", c("bar_idx") <= c("last_train")).drop("last_train")
    return cut(bo.binned(df, SERIES, STATE, fit_on="train"))


@query("boosted_series", "M1 M7 M8")
def _(spark, base):
    """A hundred boosted trees for every series, positives weighted by negatives / positives, scored on the last fifth of its bars."""
    df = binned_states(spark, base)
    share = df.where("train").groupBy(*SERIES).agg(ratio(F.sum(1 - c("label")), F.sum("label")).alias("ratio"))
    df = df.join(cut(share), SERIES).withColumn("weight", F.when(c("label") == 1, F.coalesce("ratio", F.lit(1.0))).otherwise(1.0))
    models = cut(bo.boosted_by_key(df.where("train"), SERIES, "label", "weight"))
    out = bo.scored(df.where("NOT train"), models, SERIES)
    hit = ((c("score") >= 0.5).cast("double") == c("label")).cast("double")
    return out.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(hit)).alias("accuracy"), F.count_if(c("score") >= 0.5).alias("positives"), rounded(F.avg("score")).alias("mean_score"))


@query("boosted_regression_series", "M3 A36")
def _(spark, base):
    """Boosted regression of the next return of every series, clipped to 0..1, with its errors on the last fifth."""
    df = binned_states(spark, base).withColumn("target", clip("raw_ret", 0, 1))
    models = cut(bo.boosted_by_key(df.where("train"), SERIES, "target", kind="squared"))
    out = bo.scored(df.where("NOT train"), models, SERIES, "squared").withColumn("p", clip("score", 0, 1))
    e = c("target") - c("p")
    return out.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(e * e)).alias("mse"), rounded(F.avg(F.abs(e))).alias("mae"))


@query("boosted_classes", "M2 A34")
def _(spark, base):
    """Four classes of the next return, one against the rest: the class is part of a model's key, so all series and classes are fitted together."""
    keys = [*SERIES, "class"]
    df = binned_states(spark, base).withColumn("truth", F.when(c("raw_ret") < -0.5, 0).when(c("raw_ret") < 0, 1).when(c("raw_ret") < 1, 2).otherwise(3))
    df = df.withColumn("class", F.explode(F.array(*map(F.lit, range(4))))).withColumn("own", (c("truth") == c("class")).cast("double"))
    models = cut(bo.boosted_by_key(df.where("train"), keys, "own"))
    best = bo.scored(df.where("NOT train"), models, keys).groupBy(*SERIES, "bar_idx", "truth").agg(F.max_by("class", F.struct("score", -c("class"))).alias("pred"))
    return best.groupBy(*SERIES, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("boosted_gains", "O2 M1")
def _(spark, base):
    """The three columns that gained most in each series' trees."""
    found = bo.gains(bo.boosted_by_key(binned_states(spark, base).where("train"), SERIES), SERIES, STATE)
    place = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.round("gain", 6).desc(), "feature"))
    return found.withColumn("place", place).where("place <= 3").select(*SERIES, "place", "feature", "splits", rounded("gain", 4).alias("gain"))
