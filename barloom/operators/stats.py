"""Dispersion, distribution, drift and cross-asset statistics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.columns import ratio
from barloom.operators.chunks import running
from barloom.operators.lineage import attach, cut
from barloom.operators.quantiles import sliced
from barloom.schema import SERIES


def aligned(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows on which every vector is a number."""
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull() & ~F.isnan(n)
    return df.where(ok)


def group_moments(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per vector (name, n, mean, var) from a single aggregation over the wide rows."""
    one = df.agg(*[a.alias(f"{n}__{k}") for n in names for k, a in (
        ("n", F.count(n)), ("mean", F.avg(n)), ("var", F.var_samp(n)))])
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}__n").alias("n"), F.col(f"{n}__mean").alias("mean"),
                               F.col(f"{n}__var").alias("var")) for n in names])
    return one.select(F.explode(parts).alias("g")).select("g.*")


def variance_decomposition(moments: DataFrame) -> DataFrame:
    """One-way ANOVA and variance shares from per-group moments (a handful of rows)."""
    t = moments.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("mean")).alias("s"),
                    F.sum(F.col("n") * F.col("mean") ** 2).alias("s2"), F.sum((F.col("n") - 1) * F.col("var")).alias("ss_within"))
    between = F.col("s2") - F.col("s") ** 2 / F.col("n")
    t = t.withColumns({"ss_between": between, "df_between": F.col("k") - 1, "df_within": F.col("n") - F.col("k")})
    t = t.withColumns({"var_between": F.col("ss_between") / F.col("df_between"), "var_within": F.col("ss_within") / F.col("df_within"),
                       "var_total": (F.col("ss_between") + F.col("ss_within")) / (F.col("n") - 1),
                       "eta_squared": ratio(F.col("ss_between"), F.col("ss_between") + F.col("ss_within"))})
    e = F.col("eta_squared")
    return t.withColumns({"f_statistic": F.col("var_between") / F.col("var_within"), "dispersion_ratio": F.col("var_between") / F.col("var_total"),
                          "effect": F.when(e < 0.01, "negligible").when(e < 0.06, "small").when(e < 0.14, "medium").otherwise("large")})


def with_f_pvalue(anova: DataFrame) -> DataFrame:
    """Upper tail of the F distribution for the one result row."""
    from barloom.functions.special import f_upper_tail

    @F.pandas_udf("double")
    def tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series([f_upper_tail(a, b, c) for a, b, c in zip(f, d1, d2)])
    return anova.withColumn("p_value", tail("f_statistic", F.col("df_between").cast("double"), F.col("df_within").cast("double")))


def effect_sizes(moments: DataFrame) -> DataFrame:
    """Cohen's d of every pair of groups, from their moments."""
    a, b = moments.alias("a"), moments.alias("b")
    j = a.join(F.broadcast(b), F.col("a.name") < F.col("b.name"))  # one row per strategy on both sides
    pooled = F.sqrt(((F.col("a.n") - 1) * F.col("a.var") + (F.col("b.n") - 1) * F.col("b.var")) / (F.col("a.n") + F.col("b.n") - 2))
    d = F.when(pooled > 0, (F.col("a.mean") - F.col("b.mean")) / pooled).otherwise(0.0)
    size = F.abs(F.col("cohens_d"))
    return j.select(F.col("a.name").alias("left"), F.col("b.name").alias("right"), d.alias("cohens_d")).withColumn(
        "effect", F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large"))


def value_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, value, n): duplicates collapse before anything is ordered."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")
    return long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def ks_pairs(df: DataFrame, names: Sequence[str], rows: int = 500_000) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of every pair of vectors.

    All empirical distribution functions advance together over the distinct values,
    which are cut into value ranges so that no task orders all of them."""
    counts = value_counts(df, names).groupBy("value").agg(*[
        F.coalesce(F.sum(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(n) for n in names])
    counts = cut(counts)
    total = counts.agg(*[F.sum(n).alias(f"_n_{n}") for n in names])
    # the broadcast side is one row
    placed = sliced(counts, "value", rows=rows).transform(attach, total).withColumn("_all", F.lit(1))
    seen = running(placed, ["_all"], ["_slice"], ["value"], {f"_c_{n}": ("sum", F.col(n)) for n in names})
    pairs = list(combinations(names, 2))
    gaps = seen.agg(*[F.max(F.abs(F.col(f"_c_{a}") / F.col(f"_n_{a}") - F.col(f"_c_{b}") / F.col(f"_n_{b}"))).alias(f"{a}__{b}") for a, b in pairs],
                    *[F.max(f"_n_{n}").alias(f"_n_{n}") for n in names])
    rows = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{a}__{b}").alias("ks"),
                              F.col(f"_n_{a}").alias("n1"), F.col(f"_n_{b}").alias("n2")) for a, b in pairs])
    out = gaps.select(F.explode(rows).alias("x")).select("x.*")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    lam = F.col("ks") * F.sqrt(n1 * n2 / (n1 + n2))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.pow(F.lit(-1.0), k - 1) * F.exp(-2 * k * k * lam * lam))
    return out.withColumn("p_value", F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series))))


def pair_correlations(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every pair on pairwise complete rows, in one aggregation."""
    pairs = list(combinations(names, 2))
    aggs = [F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    ns = [F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n{i}") for i, (a, b) in enumerate(pairs)]
    one = df.groupBy(*keys).agg(*aggs, *ns)
    rows = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{i}").alias("corr"), F.col(f"n{i}").alias("n_rows")) for i, (a, b) in enumerate(pairs)])
    return one.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")


def asset_pairs(bars: DataFrame, window: int = 672) -> DataFrame:
    """(left, right, corr, n_rows) of the returns of all pairs of symbols over each symbol's last ``window`` bars.
    ``bars`` carries bar_idx and ret. Symbols come from the data; rows meet on their time, so a pair costs at most ``window`` of them."""
    last = bars.groupBy(*SERIES).agg(F.max("bar_idx").alias("_last"))
    recent = bars.join(last, SERIES).where((F.col("bar_idx") > F.col("_last") - window) & F.col("ret").isNotNull())
    one = cut(recent.groupBy("symbol", "ts_s").agg(F.max("ret").alias("ret")))
    a = one.select("ts_s", F.col("symbol").alias("left"), F.col("ret").alias("_a"))
    b = one.select("ts_s", F.col("symbol").alias("right"), F.col("ret").alias("_b"))
    return a.join(b, "ts_s").where("left < right").groupBy("left", "right").agg(F.corr("_a", "_b").alias("corr"), F.count(F.lit(1)).alias("n_rows"))


def diversification(pairs: DataFrame) -> DataFrame:
    spread = 1 - F.avg(F.abs("corr"))
    out = pairs.where(F.col("corr").isNotNull()).agg(
        F.avg("corr").alias("avg_corr"), F.max("corr").alias("max_corr"), F.min("corr").alias("min_corr"), spread.alias("diversification"))
    r = F.col("diversification")
    return out.withColumn("label", F.when(r >= 0.7, "excellent").when(r >= 0.5, "good").when(r >= 0.3, "moderate").otherwise("poor"))


def effective_weights(pairs: DataFrame, scores: DataFrame, weights: Sequence[tuple[str, float]] | None = None) -> DataFrame:
    """Per asset: effective weight, contribution to the portfolio score, portfolio score.
    ``scores``: (symbol, score). Assets without correlations count fully. ``weights`` of the
    portfolio are normalised to sum 1 over the assets present; by default all are equal."""
    both = pairs.where(F.col("corr").isNotNull()).select(F.explode(F.array("left", "right")).alias("symbol"), "corr")
    eff = both.groupBy("symbol").agg((1 / (1 + F.count(F.lit(1)) * F.avg(F.abs("corr")))).alias("effective_weight"))
    s = scores.join(eff, "symbol", "left").withColumn("effective_weight", F.coalesce("effective_weight", F.lit(1.0)))
    given = F.lit(1.0) if weights is None else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in weights for x in pair]), F.col("symbol")), F.lit(0.0))
    s = s.withColumn("_w", given)
    s = s.transform(attach, s.agg(F.sum("_w").alias("_n"))).withColumn("contribution", F.col("score") * F.col("effective_weight") * F.col("_w") / F.col("_n"))
    total = s.agg(F.sum("contribution").alias("portfolio_score"))
    return s.transform(attach, total).drop("_n", "_w")


def drift(df: DataFrame, features: Sequence[str], is_train: Column, outlier: float = 3.0) -> DataFrame:
    """Per feature: training moments, shift of the other part in sigmas, severity, share beyond ``outlier`` sigmas."""
    long = df.withColumn("_t", is_train).select("_t", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("_t", "x.*")
    train = long.where("_t").groupBy("feature").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sigma"))
    j = long.join(F.broadcast(train), "feature")  # one row per feature
    z = ratio(F.col("v") - F.col("mu"), "sigma")
    out = j.groupBy("feature", "mu", "sigma").agg(
        F.avg(F.when(~F.col("_t"), F.col("v"))).alias("mean_now"), F.avg(F.when(~F.col("_t"), (F.abs(z) > outlier).cast("double"))).alias("outlier_share"),
        F.max(F.when(~F.col("_t"), F.abs(z))).alias("max_sigma"))
    shift = ratio(F.col("mean_now") - F.col("mu"), "sigma")
    a = F.abs(F.col("shift"))
    return out.withColumn("shift", shift).withColumns({
        "severity": F.when(a < 1, "OK").when(a < 2, "MILD").when(a < 3, "MODERATE").when(a < 5, "SEVERE").otherwise("CRITICAL"),
        "scale_problem": F.when(F.col("mu") > 10, "ABSOLUTE").when(F.col("max_sigma") > 1000, "HUGE").otherwise("OK")})


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per bin, the last bin closed."""
    i = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(lo, hi)).groupBy(*keys, i.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def divergences(hist: DataFrame, p: str, q: str, bins: int) -> DataFrame:
    """KL(p||q), KL(q||p) and Jensen-Shannon from two histograms (columns of counts per bin), one pseudo count per bin."""
    t = hist.agg(F.sum(F.col(p)).alias("_tp"), F.sum(F.col(q)).alias("_tq"))
    h = hist.transform(attach, t)
    pp, qq = (F.col(p) + 1) / (F.col("_tp") + bins), (F.col(q) + 1) / (F.col("_tq") + bins)
    m = (pp + qq) / 2
    return h.agg(F.sum(pp * F.log(pp / qq)).alias("kl_pq"), F.sum(qq * F.log(qq / pp)).alias("kl_qp"),
                 F.sum((pp * F.log(pp / m) + qq * F.log(qq / m)) / 2).alias("js"))


def average_ranks_auc(df: DataFrame, score: str, label: str, rows: int = 500_000) -> DataFrame:
    """ROC AUC by average ranks: scores collapse to distinct values before they are ordered."""
    counts = cut(df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")))
    placed = sliced(counts, "s", rows=rows).withColumn("_all", F.lit(1))
    seen = running(placed, ["_all"], ["_slice"], ["s"], {"upto": ("sum", F.col("n"))})
    rank = F.col("upto") - (F.col("n") - 1) / 2.0
    t = seen.agg(F.sum(rank * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return t.select(ratio(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"), F.col("p").alias("positives"), F.col("q").alias("negatives"))


def best_f1(df: DataFrame, score: str, label: str, rows: int = 500_000) -> DataFrame:
    """Threshold with the best F1 over the distinct scores (predict 1 at or above it)."""
    counts = cut(df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")))
    totals = counts.agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n"))  # one row
    placed = sliced(counts, "s", rows=rows).transform(attach, totals).withColumn("_all", F.lit(1))
    seen = running(placed, ["_all"], ["_slice"], ["s"], {"_cp": ("sum", F.col("pos")), "_cn": ("sum", F.col("n"))})
    tp, flagged = F.col("_p") - F.col("_cp") + F.col("pos"), F.col("_n") - F.col("_cn") + F.col("n")
    pr, rc = tp / flagged, tp / F.col("_p")
    scored = seen.select("s", pr.alias("precision"), rc.alias("recall"), (2 * pr * rc / (pr + rc + 1e-8)).alias("f1"))
    return scored.agg(F.max_by(F.struct("s", "precision", "recall", "f1"), F.struct("f1", (-F.col("s")).alias("t"))).alias("b")).select(
        F.col("b.s").alias("threshold"), "b.precision", "b.recall", "b.f1")


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """Precision, recall and F1 per class from one aggregation."""
    y, p = F.col(label), F.col(pred)
    one = df.agg(*[a.alias(f"{k}{c}") for c in classes for k, a in (
        ("tp", F.count_if((y == c) & (p == c))), ("pp", F.count_if(p == c)), ("ap", F.count_if(y == c)))])
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"tp{c}").alias("tp"), F.col(f"pp{c}").alias("pp"), F.col(f"ap{c}").alias("ap")) for c in classes])
    r = one.select(F.explode(rows).alias("x")).select("x.*")
    zero = F.lit(0.0)
    r = r.withColumns({"precision": F.coalesce(ratio("tp", "pp"), zero), "recall": F.coalesce(ratio("tp", "ap"), zero)})
    return r.withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)).select(
        "class", F.col("ap").alias("support"), "precision", "recall", "f1")
