"""Dispersion, drift, correlation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import pct_change, ratio, rolling_std, rounded
from barloom.operators import stats
from barloom.operators.bars import ohlcv
from barloom.operators.chunks import over_chunks, with_bar_index
from barloom.operators.lineage import attach, cut
from barloom.operators.quality import drop_non_finite, finite
from barloom.operators.quantiles import exact_quantiles, quantile_columns
from barloom.plans import sql as q
from barloom.plans.base import indexed_bars, shown
from barloom.plans.registry import query
from barloom.plans.scoring import HYB, hybrid_frame
from barloom.schema import SERIES
from barloom.sources.tables import event_ticks, read_table

c = F.col
VEC = ["p_rb", "p_ml", "p_hyb"]
AL = HYB + """, al AS (SELECT symbol, tf, bar_idx, ts_s, p_rb, p_ml, alpha * p_rb + beta * p_ml + 0.95 * CASE WHEN crisis > 0.5 THEN 0.01 ELSE 0.05 END AS p_hyb, rsi, vol50, volume FROM y6)"""
LONG = AL + """, lg AS (SELECT 'p_rb' AS name, round(p_rb, 9) AS v FROM al UNION ALL SELECT 'p_ml', round(p_ml, 9) FROM al UNION ALL SELECT 'p_hyb', round(p_hyb, 9) FROM al),
mo AS (SELECT name, count(v) AS n, avg(v) AS mean, var_samp(v) AS var FROM lg GROUP BY name)"""


def vectors(spark, base):
    """Aligned scores of three strategies, to nine places so that equal scores tie."""
    df = stats.aligned(hybrid_frame(spark, base), VEC)
    return df.withColumns({v: F.round(v, 9) for v in VEC})


@query("anova", "D1 D4 D6 D12", LONG + f""", t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * mean * mean) - pow(sum(n * mean), 2) / sum(n) AS ssb, sum((n - 1) * var) AS ssw FROM mo)
SELECT n::BIGINT AS n, k, {q.r('(ssb / (k - 1)) / (ssw / (n - k))', 4)} AS f_statistic, {q.r('ssb / (ssb + ssw)')} AS eta_squared, {q.r('ssb / (k - 1)')} AS var_between, {q.r('ssw / (n - k)')} AS var_within,
 {q.r('(ssb + ssw) / (n - 1)')} AS var_total, CASE WHEN ssb / (ssb + ssw) < 0.01 THEN 'negligible' WHEN ssb / (ssb + ssw) < 0.06 THEN 'small' WHEN ssb / (ssb + ssw) < 0.14 THEN 'medium' ELSE 'large' END AS effect FROM t""")
def _(spark, base):
    t = stats.variance_decomposition(stats.group_moments(vectors(spark, base), VEC))
    return t.select("n", "k", rounded("f_statistic", 4).alias("f_statistic"), *[rounded(x).alias(x) for x in ("eta_squared", "var_between", "var_within", "var_total")], "effect")


@query("anova_p_value", "D1")
def _(spark, base):
    t = stats.variance_decomposition(stats.group_moments(vectors(spark, base), VEC))
    return stats.with_f_pvalue(t).select("f_statistic", "df_between", "df_within", "p_value")


@query("effect_sizes", "D5 J7", LONG + f""" SELECT a.name AS "left", b.name AS "right", {q.r('(a.mean - b.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2))')} AS cohens_d FROM mo a JOIN mo b ON a.name < b.name""")
def _(spark, base):
    e = stats.effect_sizes(stats.group_moments(vectors(spark, base), VEC))
    return e.select("left", "right", rounded("cohens_d").alias("cohens_d"))


@query("ks_pairs", "D2", LONG + f""", vv AS (SELECT v, count(*) FILTER (name = 'p_rb') AS a, count(*) FILTER (name = 'p_ml') AS b, count(*) FILTER (name = 'p_hyb') AS c FROM lg GROUP BY v),
cu AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb, sum(c) OVER (ORDER BY v) / sum(c) OVER () AS fc FROM vv)
SELECT 'p_rb' AS "left", 'p_ml' AS "right", {q.r('max(abs(fa - fb))')} AS ks FROM cu UNION ALL SELECT 'p_rb', 'p_hyb', {q.r('max(abs(fa - fc))')} FROM cu UNION ALL SELECT 'p_ml', 'p_hyb', {q.r('max(abs(fb - fc))')} FROM cu""")
def _(spark, base):
    return stats.ks_pairs(vectors(spark, base), VEC).select("left", "right", rounded("ks").alias("ks"))


@query("score_correlations", "D3", AL + f""" SELECT 'p_rb' AS "left", 'p_ml' AS "right", {q.r('corr(p_rb, p_ml)')} AS corr FROM al UNION ALL SELECT 'p_rb', 'p_hyb', {q.r('corr(p_rb, p_hyb)')} FROM al UNION ALL SELECT 'p_ml', 'p_hyb', {q.r('corr(p_ml, p_hyb)')} FROM al""")
def _(spark, base):
    return stats.pair_correlations(vectors(spark, base), VEC).select("left", "right", rounded("corr").alias("corr"))


@query("score_summary", "A22 D10", LONG + f""" SELECT name, count(v) AS n, {q.r('avg(v)')} AS mean, {q.r('stddev_samp(v)')} AS sd, {q.r('min(v)')} AS lo, {q.r('quantile_cont(v, 0.25)')} AS q25, {q.r('quantile_cont(v, 0.5)')} AS median, {q.r('quantile_cont(v, 0.75)')} AS q75, {q.r('max(v)')} AS hi FROM lg GROUP BY name""")
def _(spark, base):
    v = vectors(spark, base)
    long = cut(v.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c(n).alias("v")) for n in VEC])).alias("x")).select("x.*"))
    m = long.groupBy("name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    m = m.join(quantile_columns(long, ["name"], "v", {"q25": 0.25, "median": 0.5, "q75": 0.75}), "name")
    return shown(m, "n", "mean", "sd", "lo", "q25", "median", "q75", "hi", keys=["name"])


@query("score_histogram", "A20 D10", AL + """ SELECT least(floor((round(p_ml, 9) - 0) / 0.1), 9)::INT AS bin, count(*) AS n, count(*) FILTER (p_rb > 0) AS on_rule FROM al WHERE round(p_ml, 9) BETWEEN 0 AND 1 GROUP BY 1""")
def _(spark, base):
    v = vectors(spark, base).where(c("p_ml").between(0.0, 1.0))
    b = F.least(F.floor(c("p_ml") / 0.1), F.lit(9)).cast("int")
    return v.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("p_rb") > 0).alias("on_rule"))


@query("divergences", "D7 A20", AL + f""", h AS (SELECT b, count(*) FILTER (k = 1) AS p, count(*) FILTER (k = 2) AS qn FROM (SELECT least(floor((round(p_rb, 9) + 1) / 0.1), 19) AS b, 1 AS k FROM al UNION ALL SELECT least(floor((round(p_hyb, 9) + 1) / 0.1), 19), 2 FROM al) GROUP BY b),
g AS (SELECT (p + 1) / (sum(p) OVER () + 20) AS p, (qn + 1) / (sum(qn) OVER () + 20) AS qq FROM h) SELECT {q.r('sum(p * ln(p / qq))')} AS kl_pq, {q.r('sum(qq * ln(qq / p))')} AS kl_qp, {q.r('sum((p * ln(p / ((p + qq) / 2)) + qq * ln(qq / ((p + qq) / 2))) / 2)')} AS js FROM g""")
def _(spark, base):
    v = vectors(spark, base).select(F.explode(F.array(F.struct(F.lit(1).alias("k"), c("p_rb").alias("v")), F.struct(F.lit(2).alias("k"), c("p_hyb").alias("v")))).alias("x")).select("x.*")
    b = F.least(F.floor((c("v") + 1) / 0.1), F.lit(19)).cast("int")
    h = cut(v.groupBy(b.alias("bin")).agg(F.count_if(c("k") == 1).alias("p"), F.count_if(c("k") == 2).alias("q")))
    return stats.divergences(h, "p", "q", 20).select(*[rounded(x).alias(x) for x in ("kl_pq", "kl_qp", "js")])


FE = ["p_rb", "p_ml", "rsi", "vol50", "volume"]
DR = AL + ", dl AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, bar_idx < 500 AS t, {f}::DOUBLE AS v FROM al" for f in FE) + f"""),
tr AS (SELECT feature, avg(v) AS mu, stddev_pop(v) AS sg FROM dl WHERE t GROUP BY feature)
SELECT feature, {q.r('mu')} AS mu, {q.r('sg')} AS sigma, {q.r('(avg(v) FILTER (NOT t) - mu) / sg')} AS shift, {q.r('avg(CASE WHEN abs((v - mu) / sg) > 3 THEN 1.0 WHEN v IS NOT NULL THEN 0 END) FILTER (NOT t)')} AS outlier_share,
 CASE WHEN abs((avg(v) FILTER (NOT t) - mu) / sg) < 1 THEN 'OK' WHEN abs((avg(v) FILTER (NOT t) - mu) / sg) < 2 THEN 'MILD' WHEN abs((avg(v) FILTER (NOT t) - mu) / sg) < 3 THEN 'MODERATE' WHEN abs((avg(v) FILTER (NOT t) - mu) / sg) < 5 THEN 'SEVERE' ELSE 'CRITICAL' END AS severity,
 CASE WHEN mu > 10 THEN 'ABSOLUTE' WHEN max(abs((v - mu) / sg)) FILTER (NOT t) > 1000 THEN 'HUGE' ELSE 'OK' END AS scale_problem FROM dl JOIN tr USING (feature) GROUP BY feature, mu, sg"""


@query("feature_drift", "D8 D9 D11", DR)
def _(spark, base):
    d = stats.drift(hybrid_frame(spark, base), FE, c("bar_idx") < 500)
    return shown(d, "mu", "sigma", "shift", "outlier_share", "severity", "scale_problem", keys=["feature"])


OUT = AL + ", tr AS (SELECT " + ", ".join(f"avg({f}) FILTER (bar_idx < 500) AS m_{f}, stddev_pop({f}) FILTER (bar_idx < 500) AS s_{f}" for f in FE) + f""" FROM al),
ob AS (SELECT symbol, tf, {' + '.join(f"CASE WHEN abs(({f} - m_{f}) / s_{f}) > 3 THEN 1 ELSE 0 END" for f in FE)} AS n3, {' + '.join(f"CASE WHEN abs(({f} - m_{f}) / s_{f}) > 5 THEN 1 ELSE 0 END" for f in FE)} AS n5 FROM al, tr)
SELECT symbol, tf, sum(n3)::BIGINT AS beyond_3, sum(n5)::BIGINT AS beyond_5, {q.r('avg(CASE WHEN n3 > 0 THEN 1.0 ELSE 0 END)')} AS ood_rows FROM ob GROUP BY symbol, tf"""


@query("row_outliers", "D9 A23", OUT)
def _(spark, base):
    df = cut(hybrid_frame(spark, base).select(*SERIES, "bar_idx", *[c(f).cast("double").alias(f) for f in FE]))
    train = F.array(*[F.struct(F.avg(F.when(c("bar_idx") < 500, c(f))).alias("m"), F.stddev_pop(F.when(c("bar_idx") < 500, c(f))).alias("s")) for f in FE])
    # a single row of training moments
    df = df.transform(attach, df.agg(train.alias("fit")))
    z = F.zip_with(F.array(*FE), "fit", lambda v, t: F.abs(F.try_divide(v - t["m"], t["s"])))
    def beyond(k):
        return F.size(F.filter("z", lambda x: x > k))
    df = df.withColumn("z", z)
    return df.groupBy(*SERIES).agg(F.sum(beyond(3)).alias("beyond_3"), F.sum(beyond(5)).alias("beyond_5"),
                                   rounded(F.avg((beyond(3) > 0).cast("double"))).alias("ood_rows"))


# ------------------------------------------------------------------ cross-asset

CO = q.bars_of(q.event_bars("1h", 3600)) + f""", rr AS (SELECT *, {q.pct('close')} AS ret FROM bars), rl AS (SELECT symbol, ts_s, ret FROM rr JOIN (SELECT symbol, max(bar_idx) AS lb FROM rr GROUP BY symbol) USING (symbol) WHERE bar_idx > lb - 672 AND ret IS NOT NULL),
pc AS (SELECT a.symbol AS l, b.symbol AS r, corr(a.ret, b.ret) AS corr, count(*) AS n_rows FROM rl a JOIN rl b ON a.ts_s = b.ts_s AND a.symbol < b.symbol GROUP BY ALL)"""


def asset_correlations(spark, base):
    bars = with_bar_index(ohlcv(event_ticks(spark, base), "1h"))
    bars = cut(over_chunks(bars, lambda d, w: d.withColumn("ret", pct_change("close", 1, w)), before=1))
    return bars, cut(stats.asset_pairs(bars))


@query("asset_correlations", "J6 J7 A27", CO + f""" SELECT l AS "left", r AS "right", {q.r('corr')} AS corr, n_rows FROM pc""")
def _(spark, base):
    return asset_correlations(spark, base)[1].select("left", "right", rounded("corr").alias("corr"), "n_rows")


@query("diversification", "A28", CO + f""" SELECT {q.r('avg(corr)')} AS avg_corr, {q.r('max(corr)')} AS max_corr, {q.r('min(corr)')} AS min_corr, {q.r('1 - avg(abs(corr))')} AS diversification,
 CASE WHEN 1 - avg(abs(corr)) >= 0.7 THEN 'excellent' WHEN 1 - avg(abs(corr)) >= 0.5 THEN 'good' WHEN 1 - avg(abs(corr)) >= 0.3 THEN 'moderate' ELSE 'poor' END AS label FROM pc""")
def _(spark, base):
    return shown(stats.diversification(asset_correlations(spark, base)[1]), "avg_corr", "max_corr", "min_corr", "diversification", "label", keys=[])


@query("portfolio_crisis", "A29 A30", CO + f""", ew AS (SELECT symbol, 1 / (1 + count(*) * avg(abs(corr))) AS e FROM (SELECT l AS symbol, corr FROM pc UNION ALL SELECT r, corr FROM pc) GROUP BY symbol),
sc AS (SELECT symbol, least(1, stddev_samp(ret) / 20) AS score FROM rr GROUP BY symbol)
SELECT symbol, {q.r('coalesce(e, 1)')} AS effective_weight, {q.r('score * coalesce(e, 1) / count(*) OVER ()')} AS contribution, {q.r('sum(score * coalesce(e, 1)) OVER () / count(*) OVER ()')} AS portfolio_score FROM sc LEFT JOIN ew USING (symbol)""")
def _(spark, base):
    bars, pairs = asset_correlations(spark, base)
    scores = bars.groupBy("symbol").agg(F.least(F.lit(1.0), F.stddev_samp("ret") / 20).alias("score"))
    return shown(stats.effective_weights(pairs, scores), "effective_weight", "contribution", "portfolio_score", keys=["symbol"])


# ------------------------------------------------------------------ fitting helpers and evaluation

@query("scaler_fit", "A23 A24 D6", AL + " " + " UNION ALL ".join(f"SELECT '{f}' AS feature, {q.r(f'avg({f})')} AS mean, {q.r(f'stddev_pop({f})')} AS scale, {q.r(f'quantile_cont({f}, 0.5)')} AS median FROM al" for f in FE))
def _(spark, base):
    df = hybrid_frame(spark, base)
    long = cut(df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), c(f).cast("double").alias("v")) for f in FE])).alias("x")).select("x.*"))
    m = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale"))
    return shown(m.join(quantile_columns(long, ["feature"], "v", {"median": 0.5}), "feature"), "mean", "scale", "median", keys=["feature"])


@query("volatility_terciles", "A26", AL + """, tq AS (SELECT quantile_cont(vol50, 0.33) AS a, quantile_cont(vol50, 0.67) AS b FROM al) SELECT symbol, tf, CASE WHEN vol50 IS NULL THEN NULL WHEN vol50 <= a THEN 0 WHEN vol50 <= b THEN 1 ELSE 2 END AS tercile, count(*) AS n FROM al, tq GROUP BY ALL""")
def _(spark, base):
    df = cut(hybrid_frame(spark, base))
    t = quantile_columns(df, [], "vol50", {"a": 0.33, "b": 0.67})
    v = c("vol50")
    df = df.transform(attach, t)  # one row of two cut points
    return df.groupBy(*SERIES, F.when(v.isNull(), None).when(v <= c("a"), 0).when(v <= c("b"), 1).otherwise(2).alias("tercile")).agg(F.count(F.lit(1)).alias("n"))


SCORE = "least(greatest(round((n_chars % 997) / 997.0 * 0.6 + quality * 0.3, 2), 0), 1)"
LAB = f"WITH y AS (SELECT d.doc_id, quality, toxic, {SCORE} AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def labelled(spark, base):
    d, l = read_table(spark, base, "documents", "doc_id", "n_chars"), read_table(spark, base, "labels")
    s = F.round((c("n_chars") % 997) / 997.0 * 0.6 + c("quality") * 0.3, 2)
    return l.join(d, "doc_id").select("doc_id", "quality", "toxic", F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)).alias("score"))


@query("binary_report", "A34 M7 J12", LAB + f""" SELECT "class", count(*) FILTER (quality = "class") AS support, {q.r('coalesce(count(*) FILTER (quality = "class" AND p = "class") / nullif(count(*) FILTER (p = "class"), 0), 0)')} AS "precision",
 {q.r('coalesce(count(*) FILTER (quality = "class" AND p = "class") / nullif(count(*) FILTER (quality = "class"), 0), 0)')} AS recall FROM (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS p FROM y), (VALUES (0), (1)) v("class") GROUP BY "class" """)
def _(spark, base):
    df = labelled(spark, base).withColumn("p", (c("score") >= 0.5).cast("int"))
    return shown(stats.class_report(df, "quality", "p", [0, 1]), "support", "precision", "recall", keys=["class"])


@query("confusion_matrix", "A34", LAB + " SELECT quality, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred, count(*) AS n FROM y GROUP BY ALL")
def _(spark, base):
    return stats.confusion(labelled(spark, base).withColumn("pred", (c("score") >= 0.5).cast("int")), "quality", "pred")


@query("roc_auc", "A35", LAB + f""", rk AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM y)
SELECT {q.r('(sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0))')} AS auc, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives FROM rk""")
def _(spark, base):
    a = stats.average_ranks_auc(labelled(spark, base), "score", "quality")
    return a.select(rounded("auc").alias("auc"), "positives", "negatives")


@query("best_f1_threshold", "O6", LAB + f""", t AS (SELECT DISTINCT score AS s FROM y), f AS (SELECT s, count(*) FILTER (score >= s AND quality = 1) / count(*) FILTER (score >= s) AS p, count(*) FILTER (score >= s AND quality = 1) / count(*) FILTER (quality = 1) AS r FROM t, y GROUP BY s)
SELECT {q.r('s')} AS threshold, {q.r('p')} AS "precision", {q.r('r')} AS recall, {q.r('2 * p * r / (p + r + 1e-8)')} AS f1 FROM f ORDER BY 2 * p * r / (p + r + 1e-8) DESC, s LIMIT 1""")
def _(spark, base):
    return shown(stats.best_f1(labelled(spark, base), "score", "quality"), "threshold", "precision", "recall", "f1", keys=[])


@query("regression_errors", "A36", LAB + f""", m AS (SELECT avg(quality) AS mu FROM y) SELECT {q.r('avg(pow(quality - score, 2))')} AS mse, {q.r('avg(abs(quality - score))')} AS mae, {q.r('1 - sum(pow(quality - score, 2)) / sum(pow(quality - mu, 2))')} AS r2 FROM y, m""")
def _(spark, base):
    e = c("quality") - c("score")
    y = labelled(spark, base)
    return y.agg(rounded(F.avg(e * e)).alias("mse"), rounded(F.avg(F.abs(e))).alias("mae"),
                 rounded(1 - F.sum(e * e) / (F.var_pop("quality") * F.count("quality"))).alias("r2"))


@query("temporal_split", "P13", """SELECT event_type, CASE WHEN ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-15' THEN 'train' WHEN ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22' THEN 'val' WHEN ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29' THEN 'test' END AS part, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def _(spark, base):
    from barloom.operators.ml import temporal_part
    ev = read_table(spark, base, "events").withColumn("part", temporal_part(c("ts").cast("timestamp"), {
        "train": ("2024-01-01", "2024-01-15"), "val": ("2024-01-15", "2024-01-22"), "test": ("2024-01-22", "2024-01-29")}))
    return ev.groupBy("event_type", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("finite_rows", "P14 P15", AL + f""" SELECT symbol, tf, count(*) AS kept, {q.r('sum(least(greatest(coalesce(vol50, 0), -10), 10))', 4)} AS capped FROM al WHERE vol50 IS NOT NULL AND rsi IS NOT NULL GROUP BY symbol, tf""")
def _(spark, base):
    from barloom.functions.columns import clip
    df = drop_non_finite(cut(hybrid_frame(spark, base)), ["vol50", "rsi"], max_bad_ratio=0.5)
    return df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("kept"), rounded(F.sum(clip(F.coalesce("vol50", F.lit(0.0)), -10, 10)), 4).alias("capped"))
