"""Queries from mergeable moments: rolling out-of-distribution distance, the full risk penalty, walking-forward regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import scores as sc
from barloom.functions.columns import clip, ratio, rounded, sma
from barloom.operators import indicators as ind
from barloom.operators import moments as mo
from barloom.operators.chunks import over_chunks, running_bars
from barloom.operators.lineage import cut
from barloom.plans import scoring as so
from barloom.plans import sql as q
from barloom.plans.base import indexed_bars, shown
from barloom.plans.indicators import GARCH_SQL, RSI_STAGES, _sel, with_returns
from barloom.plans.registry import query
from barloom.schema import SERIES

c, K = F.col, so.K
#: bars of a block, blocks of the training distribution before it
BLOCK, BACK = 64, 8


def ood_sql(source: str, name: str) -> str:
    """CTEs that add md, the distance of (ret, vr) to the rows of the BACK blocks before."""
    frame = f"(PARTITION BY symbol, tf ORDER BY mb RANGE BETWEEN {BACK} PRECEDING AND 1 PRECEDING)"
    return f""",
{name}0 AS (SELECT *, bar_idx // {BLOCK} AS mb, CASE WHEN vr IS NOT NULL THEN ret END AS mx, CASE WHEN ret IS NOT NULL THEN vr END AS my FROM {source}),
{name}1 AS (SELECT *, count(mx) OVER {frame} AS mn, avg(mx) OVER {frame} AS ax, avg(my) OVER {frame} AS ay, var_samp(mx) OVER {frame} + 1e-6 AS vx, var_samp(my) OVER {frame} + 1e-6 AS vy, covar_samp(mx, my) OVER {frame} AS cxy FROM {name}0),
{name} AS (SELECT *, CASE WHEN mn >= 2 THEN sqrt((vy * pow(ret - ax, 2) - 2 * cxy * (ret - ax) * (vr - ay) + vx * pow(vr - ay, 2)) / (vx * vy - cxy * cxy)) END AS md FROM {name}1)"""


VR_SQL = q.with_stages(RSI_STAGES, ("m0", "avgs", f"{q.pct('close')} AS ret, volume / nullif({q.sma('volume', 20)}, 0) AS vr")) + ood_sql("m0", "ood")


def with_state(d, w):
    return with_returns(d, w).withColumn("vr", ratio("volume", sma("volume", 20, w)))


def distances(spark, base):
    """Distance of each bar's return and volume ratio to the 512 bars before its block."""
    df = over_chunks(indexed_bars(spark, base), with_state, before=64).withColumn("block", F.floor(c("bar_idx") / BLOCK))
    return mo.with_rolling_distance(cut(df.select(*SERIES, "bar_idx", "block", "ret", "vr")), SERIES, "block", ["ret", "vr"], BACK)


@query("rolling_mahalanobis", "W31", _sel(VR_SQL, {"distance": "md"}, "ood", places={"distance": 4}).replace("\nSELECT", "\nSELECT CASE WHEN md / 3.0 > 2 THEN 1 ELSE 0 END AS ood,", 1))
def _(spark, base):
    df = distances(spark, base)
    return shown(df.withColumn("ood", F.when(c("distance") / 3.0 > 2, 1).otherwise(0)), "ood", "distance", places={"distance": 4})


FULL_SQL = GARCH_SQL + f""",
k0 AS (SELECT *, {q.TR}, volume / nullif({q.sma('volume', 20)}, 0) AS vr, max(close) OVER {q.past()} AS pk, quantile_cont(ret, 0.05) OVER {q.frame(-100)} AS var5 FROM gv),
k1 AS (SELECT *, {q.sma('tr', 14)} AS atr FROM k0)""" + ood_sql("k1", "k2") + f""",
cv AS (SELECT a.symbol, a.tf, a.bar_idx, abs(avg(b.ret)) AS cvar FROM k2 a JOIN k2 b ON a.symbol = b.symbol AND a.tf = b.tf AND b.bar_idx BETWEEN a.bar_idx - 100 AND a.bar_idx AND b.ret <= a.var5 GROUP BY ALL),
fr AS (SELECT k2.*, CASE WHEN ret > 0 THEN 1.0 ELSE 1.5 END AS m, cvar AS r_tail, 5 * CASE WHEN atr = 0 THEN 0 ELSE (high - low) * 0.1 / atr END AS r_liq, coalesce(md / 3.0, 0) AS r_ood,
  CASE WHEN pk - close <= 0 THEN 0 ELSE exp(5 * (pk - close) / pk / 0.15) - 1 END AS r_dd FROM k2 JOIN cv USING ({K}) WHERE atr IS NOT NULL)"""


def risk_frame(spark, base):
    """All five risk parts from the bars: GARCH volatility, tail, a tenth of the bar's range against ATR as spread, distance to the bars before, drawdown."""
    def cols(d, w):
        d = ind.add_atr(ind.add_garch(with_state(d, w)), w)
        span = w.rowsBetween(-100, 0)
        d = d.withColumns({"_v5": F.percentile("ret", F.lit(0.05)).over(span), "_rs": F.collect_list("ret").over(span)})
        tail = F.filter("_rs", lambda x: x <= c("_v5"))
        mean = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail)
        return d.withColumn("_cvar", F.when(F.size("_rs") > 0, mean)).drop("_rs")
    df = running_bars(over_chunks(indexed_bars(spark, base), cols), {"_peak": ("max", c("close"))}).withColumn("block", F.floor(c("bar_idx") / BLOCK))
    df = cut(df.select(*SERIES, "bar_idx", "block", "close", "high", "low", "ret", "vr", "atr", "garch_var", "_cvar", "_peak"))
    df = mo.with_rolling_distance(df, SERIES, "block", ["ret", "vr"], BACK).where("_cvar IS NOT NULL AND atr IS NOT NULL")
    regime = F.when(c("ret") > 0, "BULL").otherwise("BEAR")
    return df.withColumns(sc.total_risk(c("garch_var"), c("_cvar"), (c("high") - c("low")) * 0.1, c("atr"), c("distance"), (c("_peak") - c("close")) / c("_peak"), regime))


@query("full_risk_penalty", "F11 W31 W30", _sel(FULL_SQL, {
    "r_vol": "10 * sqrt(v) * m", "r_tail": "r_tail", "r_liq": "r_liq", "r_ood": "r_ood", "log_r_dd": "ln(1 + r_dd)", "log_risk": "ln(1 + (0.3 * 10 * sqrt(v) * m + 0.2 * r_tail + 0.2 * r_liq + 0.15 * r_ood + 0.15 * r_dd) * m)"}, "fr", places={"r_ood": 4}))
def _(spark, base):
    df = risk_frame(spark, base)
    return shown(df.withColumns({"log_r_dd": F.log1p("r_dd"), "log_risk": F.log1p("risk")}), "r_vol", "r_tail", "r_liq", "r_ood", "log_r_dd", "log_risk", places={"r_ood": 4})


WF_BLOCK, WF_TRAIN, WF_TEST, WF_STEP = 50, 10, 3, 4
WALK_SQL = q.with_stages(RSI_STAGES, ("w0", "avgs", f"{q.rsi()} / 100 AS x1, {q.pct('close')} AS r0, lead(close) OVER ({q.SER} ORDER BY bar_idx) / close - 1 AS r1")) + f""",
w1 AS (SELECT symbol, tf, bar_idx // {WF_BLOCK} AS b, x1, least(greatest(r0, -1), 1) AS x2, least(greatest(r1, -1), 1) AS y FROM w0 WHERE x1 IS NOT NULL AND r0 IS NOT NULL AND r1 IS NOT NULL),
fold AS (SELECT symbol, tf, unnest(range(max(b) // {WF_STEP} + 1)) AS fold FROM w1 GROUP BY symbol, tf),
tr AS (SELECT f.symbol, f.tf, fold, count(*)::DOUBLE AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x1 * x1) + 1 AS q11, sum(x1 * x2) AS q12, sum(x2 * x2) + 1 AS q22, sum(y) AS t0, sum(x1 * y) AS t1, sum(x2 * y) AS t2
  FROM fold f JOIN w1 w ON w.symbol = f.symbol AND w.tf = f.tf AND b >= fold * {WF_STEP} AND b < fold * {WF_STEP} + {WF_TRAIN} GROUP BY ALL),
det AS (SELECT *, n * (q11 * q22 - q12 * q12) - s1 * (s1 * q22 - q12 * s2) + s2 * (s1 * q12 - q11 * s2) AS d FROM tr),
fit AS (SELECT *, (t0 * (q11 * q22 - q12 * q12) - s1 * (t1 * q22 - q12 * t2) + s2 * (t1 * q12 - q11 * t2)) / d AS w0, (n * (t1 * q22 - q12 * t2) - t0 * (s1 * q22 - q12 * s2) + s2 * (s1 * t2 - t1 * s2)) / d AS w1,
  (n * (q11 * t2 - t1 * q12) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * q12 - q11 * s2)) / d AS w2 FROM det),
te AS (SELECT f.symbol, f.tf, f.fold, count(*) AS n_test, avg(pow(y - f.w0 - f.w1 * x1 - f.w2 * x2, 2)) AS mse FROM fit f JOIN w1 w ON w.symbol = f.symbol AND w.tf = f.tf AND b >= fold * {WF_STEP} + {WF_TRAIN} AND b < fold * {WF_STEP} + {WF_TRAIN + WF_TEST} GROUP BY ALL)"""


@query("walk_forward_fits", "L16 M4", WALK_SQL + f""" SELECT fit.symbol, fit.tf, fold, n::BIGINT AS n_train, coalesce(n_test, 0)::BIGINT AS n_test, {q.r('w0', 5)} AS intercept, {q.r('w1', 5)} AS w_rsi, {q.r('w2', 5)} AS w_ret, {q.r('mse', 5)} AS mse FROM fit LEFT JOIN te USING (symbol, tf, fold)""")
def _(spark, base):
    """Regression of the next return on RSI and return, trained on 500 bars, tested on the 150 after, every 200 bars, for all series and folds from one pass over bars."""
    def cols(d, w):
        d = with_returns(ind.add_rsi(d, w), w)
        return d.withColumns({"x1": c("rsi") / 100, "x2": clip("ret", -1, 1), "y": clip(ratio(F.lead("close", 1).over(w), "close") - 1, -1, 1)})
    df = over_chunks(indexed_bars(spark, base), cols, before=64, after=2).withColumn("block", F.floor(c("bar_idx") / WF_BLOCK))
    fits = mo.fold_fits(cut(mo.block_moments(df, SERIES, "block", ["x1", "x2", "y"])), SERIES, "block", 3, WF_TRAIN, WF_TEST, WF_STEP)
    return shown(fits.withColumns({"w_rsi": c("weights")[0], "w_ret": c("weights")[1]}), "n_train", "n_test", "intercept", "w_rsi", "w_ret", "mse", keys=[*SERIES, "fold"], places=5)
