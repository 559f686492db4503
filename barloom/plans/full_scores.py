"""Scores with all their parts: liquidity from each bar's book, rule and model scores with gates, costs and risk."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barloom.functions import scores as sc
from barloom.functions.columns import clip, flag, rolling_std, rounded, sma
from barloom.operators.leading import leading
from barloom.operators.lineage import cut
from barloom.plans import moments as mm
from barloom.plans import scoring as so
from barloom.plans import signals as sg
from barloom.plans import sql as q
from barloom.plans.base import indexed_bars, shown
from barloom.plans.registry import query
from barloom.schema import SERIES
from barloom.sources.tables import event_ticks, line_ticks

c, K = F.col, so.K
#: levels of a book's side
LEVELS = 10


def bar_books(spark, base):
    """symbol, tf, ts_s, bids, asks: the ticks of a bar as offers around its middle price, those below it bids, the others asks, the ten best of each side.

    Each task first drops the ticks that are not among the ten best of its own, in blocks of bounded size, so a bar with any number of ticks is ten rows a
    side and task before anything is sorted or shuffled."""
    hour = (event_ticks(spark, base), "1h", 3600)
    day = (line_ticks(spark, base), "1d", 86400)
    ticks = None
    for source, tf, step in (hour, day):
        part = source.select("symbol", F.lit(tf).alias("tf"), (F.floor(c("us") / (step * 1_000_000)) * step).cast("long").alias("ts_s"), "price", c("size").cast("double").alias("size"))
        ticks = part if ticks is None else ticks.unionByName(part)
    mids = ticks.groupBy(*SERIES, "ts_s").agg(((F.max("price") + F.min("price")) / 2).alias("mid"))
    sided = ticks.join(mids, [*SERIES, "ts_s"]).withColumn("bid", c("price") < c("mid"))
    sided = sided.withColumns({"best": F.when(c("bid"), -c("price")).otherwise(c("price")), "less": -c("size")})
    few = leading(sided, [*SERIES, "ts_s", "bid"], ["best", "less"], LEVELS)
    place = Window.partitionBy(*SERIES, "ts_s", "bid").orderBy("best", "less")
    top = few.withColumn("lvl", F.row_number().over(place)).where(c("lvl") <= LEVELS)
    top = top.withColumns({"price": F.when(c("bid"), -c("best")).otherwise(c("best")), "size": -c("less")})
    level = F.struct("lvl", "price", "size")
    return top.groupBy(*SERIES, "ts_s").agg(
        F.sort_array(F.collect_list(F.when(c("bid"), level))).alias("bids"), F.sort_array(F.collect_list(F.when(~c("bid"), level))).alias("asks"))


BOOK = f"""
tk AS (SELECT event_type AS symbol, '1h' AS tf, (epoch_us(ts) // 3600000000) * 3600 AS ts_s, value AS price, 1.0 AS size FROM events
  UNION ALL SELECT l_returnflag || l_linestatus, '1d', (epoch_us(l_shipdate) // 86400000000) * 86400, l_extendedprice / l_quantity, l_quantity FROM lineitem),
tm AS (SELECT *, (max(price) OVER w + min(price) OVER w) / 2 AS mid FROM tk WINDOW w AS (PARTITION BY symbol, tf, ts_s)),
tl AS (SELECT *, price < mid AS bid, row_number() OVER (PARTITION BY symbol, tf, ts_s, price < mid ORDER BY CASE WHEN price < mid THEN -price ELSE price END, -size) AS lvl FROM tm),
bk AS (SELECT symbol, tf, ts_s, max(price) FILTER (bid) AS b, min(price) FILTER (NOT bid) AS a, coalesce(sum(size) FILTER (bid), 0) AS bd, coalesce(sum(size) FILTER (NOT bid), 0) AS ad FROM tl WHERE lvl <= {LEVELS} GROUP BY ALL),
bl AS (SELECT symbol, tf, ts_s, CASE WHEN b IS NULL OR a IS NULL THEN 0 ELSE least(greatest(0.4 * (1 - tanh(100 * CASE WHEN (a + b) / 2 > 0 THEN (a - b) / ((a + b) / 2) ELSE 1 END)) + 0.4 * least(1, (bd + ad) / 10) + 0.2 * (1 - abs((bd - ad) / (bd + ad))), 0), 1) END AS liquidity FROM bk)"""
OPP_SQL = f"""WITH base AS ({so.BASE} SELECT * FROM s2), {BOOK},
lq AS (SELECT base.*, coalesce(lag(liquidity) OVER ({q.SER} ORDER BY bar_idx), 0) AS w_liq FROM base JOIN bl USING (symbol, tf, ts_s)),
op AS (SELECT *, CASE WHEN sigma IS NOT NULL THEN {so.OPP['w_vol']} END AS w_vol, {so.OPP['w_micro']} AS w_micro FROM lq),
opp AS (SELECT *, CASE WHEN w_vol IS NOT NULL THEN least(greatest(0.4 * w_vol + 0.35 * w_liq + 0.25 * w_micro, 0), 1) END AS w FROM op)"""


def opportunity_frame(spark, base, extra=lambda d, w: d):
    """Bars with the three opportunity parts and their weighted sum; liquidity is that of the bar before, 0 for the first one."""
    bars = cut(so.base_frame(spark, base, extra))
    books = bar_books(spark, base).withColumn("liquidity", sc.liquidity_opportunity(c("bids"), c("asks"))).drop("bids", "asks")
    before = bars.select(*SERIES, "ts_s", (c("bar_idx") + 1).alias("bar_idx")).join(books, [*SERIES, "ts_s"]).drop("ts_s")
    df = bars.join(before, [*SERIES, "bar_idx"], "left")
    regime = F.when(c("atr_pct") < 0.5, "low_vol").when(c("atr_pct") > 2, "high_vol").otherwise("normal")
    df = df.withColumns({"w_vol": sc.volatility_opportunity(c("sigma") / 1000, regime, F.lit(0.1)), "w_liq": F.coalesce("liquidity", F.lit(0.0)),
                         "w_micro": sc.microstructure(c("ac"), c("volume"), c("v14"))})
    return df.withColumn("w", sc.weighted_opportunity(c("w_vol"), c("w_liq"), c("w_micro")))


@query("opportunity_full", "F5 F2 F3 F4", OPP_SQL + f" SELECT {K}, " + ", ".join(f"{q.r(x)} AS {x}" for x in ("w_vol", "w_liq", "w_micro", "w")) + " FROM opp")
def _(spark, base):
    """Volatility, liquidity and microstructure parts of every bar and their weighted sum."""
    return shown(opportunity_frame(spark, base), "w_vol", "w_liq", "w_micro", "w")


def signed_log(x):
    """Keeps the sign and the order; risk parts grow exponentially with drawdown."""
    return F.signum(x) * F.log1p(F.abs(x))


RULE_SQL = OPP_SQL + f""",
f0 AS (SELECT *, {q.sma('close', 20)} AS mid, {q.std('close', 20)} AS sd FROM opp),
f1 AS (SELECT *, CASE WHEN bar_idx >= 49 AND rsi > 20 AND rsi < 80 AND close > e9 AND volume > v14 AND (close - mid + 2 * sd) / nullif(4 * sd, 0) > 0.25 AND (close - mid + 2 * sd) / nullif(4 * sd, 0) < 0.75 THEN 1 ELSE 0 END AS prod FROM f0),
rk AS ({mm.FULL_SQL} SELECT {K}, (0.3 * 10 * sqrt(v) * m + 0.2 * r_tail + 0.2 * r_liq + 0.15 * r_ood + 0.15 * r_dd) * m AS risk FROM fr),
rb AS (SELECT *, CASE WHEN prod = 0 THEN 0 ELSE coalesce(w, 0) END - 0.0015 - coalesce(risk, 0.1) AS p FROM f1 LEFT JOIN rk USING ({K}))"""


@query("rule_scores_full", "F12 F5 F11", RULE_SQL + f""" SELECT {K}, prod AS filters, {q.r('sign(p) * ln(1 + abs(p))', 4)} AS log_p_rb, CASE WHEN p > 0.05 THEN 1 ELSE 0 END AS signal,
 {q.r('CASE WHEN prod = 0 THEN 0 ELSE coalesce(w, 0) END - 0.0015')} AS before_risk FROM rb""")
def _(spark, base):
    """P_rb = W * product of the four filters - costs - risk. Before 50 bars the filters are 0; a bar without a known risk counts the default of 0.1."""
    def bands(d, w):
        return d.withColumns({"_mid": sma("close", 20, w), "_sd": rolling_std("close", 20, w)})
    df = opportunity_frame(spark, base, bands)
    place = (c("close") - c("_mid") + 2 * c("_sd")) / F.nullif(4 * c("_sd"), F.lit(0.0))
    passed = (c("bar_idx") >= 49) & (c("rsi") > 20) & (c("rsi") < 80) & (c("close") > c("e9")) & (c("volume") > c("v14")) & (place > 0.25) & (place < 0.75)
    risk = mm.risk_frame(spark, base).select(*SERIES, "bar_idx", "risk")
    df = df.withColumn("filters", F.coalesce(passed, F.lit(False)).cast("int")).join(risk, [*SERIES, "bar_idx"], "left")
    df = df.withColumn("before_risk", c("filters") * F.coalesce("w", F.lit(0.0)) - sc.round_trip_cost() / 2)
    p = c("before_risk") - F.coalesce("risk", F.lit(0.1))
    return shown(df.withColumns({"log_p_rb": signed_log(p), "signal": flag(p > 0.05)}), "filters", "log_p_rb", "signal", "before_risk", places={"log_p_rb": 4})


# How much of a model score a regime leaves.
REGIME_SHARE = {"bull": 1.0, "bear": 0.5, "sideways": 0.75}
MODEL_SQL = f"""WITH g AS ({sg.GATE_SQL} SELECT {K}, sma_regime, crisis, gate, least(greatest(1 / (1 + exp(-5 * (abs(pctile - 0.5) - 0.3))), 0.3), 0.7) AS p, coalesce(vol50, 0.02) AS vol FROM g3),
o AS ({mm.VR_SQL} SELECT {K}, md FROM ood),
pm AS (SELECT g.*, least(greatest(coalesce(md / 3.0, 0), 0), 10) AS r_ood, p * gate - 0.0015 * (1 + 2 * vol) - least(greatest(coalesce(md / 3.0, 0), 0), 10) AS p_ml,
  p * CASE sma_regime WHEN 'bull' THEN 1.0 WHEN 'bear' THEN 0.5 WHEN 'sideways' THEN 0.75 ELSE 1 END * CASE WHEN crisis < 0.7 THEN 1 ELSE 0 END - 0.0015 - CASE WHEN vol > 0.03 THEN 0.1 ELSE 0 END AS scaled FROM g JOIN o USING ({K}))"""


@query("model_scores_full", "F13 F14 W31 P8", MODEL_SQL + f""" SELECT {K}, gate, {q.r('r_ood', 4)} AS r_ood, {q.r('p_ml', 4)} AS p_ml, CASE WHEN p_ml > 0 THEN 1 ELSE 0 END AS signal,
 {q.r('CASE WHEN gate = 1 THEN p ELSE 0 END')} AS p_gated, CASE WHEN gate = 1 AND p >= 0.5 THEN 1 ELSE 0 END AS signal_gated, {q.r('scaled')} AS p_scaled, CASE WHEN scaled >= 0.3 THEN 1 ELSE 0 END AS signal_scaled FROM pm""")
def _(spark, base):
    """The three forms of the model score: p * gates - adaptive cost - out-of-distribution risk; p behind the gates; p scaled by regime less cost and volatility penalty."""
    risk = mm.distances(spark, base).select(*SERIES, "bar_idx", clip(F.coalesce(c("distance") / 3.0, F.lit(0.0)), 0, 10).alias("r_ood"))
    df = sg.gated(spark, base).join(risk, [*SERIES, "bar_idx"]).withColumns({"p": sc.heuristic_probability(c("pctile")), "vol": F.coalesce("vol50", F.lit(0.02))})
    share = sc.by_key(REGIME_SHARE, F.when(c("regime") == "normal", "sideways").otherwise(c("regime")), 1.0)
    df = df.withColumns({
        "p_ml": c("p") * c("gate") - sc.adaptive_cost(c("vol")) - c("r_ood"), "p_gated": F.when(c("gate") == 1, c("p")).otherwise(0.0),
        "p_scaled": c("p") * share * flag(c("crisis") < 0.7) - 0.0015 - F.when(c("vol") > 0.03, 0.1).otherwise(0.0)})
    df = df.withColumns({"signal": flag(c("p_ml") > 0), "signal_gated": flag((c("gate") == 1) & (c("p") >= 0.5)), "signal_scaled": flag(c("p_scaled") >= 0.3)})
    return shown(df, "gate", "r_ood", "p_ml", "signal", "p_gated", "signal_gated", "p_scaled", "signal_scaled", places={"r_ood": 4, "p_ml": 4})
