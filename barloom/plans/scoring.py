"""Score, vote and decision queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barloom.functions import scores as sc
from barloom.functions.columns import clip, flag, pct_change, ratio, rounded, sma
from barloom.operators import indicators as ind
from barloom.operators import states as st
from barloom.operators.chunks import over_chunks, running_bars
from barloom.operators.lineage import cut
from barloom.operators.quantiles import quantile_columns
from barloom.plans import sql as q
from barloom.plans.base import indexed_bars, shown
from barloom.plans.conditions import BOOK_SQL, LATCH, add_strategy_columns, order_books
from barloom.plans.indicators import GARCH_SQL, RSI_STAGES, _sel, with_returns
from barloom.plans.outcomes import SIG_SQL
from barloom.plans.registry import query
from barloom.plans.trades import ORDER, TR, trades
from barloom.schema import SERIES
from barloom.sources.tables import read_table

K = "symbol, tf, bar_idx"
c = F.col

BASE = q.with_stages(
    RSI_STAGES, ("s0", "avgs", f"{q.rsi()} AS rsi, {q.TR}, {q.ema('close', 9)} AS e9, {q.ema('close', 21)} AS e21, {q.sma('volume', 20)} AS v20, {q.sma('volume', 14)} AS v14, {q.pct('close')} AS ret"),
    ("s1", "s0", f"{q.sma('tr', 14)} AS atr, volume / nullif(v20, 0) AS vr, {q.lag('ret')} AS prev, ret * ret AS sq"),
    ("s2", "s1", f"atr / close AS atr_pct, sqrt({q.sma('sq', 24)}) * sqrt(8760) AS sigma, CASE WHEN count(prev) OVER {q.frame(-98)} >= 99 THEN corr(ret, prev) OVER {q.frame(-98)} END AS ac"))


def add_base(d, w):
    d = ind.add_atr(ind.add_ema(ind.add_rsi(with_returns(d, w), w), {"e9": 9, "e21": 21}), w)
    d = d.withColumns({"v20": sma("volume", 20, w), "v14": sma("volume", 14, w), "_prev": F.lag("ret", 1).over(w)})
    span = w.rowsBetween(-98, 0)
    return d.withColumns({
        "vr": ratio("volume", "v20"), "atr_pct": ratio("atr", "close"), "sigma": F.sqrt(sma(c("ret") * c("ret"), 24, w)) * 8760 ** 0.5,
        "ac": F.when(F.count("_prev").over(span) >= 99, F.corr("ret", "_prev").over(span))})


def base_frame(spark, base, extra=lambda d, w: d, before=1024):
    return over_chunks(indexed_bars(spark, base), lambda d, w: extra(add_base(d, w), w), before=before)


_REG = "CASE WHEN atr_pct < 0.5 THEN 'low_vol' WHEN atr_pct > 2 THEN 'high_vol' ELSE 'normal' END"
OPP = {"w_vol": f"least(greatest((1 - exp(-CASE {_REG} WHEN 'low_vol' THEN 15.0 WHEN 'high_vol' THEN 6 ELSE 10 END * sigma / 1000)) * (1 - 0.1), 0), 1)",
       "w_micro": "least(greatest(coalesce(exp(-abs(ac)), 0.5) * CASE WHEN v14 > 0 THEN least(greatest(1 - abs(ln(volume / v14)) / 2, 0), 1) ELSE 0.5 END, 0), 1)"}


@query("opportunity_parts", "F1 F2 F4 F5", _sel(
    BASE + f", o AS (SELECT *, CASE WHEN sigma IS NOT NULL THEN {OPP['w_vol']} END AS w_vol, {OPP['w_micro']} AS w_micro FROM s2)",
    {"w_vol": "w_vol", "w_micro": "w_micro", "w": "CASE WHEN w_vol IS NOT NULL THEN 0.4 * w_vol + 0.25 * w_micro END"}, "o"))
def _(spark, base):
    df = base_frame(spark, base)
    regime = F.when(c("atr_pct") < 0.5, "low_vol").when(c("atr_pct") > 2, "high_vol").otherwise("normal")
    df = df.withColumns({"w_vol": sc.volatility_opportunity(c("sigma") / 1000, regime, F.lit(0.1)), "w_micro": sc.microstructure(c("ac"), c("volume"), c("v14"))})
    return shown(df.withColumn("w", sc.weighted_opportunity(c("w_vol"), F.lit(0.0), c("w_micro"))), "w_vol", "w_micro", "w")


@query("book_score", "F3 F32", """WITH l AS (SELECT l_orderkey, l_extendedprice / l_quantity AS price, l_quantity AS size, l_linestatus AS s FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, s ORDER BY CASE WHEN s = 'O' THEN -price ELSE price END, CASE WHEN s = 'O' THEN -size ELSE size END) AS lvl FROM l),
b AS (SELECT l_orderkey, max(price) FILTER (s = 'O') AS bid, min(price) FILTER (s = 'F') AS ask, coalesce(sum(size) FILTER (s = 'O' AND lvl <= 10), 0) AS bd, coalesce(sum(size) FILTER (s = 'F' AND lvl <= 10), 0) AS ad FROM n GROUP BY l_orderkey),
o AS (SELECT b.* FROM b JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey AS o_orderkey, """ + q.r("CASE WHEN bid IS NULL OR ask IS NULL THEN 0 ELSE least(greatest(0.4 * (1 - tanh(100 * (ask - bid) / ((ask + bid) / 2))) + 0.4 * least(1, (bd + ad) / 10) + 0.2 * (1 - abs((bd - ad) / (bd + ad))), 0), 1) END") + " AS liquidity FROM o")
def _(spark, base):
    return order_books(spark, base).select("o_orderkey", rounded(sc.liquidity_opportunity(c("bids"), c("asks"))).alias("liquidity"))


SIMPLE = BASE + """, f AS (SELECT *, CASE WHEN rsi < 30 THEN (30 - rsi) / 30 ELSE 0 END AS f1, CASE WHEN vr BETWEEN 1.5 AND 3 THEN 1 - abs(vr - 2) / 1.5 WHEN vr > 5 THEN -least(0.2, (vr - 5) / 10) ELSE 0 END AS f2,
 CASE WHEN e9 / e21 > 1 THEN least(0.1, (e9 / e21 - 1) * 2) ELSE -least(0.05, 1 - e9 / e21) END AS f3, CASE WHEN atr_pct < 0.03 THEN 0.1 WHEN atr_pct > 0.08 THEN -least(0.15, (atr_pct - 0.08) / 0.1) ELSE 0 END AS f4 FROM s2),
g AS (SELECT *, least(greatest(0.5 + f1 * 0.25 + f2 * CASE WHEN vr > 5 THEN 1 ELSE 0.15 END + f3 + f4, 0), 1) AS opp,
 CASE WHEN atr_pct > 0.05 THEN least(0.01, (atr_pct - 0.05) / 0.05) ELSE 0 END + CASE WHEN vr < 0.5 THEN least(0.015, (0.5 - vr) / 0.5) ELSE 0 END + CASE WHEN bar_idx % 6 > 3 THEN least(0.03, (bar_idx % 6 - 3) * 0.01) ELSE 0 END + CASE WHEN abs(ret) > 0.5 THEN least(0.005, abs(ret) - 0.5) ELSE 0 END AS pen FROM f)"""


@query("simple_opportunity", "F6 F9 F10 F18", _sel(SIMPLE, {"opportunity": "opp", "penalty": "pen", "p_j": "rsi / 100 * 0.8 + opp - 0.003 - pen"}, "g").replace(
    "\nSELECT", "\nSELECT CASE WHEN opp >= 0.7 THEN 'EXCELLENT' WHEN opp >= 0.5 THEN 'GOOD' WHEN opp >= 0.3 THEN 'MODERATE' ELSE 'LOW' END AS label, CASE WHEN rsi < 30 AND e9 >= e21 * 0.5 AND vr >= 1.0 AND atr_pct <= 5 THEN 1 ELSE 0 END AS enter,"))
def _(spark, base):
    df = base_frame(spark, base)
    df = df.withColumns(sc.simple_opportunity(c("rsi"), c("vr"), c("e9"), c("e21"), c("atr_pct")))
    df = df.withColumn("penalty", sc.additive_penalty(c("atr_pct"), c("vr"), c("bar_idx") % 6, F.abs("ret")))
    df = df.withColumns({"p_j": c("rsi") / 100 * 0.8 + c("opportunity") - sc.round_trip_cost() - c("penalty"),
                         "enter": flag((c("rsi") < 30) & (c("e9") >= c("e21") * 0.5) & (c("vr") >= 1.0) & (c("atr_pct") <= 5))})
    return shown(df, "label", "enter", "opportunity", "penalty", "p_j")


CAL = BASE + """, iv AS (SELECT *, (high - low) / close * 100 AS intrabar, coalesce(rsi, 50) / 100 AS p FROM s2),
cal AS (SELECT symbol, tf, quantile_cont(volume, 0.3) AS v30, quantile_cont(volume, 0.95) AS v95, quantile_cont(intrabar, 0.5) AS i50, quantile_cont(intrabar, 0.75) AS i75, quantile_cont(intrabar, 0.8) AS i80 FROM iv GROUP BY symbol, tf)"""


@query("calibration_quantiles", "A25", CAL + f" SELECT symbol, tf, {', '.join(f'{q.r(x)} AS {x}' for x in ('v30', 'v95', 'i50', 'i75', 'i80'))} FROM cal")
def _(spark, base):
    return shown(calibration(cut(indexed_bars(spark, base))), "v30", "v95", "i50", "i75", "i80", keys=["symbol", "tf"])


def calibration(bars):
    bars = bars.withColumn("intrabar", (c("high") - c("low")) / c("close") * 100)
    vol = quantile_columns(bars, SERIES, "volume", {"v30": 0.3, "v95": 0.95})
    return vol.join(quantile_columns(bars, SERIES, "intrabar", {"i50": 0.5, "i75": 0.75, "i80": 0.8}), SERIES)


@query("gated_score", "F7 A25", CAL + f""" SELECT {K}, {q.r("CASE WHEN p < 0.5 OR volume < v30 OR intrabar > i80 THEN 0 ELSE p * CASE WHEN e9 > e21 THEN 1.2 ELSE 0.8 END * CASE WHEN ret < -0.9 THEN 0 ELSE 1 END END")} AS score FROM iv JOIN cal USING (symbol, tf)""")
def _(spark, base):
    df = cut(base_frame(spark, base))
    df = df.join(calibration(df), SERIES).withColumns({"p": F.coalesce("rsi", F.lit(50.0)) / 100, "_iv": (c("high") - c("low")) / c("close") * 100})
    regime = F.when(c("e9") > c("e21"), "bull").otherwise("bear")
    return shown(df.withColumn("score", sc.gated_score(c("p"), c("volume"), c("_iv"), regime, F.coalesce(c("ret") < -0.9, F.lit(False)), c("v30"), c("i80"))), "score")


PJ = BASE + f""", j AS (SELECT *, coalesce(rsi, 0) / 100 AS p, avg(volume) OVER {q.frame(-20, -1)} AS rv, CASE WHEN bar_idx >= 14 THEN max(high - low) OVER {q.frame(-14, -1)} / avg(close) OVER {q.frame(-14, -1)} ELSE 0.02 END AS vp,
 avg(close) OVER {q.frame(-50, -1)} AS s50, avg(close) OVER {q.frame(-200, -1)} AS s200 FROM s2),
k AS (SELECT *, CASE WHEN bar_idx >= 200 AND close > s50 AND s50 > s200 THEN 1.0 WHEN bar_idx >= 200 AND close < s50 AND s50 < s200 THEN 0.5 ELSE 0.8 END AS fp,
 CASE WHEN bar_idx < 20 THEN 1.0 WHEN volume < rv * 0.5 THEN 0.5 WHEN volume > rv * 1.5 THEN 1.2 ELSE 1 END AS opp, 0.0025 + CASE WHEN bar_idx >= 20 AND rv > 0 AND volume < rv * 0.5 THEN 0.0005 ELSE 0 END AS cost,
 least(1, CASE WHEN vp > 0.05 THEN least(0.5, 0.1 * vp / 0.05) ELSE 0 END + CASE WHEN p < 0.55 THEN (0.55 - p) * 0.2 ELSE 0 END) AS pen FROM j)"""


@query("multiplicative_score", "F8 F9 F10 F18 P7", _sel(PJ, {"filters": "fp", "opportunity": "opp", "cost": "cost", "penalty": "pen", "p_j": "CASE WHEN p <= 0 THEN 0 ELSE greatest(0, p * fp * opp - cost - pen) END"}, "k"))
def _(spark, base):
    def extra(d, w):
        d = d.withColumns({"p": F.coalesce("rsi", F.lit(0.0)) / 100, "_rv": F.avg("volume").over(w.rowsBetween(-20, -1)),
                           "_vp": F.when(c("bar_idx") >= 14, ind.range_atr_pct(w)).otherwise(0.02)})
        return d.withColumns(st.previous_rows_regime(w))
    df = base_frame(spark, base, extra)
    typical = F.when(c("bar_idx") >= 20, c("_rv")).otherwise(c("volume"))
    df = df.withColumns({"filters": sc.by_key({"bull": 1.0, "sideways": 0.8, "bear": 0.5}, c("sma_regime"), 0.8),
                         "opportunity": sc.volume_bucket(c("bar_idx"), c("volume"), c("_rv")), "cost": sc.volume_cost(c("volume"), typical),
                         "penalty": sc.two_term_penalty(c("_vp"), c("p"))})
    df = df.withColumn("p_j", F.when(c("p") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), c("p") * c("filters") * c("opportunity") - c("cost") - c("penalty"))))
    return shown(df, "filters", "opportunity", "cost", "penalty", "p_j")


RISK = GARCH_SQL + f""",
rk AS (SELECT *, max(close) OVER {q.past()} AS pk, quantile_cont(ret, 0.05) OVER {q.frame(-100)} AS var5 FROM gv),
cv AS (SELECT a.symbol, a.tf, a.bar_idx, abs(avg(b.ret)) AS cvar FROM rk a JOIN rk b ON a.symbol = b.symbol AND a.tf = b.tf AND b.bar_idx BETWEEN a.bar_idx - 100 AND a.bar_idx AND b.ret <= a.var5 GROUP BY ALL),
r1 AS (SELECT rk.*, 10 * sqrt(v) * m AS r_vol, cvar AS r_tail, 5 * 0.001 / 0.02 AS r_liq, CASE WHEN pk - close <= 0 THEN 0 ELSE exp(5 * (pk - close) / pk / 0.15) - 1 END AS r_dd, m
 FROM rk JOIN cv USING ({K}) JOIN (SELECT {K}, CASE WHEN ret > 0 THEN 1.0 ELSE 1.5 END AS m FROM gv) USING ({K}))"""


@query("risk_penalty", "F11 W30 W26", _sel(RISK, {"r_vol": "r_vol", "r_tail": "r_tail", "r_liq": "r_liq", "log_r_dd": "ln(1 + r_dd)", "log_risk": "ln(1 + (0.3 * r_vol + 0.2 * r_tail + 0.2 * r_liq + 0.15 * r_dd) * m)"}, "r1"))
def _(spark, base):
    def cols(d, w):
        d = ind.add_garch(with_returns(d, w))
        span = w.rowsBetween(-100, 0)
        d = d.withColumns({"_v5": F.percentile("ret", F.lit(0.05)).over(span), "_rs": F.collect_list("ret").over(span)})
        tail = F.filter("_rs", lambda x: x <= c("_v5"))
        mean = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail)
        return d.withColumn("_cvar", F.when(F.size("_rs") > 0, mean)).drop("_rs")
    df = running_bars(over_chunks(indexed_bars(spark, base), cols), {"_peak": ("max", c("close"))}).where(c("_cvar").isNotNull())
    regime = F.when(c("ret") > 0, "BULL").otherwise("BEAR")
    df = df.withColumns(sc.total_risk(c("garch_var"), c("_cvar"), F.lit(0.001), F.lit(0.02), F.lit(None).cast("double"), (c("_peak") - c("close")) / c("_peak"), regime))
    return shown(df.withColumns({"log_r_dd": F.log1p("r_dd"), "log_risk": F.log1p("risk")}), "r_vol", "r_tail", "r_liq", "log_r_dd", "log_risk")


@query("filter_flags", "P3 P4 P5 P6 P7 A16", LATCH + f""" SELECT symbol, tf, count(*) FILTER (rsi > 20 AND rsi < 80) AS i1, count(*) FILTER (close > e9) AS i2, count(*) FILTER (volume > v14) AS i3,
 count(*) FILTER ((close - lo) / nullif(up - lo, 0) > 0.25 AND (close - lo) / nullif(up - lo, 0) < 0.75) AS i4, sum(prod)::BIGINT AS passed, round(avg(CASE WHEN p_rb > 0.05 THEN 1.0 ELSE 0 END), 6) AS signal_rate FROM i3 GROUP BY symbol, tf""")
def _(spark, base):
    df = over_chunks(indexed_bars(spark, base), add_strategy_columns)
    return df.groupBy(*SERIES).agg(
        *[F.sum(f).alias(n) for n, f in (("i1", "i1_rsi"), ("i2", "i2_ema"), ("i3", "i3_volume"), ("i4", "i4_bb"), ("passed", "filters"))],
        F.round(F.avg(flag(c("p_rb") > 0.05).cast("double")), 6).alias("signal_rate"))


HYB = q.with_stages(
    LATCH, ("y0", "i3", f"list_filter(list(rsi) OVER {q.frame(-49)}, lambda v: v IS NOT NULL) AS last_rsi"),
    ("y1", "y0", "CASE WHEN len(last_rsi) >= 50 THEN len(list_filter(last_rsi, lambda v: v <= rsi)) / 50.0 ELSE 0.5 END AS pctile, CASE WHEN abs(ret) > 5 THEN 0.8 ELSE 0.1 END AS crisis"),
    ("y2", "y1", "least(greatest(1 / (1 + exp(-5 * (abs(pctile - 0.5) - 0.3))), 0.3), 0.7) * CASE WHEN crisis < 0.7 THEN 1 ELSE 0 END - 0.0015 * (1 + 2 * coalesce(vol50, 0.02)) AS p_ml"),
    ("y3", "y2", f"count(p_rb) OVER {q.frame(-20, -1)} AS n, avg(p_rb) OVER {q.frame(-20, -1)} AS ma, stddev_pop(p_rb) OVER {q.frame(-20, -1)} AS sa, avg(p_ml) OVER {q.frame(-20, -1)} AS mb, stddev_pop(p_ml) OVER {q.frame(-20, -1)} AS sb"),
    ("y4", "y3", "exp(CASE WHEN coalesce(sa, 0) < 1e-12 THEN 0 ELSE ma / sa END + 1e-6) AS ea, exp(CASE WHEN coalesce(sb, 0) < 1e-12 THEN 0 ELSE mb / sb END + 1e-6) AS eb"),
    ("y5", "y4", "CASE WHEN n < 5 THEN 0.45 ELSE least(greatest(ea / (ea + eb) * 0.9, 0.1), 0.8) END AS a0, CASE WHEN n < 5 THEN 0.45 ELSE least(greatest(eb / (ea + eb) * 0.9, 0.1), 0.8) END AS b0"),
    ("y6", "y5", "CASE WHEN n >= 5 AND a0 + b0 > 0.9 THEN a0 * 0.9 / (a0 + b0) ELSE a0 END AS alpha, CASE WHEN n >= 5 AND a0 + b0 > 0.9 THEN b0 * 0.9 / (a0 + b0) ELSE b0 END AS beta"))


def hybrid_frame(spark, base):
    """P_rb and P_ml of every bar and their adaptive blend over the previous 20 bars."""
    def cols(d, w):
        d = add_strategy_columns(d, w)
        d = d.withColumns({"_last": F.collect_list("rsi").over(w.rowsBetween(-49, 0)), "crisis": F.when(F.abs("_ret") > 5, 0.8).otherwise(0.1)})
        pctile = F.when(F.size("_last") >= 50, F.size(F.filter("_last", lambda v: v <= c("rsi"))) / F.lit(50.0)).otherwise(0.5)
        gate = sc.ml_gate(c("crisis"), F.lit(0.0), F.lit("normal"))
        d = d.withColumn("p_ml", sc.heuristic_probability(pctile) * gate - sc.adaptive_cost(F.coalesce("vol50", F.lit(0.02))))
        past = w.rowsBetween(-20, -1)
        def sd(x):
            v = F.stddev_pop(x).over(past)
            return F.when(v < 1e-12, 0.0).otherwise(v)
        d = d.withColumns({"_n": F.count("p_rb").over(past), "_ma": F.avg("p_rb").over(past), "_sa": sd("p_rb"), "_mb": F.avg("p_ml").over(past), "_sb": sd("p_ml")})
        d = sc.add_adaptive_weights(d, c("_n"), c("_ma"), c("_sa"), c("_mb"), c("_sb"))
        return d.withColumn("p_hyb", c("alpha") * c("p_rb") + c("beta") * c("p_ml") + sc.future_value(F.lit("normal"), c("crisis")))
    return over_chunks(indexed_bars(spark, base), cols)


@query("hybrid_score", "F12 F13 F14 F15 F16", _sel(HYB, {"p_rb": "p_rb", "p_ml": "p_ml", "alpha": "alpha", "beta": "beta",
    "p_hyb": "alpha * p_rb + beta * p_ml + 0.95 * CASE WHEN crisis > 0.5 THEN 0.01 ELSE 0.05 END"}, "y6"))
def _(spark, base):
    return shown(hybrid_frame(spark, base), "p_rb", "p_ml", "alpha", "beta", "p_hyb")


OVER = HYB + """, sg AS (SELECT *, CASE WHEN p_rb > 0 THEN 1 ELSE 0 END AS rule, CASE WHEN p_ml > 0.3 THEN 1 ELSE 0 END AS ml, CASE WHEN alpha * p_rb + beta * p_ml > 0.1 THEN 1 ELSE 0 END AS hyb FROM y6)"""


def signal_flags(spark, base):
    df = hybrid_frame(spark, base)
    return df.withColumns({"rule": flag(c("p_rb") > 0), "ml": flag(c("p_ml") > 0.3), "hyb": flag(c("alpha") * c("p_rb") + c("beta") * c("p_ml") > 0.1)})


@query("signal_overlap", "A38 A16", OVER + " SELECT symbol, tf, rule, ml, hyb, count(*) AS n FROM sg GROUP BY ALL")
def _(spark, base):
    return signal_flags(spark, base).groupBy(*SERIES, "rule", "ml", "hyb").agg(F.count(F.lit(1)).alias("n"))


@query("common_signals", "U2", OVER + f" SELECT {K} FROM sg WHERE rule = 1 INTERSECT SELECT {K} FROM sg WHERE ml = 1")
def _(spark, base):
    s = cut(signal_flags(spark, base).select(*SERIES, "bar_idx", "rule", "ml"))
    keys = [*SERIES, "bar_idx"]
    return s.where("rule = 1").select(*keys).intersect(s.where("ml = 1").select(*keys))


@query("exclusive_signals", "U3", OVER + f" SELECT {K} FROM sg WHERE rule = 1 EXCEPT SELECT {K} FROM sg WHERE hyb = 1")
def _(spark, base):
    s = cut(signal_flags(spark, base).select(*SERIES, "bar_idx", "rule", "hyb"))
    keys = [*SERIES, "bar_idx"]
    return s.where("rule = 1").select(*keys).exceptAll(s.where("hyb = 1").select(*keys))


@query("entry_funnel", "P11 A43", OVER + """ SELECT symbol, tf, count(*) AS bars, count(*) FILTER (l1) AS oversold, count(*) FILTER (l1 AND l2) AS ml_passed, count(*) FILTER (l1 AND l2 AND l3) AS crisis_passed,
 round(1 - count(*) FILTER (l1 AND l2) / nullif(count(*) FILTER (l1), 0), 6) + 0.0 AS ml_loss FROM (SELECT *, coalesce(bar_idx >= 200 AND rsi < 45, false) AS l1, p_ml > 0.25 AS l2, crisis < 0.7 AS l3 FROM sg) GROUP BY symbol, tf""")
def _(spark, base):
    l1 = F.coalesce((c("bar_idx") >= 200) & (c("rsi") < 45), F.lit(False))
    l2, l3 = l1 & (c("p_ml") > 0.25), l1 & (c("p_ml") > 0.25) & (c("crisis") < 0.7)
    out = hybrid_frame(spark, base).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("bars"), F.count_if(l1).alias("oversold"),
                                                         F.count_if(l2).alias("ml_passed"), F.count_if(l3).alias("crisis_passed"))
    return out.withColumn("ml_loss", F.round(1 - ratio("ml_passed", "oversold"), 6) + F.lit(0.0))


@query("signal_votes", "A31", OVER + """, v AS (SELECT symbol, tf, bar_idx, unnest([struct_pack(a := CASE WHEN rule = 1 THEN 'buy' WHEN p_rb < -0.3 THEN 'sell' ELSE 'hold' END, f := 0.5), struct_pack(a := CASE WHEN ml = 1 THEN 'buy' ELSE 'sell' END, f := 0.7),
  struct_pack(a := CASE WHEN hyb = 1 THEN 'buy' ELSE 'hold' END, f := 0.9)]) AS x FROM sg), w AS (SELECT symbol, tf, bar_idx, x.a AS a, x.f AS f FROM v),
t AS (SELECT symbol, tf, bar_idx, count(*) FILTER (a = 'buy') AS nb, count(*) FILTER (a = 'sell') AS ns, count(*) FILTER (a = 'hold') AS nh, avg(f) FILTER (a = 'buy') AS fb, avg(f) FILTER (a = 'sell') AS fs, avg(f) AS fa FROM w GROUP BY ALL)
SELECT symbol, tf, bar_idx, CASE WHEN nb > ns AND nb > nh THEN 'buy' WHEN ns > nb AND ns > nh THEN 'sell' ELSE 'hold' END AS action, round(CASE WHEN nb > ns AND nb > nh THEN fb WHEN ns > nb AND ns > nh THEN fs ELSE fa END, 6) AS confidence FROM t""")
def _(spark, base):
    """Votes of one bar sit in one row, so no regrouping is needed."""
    actions = {"a1": (F.when(c("rule") == 1, "buy").when(c("p_rb") < -0.3, "sell").otherwise("hold"), 0.5),
               "a2": (F.when(c("ml") == 1, "buy").otherwise("sell"), 0.7), "a3": (F.when(c("hyb") == 1, "buy").otherwise("hold"), 0.9)}
    df = signal_flags(spark, base).withColumn("_v", F.array(*[F.struct(a.alias("a"), F.lit(f).alias("f")) for a, f in actions.values()]))
    def n(kind):
        return F.size(F.filter("_v", lambda x: x["a"] == kind))
    def mean(kind=None):
        xs = F.filter("_v", lambda x: x["a"] == kind) if kind else c("_v")
        return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x["f"]) / F.nullif(F.size(xs), F.lit(0))
    buy, sell = (n("buy") > n("sell")) & (n("buy") > n("hold")), (n("sell") > n("buy")) & (n("sell") > n("hold"))
    return df.select(*SERIES, "bar_idx", F.when(buy, "buy").when(sell, "sell").otherwise("hold").alias("action"),
                     F.round(F.when(buy, mean("buy")).when(sell, mean("sell")).otherwise(mean()), 6).alias("confidence"))


# ------------------------------------------------------- orders as decision requests

REQ = """WITH r AS (SELECT o_orderkey AS id, o_totalprice / 500000 AS base, (o_custkey % 10) / 10.0 AS conf, (o_orderkey % 5) / 5.0 + 0.2 AS quality, (o_custkey % 7) / 7.0 AS opp,
 CASE o_orderstatus WHEN 'F' THEN 'BULL' WHEN 'O' THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime, CASE o_orderkey % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'NORMAL' ELSE 'HIGH' END AS vr, (o_custkey % 9) / 100.0 AS vol, (o_orderkey % 12) AS n_open,
 (o_orderkey % 25) - 6.0 AS pnl, (o_custkey % 12)::DOUBLE AS dd, (o_orderkey % 101) / 110.0 AS corr, (o_custkey % 101) / 100.0 AS bot, CASE o_orderkey % 5 WHEN 0 THEN 'CRASH' WHEN 1 THEN 'MANIPULATION' WHEN 2 THEN 'GLITCH' WHEN 3 THEN 'OPPORTUNITY' ELSE 'NONE' END AS ct,
 CASE WHEN o_custkey % 4 = 0 THEN 'CRITICAL' ELSE 'LOW' END AS news, (o_orderkey % 11) / 10.0 AS sent, o_totalprice AS price FROM orders)"""


def requests(spark, base):
    o, k = c("o_orderkey"), c("o_custkey")
    return read_table(spark, base, "orders").select(
        o.alias("id"), (c("o_totalprice") / 500000).alias("base"), ((k % 10) / 10.0).alias("conf"), ((o % 5) / 5.0 + 0.2).alias("quality"), ((k % 7) / 7.0).alias("opp"),
        F.when(c("o_orderstatus") == "F", "BULL").when(c("o_orderstatus") == "O", "BEAR").otherwise("SIDEWAYS").alias("regime"),
        F.element_at(F.array(F.lit("LOW"), F.lit("NORMAL"), F.lit("HIGH")), (o % 3 + 1).cast("int")).alias("vr"), ((k % 9) / 100.0).alias("vol"), (o % 12).alias("n_open"),
        (o % 25 - 6.0).alias("pnl"), (k % 12).cast("double").alias("dd"), ((o % 101) / 110.0).alias("corr"), ((k % 101) / 100.0).alias("bot"),
        F.element_at(F.array(*[F.lit(x) for x in ("CRASH", "MANIPULATION", "GLITCH", "OPPORTUNITY", "NONE")]), (o % 5 + 1).cast("int")).alias("ct"),
        F.when(k % 4 == 0, "CRITICAL").otherwise("LOW").alias("news"), ((o % 11) / 10.0).alias("sent"), c("o_totalprice").alias("price"))


DEC = REQ + """, d AS (SELECT *, dd < 8 AND conf > 0.2 AND bot < 0.9 AND quality > 0.3 AND ct <> 'CRASH' AS passed, least(greatest((1 - base) * 0.5 + (1 - conf) * 0.3 + (1 - quality) * 0.2, 0), 1) AS u,
 CASE regime WHEN 'BULL' THEN 0.3 WHEN 'BEAR' THEN 0.8 ELSE 0.5 END * CASE vr WHEN 'LOW' THEN 0.7 WHEN 'NORMAL' THEN 1 ELSE 1.5 END AS lam, (0.5 * 0.02 + 0.3 * -0.01 + 0.2 * 0.003) * pow(0.95, 24) AS fv FROM r),
e AS (SELECT *, least(greatest(CASE WHEN passed THEN base * least(greatest(0.1 + opp * 1.4, 0.1), 1.5) - (0.001 * 0.05 + 0.0005 * vol / 0.02) - 0.01 * (abs(conf - 0.3) + quality) - lam * u + 0.95 * fv ELSE 0 END, -1), 2) AS s FROM d)"""


@query("decision_score", "F19 P9 F9 J11", DEC + f""" SELECT id, passed::INT AS passed, {q.r('u')} AS uncertainty, {q.r('lam')} AS lambda, {q.r('s')} AS score, CASE WHEN s <= 0 THEN 'HALT' WHEN s < 0.3 THEN 'REDUCE' WHEN s < 0.6 THEN 'SMALL_TRADE' ELSE 'TRADE' END AS action,
 CASE WHEN s <= 0 THEN 0.0 WHEN s < 0.3 THEN 0.02 WHEN s < 0.6 THEN 0.05 ELSE 0.1 END::DOUBLE AS size FROM e""")
def _(spark, base):
    r = requests(spark, base)
    flags = F.struct((c("dd") < 8).alias("safety"), (c("conf") > 0.2).alias("regime"), (c("bot") < 0.9).alias("bot_free"), (c("quality") > 0.3).alias("data_quality"), (c("ct") != "CRASH").alias("crisis_type"))
    r = r.withColumn("filters", flags)
    passed = c("filters.safety") & c("filters.regime") & c("filters.bot_free") & c("filters.data_quality") & c("filters.crisis_type")
    before = F.create_map(F.lit("a"), c("conf"))
    after = F.create_map(F.lit("a"), F.lit(0.3).cast("double"), F.lit("b"), c("quality").cast("double"))
    before = before.cast("map<string,double>")
    trans = F.create_map(F.lit("BULL"), F.lit(0.5), F.lit("BEAR"), F.lit(0.3), F.lit("SIDEWAYS"), F.lit(0.2))
    out = sc.decision_score(c("base"), passed, c("opp"), sc.transaction_cost(F.lit(0.05), c("vol"), F.lit(0.0005)), sc.switching_cost(before, after.cast("map<string,double>")),
                            c("conf"), c("quality"), c("regime"), c("vr"), trans)
    return shown(r.withColumns(out).withColumn("passed", passed.cast("int")), "passed", "uncertainty", "lambda", "score", "action", "size", keys=["id"])


_HALTS = [("CRASH_DETECTED", "ct = 'CRASH' AND conf >= 0.9", 24), ("MAX_DRAWDOWN", "pnl <= -5.0", 12), ("MAX_DRAWDOWN", "dd >= 10", 12), ("CORRELATION_SPIKE", "corr >= 0.85", 6),
          ("BOT_MANIPULATION", "bot > 0.5 AND bot >= 0.8 AND ct = 'MANIPULATION'", 2), ("EXTREME_VOLATILITY", "vol >= 0.02 * 3.0", 4), ("NEGATIVE_CRITICAL_NEWS", "news = 'CRITICAL' AND sent < 0.3", 6)]
GOV = REQ + f""", h AS (SELECT *, array_to_string(list_filter([{', '.join(f"CASE WHEN {cond} THEN '{n}' END" for n, cond, _ in _HALTS)}], lambda x: x IS NOT NULL), '|') AS reasons, coalesce({', '.join(f"CASE WHEN {cond} THEN {h} END" for _, cond, h in reversed(_HALTS))}) AS halt_hours,
 bot > 0.5 AND bot >= 0.7 AND opp >= 0.8 AS wary, ct IN ('CRASH', 'MANIPULATION') AND opp >= 0.6 AS co FROM r),
g AS (SELECT *, CASE WHEN reasons <> '' THEN 0 WHEN co THEN 0.2 WHEN wary THEN 0.3 ELSE CASE WHEN opp >= 0.8 THEN 0.8 + (opp - 0.8) WHEN opp >= 0.6 THEN 0.5 + (opp - 0.6) * 1.5 WHEN opp >= 0.4 THEN 0.2 + (opp - 0.4) * 1.5 ELSE greatest(0, opp * 0.5) END
 * CASE WHEN vol > 0.04 THEN 0.5 ELSE 1 END * CASE WHEN abs(pnl) / 5 > 0.5 THEN 1 - abs(pnl) / 5 ELSE 1 END END AS mult FROM h)"""


@query("governance", "F20", GOV + f""" SELECT id, reasons, halt_hours, CASE WHEN reasons <> '' THEN 'HALTED' WHEN co OR wary THEN 'REDUCED' ELSE 'ACTIVE' END AS state, {q.r('mult')} AS multiplier,
 {q.r("price * 0.2 * mult * CASE WHEN corr >= 0.7 THEN 1 - (corr - 0.7) / 0.3 * 0.5 ELSE 1 END * CASE WHEN n_open >= 5 THEN 0.7 ELSE 1 END * CASE WHEN n_open >= 8 THEN 0.5 ELSE 1 END", 9)} AS max_position,
 {q.r("least(greatest(CASE ct WHEN 'CRASH' THEN 5.0 WHEN 'MANIPULATION' THEN 8 WHEN 'GLITCH' THEN 15 ELSE 10 END * CASE WHEN vol / 0.02 > 2 THEN 1.5 WHEN vol / 0.02 < 0.5 THEN 0.7 ELSE 1 END, 3), 20)")} AS stop_pct FROM g""")
def _(spark, base):
    out = sc.governance(c("ct"), c("conf"), c("pnl"), c("dd"), c("corr"), c("bot"), c("vol"), F.lit(0.02), c("news"), c("sent"), c("opp"), c("price"), c("corr"), c("n_open"))
    r = requests(spark, base).withColumns(out)
    return r.select("id", F.array_join("reasons", "|").alias("reasons"), "halt_hours", "state", rounded("multiplier").alias("multiplier"),
                    rounded("max_position", 9).alias("max_position"), rounded("stop_pct").alias("stop_pct"))


CONF_SQL = q.with_stages(BASE, ("n0", "s2", f"{q.roll('min', 'low', 50)} AS sup, {q.lag('close', 119)} AS pc, {q.sma('close', 20)} AS m20, {q.sma('close', 200)} AS m200, min(low) OVER {q.frame(-19)} AS l20"))


@query("entry_confluence", "F21", _sel(CONF_SQL, {"confluence": """CASE WHEN bar_idx >= 199 AND rsi < 30 THEN least(1, 0.25 + CASE WHEN rsi < 25 THEN 0.1 ELSE 0 END + CASE WHEN vr > 0.8 AND vr < 1.2 THEN 0.2 WHEN vr > 1.5 THEN -0.15 ELSE 0 END
 + CASE WHEN (close - sup) / sup < 0.02 THEN 0.15 ELSE 0 END + CASE WHEN close > pc THEN 0.2 ELSE 0 END + CASE WHEN bar_idx % 2 = 0 AND l20 < sup AND close > sup THEN 0.25 ELSE 0 END + CASE WHEN m20 > m200 THEN 0.1 ELSE 0 END) ELSE 0 END"""}, "n0"))
def _(spark, base):
    def extra(d, w):
        f50 = w.rowsBetween(-49, 0)
        return d.withColumns({"_sup": F.when(c("bar_idx") >= 49, F.min("low").over(f50)), "_pc": F.lag("close", 119).over(w), "_m20": sma("close", 20, w),
                              "_m200": sma("close", 200, w), "_l20": F.min("low").over(w.rowsBetween(-19, 0))})
    df = base_frame(spark, base, extra)
    return shown(df.withColumn("confluence", sc.confluence(c("bar_idx"), c("rsi"), c("vr"), c("close"), c("_sup"), c("_pc"), c("_m20"), c("_m200"), c("bar_idx") % 2 == 0, c("_l20"))), "confluence")


@query("agreement", "F22 P12", REQ + f""" SELECT id, {q.r("1 - least(greatest(base, conf, CASE WHEN n_open > 5 THEN opp END) - least(base, conf, CASE WHEN n_open > 5 THEN opp END), 1)", 9)} AS agreement,
 array_to_string(list_filter([CASE WHEN conf < 0.1 OR conf > 1 THEN 'confidence' END, CASE WHEN base > 0.8 THEN 'position_size' END, CASE WHEN ct = 'NONE' THEN 'action' END], lambda x: x IS NOT NULL), ',') AS violations FROM r""")
def _(spark, base):
    bad = F.array_compact(F.array(F.when((c("conf") < 0.1) | (c("conf") > 1), "confidence"), F.when(c("base") > 0.8, "position_size"), F.when(c("ct") == "NONE", "action")))
    return requests(spark, base).select("id", rounded(sc.agreement(c("base"), c("conf").cast("double"), F.when(c("n_open") > 5, c("opp").cast("double"))), 9).alias("agreement"),
                                        F.array_join(bad, ",").alias("violations"))


SIZE_SQL = REQ + """, z AS (SELECT *, 10000.0 AS cap, price / 1000 AS px, price / 1000 * (0.9 + (n_open % 3) * 0.05) AS stop, price / 1000 * vol AS atr, conf AS wr, opp * 2 AS wl,
 CASE id % 4 WHEN 0 THEN 'fixed_pct' WHEN 1 THEN 'risk_based' WHEN 2 THEN 'kelly' ELSE 'atr_based' END AS m FROM r),
zz AS (SELECT *, CASE WHEN m = 'risk_based' AND stop < px THEN cap * 0.02 / abs(px - stop) WHEN m = 'kelly' AND wr > 0 AND wr < 1 AND wl > 0 THEN cap * least(greatest(0, (wr * wl - (1 - wr)) / wl * 0.25), 0.95) / px
 WHEN m = 'atr_based' AND atr > 0 THEN cap * 0.02 / (atr * 2) ELSE cap * 0.95 / px END AS raw FROM z)"""


@query("position_size", "F23 F24", SIZE_SQL + f""" SELECT id, m AS method, {q.r('greatest(0, least(raw * quality, cap * 0.95 / px))')} AS size, CASE WHEN base > 0.7 THEN 'POSITION_TOO_LARGE' WHEN conf > 0.5 THEN 'EXPOSURE_TOO_HIGH' WHEN -dd / 50 < -0.2 THEN 'DRAWDOWN_TOO_LARGE' WHEN n_open >= 5 THEN 'TOO_MANY_TRADES' ELSE 'OK' END AS check_result FROM zz""")
def _(spark, base):
    px = c("price") / 1000
    method = F.element_at(F.array(*[F.lit(x) for x in ("fixed_pct", "risk_based", "kelly", "atr_based")]), (c("id") % 4 + 1).cast("int"))
    r = requests(spark, base).withColumns({"method": method, "_px": px, "_stop": px * (0.9 + (c("n_open") % 3) * 0.05), "_atr": px * c("vol")})
    size = sc.position_size(c("method"), F.lit(10000.0), c("_px"), c("_stop"), c("_atr"), c("conf"), c("opp") * 2, c("quality"))
    check = sc.trade_check(c("base"), c("conf"), -c("dd") / 50, c("n_open"), max_pos=0.7)
    return r.select("id", "method", rounded(size).alias("size"), check.alias("check_result"))


@query("bot_types", "F26", REQ + """ SELECT CASE WHEN bot > 0.5 THEN CASE WHEN conf > 0.6 THEN 'latency_arbitrage' WHEN opp > 0.7 THEN 'spoofing' WHEN n_open > 5 THEN 'wash_trading' ELSE 'front_running' END END AS bot_type, count(*) AS n FROM r GROUP BY 1""")
def _(spark, base):
    return requests(spark, base).groupBy(sc.bot_type(c("bot"), c("conf"), c("opp"), c("n_open")).alias("bot_type")).agg(F.count(F.lit(1)).alias("n"))


@query("portfolio_exposure", "A32", TR + """, last AS (SELECT symbol, max_by(notional / size, (exit_s, order_no, line_no, part_no, supp_no, notional, size)) AS px FROM trades GROUP BY symbol),
p AS (SELECT strategy, symbol, sum(size * direction) AS qty, sum(notional * direction) AS cost FROM trades GROUP BY ALL)
SELECT strategy, round(1e9 + sum(qty * px), 1) AS equity, round(sum(abs(qty * px)) / (1e9 + sum(qty * px)), 6) AS exposure, round(sum(qty * px - cost), 1) AS open_pnl FROM p JOIN last USING (symbol) GROUP BY strategy""")
def _(spark, base):
    t = trades(spark, base)
    last = t.groupBy("symbol").agg(F.max_by(c("notional") / c("size"), F.struct(*ORDER)).alias("px"))
    p = t.groupBy("strategy", "symbol").agg(F.sum(c("size") * c("direction")).alias("qty"), F.sum(c("notional") * c("direction")).alias("cost"))
    j = p.join(last, "symbol").withColumn("v", c("qty") * c("px"))
    return j.groupBy("strategy").agg(F.round(1e9 + F.sum("v"), 1).alias("equity"), F.round(F.sum(F.abs("v")) / (1e9 + F.sum("v")), 6).alias("exposure"),
                                     F.round(F.sum(c("v") - c("cost")), 1).alias("open_pnl"))


@query("latest_bar", "O4", q.BARS + f" SELECT symbol, tf, max(bar_idx) AS bar_idx, {q.r('max_by(close, bar_idx)')} AS close, {q.r('max_by(volume, bar_idx)')} AS volume FROM bars GROUP BY symbol, tf")
def _(spark, base):
    last = indexed_bars(spark, base).groupBy(*SERIES).agg(F.max_by(F.struct("bar_idx", "close", "volume"), "bar_idx").alias("l"))
    return shown(last.select(*SERIES, "l.*"), "close", "volume")


@query("retrieved_context", "F31 O3 F29 S15", """WITH d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
k AS (SELECT lang, string_agg('[' || upper(source) || '-' || doc_id || '] ' || text, chr(10) ORDER BY rn) AS t FROM d WHERE rn <= 3 GROUP BY lang) SELECT lang, length(t) AS n_chars, md5(t) AS digest FROM k""")
def _(spark, base):
    """The first three documents of each language as one context text; whole texts, three rows per group."""
    w = Window.partitionBy("lang").orderBy("doc_id")
    d = read_table(spark, base, "documents").withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    line = F.concat(F.lit("["), F.upper("source"), F.lit("-"), c("doc_id").cast("string"), F.lit("] "), c("text"))
    t = d.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rn", line.alias("line")))).alias("x")).select("lang", F.concat_ws("\n", F.col("x.line")).alias("t"))
    return t.select("lang", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))
