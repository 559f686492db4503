"""Gates, switchable entries, joined signal streams and halt windows."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from barloom.functions import scores as sc
from barloom.functions.columns import flag, ratio, rounded
from barloom.operators import intervals as iv
from barloom.operators import states as st
from barloom.operators.chunks import over_chunks, running_bars
from barloom.operators.lineage import cut
from barloom.plans import scoring as so
from barloom.plans import sql as q
from barloom.plans.base import indexed_bars, shown
from barloom.plans.conditions import T11_SQL, add_strategy_columns
from barloom.plans.indicators import _sel
from barloom.plans.registry import query
from barloom.schema import SERIES
from barloom.streaming.bars import tick_stream
from barloom.streaming.joins import confirmed_signals
from barloom.streaming.run import drain

c, K = F.col, so.K

GATE_SQL = so.HYB + f""",
g0 AS (SELECT *, max(close) OVER {q.past()} AS peak, {T11_SQL} FROM y1),
g1 AS (SELECT *, (peak - close) / peak AS drawdown, CASE sma_regime WHEN 'sideways' THEN 'normal' ELSE sma_regime END AS regime FROM g0),
g2 AS (SELECT *, CASE WHEN crisis < 0.7 THEN 1 ELSE 0 END AS f_crisis, CASE WHEN drawdown < 0.2 THEN 1 ELSE 0 END AS f_drawdown, CASE WHEN regime IN ('normal', 'bull', 'recovery') THEN 1 ELSE 0 END AS f_regime FROM g1),
g3 AS (SELECT *, f_crisis * f_drawdown * f_regime AS gate, least(greatest(1 / (1 + exp(-5 * (abs(pctile - 0.5) - 0.3))), 0.3), 0.7) * (f_crisis * f_drawdown * f_regime) - 0.0015 * (1 + 2 * coalesce(vol50, 0.02)) AS gated FROM g2)"""


def gated(spark, base):
    """Bars with the market state that the gate reads: crisis level, fall from the running peak, regime of the previous bars."""
    def cols(d, w):
        d = add_strategy_columns(d, w).withColumns(st.previous_rows_regime(w))
        d = d.withColumns({"_last": F.collect_list("rsi").over(w.rowsBetween(-49, 0)), "crisis": F.when(F.abs("_ret") > 5, 0.8).otherwise(0.1)})
        pctile = F.when(F.size("_last") >= 50, F.size(F.filter("_last", lambda v: v <= c("rsi"))) / F.lit(50.0)).otherwise(0.5)
        d = d.withColumns({"drawdown": (c("peak") - c("close")) / c("peak"), "regime": F.when(c("sma_regime") == "sideways", "normal").otherwise(c("sma_regime")), "pctile": pctile})
        d = d.withColumn("gate", sc.ml_gate(c("crisis"), c("drawdown"), c("regime")))
        return d.withColumn("p_ml", sc.heuristic_probability(c("pctile")) * c("gate") - sc.adaptive_cost(F.coalesce("vol50", F.lit(0.02))))
    bars = running_bars(indexed_bars(spark, base), {"peak": ("max", F.col("close"))})
    return over_chunks(bars, cols).select(*SERIES, "bar_idx", "ts_s", "p_rb", "p_ml", "crisis", "drawdown", "regime", "gate", "pctile", "vol50")


@query("gated_signals", "P8 F13", _sel(GATE_SQL, {"drawdown": "drawdown", "p_ml": "gated"}, "g3").replace("\nSELECT", "\nSELECT regime, gate,", 1))
def _(spark, base):
    """Model probability behind the product of crisis, drawdown and regime gates, all three from the bars."""
    return shown(gated(spark, base), "regime", "gate", "drawdown", "p_ml")


@query("gate_counts", "P8 A43", GATE_SQL + " SELECT symbol, tf, regime, count(*) AS bars, sum(f_crisis)::BIGINT AS calm, sum(f_drawdown)::BIGINT AS shallow, sum(f_regime)::BIGINT AS allowed, sum(gate)::BIGINT AS passed FROM g3 GROUP BY ALL")
def _(spark, base):
    df = gated(spark, base)
    return df.groupBy(*SERIES, "regime").agg(
        F.count(F.lit(1)).alias("bars"), F.sum(flag(c("crisis") < 0.7)).alias("calm"), F.sum(flag(c("drawdown") < 0.20)).alias("shallow"),
        F.sum(flag(c("regime").isin("normal", "bull", "recovery"))).alias("allowed"), F.sum(c("gate").cast("long")).alias("passed"))


JOINED_SQL = GATE_SQL + f""",
rb AS (SELECT symbol, tf, ts_s, p_rb FROM g3 WHERE bar_idx >= 50 AND p_rb > -1), ml AS (SELECT symbol, tf, ts_s, gated AS p_ml, gate FROM g3 WHERE bar_idx >= 50 AND gate = 1)"""


@query("joined_streams", "J4 F16", JOINED_SQL + f""" SELECT symbol, tf, ts_s, {q.r('p_rb')} AS p_rb, {q.r('p_ml')} AS p_ml, {q.r('0.45 * p_rb + 0.45 * p_ml')} AS p_hyb,
 CASE WHEN p_rb > 0.05 AND p_ml > 0 THEN 'both' WHEN p_rb > 0.05 THEN 'rule' WHEN p_ml > 0 THEN 'ml' ELSE 'none' END AS who FROM rb JOIN ml USING (symbol, tf, ts_s)""")
def _(spark, base):
    """Two signal tables of their own rows, joined where both have a bar."""
    df = cut(gated(spark, base).where("bar_idx >= 50"))
    rule = df.where("p_rb > -1").select(*SERIES, "ts_s", "p_rb")
    model = df.where("gate = 1").select(*SERIES, "ts_s", "p_ml")
    both = rule.join(model, [*SERIES, "ts_s"])
    a, b = c("p_rb") > 0.05, c("p_ml") > 0
    who = F.when(a & b, "both").when(a, "rule").when(b, "ml").otherwise("none")
    return shown(both.withColumns({"p_hyb": 0.45 * c("p_rb") + 0.45 * c("p_ml"), "who": who}), "p_rb", "p_ml", "p_hyb", "who", keys=[*SERIES, "ts_s"])


CONFIRMED_SQL = """WITH r AS (SELECT event_type AS symbol, event_id AS rule_id, ts FROM events WHERE value > 80 AND event_type <> 'error'),
m AS (SELECT event_type AS symbol, event_id AS model_id, ts FROM events WHERE value < 15),
p AS (SELECT r.*, m.model_id, (epoch_us(m.ts) - epoch_us(r.ts)) / 1e6 AS lag_s FROM r JOIN m ON m.symbol = r.symbol AND m.ts >= r.ts AND m.ts <= r.ts + INTERVAL 10 MINUTE),
wm AS (SELECT least((SELECT max(epoch_ms(ts)) FROM r), (SELECT max(epoch_ms(ts)) FROM m)) - 300000 AS w)
SELECT symbol, rule_id, model_id, round(lag_s, 3) + 0.0 AS lag_s FROM p UNION ALL
SELECT symbol, rule_id, NULL, NULL FROM r, wm WHERE rule_id NOT IN (SELECT rule_id FROM p) AND epoch_ms(ts) + 600000 < w"""


@query("stream_confirmed_signals", "J4 T15", CONFIRMED_SQL)
def _(spark, base):
    """Rule signals of one stream with the model signals of another up to ten minutes later; those nobody confirmed come once the watermark has passed."""
    ticks = tick_stream(spark, base)
    rule = ticks.where("price > 80 AND symbol <> 'error'").select("symbol", "ts", c("event_id").alias("signal_id"))
    model = tick_stream(spark, base).where("price < 15").select("symbol", "ts", c("event_id").alias("signal_id"))
    out = drain(spark, confirmed_signals(rule, model))
    return out.select("symbol", "rule_id", "model_id", (F.round("lag_s", 3) + F.lit(0.0)).alias("lag_s"))


SWITCHES = list(product((False, True), repeat=4))
_TESTS = {"rsi": "rsi < 40", "ema": "e9 / e21 >= 0.8", "volume": "vr >= 1.2", "atr": "atr_pct <= 2.5"}


@query("switched_entries", "P10", so.BASE + " SELECT symbol, tf, n.switches, count(*) FILTER (" + " AND ".join(
    f"(NOT contains(n.switches, '{k}') OR coalesce({t}, false))" for k, t in _TESTS.items()) + ") AS entries, count(*) AS bars FROM s2, (VALUES " + ", ".join(
    f"('{'+'.join(k for k, on in zip(_TESTS, s) if on) or 'none'}')" for s in SWITCHES) + ") n(switches) GROUP BY ALL")
def _(spark, base):
    """Entries under every combination of the four conditions of the improved rule, each of which can be switched off."""
    df = so.base_frame(spark, base).withColumn("ema_ratio", ratio("e9", "e21"))
    rules = {"+".join(k for k, on in zip(_TESTS, s) if on) or "none": sc.rule_entry(
        c("rsi"), c("ema_ratio"), c("vr"), c("atr_pct"), rsi_below=40 if s[0] else None, ema_least=0.8 if s[1] else None, volume_least=1.2 if s[2] else None, atr_most=2.5 if s[3] else None) for s in SWITCHES}
    counts = df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("bars"), *[F.count_if(rule).alias(name) for name, rule in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("switches"), F.col(f"`{n}`").alias("entries")) for n in rules]))
    return counts.select(*SERIES, "bars", pairs.alias("p")).select(*SERIES, "bars", "p.switches", "p.entries")


LEAD_S = 168 * 3600
HALTS_SQL = f"""WITH raw_bars AS ({q.event_bars('1h', 3600)}), bars AS (SELECT *, row_number() OVER ({q.SER} ORDER BY ts_s) - 1 AS bar_idx FROM raw_bars),
f AS (SELECT *, close / lag(close) OVER ({q.SER} ORDER BY bar_idx) - 1 AS ret FROM bars),
halt AS (SELECT symbol, ts_s + 3600 AS a, ts_s + 3600 + CASE WHEN ret < -0.95 THEN 43200 ELSE 14400 END AS b FROM f WHERE ret < -0.9),
o AS (SELECT *, max(b) OVER (PARTITION BY symbol ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM halt),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY a, b) AS n FROM o),
halted AS (SELECT symbol, min(a) AS a, max(b) AS b FROM i GROUP BY symbol, n),
win AS (SELECT symbol, bar_idx AS window_id, ts_s AS a, ts_s + 21600 AS b FROM f WHERE ret > 8)"""


@query("halt_windows", "A39 J10", HALTS_SQL + f""" SELECT w.symbol, w.window_id, count(h.a) FILTER (h.a < w.b AND h.b > w.a) AS halts, {q.r('coalesce(sum(least(h.b, w.b) - greatest(h.a, w.a)) FILTER (h.a < w.b AND h.b > w.a), 0) / 21600.0')} AS halt_rate,
 {q.r('(w.a - min(h.a) FILTER (h.a < w.a)) / 3600.0', 4)} AS lead_h FROM win w LEFT JOIN halted h ON h.symbol = w.symbol AND h.a < w.b AND h.b > w.a - {LEAD_S} GROUP BY w.symbol, w.window_id, w.a, w.b""")
def _(spark, base):
    """Event windows against trading halts: share of the window that was halted, hours from the first halt within the week before to its start."""
    return halt_windows(spark, base)


def halt_windows(spark, base):
    bars = cut(over_chunks(indexed_bars(spark, base).where("tf = '1h'"), lambda d, w: d.withColumn("ret", ratio("close", F.lag("close", 1).over(w)) - 1), before=8))
    over = F.when(c("ret") < -0.95, 43200).otherwise(14400)
    halts = iv.merged(bars.where("ret < -0.9").select("symbol", (c("ts_s") + 3600).alias("start"), (c("ts_s") + 3600 + over).alias("end")), ["symbol"])
    events = bars.where("ret > 8").select("symbol", c("bar_idx").alias("window_id"), c("ts_s").alias("at"), (c("ts_s") + 21600).alias("until"))
    looked = events.select("*", (c("at") - LEAD_S).alias("start"), c("until").alias("end"))
    met = iv.overlapping(looked, halts.select("symbol", c("start").alias("r_start"), c("end").alias("r_end")), ["symbol"], 86400 * 8)
    inside = c("r_end") > c("at")
    per = met.groupBy("symbol", "window_id").agg(
        F.count_if(inside).alias("halts"), F.sum(F.when(inside, F.least("r_end", "until") - F.greatest("r_start", "at"))).alias("halted"), F.min(F.when(c("r_start") < c("at"), c("r_start"))).alias("first"))
    out = events.join(per, ["symbol", "window_id"], "left")
    return out.select("symbol", "window_id", F.coalesce("halts", F.lit(0)).alias("halts"), rounded(F.coalesce("halted", F.lit(0)) / 21600.0).alias("halt_rate"), rounded((c("at") - c("first")) / 3600.0, 4).alias("lead_h"))


@query("crisis_validation", "A39", HALTS_SQL + f""", w AS (SELECT w.symbol, w.window_id, coalesce(sum(least(h.b, w.b) - greatest(h.a, w.a)) FILTER (h.a < w.b AND h.b > w.a), 0) / 21600.0 AS rate, (w.a - min(h.a) FILTER (h.a < w.a)) / 3600.0 AS lead_h
  FROM win w LEFT JOIN halted h ON h.symbol = w.symbol AND h.a < w.b AND h.b > w.a - {LEAD_S} GROUP BY w.symbol, w.window_id, w.a, w.b)
 SELECT symbol, count(*) AS windows, {q.r('avg(rate)', 5)} AS halt_rate, count(*) FILTER (rate > 0) AS caught, {q.r('avg(lead_h)', 4)} AS mean_lead_h FROM w GROUP BY symbol""")
def _(spark, base):
    """Halt rate and lead over all event windows of a series."""
    return halt_windows(spark, base).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("windows"), rounded(F.avg("halt_rate"), 5).alias("halt_rate"), F.count_if(c("halt_rate") > 0).alias("caught"), rounded(F.avg("lead_h"), 4).alias("mean_lead_h"))
