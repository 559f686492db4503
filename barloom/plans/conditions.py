"""State queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barloom.functions.columns import flag, pct_change, ratio, rounded, rolling_std, sma
from barloom.operators import indicators as ind
from barloom.operators import states as st
from barloom.operators.bars import ohlcv
from barloom.operators.chains import greedy_chain, price_latch
from barloom.operators.chunks import over_chunks, running_bars, with_bar_index
from barloom.operators.lineage import cut
from barloom.operators.quantiles import quantile_columns
from barloom.plans import sql as q
from barloom.plans.base import indexed_bars, shown
from barloom.plans.indicators import RSI_STAGES, _sel, add_trend
from barloom.plans.registry import query
from barloom.plans.trades import TR, trades
from barloom.schema import SERIES
from barloom.sources.tables import event_ticks, read_table

K = "symbol, tf, bar_idx"


def _wret(n):
    return f"(CASE WHEN bar_idx >= {n - 1} THEN coalesce(close / nullif({q.lag('close', n - 1)}, 0) - 1, 0) ELSE 0 END)"


def _kind(x):
    return f"(CASE WHEN {x} > 0.02 THEN 'BULL' WHEN {x} < -0.02 THEN 'BEAR' ELSE 'SIDEWAYS' END)"


VOTE_SQL = q.with_stages(
    q.BARS, ("vr", "bars", f"{_wret(96)} AS r96, {_wret(672)} AS r672, {_wret(2880)} AS r2880, {_wret(4)} AS r4, first_value(close) OVER {q.past()} AS fc"),
    ("vk", "vr", f"{_kind('r96')} AS k1, {_kind('r672')} AS k2, {_kind('r2880')} AS k3"),
    ("vt", "vk", "CASE WHEN k1 = k2 OR k1 = k3 THEN k1 WHEN k2 = k3 THEN k2 ELSE 'UNKNOWN' END AS regime, CASE WHEN k1 = k2 AND k2 = k3 THEN 3 WHEN k1 = k2 OR k1 = k3 OR k2 = k3 THEN 2 ELSE 1 END AS votes"),
    ("hy", "vt", f"CASE WHEN bar_idx = 0 OR regime = {q.lag('regime')} THEN regime END AS seen"),
    ("hc", "hy", f"last_value(seen IGNORE NULLS) OVER {q.past()} AS confirmed"),
    ("hw", "hc", f"{q.lag('confirmed')} AS was"),
    ("hz", "hw", f"last_value(CASE WHEN bar_idx > 0 AND confirmed <> was THEN bar_idx END IGNORE NULLS) OVER {q.past()} AS changed_at"))


@query("regime_vote", "T1 T2", VOTE_SQL + f" SELECT {K}, regime, votes, confirmed, changed_at, {q.r('r96')} AS ret_1d FROM hz")
def _(spark, base):
    df = over_chunks(indexed_bars(spark, base), st.add_regime_vote, before=4096)
    return shown(st.hysteresis(df), "regime", "votes", "confirmed", "changed_at", "ret_1d")


RULES_SQL = """[CASE WHEN bar_idx >= 3 AND r4 <= -0.25 THEN 'EMERGENCY_1H' WHEN bar_idx >= 3 AND r4 <= -0.1 THEN 'WARNING_1H' END,
 CASE WHEN bar_idx >= 95 AND r96 <= -0.2 THEN 'CRISIS_24H' END,
 CASE WHEN bar_idx >= 671 AND r672 <= -0.25 THEN 'CRISIS_7D' WHEN bar_idx >= 671 AND r672 <= -0.12 THEN 'WARNING_7D'
  WHEN bar_idx BETWEEN 95 AND 670 AND close / fc - 1 <= -0.25 THEN 'CRISIS_SINCE_START' WHEN bar_idx BETWEEN 95 AND 670 AND close / fc - 1 <= -0.12 THEN 'WARNING_SINCE_START' END]"""

STATE_SQL = VOTE_SQL + f""",
c1 AS (SELECT *, array_to_string(list_filter({RULES_SQL}, lambda x: x IS NOT NULL), '|') AS rules, {q.sma('close', 20)} AS s20, {q.pct('close')} AS ret FROM hz),
c2 AS (SELECT *, CASE WHEN rules LIKE '%EMERGENCY%' THEN 'HALT' WHEN rules LIKE '%CRISIS%' THEN 'CRISIS' WHEN rules LIKE '%WARNING%' THEN 'ALERT' ELSE 'NORMAL' END AS alert,
  {q.std('ret', 20)} AS v20, max(close) OVER {q.frame(-95)} AS hi96, max(close) OVER {q.frame(-671)} AS hi7, min(close) OVER {q.frame(-671)} AS lo7,
  -arg_max(-bar_idx, (-close, -bar_idx)) OVER {q.frame(-671)} AS lo_idx FROM c1),
c3 AS (SELECT *, (close - hi7) / hi7 AS dd, coalesce((bar_idx >= 95) AND (hi96 - close) / hi96 < 0.05, false)::INT AS f1,
  coalesce(bar_idx >= 200 AND avg(v20) OVER {q.frame(-20)} / nullif(quantile_cont(v20, 0.5) OVER {q.frame(-200)}, 0) < 1.3, false)::INT AS f2,
  coalesce(bar_idx >= 100 AND avg(volume) OVER {q.frame(-20)} / nullif(quantile_cont(volume, 0.5) OVER {q.frame(-100)}, 0) >= 0.6, false)::INT AS f3,
  coalesce(bar_idx >= 29 AND close > s20 AND s20 > {q.lag('s20', 9)} * 1.02, false)::INT AS f5 FROM c2),
c4 AS (SELECT *, coalesce(bar_idx >= 287 AND dd < -0.1 AND close > lo7 * 1.03, false) AS recovering,
  CASE WHEN bar_idx >= 287 AND NOT dd < -0.1 THEN 'reset' WHEN bar_idx >= 287 AND dd < -0.1 AND close > lo7 * 1.03 THEN 'recovering' END AS ev FROM c3),
c5 AS (SELECT *, last_value(ev IGNORE NULLS) OVER {q.frame(-1000000, -1)} AS bef FROM c4),
c6 AS (SELECT *, last_value(CASE WHEN ev = 'reset' THEN -1 WHEN ev = 'recovering' AND coalesce(bef = 'reset', true) THEN lo_idx END IGNORE NULLS) OVER {q.past()} AS ref0 FROM c5),
c7 AS (SELECT *, CASE WHEN ref0 >= 0 THEN ref0 END AS recovery_bar, recovering OR coalesce(was = 'BEAR' AND confirmed IN ('SIDEWAYS', 'BULL'), false) AS checked FROM c6),
c8 AS (SELECT *, CASE WHEN checked AND bar_idx >= 96 THEN f1 + f2 + f3 + f5 + CASE WHEN coalesce(recovery_bar, changed_at) IS NULL OR bar_idx - coalesce(recovery_bar, changed_at) >= 192 THEN 1 ELSE 0 END END AS resume_score FROM c7),
c9 AS (SELECT *, CASE WHEN NOT checked THEN NULL WHEN bar_idx < 96 THEN 'CAUTIOUS' WHEN resume_score >= 4 THEN 'NORMAL' WHEN resume_score >= 3 THEN 'CAUTIOUS' ELSE 'HALT' END AS resume FROM c8)
SELECT {K}, rules, alert, recovering::INT AS recovering, recovery_bar, resume_score, resume, CASE WHEN alert IN ('HALT', 'CRISIS') THEN 'HALT' WHEN alert = 'ALERT' THEN 'CAUTION'
 WHEN resume = 'HALT' THEN 'HALT' WHEN resume = 'CAUTIOUS' THEN 'CAUTION' ELSE 'CONTINUE' END AS recommendation FROM c9"""


@query("market_state", "T1 T2 T3 T4", STATE_SQL)
def _(spark, base):
    df = st.market_state(indexed_bars(spark, base))
    return df.select("symbol", "tf", "bar_idx", F.array_join("rules", "|").alias("rules"), "alert", F.col("recovering").cast("int").alias("recovering"),
                     "recovery_bar", "resume_score", "resume", "recommendation")


T9_SQL = q.with_stages(
    RSI_STAGES, ("t0", "avgs", f"{q.rsi()} AS rsi, {q.TR}, first_value(close) OVER {q.past()} AS fc, avg(close) OVER {q.frame(-20)} AS ms, avg(close) OVER {q.frame(-200)} AS ml, "
     f"max(close) OVER {q.frame(-720)} AS hi, stddev_samp(close) OVER {q.frame(-20)} AS sd21, stddev_samp(close) OVER {q.frame(-200, -21)} AS sd180, "
     f"{q.lag('close', 100)} AS mid, {q.lag('close', 720)} AS far, {q.lag('close', 719)} AS far719, {q.sma('close', 20)} AS m20, {q.sma('close', 200)} AS m200, {q.sma('volume', 20)} AS v20"),
    ("t1", "t0", f"(close - coalesce(far, fc)) / coalesce(far, fc) AS r, (close - hi) / hi AS dd, {q.sma('tr', 14)} AS atr, CASE WHEN bar_idx >= 719 THEN (close - far719) / far719 ELSE 0 END AS mom"),
    ("t2", "t1", f"CASE WHEN bar_idx < 200 THEN 'SIDEWAYS' WHEN dd < -0.3 AND sd21 / close > sd180 / mid * 1.5 THEN 'CRISIS' WHEN dd < -0.3 AND r < -0.1 THEN 'BEAR_MARKET' "
     f"WHEN ms > ml * 1.02 AND r > 0.1 THEN 'BULL_TREND' WHEN ms < ml * 0.98 AND r < -0.1 THEN 'BEAR_MARKET' ELSE 'SIDEWAYS' END AS trend_regime, {q.sma('atr', 100)} AS a100"),
    ("t3", "t2", "CASE WHEN a100 > 0 THEN atr / a100 ELSE 1 END AS vr"),
    ("t4", "t3", "CASE WHEN bar_idx < 199 THEN 'SIDEWAYS' WHEN m20 > m200 * 1.05 AND mom > 0.15 AND vr < 2 THEN 'BULL_TREND' WHEN m20 < m200 AND rsi < 25 AND volume > v20 * 1.5 AND mom > -0.2 THEN 'RECOVERING_BEAR' "
     "WHEN vr > 3 THEN 'VOLATILE' WHEN m20 < m200 * 0.95 AND mom < -0.1 THEN 'BEAR_TREND' ELSE 'SIDEWAYS' END AS gate"))
T11_SQL = f"""CASE WHEN bar_idx < 200 THEN 'sideways' WHEN close > avg(close) OVER {q.frame(-50, -1)} AND avg(close) OVER {q.frame(-50, -1)} > avg(close) OVER {q.frame(-200, -1)} THEN 'bull'
 WHEN close < avg(close) OVER {q.frame(-50, -1)} AND avg(close) OVER {q.frame(-50, -1)} < avg(close) OVER {q.frame(-200, -1)} THEN 'bear' ELSE 'sideways' END AS sma_regime,
 CASE WHEN bar_idx >= 20 AND max(high - low) OVER {q.frame(-14, -1)} / avg(close) OVER {q.frame(-14, -1)} > 0.04 THEN 1 ELSE 0 END AS range_crisis"""


def regimes(bars):
    bars = running_bars(bars, {"first_close": ("first", F.col("close"))})
    def cols(d, w):
        d = ind.add_atr(ind.add_rsi(d, w), w)
        return st.add_regime_gate(st.add_trend_regime(d, w), w).withColumns(st.previous_rows_regime(w))
    return over_chunks(bars, cols, before=1024)


@query("trend_regimes", "T9 T10 T11", T9_SQL + f""" SELECT {K}, trend_regime, {q.r("CASE trend_regime WHEN 'CRISIS' THEN least(1, abs(dd) / 0.3) WHEN 'SIDEWAYS' THEN 0.5 ELSE (least(1, abs(ms - ml) / ml / 0.05) + least(1, abs(r) / 0.2)) / 2 END")} AS trend_confidence,
 gate, CASE gate WHEN 'BULL_TREND' THEN 1.0 WHEN 'RECOVERING_BEAR' THEN 0.5 ELSE 0 END::DOUBLE AS gate_confidence, {T11_SQL} FROM t4""")
def _(spark, base):
    return shown(regimes(indexed_bars(spark, base)), "trend_regime", "trend_confidence", "gate", "gate_confidence", "sma_regime", "range_crisis")


@query("regime_distribution", "A18", T9_SQL + " SELECT symbol, tf, trend_regime, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY symbol, tf), 4) AS pct FROM t4 GROUP BY symbol, tf, trend_regime")
def _(spark, base):
    n = regimes(indexed_bars(spark, base)).groupBy(*SERIES, "trend_regime").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*SERIES)), 4))


# ------------------------------------------------------------------ latches

LATCH = q.with_stages(
    RSI_STAGES, ("i0", "avgs", f"{q.rsi(variant='inverse')} AS rsi, {q.sma('close', 9)} AS f9, {q.sma('close', 21)} AS s21, {q.sma('close', 50)} AS m50, {q.sma('close', 20)} AS mid, {q.std('close', 20)} AS sd, "
     f"{q.ema('close', 9)} AS e9, {q.sma('volume', 14)} AS v14, {q.pct('close')} AS ret"),
    ("i1", "i0", f"mid - 2 * sd AS lo, mid + 2 * sd AS up, coalesce({q.lag('f9')} > {q.lag('s21')}, false) AS pa, coalesce(f9 > s21, false) AS ca, {q.std('ret', 50)} AS vol50"),
    ("i2", "i1", "CASE WHEN rsi > 20 AND rsi < 80 AND close > e9 AND volume > v14 AND (close - lo) / nullif(up - lo, 0) > 0.25 AND (close - lo) / nullif(up - lo, 0) < 0.75 THEN 1 ELSE 0 END AS prod"),
    ("i3", "i2", "coalesce((0.5 * CASE WHEN vol50 IS NOT NULL THEN least(greatest(vol50 / 0.05, 0), 1) END + 0.5 * CASE WHEN v14 IS NOT NULL THEN least(greatest(volume / v14, 0), 2) / 2 END) * prod - 0.0015 "
     "- CASE WHEN vol50 IS NOT NULL THEN least(greatest(vol50 * 2.0, 0), 0.5) END, -1) AS p_rb"))


def _latch_sql(src, enter, leave, name):
    return (f"SELECT symbol, tf, bar_idx, m - coalesce(lag(m) OVER (PARTITION BY symbol, tf ORDER BY bar_idx), 0) AS {name} FROM (SELECT symbol, tf, bar_idx, coalesce(last_value(CASE WHEN {enter} THEN 1 WHEN {leave} THEN 0 END IGNORE NULLS) OVER {q.past()}, 0) AS m FROM {src})")


LATCHES = {
    "ma_signal": ("s21 IS NOT NULL AND bar_idx > 0 AND NOT pa AND ca", "s21 IS NOT NULL AND pa AND NOT ca"),
    "bollinger_signal": ("close <= lo", "close >= up"),
    "combined_signal": ("rsi < 40 AND close > m50 AND close < lo * 1.02", "m50 IS NOT NULL AND (rsi > 60 OR close < m50)"),
    "rule_signal": ("bar_idx >= 20 AND p_rb > 0.05", "bar_idx >= 20 AND (p_rb < -0.1 OR prod = 0)"),
}


def add_strategy_columns(d, w):
    d = ind.add_bollinger(ind.add_ema(ind.add_rsi(d, w, variant="inverse"), {"ema_9": 9}), w)
    d = d.withColumns({"f9": sma("close", 9, w), "s21": sma("close", 21, w), "m50": sma("close", 50, w), "v14": sma("volume", 14, w),
                       "_ret": pct_change("close", 1, w)})
    d = d.withColumns({"vol50": rolling_std("_ret", 50, w), "_ca": F.coalesce(F.col("f9") > F.col("s21"), F.lit(False))})
    d = d.withColumn("_pa", F.coalesce(F.lag("_ca", 1).over(w), F.lit(False)))
    c = F.col
    filters = {
        "i1_rsi": flag((c("rsi") > 20) & (c("rsi") < 80)), "i2_ema": flag(c("close") > c("ema_9")), "i3_volume": flag(c("volume") > c("v14")),
        "i4_bb": flag((c("bb_position") > 0.25) & (c("bb_position") < 0.75))}
    d = d.withColumns(filters)
    from barloom.functions.scores import rule_score
    return d.withColumn("filters", c("i1_rsi") * c("i2_ema") * c("i3_volume") * c("i4_bb")).withColumn(
        "p_rb", rule_score(c("vol50"), ratio("volume", "v14"), c("filters")))


@query("strategy_latches", "T12 W24", LATCH + " SELECT * FROM " + " JOIN ".join(
    f"({_latch_sql('i3', a, b, n)})" + (f" USING ({K})" if i else "") for i, (n, (a, b)) in enumerate(LATCHES.items())))
def _(spark, base):
    c = F.col
    df = over_chunks(indexed_bars(spark, base), add_strategy_columns)
    ready, far = c("s21").isNotNull() & (c("bar_idx") > 0), c("bar_idx") >= 20
    events = {
        "ma_signal": (ready & ~c("_pa") & c("_ca"), ready & c("_pa") & ~c("_ca")),
        "bollinger_signal": (c("close") <= c("bb_lower"), c("close") >= c("bb_upper")),
        "combined_signal": ((c("rsi") < 40) & (c("close") > c("m50")) & (c("close") < c("bb_lower") * 1.02),
                            c("m50").isNotNull() & ((c("rsi") > 60) | (c("close") < c("m50")))),
        "rule_signal": (far & (c("p_rb") > 0.05), far & ((c("p_rb") < -0.1) | (c("filters") == 0)))}
    marks = {f"_{n}": ("last", F.when(a, 1).when(b, 0)) for n, (a, b) in events.items()}
    df = running_bars(df, marks)
    def emit(d, w):
        return d.withColumns({n: F.coalesce(c(f"_{n}"), F.lit(0)) - F.coalesce(F.lag(f"_{n}", 1).over(w), F.lit(0)) for n in events})
    return shown(over_chunks(df, emit, before=1), *events)


def rsi_latch_rows(bars):
    def cols(d, w):
        d = ind.add_ema(ind.add_rsi(d, w, variant="inverse"), {"ema_50": 50})
        up = F.col("close") > F.col("ema_50")
        return d.where(F.col("rsi").isNotNull()).select(
            *SERIES, "bar_idx", "chunk", F.col("close").alias("price"), ((F.col("rsi") < 45) & up).alias("enter"),
            ((F.col("rsi") > 65) | ~up).alias("forced"), (F.col("close") / 1.03).alias("up"), F.lit(float("inf")).alias("down"))
    return over_chunks(bars, cols)


def hybrid_rows(bars):
    def cols(d, w):
        d = ind.add_atr(ind.add_bollinger(ind.add_rsi(d, w, variant="inverse"), w), w)
        d = d.withColumns({"f9": sma("close", 9, w), "s21": sma("close", 21, w)})
        c = F.col
        from barloom.functions.scores import hybrid_simple
        d = d.withColumn("p", hybrid_simple(c("f9"), c("s21"), c("rsi"), c("close"), c("bb_lower"), c("bb_upper")))
        atr = F.coalesce(c("atr"), c("close") * 0.02)
        trend = F.coalesce(c("f9") > c("s21"), F.lit(False))
        return d.where("bar_idx >= 21").select(
            *SERIES, "bar_idx", "chunk", c("close").alias("price"), (c("p").__gt__(0.3) & trend).alias("enter"), (c("p") < -0.3).alias("forced"),
            (c("close") - 2 * atr).alias("up"), (c("close") + 1.5 * atr).alias("down"))
    return over_chunks(bars, cols)


LATCH_ROWS = q.with_stages(
    RSI_STAGES, ("h0", "avgs", f"{q.rsi(variant='inverse')} AS rsi, {q.ema('close', 50)} AS e50, {q.TR}, {q.sma('close', 9)} AS f9, {q.sma('close', 21)} AS s21, {q.sma('close', 20)} AS mid, {q.std('close', 20)} AS sd"),
    ("h1", "h0", f"coalesce({q.sma('tr', 14)}, close * 0.02) AS atr, 0.4 * CASE WHEN f9 > s21 THEN 1 ELSE -1 END + 0.4 * (0.5 * CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END "
     "+ 0.5 * CASE WHEN close < mid - 2 * sd THEN 1 WHEN close > mid + 2 * sd THEN -1 ELSE 0 END) + 0.2 * CASE WHEN close > s21 THEN 1 ELSE -1 END AS p")).replace("WITH raw", "WITH RECURSIVE raw", 1) + """,
lr AS (SELECT symbol, tf, 'rsi' AS kind, bar_idx, close AS price, rsi < 45 AND close > e50 AS enter, rsi > 65 OR NOT close > e50 AS forced, close / 1.03 AS up, 1e300 AS down FROM h1 WHERE rsi IS NOT NULL
 UNION ALL SELECT symbol, tf, 'hybrid', bar_idx, close, p > 0.3 AND f9 > s21, p < -0.3, close - 2 * atr, close + 1.5 * atr FROM h1 WHERE bar_idx >= 21),
ln AS (SELECT *, row_number() OVER (PARTITION BY symbol, tf, kind ORDER BY bar_idx) AS n FROM lr),
fold AS (SELECT symbol, tf, kind, bar_idx, n, CASE WHEN enter THEN price END AS held, CASE WHEN enter THEN 1 ELSE 0 END AS signal FROM ln WHERE n = 1
 UNION ALL SELECT l.symbol, l.tf, l.kind, l.bar_idx, l.n, CASE WHEN f.held IS NULL THEN CASE WHEN l.enter THEN l.price END WHEN l.forced OR l.up > f.held OR l.down < f.held THEN NULL ELSE f.held END,
  CASE WHEN f.held IS NULL THEN CASE WHEN l.enter THEN 1 ELSE 0 END WHEN l.forced OR l.up > f.held OR l.down < f.held THEN -1 ELSE 0 END
  FROM fold f JOIN ln l ON l.symbol = f.symbol AND l.tf = f.tf AND l.kind = f.kind AND l.n = f.n + 1)"""


@query("price_latches", "T13 F17", LATCH_ROWS + " SELECT symbol, tf, kind, bar_idx, signal FROM fold WHERE signal <> 0")
def _(spark, base):
    bars = cut(indexed_bars(spark, base))
    a = price_latch(rsi_latch_rows(bars)).withColumn("kind", F.lit("rsi"))
    b = price_latch(hybrid_rows(bars)).withColumn("kind", F.lit("hybrid"))
    return a.unionByName(b).select("symbol", "tf", "kind", "bar_idx", "signal")


# ------------------------------------------------------------------ halts, limits, watches

HALT_SQL = q.with_stages(q.BARS, ("hr", "bars", f"{q.pct('close')} AS ret, {q.lag('volume')} AS pv")).replace("WITH raw", "WITH RECURSIVE raw", 1) + """,
hc AS (SELECT symbol, tf, ts_s // 3600 AS hour, bar_idx, CASE WHEN volume > 3 * pv THEN 4 WHEN ret > 4 THEN 6 WHEN ret < -0.9 THEN 24 END AS hours FROM hr),
hh AS (SELECT * FROM hc WHERE hours IS NOT NULL),
hop AS (SELECT a.symbol, a.tf, a.hour, a.hours, b.hour AS nxt FROM hh a ASOF LEFT JOIN (SELECT symbol, tf, hour FROM hh) b ON a.symbol = b.symbol AND a.tf = b.tf AND b.hour >= a.hour + a.hours),
ch AS (SELECT symbol, tf, hour, hours, nxt FROM hop WHERE (symbol, tf, hour) IN (SELECT (symbol, tf, min(hour)) FROM hop GROUP BY symbol, tf)
 UNION ALL SELECT h.symbol, h.tf, h.hour, h.hours, h.nxt FROM ch c JOIN hop h ON h.symbol = c.symbol AND h.tf = c.tf AND h.hour = c.nxt),
fin AS (SELECT hc.*, ch.hour + ch.hours AS until FROM hc ASOF LEFT JOIN ch ON hc.symbol = ch.symbol AND hc.tf = ch.tf AND hc.hour >= ch.hour)
SELECT symbol, tf, bar_idx, CASE WHEN until > hour THEN 'HALTED' ELSE 'ACTIVE' END AS state, CASE WHEN until > hour THEN until END AS halted_until FROM fin"""


@query("halt_carry_over", "T5", HALT_SQL)
def _(spark, base):
    """A live halt hides later triggers; a trigger after it starts a new halt."""
    def cols(d, w):
        ret, before = pct_change("close", 1, w), F.lag("volume", 1).over(w)
        return d.withColumns({"hour": F.floor(F.col("ts_s") / 3600).cast("long"),
                              "hours": F.when(F.col("volume") > 3 * before, 4).when(ret > 4, 6).when(ret < -0.9, 24)})
    bars = cut(over_chunks(indexed_bars(spark, base), cols, before=1))
    trig = bars.where(F.col("hours").isNotNull()).select(*SERIES, "bar_idx", "hour", (F.col("hour") + F.col("hours")).alias("until"))
    kept = greedy_chain(trig, "hour", "until", 24).select(*SERIES, "bar_idx", "until")
    out = running_bars(bars.join(kept, [*SERIES, "bar_idx"], "left"), {"_until": ("last", F.col("until"))})
    live = F.col("_until") > F.col("hour")
    return out.select(*SERIES, "bar_idx", F.when(live, "HALTED").otherwise("ACTIVE").alias("state"), F.when(live, F.col("_until")).alias("halted_until"))


LIMIT_SQL = TR + """, d AS (SELECT strategy, exit_s // 86400 AS day, sum(pnl) AS day_pnl, avg(pnl_pct) AS r FROM trades GROUP BY ALL),
e AS (SELECT *, 10000 * exp(sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY day)) AS value FROM d),
f AS (SELECT *, max(value) OVER (PARTITION BY strategy ORDER BY day) AS peak FROM e),
g AS (SELECT *, CASE WHEN (peak - value) / peak >= 0.2 THEN 1 ELSE 0 END AS dd_hit, CASE WHEN -r >= 0.05 THEN 1 ELSE 0 END AS day_hit FROM f)
SELECT strategy, day, day_hit, max(dd_hit) OVER (PARTITION BY strategy ORDER BY day) AS latched, """ + q.r('(peak - value) / peak', 9) + " AS drawdown FROM g"


@query("risk_limits", "T6", LIMIT_SQL)
def _(spark, base):
    from barloom.operators import ledger as lg
    e = lg.with_drawdown(lg.equity_curve(trades(spark, base), "strategy"))
    e = e.withColumns({"day_hit": flag(-F.col("day_ret") >= 0.05), "_dd": flag(F.col("drawdown") <= -0.2)})
    e = running_bars(e, {"latched": ("max", F.col("_dd"))})
    return e.select(F.col("symbol").alias("strategy"), F.floor(F.col("ts_s") / 86400).alias("day"), "day_hit", "latched",
                    rounded(-F.col("drawdown"), 9).alias("drawdown"))


def post_entry_rules(bars):
    """Two-hour watch after each entry (volume above twice its 14-bar mean): the first rule that fires.

    A 15m bar is followed by at most 7 others within two hours, so the watch is a short forward frame."""
    def cols(d, w):
        d = d.withColumn("_v14", sma("volume", 14, w))
        path = F.collect_list(F.struct("ts_s", "close", "volume")).over(w.rowsBetween(1, 8))
        d = d.withColumn("_path", path).where(F.col("volume") > 2 * F.col("_v14"))
        d = d.withColumn("_path", F.filter("_path", lambda b: b["ts_s"] - F.col("ts_s") < 7200))
        d = d.withColumn("_mv", F.transform("_path", lambda b: b["close"] / F.col("close") - 1))
        k = F.sequence(F.lit(1), F.size("_path"))
        def rule(i):
            now = F.try_element_at(F.col("_mv"), i)
            best = F.greatest(F.lit(0.0), F.array_max(F.slice("_mv", 1, i)))
            vols = F.transform("_path", lambda b: b["volume"])
            first2 = (F.try_element_at(vols, F.lit(1)) + F.try_element_at(vols, F.lit(2))) / 2
            last2 = (F.try_element_at(vols, i) + F.try_element_at(vols, i - 1)) / 2
            return (F.when((best > 0.05) & (now < best * 0.5), "bull_trap").when((i >= 2) & (best <= 0.005) & (now <= -0.003), "false_breakout")
                    .when((i >= 4) & (now < -0.02), "adverse_move").when((i >= 4) & (last2 < first2 * 0.3), "volume_drop")
                    .when((i >= 4) & (now > 0.10), "too_good"))
        d = d.withColumn("_r", F.when(F.size("_path") > 0, F.transform(k, rule)))
        at = F.array_position(F.transform("_r", lambda x: x.isNotNull()), True)
        return d.select(*SERIES, "bar_idx", "chunk", F.size("_path").cast("long").alias("watched"),
                        F.when(at > 0, at).alias("exit_after"), F.when(at > 0, F.try_element_at(F.col("_r"), at.cast("int"))).alias("reason"))
    return over_chunks(bars, cols, before=64, after=8)


WATCH_SQL = q.bars_of(q.event_bars("15m", 900)) + f""",
v AS (SELECT *, {q.sma('volume', 14)} AS v14 FROM bars), en AS (SELECT * FROM v WHERE volume > 2 * v14),
p AS (SELECT e.symbol, e.tf, e.bar_idx, b.bar_idx - e.bar_idx AS k, b.close / e.close - 1 AS mv, b.volume FROM en e JOIN bars b ON b.symbol = e.symbol AND b.tf = e.tf AND b.bar_idx BETWEEN e.bar_idx + 1 AND e.bar_idx + 8 AND b.ts_s - e.ts_s < 7200),
p2 AS (SELECT *, greatest(0, max(mv) OVER w) AS best, (volume + lag(volume) OVER w) / 2 AS l2, (first_value(volume) OVER w + nth_value(volume, 2) OVER w) / 2 AS f2 FROM p WINDOW w AS (PARTITION BY symbol, tf, bar_idx ORDER BY k)),
p3 AS (SELECT *, CASE WHEN best > 0.05 AND mv < best * 0.5 THEN 'bull_trap' WHEN k >= 2 AND best <= 0.005 AND mv <= -0.003 THEN 'false_breakout' WHEN k >= 4 AND mv < -0.02 THEN 'adverse_move'
 WHEN k >= 4 AND l2 < f2 * 0.3 THEN 'volume_drop' WHEN k >= 4 AND mv > 0.1 THEN 'too_good' END AS r FROM p2)
SELECT en.symbol, en.tf, en.bar_idx, count(k) AS watched, min(k) FILTER (r IS NOT NULL) AS exit_after, min_by(r, k) FILTER (r IS NOT NULL) AS reason FROM en LEFT JOIN p3 USING ({K}) GROUP BY ALL"""


@query("post_entry_watch", "T7 J9", WATCH_SQL)
def _(spark, base):
    return post_entry_rules(with_bar_index(ohlcv(event_ticks(spark, base), "15m")))


def order_books(spark, base):
    """The ten best levels of each side per order: open lines are bids, filled lines asks.
    The rank limit is applied before the shuffle, so a huge order stays ten rows a side."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    li = read_table(spark, base, "lineitem").select("l_orderkey", "l_linestatus", price.alias("price"), F.col("l_quantity").alias("size"))
    best = F.when(F.col("l_linestatus") == "O", -F.col("price")).otherwise(F.col("price"))
    big = F.when(F.col("l_linestatus") == "O", -F.col("size")).otherwise(F.col("size"))
    w = Window.partitionBy("l_orderkey", "l_linestatus").orderBy(best, big)
    top = li.withColumn("lvl", F.row_number().over(w)).where("lvl <= 10")
    level = F.struct("lvl", "price", "size")
    books = top.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.when(F.col("l_linestatus") == "O", level))).alias("bids"),
        F.sort_array(F.collect_list(F.when(F.col("l_linestatus") == "F", level))).alias("asks"))
    od = read_table(spark, base, "orders", "o_orderkey")
    return books.join(od, books.l_orderkey == od.o_orderkey).select("o_orderkey", "bids", "asks")


def book_summaries(spark, base):
    """Best prices, whole depth and line count per order, from plain aggregates."""
    price, side = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_linestatus")
    s = read_table(spark, base, "lineitem").groupBy("l_orderkey").agg(
        F.max(F.when(side == "O", price)).alias("bid"), F.min(F.when(side == "F", price)).alias("ask"),
        F.sum(price * F.col("l_quantity")).alias("depth"), (F.count(F.lit(1)) * 4).alias("trades"))
    od = read_table(spark, base, "orders")
    return s.join(od, s.l_orderkey == od.o_orderkey).select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), "bid", "ask", "depth", "trades", F.col("o_totalprice").alias("volume"),
        ratio(F.col("ask") - F.col("bid"), (F.col("ask") + F.col("bid")) / 2).alias("spread"))


BOOK_SQL = """WITH l AS (SELECT l_orderkey, l_extendedprice / l_quantity AS price, l_quantity AS size, l_linestatus FROM lineitem),
b AS (SELECT l_orderkey, max(price) FILTER (l_linestatus = 'O') AS bid, min(price) FILTER (l_linestatus = 'F') AS ask, sum(price * size) AS depth, count(*) * 4 AS trades FROM l GROUP BY l_orderkey),
k AS (SELECT o_orderkey, o_orderstatus AS status, bid, ask, depth, o_totalprice AS volume, trades, (ask - bid) / ((ask + bid) / 2) AS spread FROM b JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT status, quantile_cont(depth, 0.5) AS dm, quantile_cont(volume, 0.5) AS vm FROM k GROUP BY status),
f AS (SELECT k.*, CASE WHEN spread IS NULL OR spread >= 0.01 THEN 1 ELSE 0 END AS wide_spread, CASE WHEN depth / dm < 0.3 THEN 1 ELSE 0 END AS thin_depth,
 CASE WHEN volume / vm < 0.2 THEN 1 ELSE 0 END AS low_volume, CASE WHEN trades / 15.0 < 1 THEN 1 ELSE 0 END AS few_trades FROM k JOIN m USING (status))
SELECT o_orderkey, wide_spread, thin_depth, low_volume, few_trades, wide_spread + thin_depth + low_volume + few_trades AS n_triggered,
 CASE wide_spread + thin_depth + low_volume + few_trades WHEN 4 THEN 'FROZEN' WHEN 3 THEN 'CRISIS' WHEN 0 THEN 'NORMAL' ELSE 'WARNING' END AS liquidity FROM f"""


@query("liquidity_monitor", "T8 F32", BOOK_SQL)
def _(spark, base):
    k = cut(book_summaries(spark, base))
    dm = quantile_columns(k, ["status"], "depth", {"dm": 0.5})
    vm = quantile_columns(k, ["status"], "volume", {"vm": 0.5})
    k = k.join(dm, "status", "left").join(vm, "status", "left")
    out = st.liquidity_factors(F.col("spread"), F.col("depth"), F.col("volume"), F.col("trades"), F.col("dm"), F.col("vm"))
    return k.select("o_orderkey", *[c.alias(n) for n, c in out.items()])


from barloom.strategies import run_strategy, strategy  # noqa: E402


@strategy("bollinger")
def _bollinger(bars):
    """Buy at the lower band, sell at the upper one."""
    df = over_chunks(bars, ind.add_bollinger, before=64)
    return st.latch(df, F.col("close") <= F.col("bb_lower"), F.col("close") >= F.col("bb_upper"))


@strategy("moving_average")
def _moving_average(bars):
    def cols(d, w):
        return d.withColumns({"_f": sma("close", 9, w), "_s": sma("close", 21, w)})
    df = over_chunks(bars, cols, before=64)
    return st.latch(df, F.col("_f") > F.col("_s"), F.col("_f") <= F.col("_s"))


X1_SQL = LATCH + f""", a AS ({_latch_sql('i3', 'close <= lo', 'close >= up', 'signal')}), b AS ({_latch_sql('i3', 'f9 > s21', 'f9 <= s21', 'signal')})
SELECT symbol, tf, 'bollinger' AS strategy, signal, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT symbol, tf, 'moving_average', signal, count(*) FROM b GROUP BY ALL"""


@query("registered_strategies", "X1 U1 A16", X1_SQL)
def _(spark, base):
    """Every registered strategy over the same bars, their signals stacked."""
    bars = cut(indexed_bars(spark, base))
    both = run_strategy("bollinger", bars).unionByName(run_strategy("moving_average", bars))
    return both.groupBy("symbol", "tf", "strategy", "signal").agg(F.count(F.lit(1)).alias("n"))
