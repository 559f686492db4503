"""Label, barrier, sweep and chain queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barloom.functions.columns import ratio, rounded, rolling_std, sma
from barloom.operators import indicators as ind
from barloom.operators import labels as lb
from barloom.operators.bars import ohlcv
from barloom.operators.chains import greedy_chain, price_latch
from barloom.operators.chunks import over_chunks, running_bars
from barloom.operators.lineage import cut
from barloom.plans import sql as q
from barloom.plans.base import indexed_bars, shown
from barloom.plans.indicators import BB_STAGES, RSI_STAGES, _sel
from barloom.plans.registry import query
from barloom.schema import SERIES

K = "symbol, tf, bar_idx"
H = 48
# the prices of the test tables move by multiples from bar to bar, so the barriers are wide
TP, SL = 3.0, 0.9

LEAD_SQL = q.BARS + f""", f AS (SELECT *, lead(open, 1) OVER w AS e, lead(close, 12) OVER w AS x, lead(open, 2) OVER w AS x2 FROM bars WINDOW w AS (PARTITION BY symbol, tf ORDER BY bar_idx))
SELECT {K}, {q.r('(x - e) / e')} AS raw_ret, {q.r('(x - e) / e - 0.003')} AS fee_ret, CASE WHEN (x - e) / e - 0.003 > 0 THEN 1 ELSE 0 END AS target_fee,
 CASE WHEN (x - e) / e > 0 THEN 1 ELSE 0 END AS target_raw, {q.r('x2 * 0.9995 * 0.999 / (e * 1.0005 * 1.001) - 1')} AS next_open FROM f WHERE x IS NOT NULL"""


@query("forward_return_label", "L1 L2", LEAD_SQL)
def _(spark, base):
    df = over_chunks(indexed_bars(spark, base), lambda d, w: d.withColumns(
        {**lb.forward_return(w, 12), "next_open": lb.next_open_trade(w)}), before=0, after=16)
    return shown(df.where(F.col("raw_ret").isNotNull()), "raw_ret", "fee_ret", "target_fee", "target_raw", "next_open")


def with_signals(d, w):
    """RSI under 40 marks a raw entry signal."""
    return ind.add_rsi(d, w).withColumn("entry", F.coalesce(F.col("rsi") < 40, F.lit(False)))


SIG_SQL = q.with_stages(RSI_STAGES, ("sg", "avgs", f"{q.rsi()} AS rsi"), ("cand", "sg", "coalesce(rsi < 40, false) AS entry"))


def _barrier_sql(tp, sl, h=H, extra_cte="", src="(SELECT * FROM cand WHERE entry)", grid_cols=""):
    """Outcome of each candidate through a self-join over the bars ahead."""
    return f""",
pairs AS (SELECT c.symbol, c.tf, c.bar_idx, c.close AS entry_price{grid_cols}, b.bar_idx - c.bar_idx AS k, b.high, b.low, b.close, {tp} AS tp_, {sl} AS sl_
  FROM {src} c JOIN bars b ON b.symbol = c.symbol AND b.tf = c.tf AND b.bar_idx > c.bar_idx AND b.bar_idx <= c.bar_idx + {h}),
hits AS (SELECT symbol, tf, bar_idx, entry_price, tp_, sl_, min(k) FILTER (high >= entry_price * (1 + tp_)) AS up, min(k) FILTER (low <= entry_price * (1 - sl_)) AS down,
  max(k) AS n, max_by(close, k) AS last_close FROM pairs GROUP BY ALL),
outcome AS (SELECT *, CASE WHEN up IS NOT NULL AND (down IS NULL OR up <= down) THEN 'tp' WHEN down IS NOT NULL THEN 'sl' WHEN n >= {h} THEN 'time' ELSE 'open' END AS reason FROM hits),
done AS (SELECT *, CASE reason WHEN 'tp' THEN up WHEN 'sl' THEN down ELSE n END AS bars_held,
  CASE reason WHEN 'tp' THEN entry_price * (1 + tp_) WHEN 'sl' THEN entry_price * (1 - sl_) ELSE last_close END AS exit_price FROM outcome)"""


def barriers(bars, tp=TP, sl=SL, horizon=H):
    """Candidates with their triple-barrier outcome; the path arrays live only inside a chunk."""
    def cols(d, w):
        d = lb.add_path(with_signals(d, w), w, horizon, "high", "low", "close").where("entry")
        d = d.withColumn("_o", lb.barrier(F.col("close"), F.lit(tp), F.lit(sl), horizon))
        return d.select(*SERIES, "bar_idx", "chunk", "ts_s", F.col("close").alias("entry_price"), "_o.*").where(F.col("bars") > 0)
    return over_chunks(bars, cols, before=64, after=horizon).withColumnRenamed("bars", "bars_held")


@query("triple_barrier", "L3 J9", SIG_SQL + _barrier_sql(TP, SL) + f" SELECT {K}, reason, bars_held, {q.r('exit_price', 9)} AS exit_price, {q.r('exit_price / entry_price - 1')} AS gross FROM done")
def _(spark, base):
    df = barriers(indexed_bars(spark, base)).withColumns({
        "gross": ratio("exit_price", "entry_price") - 1, "bars_held": F.col("bars_held").cast("long")})
    return shown(df, "reason", "bars_held", "exit_price", "gross", places={"exit_price": 9})


CB_SQL = SIG_SQL + f""",
pairs AS (SELECT c.symbol, c.tf, c.bar_idx, c.close AS e, b.bar_idx - c.bar_idx AS k, b.open, b.high, b.low, b.close FROM (SELECT * FROM cand WHERE entry) c
 JOIN bars b ON b.symbol = c.symbol AND b.tf = c.tf AND b.bar_idx > c.bar_idx AND b.bar_idx <= c.bar_idx + {H}),
f AS (SELECT *, CASE WHEN (close - e) / e >= {TP} THEN 'tp' WHEN (close - e) / e <= -{SL} THEN 'sl' END AS hit, max(k) OVER (PARTITION BY symbol, tf, bar_idx) AS n FROM pairs),
g AS (SELECT *, row_number() OVER (PARTITION BY symbol, tf, bar_idx ORDER BY CASE WHEN hit IS NULL THEN n + 1 ELSE k END, -k) AS rn FROM f)
SELECT {K}, coalesce(hit, 'time') AS reason, k AS bars_held, {q.r("CASE hit WHEN 'tp' THEN greatest(open, high, e * (1 + 3.0)) WHEN 'sl' THEN least(open, low, e * (1 - 0.9)) ELSE close END")} AS exit_price FROM g WHERE rn = 1"""


@query("close_barrier", "L4", CB_SQL)
def _(spark, base):
    def cols(d, w):
        d = lb.add_path(with_signals(d, w), w, H, "open", "high", "low", "close").where("entry")
        d = d.withColumn("_o", lb.close_barrier(F.col("close"), TP, SL))
        return d.select(*SERIES, "bar_idx", "chunk", "_o.*").where(F.col("bars") > 0)
    df = over_chunks(indexed_bars(spark, base), cols, before=64, after=H).withColumn("bars_held", F.col("bars").cast("long"))
    return shown(df, "reason", "bars_held", "exit_price")


TPS, SLS = (100.0, 150.0, 200.0, 250.0, 300.0), (50.0, 75.0, 90.0, 95.0)
GRID_SRC = "(SELECT * FROM cand, (SELECT unnest([" + ", ".join(map(str, TPS)) + "]) / 100 AS tp_g), (SELECT unnest([" + ", ".join(map(str, SLS)) + "]) / 100 AS sl_g) WHERE entry)"


@query("barrier_grid", "L5 L6", SIG_SQL + _barrier_sql("tp_g", "sl_g", src=GRID_SRC, grid_cols=", tp_g, sl_g") + f"""
SELECT symbol, tf, round(tp_ * 100, 1) AS tp, round(sl_ * 100, 1) AS sl, count(*) AS trades, count(*) FILTER (reason = 'tp') AS wins, count(*) FILTER (reason = 'sl') AS losses,
 round(avg(bars_held), 4) AS avg_bars, {q.r('avg(exit_price / entry_price - 1)')} AS avg_gross FROM done GROUP BY symbol, tf, tp_, sl_""")
def _(spark, base):
    def cols(d, w):
        d = lb.add_path(with_signals(d, w), w, H, "high", "low", "close").where("entry")
        d = lb.grid(d, TPS, SLS).withColumn("_o", lb.barrier(F.col("close"), F.col("tp") / 100, F.col("sl") / 100, H))
        return d.select(*SERIES, "bar_idx", "chunk", "tp", "sl", F.col("close").alias("entry_price"), "_o.*").where(F.col("bars") > 0)
    df = over_chunks(indexed_bars(spark, base), cols, before=64, after=H)
    return df.groupBy(*SERIES, F.round("tp", 1).alias("tp"), F.round("sl", 1).alias("sl")).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("reason") == "tp").alias("wins"), F.count_if(F.col("reason") == "sl").alias("losses"),
        F.round(F.avg("bars"), 4).alias("avg_bars"), rounded(F.avg(F.col("exit_price") / F.col("entry_price") - 1)).alias("avg_gross"))


@query("excursions", "L6", _sel(q.BARS, {
    "max_profit_pct": f"(max(high) OVER {q.frame(1, 50)} - close) / close * 100", "max_drawdown_pct": f"(close - min(low) OVER {q.frame(1, 50)}) / close * 100",
    "future_bars": f"count(*) OVER {q.frame(1, 50)}"}, "bars"))
def _(spark, base):
    def cols(d, w):
        ahead = w.rowsBetween(1, 50)
        return d.withColumns({
            "max_profit_pct": ratio(F.max("high").over(ahead) - F.col("close"), "close") * 100,
            "max_drawdown_pct": ratio(F.col("close") - F.min("low").over(ahead), "close") * 100,
            "future_bars": F.count("close").over(ahead).cast("double")})
    return shown(over_chunks(indexed_bars(spark, base), cols, before=0, after=50), "max_profit_pct", "max_drawdown_pct", "future_bars")


def _chain_sql(cand: str, jump: str) -> str:
    """Follow the chain with a recursive query: each step looks up the next candidate."""
    return f""",
cc AS ({cand}),
rel AS (SELECT symbol, tf, bar_idx, {jump} AS release FROM cc),
hop AS (SELECT a.symbol, a.tf, a.bar_idx, a.release, b.bar_idx AS nxt FROM rel a ASOF LEFT JOIN (SELECT symbol, tf, bar_idx FROM rel) b
  ON a.symbol = b.symbol AND a.tf = b.tf AND b.bar_idx >= a.release),
chain AS (SELECT symbol, tf, bar_idx, nxt FROM hop WHERE (symbol, tf, bar_idx) IN (SELECT (symbol, tf, min(bar_idx)) FROM hop GROUP BY symbol, tf)
  UNION ALL SELECT h.symbol, h.tf, h.bar_idx, h.nxt FROM chain c JOIN hop h ON h.symbol = c.symbol AND h.tf = c.tf AND h.bar_idx = c.nxt)"""


@query("spaced_signals", "O7 P11", SIG_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1) + _chain_sql("SELECT * FROM cand WHERE entry", "bar_idx + 24") + f" SELECT {K} FROM chain")
def _(spark, base):
    sig = over_chunks(indexed_bars(spark, base), with_signals, before=64).where("entry")
    sig = sig.select(*SERIES, "bar_idx", (F.col("bar_idx") + 24).alias("release"))
    return greedy_chain(sig, "bar_idx", "release", 24).select(*SERIES, "bar_idx")


@query("trade_chain", "L7", SIG_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1) + _barrier_sql(TP, SL)
       + _chain_sql("SELECT * FROM done", "bar_idx + bars_held + 10") + f""" SELECT symbol, tf, count(*) AS trades, count(*) FILTER (reason = 'tp') AS wins,
 {q.r('sum(exit_price / entry_price - 1 - 0.003)')} AS net, sum(bars_held)::BIGINT AS bars_in_market FROM chain JOIN done USING ({K}) GROUP BY symbol, tf""")
def _(spark, base):
    out = barriers(indexed_bars(spark, base)).withColumn("release", F.col("bar_idx") + F.col("bars_held") + 10)
    kept = greedy_chain(out, "bar_idx", "release", H + 10)
    return kept.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("reason") == "tp").alias("wins"),
        rounded(F.sum(F.col("exit_price") / F.col("entry_price") - 1 - 0.003)).alias("net"), F.sum("bars_held").alias("bars_in_market"))


STOP_SQL = q.with_stages(
    RSI_STAGES, ("t0", "avgs", f"{q.rsi()} AS rsi, {q.TR}"),
    ("t1", "t0", f"{q.sma('tr', 14)} AS atr, CASE WHEN low < {q.lag('low')} AND low < {q.lag('low', 2)} AND low < lead(low, 1) OVER w AND low < lead(low, 2) OVER w THEN low END AS mn"
     .replace("OVER w ", "OVER (PARTITION BY symbol, tf ORDER BY bar_idx) ")),
) + f""",
sp AS (SELECT a.symbol, a.tf, a.bar_idx, max(b.mn) AS support FROM t1 a JOIN t1 b ON a.symbol = b.symbol AND a.tf = b.tf AND b.bar_idx BETWEEN a.bar_idx - 98 AND a.bar_idx - 3 AND b.mn < a.close
  WHERE a.bar_idx >= 100 GROUP BY ALL),
t2 AS (SELECT t1.*, support, 2.0 * CASE WHEN rsi > 70 THEN 0.8 WHEN rsi < 30 THEN 1.2 ELSE 1 END * CASE WHEN volume > 10 THEN 1.5 ELSE 1 END AS mult FROM t1 LEFT JOIN sp USING ({K}) WHERE t1.bar_idx >= 14),
t3 AS (SELECT *, close - atr * mult AS raw, (close - (close - atr * mult)) / close AS gap, (close - support) / close AS sgap FROM t2),
st AS (SELECT *, CASE WHEN sgap BETWEEN 0.01 AND 0.05 AND sgap < gap * 1.2 THEN support WHEN abs(gap) > 0.05 THEN close * 0.95 WHEN abs(gap) < 0.01 THEN close * 0.99 ELSE raw END AS stop FROM t3)"""


def add_stops(d, w):
    d = ind.add_atr(ind.add_rsi(d, w), w)
    d = lb.add_support(d, w)
    return d.withColumn("stop", lb.adaptive_stop(
        F.col("close"), F.col("atr"), F.col("rsi"), F.col("support"), F.col("volume") > 10))


@query("adaptive_stop", "L8", _sel(STOP_SQL, {"support": "support", "stop": "stop"}, "st", places={"stop": 9}))
def _(spark, base):
    df = over_chunks(indexed_bars(spark, base), add_stops, before=128, after=2)
    return shown(df.where("bar_idx >= 14"), "support", "stop", places={"stop": 9})


# Reward multiples and sizes of the profit ladder.
LADDER = [("TP1", 1.5, 0.4), ("TP2", 3.0, 0.3), ("TP3", 5.0, 0.2)]


def ladder_outcomes(bars):
    def cols(d, w):
        d = lb.add_path(add_stops(d, w), w, H, "close")
        d = d.where((F.col("bar_idx") >= 14) & (F.size("_p_close") > 0)).withColumn("_risk", F.abs(F.col("close") - F.col("stop")))
        levels = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(m).alias("rr"), F.lit(s).alias("size")) for n, m, s in LADDER])
        d = d.withColumn("_l", F.explode(levels))
        price = F.col("close") + F.col("_risk") * F.col("_l.rr")
        hit = lb.first_where(F.col("_p_close"), lambda c: c >= price)
        dead = lb.first_where(F.col("_p_close"), lambda c: c <= F.col("stop"))
        reached = hit.isNotNull() & (dead.isNull() | (hit < dead))
        return d.select(*SERIES, "bar_idx", "chunk", "_l.label", "_l.size", F.when(reached, hit).alias("hit_bar"), dead.alias("stop_bar"))
    return over_chunks(bars, cols, before=128, after=H)


LADDER_SQL = STOP_SQL + f""",
lv AS (SELECT * FROM st, (VALUES ('TP1', 1.5, 0.4), ('TP2', 3.0, 0.3), ('TP3', 5.0, 0.2)) v(label, rr, size)),
pp AS (SELECT l.symbol, l.tf, l.bar_idx, l.label, l.size, min(b.bar_idx - l.bar_idx) FILTER (b.close >= l.close + abs(l.close - l.stop) * rr) AS hit,
  min(b.bar_idx - l.bar_idx) FILTER (b.close <= l.stop) AS dead FROM lv l JOIN bars b ON b.symbol = l.symbol AND b.tf = l.tf AND b.bar_idx BETWEEN l.bar_idx + 1 AND l.bar_idx + {H} GROUP BY ALL)"""


@query("profit_ladder", "L9 L11", LADDER_SQL + f""" SELECT symbol, tf, label, count(*) AS n, count(*) FILTER (hit IS NOT NULL AND (dead IS NULL OR hit < dead)) AS reached,
 {q.r('avg(hit) FILTER (hit IS NOT NULL AND (dead IS NULL OR hit < dead))', 4)} AS mean_bar, count(dead) AS stopped FROM pp GROUP BY symbol, tf, label""")
def _(spark, base):
    return ladder_outcomes(indexed_bars(spark, base)).groupBy(*SERIES, "label").agg(
        F.count(F.lit(1)).alias("n"), F.count("hit_bar").alias("reached"), rounded(F.avg("hit_bar"), 4).alias("mean_bar"),
        F.count("stop_bar").alias("stopped"))


EXIT_SQL = LADDER_SQL + f""",
ev AS (SELECT symbol, tf, bar_idx, min(dead) AS stop_bar, min(CASE WHEN hit IS NOT NULL AND (dead IS NULL OR hit < dead) THEN hit END) AS tp_bar FROM pp GROUP BY ALL),
wh AS (SELECT {K}, least(coalesce(stop_bar, {H}), {H}) AS last_bar, CASE WHEN stop_bar IS NOT NULL THEN 'STOP' ELSE 'TIME_STOP' END AS reason, tp_bar FROM ev)"""


@query("exit_precedence", "L11", EXIT_SQL + """ SELECT symbol, tf, reason, count(*) AS n, count(tp_bar) AS with_partial, sum(last_bar)::BIGINT AS bars FROM wh GROUP BY ALL""")
def _(spark, base):
    """Full exits of each trade: stop before time; partial exits before the full one count."""
    per = ladder_outcomes(indexed_bars(spark, base)).groupBy(*SERIES, "bar_idx").agg(
        F.min("stop_bar").alias("stop_bar"), F.min("hit_bar").alias("tp_bar"))
    full = F.when(F.col("stop_bar").isNotNull(), "STOP").otherwise("TIME_STOP")
    return per.groupBy(*SERIES, full.alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.count("tp_bar").alias("with_partial"),
        F.sum(F.coalesce("stop_bar", F.lit(H))).alias("bars"))


TRAIL_SQL = SIG_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1) + f""",
tt AS (SELECT *, {q.TR} FROM cand), ta AS (SELECT *, {q.sma('tr', 14)} AS atr FROM tt),
en AS (SELECT symbol, tf, bar_idx, close AS e, atr FROM ta WHERE entry AND atr IS NOT NULL),
st AS (SELECT symbol, tf, bar_idx, e, 0::BIGINT AS k, e - atr * 3.0 AS stop, 0.02::DOUBLE AS af, NULL::BIGINT AS exit_bar FROM en
 UNION ALL SELECT s.symbol, s.tf, s.bar_idx, s.e, s.k + 1, CASE WHEN s.exit_bar IS NULL AND b.close > s.stop AND (b.close - s.e) / s.e >= 0.02
   THEN greatest(least(greatest(s.stop + (b.close - s.stop) * s.af, s.stop), b.close * 0.99), s.stop) ELSE s.stop END,
  CASE WHEN s.exit_bar IS NULL AND b.close > s.stop AND (b.close - s.e) / s.e >= 0.02 THEN least(s.af + 0.02, 0.2) ELSE s.af END,
  CASE WHEN s.exit_bar IS NULL AND b.close <= s.stop THEN s.k + 1 ELSE s.exit_bar END
  FROM st s JOIN bars b ON b.symbol = s.symbol AND b.tf = s.tf AND b.bar_idx = s.bar_idx + s.k + 1 WHERE s.k < 24),
fin AS (SELECT symbol, tf, bar_idx, max_by(stop, k) AS stop, max(exit_bar) AS exit_bar FROM st GROUP BY ALL)"""


@query("trailing_stop", "T14", TRAIL_SQL + f" SELECT {K}, {q.r('stop', 5)} AS stop, exit_bar FROM fin")
def _(spark, base):
    def cols(d, w):
        d = lb.add_path(ind.add_atr(with_signals(d, w), w), w, 24, "close").where("entry AND atr IS NOT NULL")
        d = d.withColumn("_t", lb.trailing_stop(F.col("close"), F.col("atr"), F.col("_p_close")))
        return d.select(*SERIES, "bar_idx", "chunk", "_t.stop", F.col("_t.exit_bar").cast("long").alias("exit_bar"))
    return shown(over_chunks(indexed_bars(spark, base), cols, before=64, after=24), "stop", "exit_bar", places=5)


@query("rsi_sensitivity", "L15", SIG_SQL + """ SELECT symbol, tf, count(*) FILTER (rsi < 28) AS n_28, count(*) FILTER (rsi < 30) AS n_30, count(*) FILTER (rsi < 32) AS n_32 FROM cand GROUP BY ALL""")
def _(spark, base):
    df = over_chunks(indexed_bars(spark, base), with_signals, before=64)
    return df.groupBy(*SERIES).agg(*[F.count_if(F.col("rsi") < t).alias(f"n_{t}") for t in (28, 30, 32)])


SWEEP_SQL = RSI_STAGES + f""",
s0 AS (SELECT *, {q.rsi()} / 100 AS proba, lead(open, 1) OVER w AS e, lead(close, 12) OVER w AS x FROM avgs WINDOW w AS (PARTITION BY symbol, tf ORDER BY bar_idx)),
s1 AS (SELECT *, round(((x - e) / e - 0.003) * 0.1, 10) AS fee_ret, (max(ts_s) OVER (PARTITION BY symbol, tf) - min(ts_s) OVER (PARTITION BY symbol, tf)) / 86400.0 AS days FROM s0 WHERE x IS NOT NULL),
s2 AS (SELECT * FROM s1, (SELECT unnest([0.4, 0.45, 0.5, 0.55, 0.6]) AS threshold) WHERE proba >= threshold),
s3 AS (SELECT *, CASE WHEN count(*) FILTER (1 + fee_ret = 0) OVER w > 0 THEN 0 ELSE exp(sum(CASE WHEN 1 + fee_ret <> 0 THEN ln(abs(1 + fee_ret)) END) OVER w) * CASE WHEN count(*) FILTER (1 + fee_ret < 0) OVER w % 2 = 1 THEN -1 ELSE 1 END END AS eq
  FROM s2 WINDOW w AS (PARTITION BY symbol, tf, threshold ORDER BY bar_idx)),
s4 AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol, tf, threshold ORDER BY bar_idx) - 1 AS dd FROM s3),
s5 AS (SELECT symbol, tf, threshold, count(*) AS n_trades, sum(fee_ret) AS total_return, avg(fee_ret) AS mean_return,
  avg(fee_ret) / stddev_samp(fee_ret) * sqrt(count(*) * 365.0 / max(days)) AS sharpe, min(dd) * 100 AS max_drawdown_pct, avg(CASE WHEN fee_ret > 0 THEN 100.0 ELSE 0 END) AS win_rate FROM s4 GROUP BY symbol, tf, threshold)"""
THRESHOLDS = (0.4, 0.45, 0.5, 0.55, 0.6)


def threshold_sweep(bars, position=0.1):
    """Metrics per threshold of trades that each risk ``position`` of the capital."""
    def cols(d, w):
        d = ind.add_rsi(d, w).withColumns({"proba": F.col("rsi") / 100, **lb.forward_return(w, 12)})
        return d.withColumn("fee_ret", F.round(F.col("fee_ret") * position, 10))
    df = cut(over_chunks(bars, cols, before=64, after=16).where(F.col("fee_ret").isNotNull()))
    span = df.groupBy(*SERIES).agg(((F.max("ts_s") - F.min("ts_s")) / 86400.0).alias("days"))
    hit = df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS]))).where(F.col("proba") >= F.col("threshold"))
    # each (series, threshold) is its own series of trades
    hit = hit.select("symbol", F.concat_ws("|", "tf", F.col("threshold").cast("string")).alias("tf"), "bar_idx", "fee_ret")
    # the compounded product as logs, with its sign and zeros counted apart
    f = 1 + F.col("fee_ret")
    hit = running_bars(hit, {"_g": ("sum", F.when(f != 0, F.log(F.abs(f)))), "_neg": ("sum", (f < 0).cast("long")),
                             "_zero": ("sum", (f == 0).cast("long"))})
    value = F.exp(F.coalesce("_g", F.lit(0.0))) * F.when(F.col("_neg") % 2 == 1, -1.0).otherwise(1.0)
    hit = hit.withColumn("value", F.when(F.col("_zero") > 0, 0.0).otherwise(value))
    hit = running_bars(hit, {"top": ("max", F.col("value"))})
    out = hit.groupBy("symbol", "tf").agg(
        F.count(F.lit(1)).alias("n_trades"), F.sum("fee_ret").alias("total_return"), F.avg("fee_ret").alias("mean_return"),
        F.stddev_samp("fee_ret").alias("_sd"), (F.min(ratio("value", "top") - 1) * 100).alias("max_drawdown_pct"),
        F.avg(F.when(F.col("fee_ret") > 0, 100.0).otherwise(0.0)).alias("win_rate"))
    parts = F.split("tf", r"\|")
    out = out.withColumns({"threshold": parts[1].cast("double"), "tf": parts[0]}).join(span, SERIES)
    return out.withColumn("sharpe", ratio("mean_return", "_sd") * F.sqrt(F.col("n_trades") * 365.0 / F.col("days")))


SWEEP = ("total_return", "mean_return", "sharpe", "max_drawdown_pct", "win_rate")


@query("threshold_sweep", "L12", SWEEP_SQL + f" SELECT symbol, tf, threshold::DOUBLE AS threshold, n_trades, {', '.join(f'{q.r(c, 4)} AS {c}' for c in SWEEP)} FROM s5")
def _(spark, base):
    return shown(threshold_sweep(indexed_bars(spark, base)), *SWEEP, keys=["symbol", "tf", "threshold", "n_trades"], places=4)


@query("best_threshold", "O5", SWEEP_SQL + f""", s6 AS (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY CASE WHEN n_trades >= 10 AND max_drawdown_pct >= -20 THEN 0 ELSE 1 END, sharpe DESC NULLS LAST, threshold) AS rn FROM s5)
SELECT symbol, tf, threshold::DOUBLE AS threshold, n_trades, {q.r('sharpe', 4)} AS sharpe FROM s6 WHERE rn = 1""")
def _(spark, base):
    feasible = (F.col("n_trades") >= 10) & (F.col("max_drawdown_pct") >= -20)
    w = Window.partitionBy(*SERIES).orderBy(F.when(feasible, 0).otherwise(1), F.col("sharpe").desc_nulls_last(), "threshold")
    best = threshold_sweep(indexed_bars(spark, base)).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return shown(best, "sharpe", keys=["symbol", "tf", "threshold", "n_trades"], places=4)


@query("walk_forward_folds", "L16", q.BARS + """, folds AS (SELECT unnest(range(0, 100)) AS fold)
SELECT symbol, tf, fold, count(*) FILTER (bar_idx < fold * 200 + 500) AS n_train, count(*) FILTER (bar_idx >= fold * 200 + 500) AS n_test, round(avg(close) FILTER (bar_idx >= fold * 200 + 500), 4) AS test_mean
FROM bars JOIN folds ON bar_idx >= fold * 200 AND bar_idx < fold * 200 + 650 GROUP BY ALL""")
def _(spark, base):
    """Train 500, test 150, step 200 bars: a bar lists the few folds it lies in."""
    step, train, test = 200, 500, 150
    first = F.greatest(F.lit(0), F.ceil((F.col("bar_idx") - (train + test) + 1) / step))
    df = indexed_bars(spark, base).withColumn("fold", F.explode(F.sequence(first, F.floor(F.col("bar_idx") / step))))
    in_test = F.col("bar_idx") >= F.col("fold") * step + train
    return df.groupBy(*SERIES, "fold").agg(F.count_if(~in_test).alias("n_train"), F.count_if(in_test).alias("n_test"),
                                           F.round(F.avg(F.when(in_test, F.col("close"))), 4).alias("test_mean"))


Z = {"rsi_z": "rsi", "atr_z": "atr", "vol_z": "volume"}
BOX_SQL = q.with_stages(
    RSI_STAGES, ("b0", "avgs", f"{q.rsi()} AS rsi, {q.TR}"), ("b1", "b0", f"{q.sma('tr', 14)} AS atr"),
    ("b2", "b1", ", ".join(f"({c} - {q.sma(c, 50)}) / nullif({q.std(c, 50)}, 0) AS {n}" for n, c in Z.items())),
    ("b3", "b2", ", ".join(f"{q.lag(n)} AS s_{n}" for n in Z) + f", min(low) OVER {q.frame(-48, -1)} AS sup, max(high) OVER {q.frame(-48, -1)} AS res, count(*) OVER {q.frame(-48, -1)} AS nb"),
) + f""",
bx AS (SELECT a.symbol, a.tf, a.bar_idx, a.sup, a.res, a.nb, any_value(a.s_rsi_z) AS rz, any_value(a.s_atr_z) AS az, any_value(a.s_vol_z) AS vz,
  count(*) FILTER (b.low <= a.sup * 1.003 AND b.low >= a.sup * (1 - 0.003)) AS ts, count(*) FILTER (b.high >= a.res * (1 - 0.003) AND b.high <= a.res * 1.003) AS tr_,
  avg(CASE WHEN b.bar_idx = greatest(a.bar_idx - 48, 0) THEN b.high - b.low ELSE b.tr END) AS atr_box
  FROM b3 a JOIN b3 b ON a.symbol = b.symbol AND a.tf = b.tf AND b.bar_idx BETWEEN a.bar_idx - 48 AND a.bar_idx - 1 WHERE a.nb >= 10 GROUP BY ALL),
wb AS (SELECT *, CASE WHEN abs(rz) <= 0.5 THEN 1.0 WHEN abs(rz) <= 1 THEN 0.7 WHEN abs(rz) <= 1.5 THEN 0.3 WHEN rz IS NOT NULL THEN 0 END AS i_rsi,
  CASE WHEN az < -0.5 THEN 1.0 WHEN az < 0 THEN 0.8 WHEN az < 0.5 THEN 0.5 WHEN az IS NOT NULL THEN 0 END AS i_volatility,
  CASE WHEN vz > 1 THEN 1.0 WHEN vz > 0.5 THEN 0.8 WHEN vz > 0 THEN 0.5 WHEN vz IS NOT NULL THEN 0.3 END AS i_volume,
  CASE WHEN ts >= 3 AND tr_ >= 3 THEN 1.0 WHEN ts >= 2 AND tr_ >= 2 THEN 0.7 ELSE 0.3 END AS i_touches FROM bx)"""


def add_box(d, w):
    """Box of the 48 bars before a bar, its weight from the setup bar (one earlier)."""
    d = ind.add_atr(ind.add_rsi(d, w), w)
    d = d.withColumns({n: ratio(F.col(c) - sma(c, 50, w), rolling_std(c, 50, w)) for n, c in Z.items()})
    d = d.withColumn("_setup", F.lag(F.struct(*Z), 1).over(w))
    d = lb.box_metrics(d, w)
    return d.withColumns(lb.box_weight(F.col("_setup.rsi_z"), F.col("_setup.atr_z"), F.col("_setup.vol_z"),
                                       F.col("touches_support"), F.col("touches_resistance")))


@query("box_metrics", "L17 L18 F25", _sel(BOX_SQL, {
    "support": "sup", "resistance": "res", "box_range_pct": "(res - sup) / sup * 100", "touches_support": "ts", "touches_resistance": "tr_", "atr_box": "atr_box",
    "i_rsi": "i_rsi", "i_volatility": "i_volatility", "i_volume": "i_volume", "i_touches": "i_touches",
    "w_box": "coalesce(i_rsi, 1) * coalesce(i_volatility, 1) * coalesce(i_volume, 1) * i_touches"}, "wb"))
def _(spark, base):
    df = over_chunks(indexed_bars(spark, base), add_box, before=128).where("box_bars >= 10")
    df = df.withColumns({c: F.col(c).cast("double") for c in ("touches_support", "touches_resistance")})
    return shown(df, "support", "resistance", "box_range_pct", "touches_support", "touches_resistance", "atr_box",
                 "i_rsi", "i_volatility", "i_volume", "i_touches", "w_box")
