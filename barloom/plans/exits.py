"""Managed exits and sweeps of chained trades."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from barloom.functions.columns import ratio, rounded
from barloom.operators import exits as ex
from barloom.operators import labels as lb
from barloom.operators import states as st
from barloom.operators.chains import greedy_chain
from barloom.operators.chunks import over_chunks, running_bars
from barloom.operators.lineage import cut
from barloom.plans import outcomes as oc
from barloom.plans import sql as q
from barloom.plans.base import indexed_bars, shown
from barloom.plans.conditions import T9_SQL
from barloom.plans.indicators import RSI_STAGES
from barloom.plans.registry import query
from barloom.schema import SERIES

K, H = oc.K, oc.H
COST = 0.003

# the regime stages follow the stop stages under names of their own
REGIME_CTES = re.sub(r"\bt(\d)\b", r"u\1", T9_SQL[len(RSI_STAGES):])
LEVEL_ROWS = ", ".join(f"({i}, '{n}', {r}::DOUBLE, {s}::DOUBLE)" for i, (n, r, s) in enumerate(ex.LEVELS))
MANAGED_SQL = oc.STOP_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1) + REGIME_CTES + f""",
en AS (SELECT st.symbol, st.tf, st.bar_idx, st.close AS e, st.atr, abs(st.close - stop) AS risk, trend_regime AS regime,
  st.close - abs(st.close - stop) * CASE trend_regime WHEN 'BEAR_MARKET' THEN 0.75 WHEN 'CRISIS' THEN 0.5 ELSE 1.0 END::DOUBLE AS stop0 FROM st JOIN u2 USING ({K}) WHERE st.rsi < 40 AND st.atr IS NOT NULL),
step AS (SELECT symbol, tf, bar_idx, e, 0::BIGINT AS k, stop0 AS stop, e - atr * 3.0 AS trail, 0.02::DOUBLE AS af, NULL::BIGINT AS hit, NULL::DOUBLE AS c FROM en
 UNION ALL SELECT symbol, tf, bar_idx, e, k, CASE WHEN moves THEN greatest(stop, moved) ELSE stop END, CASE WHEN moves THEN moved ELSE trail END, CASE WHEN moves THEN least(af + 0.02, 0.2) ELSE af END,
   CASE WHEN hit IS NULL AND c <= stop THEN k ELSE hit END, c
  FROM (SELECT s.symbol, s.tf, s.bar_idx, s.e, s.k + 1 AS k, s.stop, s.trail, s.af, s.hit, b.close AS c, s.hit IS NULL AND b.close > s.stop AND (b.close - s.e) / s.e >= 0.02 AS moves,
    greatest(least(greatest(s.trail + (b.close - s.trail) * s.af, s.trail), b.close * 0.99), s.trail) AS moved
   FROM step s JOIN bars b ON b.symbol = s.symbol AND b.tf = s.tf AND b.bar_idx = s.bar_idx + s.k + 1 WHERE s.k < {H})),
fin AS (SELECT symbol, tf, bar_idx, max(k) AS n, max_by(stop, k) AS stop, max(hit) AS hit, max_by(c, k) AS c FROM step GROUP BY ALL HAVING max(k) > 0),
done AS (SELECT {K}, regime, e, risk, n, CASE WHEN hit IS NOT NULL THEN 'STOP' WHEN n >= {H} THEN 'TIME_STOP' ELSE 'OPEN' END AS label, coalesce(hit, CASE WHEN n >= {H} THEN n ELSE n + 1 END) AS bar,
  CASE WHEN hit IS NOT NULL THEN stop ELSE c END AS price FROM fin JOIN en USING ({K})),
lev AS (SELECT d.symbol, d.tf, d.bar_idx, d.bar AS last_bar, v.i, v.label, v.share, d.e + d.risk * v.reward AS price, min(s.k) AS bar FROM done d, (VALUES {LEVEL_ROWS}) v(i, label, reward, share), step s
  WHERE d.regime <> 'BULL_TREND' AND s.symbol = d.symbol AND s.tf = d.tf AND s.bar_idx = d.bar_idx AND s.k > 0 AND s.c >= d.e + d.risk * v.reward GROUP BY ALL HAVING min(s.k) < d.bar),
events AS (SELECT {K}, i, label, bar, price, share FROM lev UNION ALL SELECT {K}, 9, label, bar, price, 1.0 FROM done),
sized AS (SELECT *, row_number() OVER p AS exit_no, share * coalesce(product(1 - share) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS size FROM events WINDOW p AS (PARTITION BY symbol, tf, bar_idx ORDER BY i)),
exits AS (SELECT {K}, regime, e, exit_no, s.label, least(s.bar, n) AS bar, s.price, size FROM sized s JOIN done USING ({K}))"""


def managed(bars):
    """One row a trade and exit: entries at RSI under 40, adaptive stop, regime of the entry bar."""
    bars = running_bars(bars, {"first_close": ("first", F.col("close"))})

    def cols(d, w):
        d = st.add_trend_regime(oc.add_stops(d, w), w)
        d = lb.add_path(d, w, H, "close").where("bar_idx >= 14 AND rsi < 40 AND atr IS NOT NULL")
        d = d.withColumn("_x", ex.exits(F.col("close"), F.col("stop"), F.col("atr"), F.col("trend_regime"), F.col("_p_close"), H))
        d = d.select(*SERIES, "bar_idx", "chunk", F.col("close").alias("e"), F.col("trend_regime").alias("regime"), F.posexplode("_x").alias("at", "x"))
        return d.select(*SERIES, "bar_idx", "chunk", "e", "regime", (F.col("at") + 1).cast("long").alias("exit_no"), "x.label", F.col("x.bar").cast("long").alias("bar"), "x.price", "x.size")
    return over_chunks(bars, cols, before=1024, after=H)


@query("managed_exits", "L10 L11", MANAGED_SQL + f" SELECT {K}, exit_no, regime, label, bar, {q.r('price', 9)} AS price, {q.r('size')} AS size FROM exits")
def _(spark, base):
    """Partial and full exits of each trade with the size that is left; the stop is tightened by the regime at entry."""
    return shown(managed(indexed_bars(spark, base)), "exit_no", "regime", "label", "bar", "price", "size", places={"price": 9})


@query("managed_exit_totals", "L10 L11 A17", MANAGED_SQL + f""", trade AS (SELECT {K}, regime, sum(size * (price / e - 1)) - {COST} AS net, count(*) AS parts, max(bar) AS bars, max_by(label, exit_no) AS ended FROM exits GROUP BY ALL)
 SELECT symbol, tf, regime, ended, count(*) AS trades, count(*) FILTER (parts > 1) AS with_partial, count(*) FILTER (net > 0) AS wins, sum(bars)::BIGINT AS bars, {q.r('sum(net)')} AS net FROM trade GROUP BY ALL""")
def _(spark, base):
    """Outcome of whole trades by regime at entry and by what ended them."""
    trade = managed(indexed_bars(spark, base)).groupBy(*SERIES, "bar_idx", "regime").agg(
        (F.sum(F.col("size") * (F.col("price") / F.col("e") - 1)) - COST).alias("net"), F.count(F.lit(1)).alias("parts"), F.max("bar").alias("bars"), F.max_by("label", "exit_no").alias("ended"))
    return trade.groupBy(*SERIES, "regime", "ended").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("parts") > 1).alias("with_partial"), F.count_if(F.col("net") > 0).alias("wins"), F.sum("bars").alias("bars"), rounded(F.sum("net")).alias("net"))


CELL = "symbol, tf, tp_, sl_"
SWEEP_SQL = oc.SIG_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1) + oc._barrier_sql("tp_g", "sl_g", src=oc.GRID_SRC, grid_cols=", tp_g, sl_g") + f""",
hop AS (SELECT a.symbol, a.tf, a.tp_, a.sl_, a.bar_idx, a.exit_price / a.entry_price - 1 - {COST} AS net, b.bar_idx AS nxt FROM done a ASOF LEFT JOIN (SELECT {CELL}, bar_idx FROM done) b
  ON a.symbol = b.symbol AND a.tf = b.tf AND a.tp_ = b.tp_ AND a.sl_ = b.sl_ AND b.bar_idx >= a.bar_idx + a.bars_held + 10),
chain AS (SELECT * FROM hop WHERE ({CELL}, bar_idx) IN (SELECT ({CELL}, min(bar_idx)) FROM hop GROUP BY {CELL})
  UNION ALL SELECT h.* FROM chain c JOIN hop h ON h.symbol = c.symbol AND h.tf = c.tf AND h.tp_ = c.tp_ AND h.sl_ = c.sl_ AND h.bar_idx = c.nxt),
size AS (SELECT symbol, tf, count(*) AS bars, count(*) FILTER (entry) AS signals FROM cand GROUP BY ALL),
run AS (SELECT {CELL}, count(*) AS trades, count(*) FILTER (net > 0) AS wins, coalesce(sum(net) FILTER (net > 0), 0) AS won, coalesce(-sum(net) FILTER (net <= 0), 0) AS lost FROM chain GROUP BY {CELL}),
cell AS (SELECT s.symbol, s.tf, g.tp_, g.sl_, bars, signals, coalesce(trades, 0) AS trades, coalesce(wins, 0) AS wins, coalesce(won, 0) AS won, coalesce(lost, 0) AS lost
  FROM size s CROSS JOIN (SELECT unnest([{', '.join(map(str, oc.TPS))}]) / 100 AS tp_) g1 CROSS JOIN (SELECT unnest([{', '.join(map(str, oc.SLS))}]) / 100 AS sl_) g2
  CROSS JOIN LATERAL (SELECT g1.tp_, g2.sl_) g LEFT JOIN run r ON r.symbol = s.symbol AND r.tf = s.tf AND r.tp_ = g.tp_ AND r.sl_ = g.sl_)"""


def swept(spark, base):
    """Chained trades of every (tp, sl) cell of every series: symbol, tf, tp, sl, bars, signals, trades, wins, won, lost.

    A cell is part of the chain's key, so chunks of all cells are summarised, composed and replayed in the same three passes; the chain of
    one cell never waits for another. Cells without trades stay in the table.
    """
    bars = cut(indexed_bars(spark, base))

    def cols(d, w):
        d = lb.add_path(oc.with_signals(d, w), w, H, "high", "low", "close").where("entry")
        d = lb.grid(d, oc.TPS, oc.SLS).withColumn("_o", lb.barrier(F.col("close"), F.col("tp") / 100, F.col("sl") / 100, H))
        return d.select(*SERIES, "bar_idx", "chunk", "tp", "sl", F.col("close").alias("e"), "_o.bars", "_o.exit_price").where("bars > 0")
    trades = over_chunks(bars, cols, before=64, after=H).withColumn("release", F.col("bar_idx") + F.col("bars") + 10)
    kept = greedy_chain(trades, "bar_idx", "release", H + 10, keys=[*SERIES, "tp", "sl"]).withColumn("net", F.col("exit_price") / F.col("e") - 1 - COST)
    run = kept.groupBy(*SERIES, "tp", "sl").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("net") > 0).alias("wins"),
        F.sum(F.when(F.col("net") > 0, F.col("net"))).alias("won"), F.sum(F.when(F.col("net") <= 0, -F.col("net"))).alias("lost"))
    size = over_chunks(bars, oc.with_signals, before=64).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("bars"), F.count_if("entry").alias("signals"))
    cells = lb.grid(size, oc.TPS, oc.SLS).join(run, [*SERIES, "tp", "sl"], "left")
    return cells.na.fill(0, ["trades", "wins"]).na.fill(0.0, ["won", "lost"])


@query("chained_sweep", "L13 L14 L5 L7", SWEEP_SQL + f""" SELECT symbol, tf, round(tp_ * 100, 1) AS tp, round(sl_ * 100, 1) AS sl, bars, signals, trades, wins, {q.r('won / nullif(lost, 0)')} AS pf, {q.r('won - lost')} AS pnl FROM cell""")
def _(spark, base):
    """Run table of all series and cells: bars, signals, non-overlapping trades, profit factor, sum of net returns."""
    return swept(spark, base).select(*SERIES, F.round("tp", 1).alias("tp"), F.round("sl", 1).alias("sl"), "bars", "signals", "trades", "wins",
                                     rounded(ratio("won", "lost")).alias("pf"), rounded(F.col("won") - F.col("lost")).alias("pnl"))


@query("sweep_totals", "L13", SWEEP_SQL + f""" SELECT round(tp_ * 100, 1) AS tp, round(sl_ * 100, 1) AS sl, sum(trades)::BIGINT AS trades, {q.r('sum(wins) * 100.0 / nullif(sum(trades), 0)')} AS win_rate,
 {q.r('sum(won) / nullif(sum(lost), 0)')} AS pf, {q.r('sum(won) - sum(lost)')} AS pnl, count(*) FILTER (won > lost) AS series_won FROM cell GROUP BY tp_, sl_""")
def _(spark, base):
    """One line a cell over all series, as a parameter search compares them."""
    return swept(spark, base).groupBy(F.round("tp", 1).alias("tp"), F.round("sl", 1).alias("sl")).agg(
        F.sum("trades").alias("trades"), rounded(ratio(F.sum("wins") * 100.0, F.sum("trades"))).alias("win_rate"), rounded(ratio(F.sum("won"), F.sum("lost"))).alias("pf"),
        rounded(F.sum("won") - F.sum("lost")).alias("pnl"), F.count_if(F.col("won") > F.col("lost")).alias("series_won"))
