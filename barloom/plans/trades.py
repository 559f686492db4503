"""Ledger queries: trades are order lines, from the earlier to the later of order and ship date."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barloom.functions.columns import ratio, rounded
from barloom.operators import ledger as lg
from barloom.operators.chunks import over_chunks, running_bars
from barloom.operators.lineage import cut
from barloom.operators.quantiles import exact_quantiles
from barloom.plans import sql as q
from barloom.plans.registry import query
from barloom.sources.tables import read_table

ORDER = ["exit_s", "order_no", "line_no", "part_no", "supp_no", "notional", "size"]


def trades(spark, base):
    li, od = read_table(spark, base, "lineitem"), read_table(spark, base, "orders")
    ship = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    made = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("o_orderpriority").alias("strategy"),
        F.least(ship, made).alias("entry_s"), F.greatest(ship, made).alias("exit_s"),
        F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_no"),
        F.col("l_suppkey").alias("supp_no"), F.col("l_extendedprice").alias("notional"), F.col("l_quantity").alias("size"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("direction"),
        F.round(F.col("l_tax") - F.col("l_discount") + 0.01, 2).alias("pnl_pct"),
        F.round(F.col("l_extendedprice") * F.round(F.col("l_tax") - F.col("l_discount") + 0.01, 2), 4).alias("pnl"),
        F.when(F.col("o_orderstatus") == "F", "tp").when(F.col("o_orderstatus") == "O", "sl").otherwise("time").alias("exit_reason"))


TR = """WITH trades AS (SELECT l_returnflag || l_linestatus AS symbol, o_orderpriority AS strategy,
 epoch(least(l_shipdate, o_orderdate))::BIGINT AS entry_s, epoch(greatest(l_shipdate, o_orderdate))::BIGINT AS exit_s,
 l_orderkey AS order_no, l_linenumber AS line_no, l_partkey AS part_no, l_suppkey AS supp_no, l_extendedprice AS notional, l_quantity AS size,
 CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS direction,
 round(l_tax - l_discount + 0.01, 2) AS pnl_pct, round(l_extendedprice * round(l_tax - l_discount + 0.01, 2), 4) AS pnl,
 CASE o_orderstatus WHEN 'F' THEN 'tp' WHEN 'O' THEN 'sl' ELSE 'time' END AS exit_reason
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_ORD = ", ".join(ORDER)


def cols(df, keys, spec):
    return df.select(*keys, *[rounded(c, p).alias(c) if p is not None else F.col(c) for c, p in spec.items()])


def sel(keys, spec, exprs, tail):
    return f"SELECT {keys}, " + ", ".join(f"{q.r(exprs.get(c, c), p) if p is not None else exprs.get(c, c)} AS {c}" for c, p in spec.items()) + " " + tail


STAT = {"total": None, "winners": None, "losers": None, "win_rate": 6, "gross_profit": 1, "gross_loss": 1, "profit_factor": 6,
        "avg_win": 4, "avg_loss": 4, "avg_win_pct": 6, "avg_loss_pct": 6, "largest_win": 4, "largest_loss": 4, "expectancy": 4,
        "avg_duration_hours": 4}
_STAT_SQL = {
    "total": "count(*)", "winners": "count(*) FILTER (pnl > 0)", "losers": "count(*) FILTER (pnl <= 0)",
    "win_rate": "count(*) FILTER (pnl > 0) / count(*) * 100", "gross_profit": "coalesce(sum(pnl) FILTER (pnl > 0), 0)",
    "gross_loss": "abs(coalesce(sum(pnl) FILTER (pnl <= 0), 0))",
    "profit_factor": "CASE WHEN abs(sum(pnl) FILTER (pnl <= 0)) > 0 THEN sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl <= 0)) ELSE 0 END",
    "avg_win": "avg(pnl) FILTER (pnl > 0)", "avg_loss": "avg(pnl) FILTER (pnl <= 0)", "avg_win_pct": "avg(pnl_pct) FILTER (pnl > 0)",
    "avg_loss_pct": "avg(pnl_pct) FILTER (pnl <= 0)", "largest_win": "max(pnl) FILTER (pnl > 0)", "largest_loss": "min(pnl) FILTER (pnl <= 0)",
    "expectancy": "avg(pnl)", "avg_duration_hours": "avg((exit_s - entry_s) / 3600.0)"}


@query("trade_statistics", "A1 F27", TR + sel("strategy, symbol", STAT, _STAT_SQL, "FROM trades GROUP BY strategy, symbol"))
def _(spark, base):
    return cols(lg.trade_statistics(trades(spark, base), ["strategy", "symbol"]), ["strategy", "symbol"], STAT)


@query("strategy_comparison", "A14 A15 U1", TR + """ SELECT strategy, 'line' AS book, count(*) AS trades, round(count(*) FILTER (pnl > 0) / count(*) * 100, 4) AS win_rate,
 round(sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl <= 0)), 6) AS pf,
 CASE WHEN sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl <= 0)) >= 2 THEN 1 ELSE 0 END AS meets_pf FROM trades GROUP BY strategy
UNION ALL SELECT strategy, 'long', count(*), round(count(*) FILTER (pnl > 0) / count(*) * 100, 4),
 round(sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl <= 0)), 6), CASE WHEN sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl <= 0)) >= 2 THEN 1 ELSE 0 END
 FROM trades WHERE direction = 1 GROUP BY strategy""")
def _(spark, base):
    t = trades(spark, base)
    both = t.withColumn("book", F.explode(F.array_compact(F.array(F.lit("line"), F.when(F.col("direction") == 1, F.lit("long"))))))
    s = lg.trade_statistics(both, ["strategy", "book"])
    return s.select("strategy", "book", F.col("total").alias("trades"), F.round("win_rate", 4).alias("win_rate"),
                    F.round("profit_factor", 6).alias("pf"), (F.col("profit_factor") >= 2).cast("int").alias("meets_pf"))


@query("trades_by_hour", "A2 F28", """SELECT event_type, hour(ts)::INT AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def _(spark, base):
    ev = read_table(spark, base, "events")
    return ev.groupBy("event_type", F.hour(F.col("ts").cast("timestamp")).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("trades_by_weekday", "A3 F28", TR + """ SELECT dayname(make_timestamp(entry_s * 1000000)) AS weekday, month(make_timestamp(entry_s * 1000000))::INT AS month,
 count(*) AS n, round(sum(pnl), 2) AS pnl, round(avg(pnl_pct), 6) AS pnl_pct FROM trades GROUP BY ALL""")
def _(spark, base):
    at = F.timestamp_seconds("entry_s")
    return trades(spark, base).groupBy(F.date_format(at, "EEEE").alias("weekday"), F.month(at).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("pnl"), 2).alias("pnl"), F.round(F.avg("pnl_pct"), 6).alias("pnl_pct"))


@query("streaks", "A13", TR + f""", m AS (SELECT *, CASE WHEN pnl > 0 THEN 1 ELSE 0 END AS win FROM trades),
n AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY {_ORD}) - row_number() OVER (PARTITION BY strategy, win ORDER BY {_ORD}) AS isl FROM m),
g AS (SELECT strategy, win, isl, count(*) AS len FROM n GROUP BY ALL)
SELECT strategy, coalesce(max(len) FILTER (win = 1), 0) AS max_wins, coalesce(max(len) FILTER (win = 0), 0) AS max_losses FROM g GROUP BY strategy""")
def _(spark, base):
    return lg.streaks(trades(spark, base), ["strategy"], F.col("pnl") > 0, ORDER)


EQ = TR + """, daily AS (SELECT strategy, exit_s // 86400 * 86400 AS ts_s, avg(pnl_pct) AS day_ret, sum(pnl) AS day_pnl FROM trades GROUP BY ALL),
eq0 AS (SELECT *, row_number() OVER w - 1 AS bar_idx, 10000 * exp(sum(ln(1 + day_ret)) OVER w) AS value, sum(day_pnl) OVER w AS pnl_to_date FROM daily
 WINDOW w AS (PARTITION BY strategy ORDER BY ts_s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
eq AS (SELECT *, round(value / lag(value) OVER w - 1, 10) AS ret, max(value) OVER w AS peak, value / max(value) OVER w - 1 AS dd FROM eq0
 WINDOW w AS (PARTITION BY strategy ORDER BY ts_s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
UW = """, uw AS (SELECT *, count(*) FILTER (dd >= 0) OVER (PARTITION BY strategy ORDER BY ts_s) AS isl FROM eq),
uwl AS (SELECT strategy, max(len) AS underwater_bars FROM (SELECT strategy, isl, count(*) AS len FROM uw WHERE dd < 0 GROUP BY ALL) GROUP BY strategy)"""


def equity(spark, base):
    return lg.equity_curve(trades(spark, base), "strategy")


@query("equity_curve", "W26 W27 A11", EQ + f" SELECT strategy, bar_idx, ts_s, {q.r('value', 4)} AS value, {q.r('pnl_to_date', 4)} AS pnl_to_date, {q.r('dd', 9)} AS drawdown FROM eq")
def _(spark, base):
    e = lg.with_drawdown(equity(spark, base))
    return cols(e.withColumnRenamed("symbol", "strategy"), ["strategy", "bar_idx", "ts_s"], {"value": 4, "pnl_to_date": 4, "drawdown": 9})


METRICS = {"n_bars": None, "final_value": 4, "total_return_pct": 5, "annualized_return": 5, "cagr": 5, "volatility": 6, "sharpe": 6, "sortino": 6,
           "max_drawdown": 6, "calmar": 6, "var_95": 6, "cvar_95": 6, "tail_ratio": 6, "underwater_bars": None, "underwater_days": 5}
_M_SQL = EQ + UW + """, b AS (SELECT strategy, count(*) AS n_bars, count(ret) AS n_ret, max_by(value, ts_s) AS final_value, exp(sum(ln(1 + ret))) AS growth,
 avg(ret) AS mean, stddev_samp(ret) AS sd, stddev_samp(ret) FILTER (ret < 0) AS sdd, abs(min(dd)) AS max_drawdown,
 quantile_cont(ret, 0.05) AS p05, quantile_cont(ret, 0.95) AS p95, (max(ts_s) - min(ts_s)) / count(*) / 86400 AS bar_days FROM eq GROUP BY strategy),
c AS (SELECT strategy, abs(avg(ret)) AS cvar_95 FROM eq JOIN b USING (strategy) WHERE ret <= p05 GROUP BY strategy),
m AS (SELECT *, (pow(growth, 365 / n_ret) - 1) * 100 AS annualized_return FROM b JOIN c USING (strategy) JOIN uwl USING (strategy))
""" + sel("strategy", METRICS, {
    "total_return_pct": "(final_value / 10000 - 1) * 100", "cagr": "(pow(final_value / 10000, 365 / n_bars) - 1) * 100",
    "volatility": "sd * sqrt(365)", "sharpe": "(mean - 0.05 / 365) / sd * sqrt(365)", "sortino": "(mean - 0.05 / 365) * 365 / (sdd * sqrt(365))",
    "calmar": "annualized_return / (max_drawdown * 100)", "var_95": "abs(p05)", "tail_ratio": "p95 / abs(p05)",
    "underwater_days": "underwater_bars * bar_days"}, "FROM m")


@query("return_metrics", "A4 A5 A6 A7 A8 A9 A10 A11 A12 X2", _M_SQL)
def _(spark, base):
    m = lg.return_metrics(equity(spark, base)).withColumnRenamed("symbol", "strategy")
    return cols(m, ["strategy"], METRICS)


@query("sharpe_variants", "A7 A9", EQ + """ SELECT strategy, round(avg(ret) / stddev_samp(ret), 6) + 0.0 AS raw, round(avg(ret) / stddev_samp(ret) * sqrt(count(ret) * 365.0 / ((max(ts_s) - min(ts_s)) / 86400.0)), 6) + 0.0 AS per_trades,
 round(avg(ret) / stddev_pop(ret) * sqrt(252 * 96), 6) + 0.0 AS bars_15m, round(avg(ret) / stddev_pop(ret) * sqrt(252 * 24), 6) + 0.0 AS bars_1h,
 round(avg(ret) / stddev_samp(ret) * sqrt(26208), 6) + 0.0 AS half_hours FROM eq GROUP BY strategy""")
def _(spark, base):
    e = lg.equity_returns(equity(spark, base))
    days = (F.max("ts_s") - F.min("ts_s")) / 86400.0
    raw, pop = F.avg("ret") / F.stddev_samp("ret"), F.avg("ret") / F.stddev_pop("ret")
    out = {"raw": raw, "per_trades": raw * F.sqrt(F.count("ret") * 365.0 / days), "bars_15m": pop * F.sqrt(F.lit(252.0 * 96)),
           "bars_1h": pop * F.sqrt(F.lit(252.0 * 24)), "half_hours": raw * F.sqrt(F.lit(26208.0))}
    return e.groupBy(F.col("symbol").alias("strategy")).agg(*[(F.round(c, 6) + F.lit(0.0)).alias(n) for n, c in out.items()])


@query("exit_reasons", "A17", TR + " SELECT strategy, exit_reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY strategy), 6) AS share FROM trades GROUP BY strategy, exit_reason")
def _(spark, base):
    n = trades(spark, base).groupBy("strategy", "exit_reason").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("strategy")), 6))


_MONTHS = ", ".join(f"round(max(ret) FILTER (month = {i}), 6) + 0.0 AS m{i}" for i in range(1, 13))


@query("monthly_returns", "A19 O4", EQ + f""", mo AS (SELECT strategy, year(make_timestamp(ts_s * 1000000)) AS year, month(make_timestamp(ts_s * 1000000)) AS month, max_by(value, ts_s) AS value FROM eq GROUP BY ALL),
mr AS (SELECT *, value / lag(value) OVER (PARTITION BY strategy ORDER BY year, month) - 1 AS ret FROM mo)
SELECT strategy, year::INT AS year, {_MONTHS} FROM mr GROUP BY strategy, year""")
def _(spark, base):
    at = F.timestamp_seconds("ts_s")
    mo = equity(spark, base).groupBy(F.col("symbol").alias("strategy"), F.year(at).alias("year"), F.month(at).alias("month")).agg(
        F.max_by("value", "ts_s").alias("value"))
    # one row per calendar month is all a strategy keeps here
    w = Window.partitionBy("strategy").orderBy("year", "month")
    mr = mo.withColumn("ret", ratio("value", F.lag("value").over(w)) - 1)
    p = mr.groupBy("strategy", "year").pivot("month", list(range(1, 13))).agg(F.max("ret"))
    return p.select("strategy", "year", *[(F.round(F.col(str(i)), 6) + F.lit(0.0)).alias(f"m{i}") for i in range(1, 13)])


@query("return_histogram", "A20", TR + """ SELECT strategy, least(floor((pnl_pct + 0.1) / 0.004 + 1e-9), 49)::INT AS bin, count(*) AS n FROM trades GROUP BY ALL""")
def _(spark, base):
    bin_ = F.least(F.floor((F.col("pnl_pct") + 0.1) / 0.004 + 1e-9), F.lit(49)).cast("int")
    return trades(spark, base).groupBy("strategy", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


MOM = {"n": None, "mean": 6, "sd": 6, "skew": 4, "kurt": 4, "skew_pop": 4, "kurt_pop": 4, "lo": 6, "q25": 6, "median": 6, "q75": 6, "hi": 6}


@query("return_moments", "A21 A22", EQ + ", s AS (SELECT strategy, count(ret)::DOUBLE AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, stddev_pop(ret) AS sp FROM eq GROUP BY strategy),"
       " c AS (SELECT strategy, n, mean, sd, avg(pow(ret - mean, 3)) / pow(sp, 3) AS g1, avg(pow(ret - mean, 4)) / pow(sp, 4) - 3 AS g2, min(ret) AS lo, quantile_cont(ret, 0.25) AS q25,"
       " quantile_cont(ret, 0.5) AS median, quantile_cont(ret, 0.75) AS q75, max(ret) AS hi FROM eq JOIN s USING (strategy) GROUP BY strategy, n, mean, sd, sp)"
       + sel("strategy", MOM, {"n": "n::BIGINT", "skew": "sqrt(n * (n - 1)) / (n - 2) * g1", "kurt": "(n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)",
                               "skew_pop": "g1", "kurt_pop": "g2"}, "FROM c"))
def _(spark, base):
    e = cut(lg.equity_returns(equity(spark, base)))
    s = e.groupBy("symbol").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"),
                                F.skewness("ret").alias("skew_pop"), F.kurtosis("ret").alias("kurt_pop"), F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    from barloom.operators.quantiles import quantile_columns
    s = s.join(quantile_columns(e, ["symbol"], "ret", {"q25": 0.25, "median": 0.5, "q75": 0.75}), "symbol")
    n = F.col("n").cast("double")
    s = s.withColumns({"skew": F.sqrt(n * (n - 1)) / (n - 2) * F.col("skew_pop"),
                       "kurt": (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("kurt_pop") + 6)})
    return cols(s.withColumnRenamed("symbol", "strategy"), ["strategy"], MOM)


@query("entry_gaps", "A37", TR + f""", g AS (SELECT strategy, (entry_s - lag(entry_s) OVER (PARTITION BY strategy ORDER BY entry_s, {_ORD})) / 3600.0 AS gap FROM trades)
SELECT strategy, count(gap) AS n_gaps, quantile_cont(gap, 0.5) AS median_gap_h, round(count(*) FILTER (gap < 24) / count(gap), 6) AS share_under_day FROM g GROUP BY strategy""")
def _(spark, base):
    g = lg.entry_gaps(trades(spark, base), "strategy")
    return g.select("strategy", "n_gaps", "median_gap_h", F.round("share_under_day", 6).alias("share_under_day"))


PERIODS = [("early", "1995-01-01", "1998-06-30"), ("middle", "1997-01-01", "2000-12-31"), ("late", "1999-06-01", "2002-12-31")]
_PV = "(VALUES " + ", ".join(f"('{n}', epoch(TIMESTAMP '{a}')::BIGINT, epoch(TIMESTAMP '{b}')::BIGINT)" for n, a, b in PERIODS) + ") p(period, lo, hi)"


@query("trades_by_period", "J10", TR + f""" SELECT period, strategy, count(*) AS n, round(avg(CASE WHEN exit_reason = 'sl' THEN 1.0 ELSE 0.0 END), 6) AS stop_rate,
 round(min(entry_s - lo) / 3600.0, 4) AS lead_h, round(sum(pnl), 1) AS pnl FROM trades JOIN {_PV} ON entry_s BETWEEN lo AND hi GROUP BY ALL""")
def _(spark, base):
    """Named ranges may overlap; a row carries the ones it falls in."""
    e = F.col("entry_s")
    def sec(d):
        return F.unix_seconds(F.lit(d).cast("timestamp"))
    hits = F.array_compact(F.array(*[
        F.when(e.between(sec(a), sec(b)), F.struct(F.lit(n).alias("period"), sec(a).alias("lo"))) for n, a, b in PERIODS]))
    t = trades(spark, base).withColumn("_p", F.explode(hits))
    return t.groupBy(F.col("_p.period").alias("period"), "strategy").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("exit_reason") == "sl").cast("double")), 6).alias("stop_rate"),
        F.round(F.min(e - F.col("_p.lo")) / 3600.0, 4).alias("lead_h"), F.round(F.sum("pnl"), 1).alias("pnl"))


@query("edge_summary", "A40", TR + """ SELECT strategy, count(*) AS n, round(sum(pnl_pct), 4) AS gross, round(sum(pnl_pct - 0.0015), 4) AS net,
 round(sum(pnl_pct - 0.0015) / (((max(entry_s) - min(entry_s)) // 86400) / 365.0), 4) + 0.0 AS net_per_year FROM trades GROUP BY strategy""")
def _(spark, base):
    years = F.floor((F.max("entry_s") - F.min("entry_s")) / 86400) / 365.0
    net = F.sum(F.col("pnl_pct") - 0.0015)
    return trades(spark, base).groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("pnl_pct"), 4).alias("gross"), F.round(net, 4).alias("net"),
        (F.round(net / years, 4) + F.lit(0.0)).alias("net_per_year"))


@query("missed_orders", "A40 U3", """SELECT o_orderpriority AS strategy, count(*) AS signals, count(*) FILTER (NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS missed
FROM orders GROUP BY 1""")
def _(spark, base):
    od = read_table(spark, base, "orders")
    li = read_table(spark, base, "lineitem", "l_orderkey")
    missed = od.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", F.lit(1).alias("m"))
    return od.join(missed, "o_orderkey", "left").groupBy(F.col("o_orderpriority").alias("strategy")).agg(
        F.count(F.lit(1)).alias("signals"), F.count("m").alias("missed"))


@query("distinct_counts", "A42", TR + " SELECT strategy, count(DISTINCT exit_reason) AS reasons, count(DISTINCT pnl_pct) AS levels, count(DISTINCT order_no) AS orders FROM trades GROUP BY strategy")
def _(spark, base):
    return trades(spark, base).groupBy("strategy").agg(
        F.count_distinct("exit_reason").alias("reasons"), F.count_distinct("pnl_pct").alias("levels"), F.count_distinct("order_no").alias("orders"))


_TOP = ", ".join(f"avg({c}) FILTER (best <= 10) AS win_{c}, avg({c}) FILTER (worst <= 10) AS lose_{c}" for c in ("pnl", "pnl_pct", "size"))


@query("winners_and_losers", "O1 W35", TR + f""", ranked AS (SELECT *, row_number() OVER (ORDER BY pnl DESC, {_ORD}) AS best, row_number() OVER (ORDER BY pnl, {_ORD}) AS worst FROM trades)
SELECT CASE WHEN best <= 10 THEN 'best' ELSE 'worst' END AS side, CASE WHEN best <= 10 THEN best ELSE worst END AS place, order_no, line_no, round(pnl, 4) AS pnl,
 round(avg(pnl) OVER (PARTITION BY best <= 10), 4) AS side_mean FROM ranked WHERE best <= 10 OR worst <= 10""")
def _(spark, base):
    t = trades(spark, base)
    best = t.orderBy(F.col("pnl").desc(), *ORDER).limit(10).withColumn("side", F.lit("best"))
    worst = t.orderBy(F.col("pnl"), *ORDER).limit(10).withColumn("side", F.lit("worst"))
    key = F.when(F.col("side") == "best", -F.col("pnl")).otherwise(F.col("pnl"))
    w = Window.partitionBy("side")
    both = best.unionByName(worst).withColumn("_k", key)
    return both.select("side", F.row_number().over(w.orderBy("_k", *ORDER)).alias("place"), "order_no", "line_no",
                       F.round("pnl", 4).alias("pnl"), F.round(F.avg("pnl").over(w), 4).alias("side_mean"))


@query("last_trades", "O3", TR + f""" SELECT strategy, order_no, line_no, exit_s, place FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY exit_s DESC, order_no DESC, line_no DESC, part_no DESC, supp_no DESC, notional DESC, size DESC) AS place FROM trades) WHERE place <= 5""")
def _(spark, base):
    """Top 5 per strategy: the rank filter is pushed below the shuffle as a per-task limit."""
    w = Window.partitionBy("strategy").orderBy(*[F.col(c).desc() for c in ORDER])
    return trades(spark, base).withColumn("place", F.row_number().over(w)).where("place <= 5").select(
        "strategy", "order_no", "line_no", "exit_s", "place")


@query("pattern_totals", "A33", TR + """ SELECT coalesce(symbol, '*') AS symbol, coalesce(strategy, '*') AS strategy, count(*) AS n, round(avg(pnl_pct), 6) + 0.0 AS mean_w, round(avg(CASE WHEN pnl_pct > 0.03 THEN 1.0 ELSE 0.0 END), 6) AS share_strong
 FROM trades GROUP BY GROUPING SETS ((symbol), (strategy), ())""")
def _(spark, base):
    g = trades(spark, base).groupingSets([["symbol"], ["strategy"], []], "symbol", "strategy").agg(
        F.count(F.lit(1)).alias("n"), (F.round(F.avg("pnl_pct"), 6) + F.lit(0.0)).alias("mean_w"),
        F.round(F.avg((F.col("pnl_pct") > 0.03).cast("double")), 6).alias("share_strong"))
    return g.select(F.coalesce("symbol", F.lit("*")).alias("symbol"), F.coalesce("strategy", F.lit("*")).alias("strategy"), "n", "mean_w", "share_strong")


@query("ledger_sink", "S13 U1", TR + """ SELECT symbol, strategy, count(*) AS n, round(sum(pnl), 2) AS pnl, max(exit_s) AS last_exit FROM trades GROUP BY symbol, strategy""")
def _(spark, base):
    """The ledger written as a partitioned table in the shared folder and read back."""
    import uuid
    from barloom.operators.lineage import ensure_checkpoint_dir
    from barloom.sources.files import write_table
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}"
    write_table(trades(spark, base), path, by=["symbol"])
    return spark.read.parquet(path).groupBy("symbol", "strategy").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("pnl"), 2).alias("pnl"), F.max("exit_s").alias("last_exit"))
