"""Trade-ledger and equity analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.columns import ratio
from barloom.operators.chunks import over_chunks, running, running_bars
from barloom.operators.lineage import attach, cut
from barloom.operators.quantiles import quantile_columns
from barloom.schema import SERIES

RISK_FREE = 0.05


def profit_factor(profit: Column, loss: Column) -> Column:
    """Infinite without losses but with profit, 0 with neither."""
    return F.when(loss > 0, ratio(profit, loss)).when(profit > 0, F.lit(float("inf"))).otherwise(0.0)


def trade_statistics(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    pnl, win = F.col("pnl"), F.col("pnl") > 0
    hours = (F.col("exit_s") - F.col("entry_s")) / 3600.0
    zero = F.lit(0.0)
    s = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(win).alias("winners"), F.count_if(~win).alias("losers"),
        F.coalesce(F.sum(F.when(win, pnl)), zero).alias("gross_profit"),
        F.abs(F.coalesce(F.sum(F.when(~win, pnl)), zero)).alias("gross_loss"),
        F.coalesce(F.avg(F.when(win, pnl)), zero).alias("avg_win"),
        F.coalesce(F.avg(F.when(~win, pnl)), zero).alias("avg_loss"),
        F.coalesce(F.avg(F.when(win, F.col("pnl_pct"))), zero).alias("avg_win_pct"),
        F.coalesce(F.avg(F.when(~win, F.col("pnl_pct"))), zero).alias("avg_loss_pct"),
        F.coalesce(F.max(F.when(win, pnl)), zero).alias("largest_win"),
        F.coalesce(F.min(F.when(~win, pnl)), zero).alias("largest_loss"),
        F.avg(pnl).alias("expectancy"), F.avg(hours).alias("avg_duration_hours"))
    return s.withColumns({
        "win_rate": F.col("winners") / F.col("total") * 100,
        "profit_factor": profit_factor(F.col("gross_profit"), F.col("gross_loss"))})


def streaks(trades: DataFrame, keys: Sequence[str], win: Column, order: Sequence[str], per_slice: int = 200_000) -> DataFrame:
    """Longest run of wins and of losses in exit order.

    A run is a set of rows with the same (row number - number of rows of its kind);
    both numbers come from the sliced running count and the runs are counted by a
    plain aggregation, so neither step sees a whole group."""
    df = cut(trades.withColumn("_win", win.cast("int")).withColumn("_day", F.floor(F.col("exit_s") / 86400)))
    span = df.agg(F.min("order_no").alias("_lo"), F.max("order_no").alias("_hi"))
    busiest = df.groupBy("_day").count().agg(F.ceil(F.max("count") / per_slice).alias("_n"))
    place = F.floor((F.col("order_no") - F.col("_lo")) * F.col("_n") / (F.col("_hi") - F.col("_lo") + 1))
    # both sides of these joins are single-row aggregates
    df = df.transform(attach, span).transform(attach, busiest).withColumn(
        "_slice", F.coalesce(place, F.lit(0)).cast("long")).drop("_lo", "_hi", "_n")
    df = running(df, keys, ["_day", "_slice"], order, {"_n": ("sum", F.lit(1)), "_w": ("sum", F.col("_win"))})
    island = F.when(F.col("_win") == 1, F.col("_n") - F.col("_w")).otherwise(F.col("_w"))
    runs = df.groupBy(*keys, "_win", island.alias("_island")).agg(F.count(F.lit(1)).alias("len"))
    return runs.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("_win") == 1, F.col("len"))), F.lit(0)).alias("max_wins"),
        F.coalesce(F.max(F.when(F.col("_win") == 0, F.col("len"))), F.lit(0)).alias("max_losses"))


def equity_curve(trades: DataFrame, strategy: str, capital: float = 10_000.0) -> DataFrame:
    """Daily compounded equity per strategy, shaped like bars: the trades of a day
    are averaged before anything is ordered."""
    day = (F.floor(F.col("exit_s") / 86400) * 86400).cast("long")
    daily = trades.groupBy(F.col(strategy).alias("symbol"), day.alias("ts_s")).agg(
        F.avg("pnl_pct").alias("day_ret"), F.sum("pnl").alias("day_pnl"))
    daily = daily.select("symbol", F.lit("1d").alias("tf"), F.lit(86400).cast("long").alias("step_s"), "ts_s", "day_ret", "day_pnl")
    block = F.floor(F.col("ts_s") / (86400 * 4096))
    out = running(daily.withColumn("_b", block), SERIES, ["_b"], ["ts_s"], {
        "bar_idx": ("sum", F.lit(1)), "_g": ("sum", F.log1p("day_ret")), "pnl_to_date": ("sum", F.col("day_pnl"))})
    return out.withColumns({"bar_idx": (F.col("bar_idx") - 1).cast("long"), "value": capital * F.exp("_g")}).drop("_b", "_g")


def equity_returns(equity: DataFrame) -> DataFrame:
    """Bar returns, to 10 places so that an unchanged value gives exactly 0."""
    step = lambda w: F.round(ratio("value", F.lag("value", 1).over(w)) - 1, 10)
    return over_chunks(equity, lambda d, w: d.withColumn("ret", step(w)), before=1)


def with_drawdown(equity: DataFrame) -> DataFrame:
    return running_bars(equity, {"peak": ("max", F.col("value"))}).withColumn("drawdown", ratio(F.col("value") - F.col("peak"), "peak"))


def return_metrics(equity: DataFrame, bars_per_year: int = 365, capital: float = 10_000.0) -> DataFrame:
    """One row per strategy: returns, risk, drawdown and tail figures."""
    eq = cut(equity_returns(with_drawdown(equity)))
    root, rf = bars_per_year ** 0.5, RISK_FREE / bars_per_year
    ret = F.col("ret")
    base = eq.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"), F.count("ret").alias("n_ret"), F.max_by("value", "bar_idx").alias("final_value"),
        F.exp(F.sum(F.log1p("ret"))).alias("growth"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"),
        F.stddev_samp(F.when(ret < 0, ret)).alias("sd_down"), F.abs(F.min("drawdown")).alias("max_drawdown"),
        F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"))
    tails = quantile_columns(eq, ["symbol"], "ret", {"p05": 0.05, "p95": 0.95})
    cvar = eq.join(tails, "symbol").where(ret <= F.col("p05")).groupBy("symbol").agg(F.abs(F.avg("ret")).alias("cvar_95"))
    m = base.join(tails, "symbol").join(cvar, "symbol").join(underwater(eq), "symbol", "left")
    years = F.col("n_ret") / bars_per_year
    excess = F.col("mean") - rf
    m = m.withColumns({
        "total_return_pct": (F.col("final_value") / capital - 1) * 100,
        "annualized_return": F.when(F.col("n_ret") > 0, (F.pow(F.col("growth"), 1 / years) - 1) * 100).otherwise(0.0),
        "cagr": (F.pow(F.col("final_value") / capital, bars_per_year / F.col("n_bars")) - 1) * 100,
        "volatility": F.col("sd") * root,
        "sharpe": F.when(F.col("sd") == 0, 0.0).otherwise(ratio(excess, "sd") * root),
        "sortino": F.when(F.coalesce(F.col("sd_down"), F.lit(0.0)) == 0,
                          F.when(excess > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(
            ratio(excess * bars_per_year, F.col("sd_down") * root)),
        "var_95": F.abs("p05"),
        "tail_ratio": F.when(F.col("p05") == 0, F.when(F.col("p95") > 0, F.lit(float("inf"))).otherwise(1.0)).otherwise(
            ratio("p95", F.abs("p05"))),
        "underwater_days": F.coalesce("underwater_bars", F.lit(0)) * F.when(
            F.col("n_bars") >= 2, (F.col("last_s") - F.col("first_s")) / F.col("n_bars") / 86400).otherwise(0.01)})
    return m.withColumn("calmar", F.when(F.col("max_drawdown") > 0, F.col("annualized_return") / (F.col("max_drawdown") * 100)).otherwise(0.0))


def underwater(equity: DataFrame) -> DataFrame:
    """Longest stretch of bars below the running peak."""
    dry = F.when(F.col("drawdown") >= 0, F.col("bar_idx"))
    marked = running_bars(equity, {"_dry": ("last", dry)})
    runs = marked.where(F.col("drawdown") < 0).groupBy("symbol", "_dry").agg(F.count(F.lit(1)).alias("len"))
    return runs.groupBy("symbol").agg(F.max("len").alias("underwater_bars"))


def entry_gaps(trades: DataFrame, key: str) -> DataFrame:
    """Median gap between consecutive entries and share of gaps under a day, from
    per-instant counts: all but the first entry of an instant have gap 0."""
    per = trades.groupBy(F.col(key).alias("symbol"), F.lit("entries").alias("tf"), F.col("entry_s").alias("ts_s")).agg(F.count(F.lit(1)).alias("n"))
    month = F.floor(F.col("ts_s") / (86400 * 30))
    per = running(per.withColumn("_b", month), SERIES, ["_b"], ["ts_s"], {"bar_idx": ("sum", F.lit(1))}).withColumn("bar_idx", (F.col("bar_idx") - 1).cast("long"))
    gaps = over_chunks(per, lambda d, w: d.withColumn("gap_h", (F.col("ts_s") - F.lag("ts_s", 1).over(w)) / 3600.0), before=1)
    one = F.when(F.col("gap_h").isNotNull(), F.struct("gap_h", F.lit(1).cast("long").alias("c")))
    zero = F.when(F.col("n") > 1, F.struct(F.lit(0.0).alias("gap_h"), (F.col("n") - 1).alias("c")))
    counted = gaps.select("symbol", F.explode(F.array_compact(F.array(one, zero))).alias("g")).groupBy("symbol", "g.gap_h").agg(F.sum("g.c").alias("c"))
    counted = cut(counted.withColumn("_b", F.floor(F.col("gap_h") / 24)))
    r = running(counted, ["symbol"], ["_b"], ["gap_h"], {"upto": ("sum", F.col("c"))})
    r = r.join(counted.groupBy("symbol").agg(F.sum("c").alias("total")), "symbol")
    pos = (F.col("total") - 1) / 2.0
    return r.groupBy(F.col("symbol").alias(key)).agg(
        F.max("total").alias("n_gaps"),
        ((F.min(F.when(F.col("upto") > F.floor(pos), F.col("gap_h"))) + F.min(F.when(F.col("upto") > F.ceil(pos), F.col("gap_h")))) / 2
         ).alias("median_gap_h"),
        (F.sum(F.when(F.col("gap_h") < 24, F.col("c")).otherwise(0)) / F.max("total")).alias("share_under_day"))
