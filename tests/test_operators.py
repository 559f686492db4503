"""Exact values, brute-force comparisons and chunk invariance."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.columns import rounded, sma
from barloom.functions.special import f_upper_tail
from barloom.operators import indicators as ind
from barloom.operators import ledger, ml, quality, stats
from barloom.operators.asof import around, asof_join, nearest_join
from barloom.operators.chains import greedy_chain, price_latch
from barloom.operators.chunks import over_chunks, running, with_bar_index
from barloom.operators.labels import trailing_stop
from barloom.operators.quantiles import exact_quantiles
from barloom.operators.states import hysteresis, latch


def bars_frame(spark, closes, symbol="A", tf="1h", step=3600, idx=True):
    closes = np.asarray(closes, float)
    n = len(closes)
    pdf = pd.DataFrame({
        "symbol": symbol, "tf": tf, "step_s": step, "ts_s": np.arange(n) * step, "open": closes, "high": closes * 1.01, "low": closes * 0.99,
        "close": closes, "volume": np.arange(n) % 7 + 1.0})
    df = spark.createDataFrame(pdf)
    return df.withColumn("bar_idx", F.floor(F.col("ts_s") / step).cast("long")) if idx else df


def walk(n, seed=42):
    rng = np.random.default_rng(seed)
    return 100 * np.cumprod(1 + rng.normal(0.0001, 0.01, n))


def column(df, name):
    return np.array([np.nan if r[0] is None else r[0] for r in df.orderBy("bar_idx").select(name).collect()], float)


def test_bar_index_ignores_input_order(spark):
    df = bars_frame(spark, walk(700), idx=False).orderBy(F.rand(1))
    df = df.unionByName(bars_frame(spark, walk(100), "B", idx=False)).where("ts_s % 5 <> 0")
    out = with_bar_index(df, rows=64).toPandas().sort_values(["symbol", "ts_s"])
    assert (out.groupby("symbol").cumcount() == out["bar_idx"]).all()


@pytest.mark.parametrize("levels", [["b"], ["a", "b"]])
def test_running_equals_whole_series(spark, levels):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.integers(0, 2, 900), "t": np.arange(900), "v": rng.normal(size=900)})
    pdf.loc[rng.random(900) < 0.3, "v"] = None
    df = spark.createDataFrame(pdf).withColumns({"a": F.floor(F.col("t") / 200), "b": F.floor(F.col("t") / 50)})
    v = F.when(~F.isnan("v"), F.col("v"))
    out = running(df, ["k"], levels, ["t"], {n: (n, v) for n in ("sum", "max", "min", "first", "last")}).toPandas().sort_values("t")
    for _, g in out.groupby("k"):
        assert np.allclose(g["sum"], g["v"].cumsum().ffill(), equal_nan=True)
        assert np.allclose(g["max"], g["v"].cummax().ffill(), equal_nan=True)
        assert np.allclose(g["min"], g["v"].cummin().ffill(), equal_nan=True)
        assert np.allclose(g["last"], g["v"].ffill(), equal_nan=True)
        assert np.allclose(g["first"].dropna(), g["v"].dropna().iloc[0])


@pytest.mark.parametrize("span", [9, 26, 50, 200])
def test_ema_over_many_chunks(spark, span):
    x = walk(5000)
    before = ind.carries_needed(1 - 2 / (span + 1)) * 1024
    df = over_chunks(bars_frame(spark, x), lambda d, w: ind.add_ema(d, {"e": span}), before=before, rows=max(2048, before))
    assert np.allclose(column(df, "e"), pd.Series(x).ewm(span=span, adjust=False).mean(), rtol=1e-12)


def test_adjusted_ema(spark):
    x = walk(3000)
    df = over_chunks(bars_frame(spark, x), lambda d, w: ind.add_ema_adjusted(d, {"e": 12}), rows=1024)
    assert np.allclose(column(df, "e"), pd.Series(x).ewm(span=12).mean(), rtol=1e-10)


def test_rolling_frames_do_not_depend_on_chunks(spark):
    x = walk(900)
    small = over_chunks(bars_frame(spark, x), lambda d, w: d.withColumn("m", sma("close", 21, w)), before=32, rows=64)
    assert np.allclose(column(small, "m"), pd.Series(x).rolling(21).mean(), equal_nan=True)


def test_long_frames(spark):
    x = walk(2500)
    s = pd.Series(x)
    def cols(d, w):
        d = d.withColumn("ret", F.col("close") / F.lag("close", 1).over(w) - 1)
        d = ind.add_rolling_moments(d, "ret", {"sd": (300, 100)})
        return ind.add_rolling_extremes(d, {"hi": ("max", "close", 300), "lo": ("min", "close", 300)})
    df = over_chunks(bars_frame(spark, x), cols, before=700, rows=1000)
    assert np.allclose(column(df, "hi"), s.rolling(300, min_periods=1).max())
    assert np.allclose(column(df, "lo"), s.rolling(300, min_periods=1).min())
    assert np.allclose(column(df, "sd"), s.pct_change().rolling(300, min_periods=100).std(), equal_nan=True, rtol=1e-9)


@pytest.mark.parametrize("series,variant,expected", [
    ([5.0] * 20, "plain", None), ([5.0] * 20, "inverse", 0.0), (list(range(1, 21)), "plain", 100.0), (list(range(1, 21)), "inverse", 0.0),
    (list(range(20, 0, -1)), "plain", 0.0)])
def test_rsi_edges(spark, series, variant, expected):
    df = over_chunks(bars_frame(spark, series), lambda d, w: ind.add_rsi(d, w, variant=variant), before=32)
    rows = [r["rsi"] for r in df.orderBy("bar_idx").collect()]
    assert rows[:13] == [None] * 13 and rows[-1] == expected


def test_wilder_rsi(spark):
    x = walk(400)
    d = np.diff(x)
    up, down = d[:15][d[:15] >= 0].sum() / 14, -d[:15][d[:15] < 0].sum() / 14
    want = np.full(len(x), 100 - 100 / (1 + up / down))
    for i in range(14, len(x)):
        up, down = (up * 13 + max(d[i - 1], 0)) / 14, (down * 13 + max(-d[i - 1], 0)) / 14
        want[i] = 100 - 100 / (1 + up / down)
    df = over_chunks(bars_frame(spark, x), lambda f, w: ind.add_rsi_wilder(f, w), after=32)
    assert np.allclose(column(df, "rsi_wilder"), want)


@pytest.mark.parametrize("hot,rest", [(4, 3), (4000, 6000), (60_000, 140_000)])
def test_exact_quantiles_with_hot_values(spark, hot, rest):
    rng = np.random.default_rng(3)
    x = np.r_[np.full(hot, 0.3), rng.normal(size=rest)]
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x}))
    qs = [0.0, 0.05, 0.3, 0.5, 0.95, 1.0]
    got = {r["q"]: r["value"] for r in exact_quantiles(df, ["k"], "x", qs).collect()}
    for q in qs:
        assert got[q] == pytest.approx(np.quantile(x, q), abs=1e-12)


@pytest.mark.parametrize("density", [0.02, 0.3, 0.95])
def test_greedy_chain_matches_a_loop(spark, density):
    rng = np.random.default_rng(7)
    n, reach = 3000, 40
    rows = [(s, "1h", i, i + int(rng.integers(1, reach + 1))) for s in ("A", "B") for i in range(n) if rng.random() < density]
    df = spark.createDataFrame(rows, "symbol string, tf string, bar_idx long, release long")
    want = []
    for s in ("A", "B"):
        free = 0
        for _, _, i, r in [x for x in rows if x[0] == s]:
            if i >= free:
                want.append((s, i))
                free = r
    for fan in (512, 3):  # all chunks at once, and four levels of composed functions
        got = greedy_chain(df, "bar_idx", "release", reach, rows=64, fan=fan).select("symbol", "bar_idx").collect()
        assert sorted((r[0], r[1]) for r in got) == want, fan


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_price_latch_matches_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    n = 1500
    price = walk(n, seed)
    enter, forced = rng.random(n) < 0.2, rng.random(n) < 0.01
    up, down = price / 1.03, price / 0.95
    df = spark.createDataFrame(pd.DataFrame({
        "symbol": "A", "tf": "1h", "bar_idx": np.arange(n), "price": price, "enter": enter, "forced": forced, "up": up, "down": down}))
    held, want = None, []
    for i in range(n):
        if held is None:
            if enter[i]:
                held = price[i]
                want.append((i, 1))
        elif forced[i] or up[i] > held or down[i] < held:
            held = None
            want.append((i, -1))
    for fan in (512, 3):
        got = price_latch(df, chunk_rows=64, fan=fan).select("bar_idx", "signal").collect()
        assert sorted((r[0], r[1]) for r in got) == want, fan


def test_chain_jumps_over_empty_chunks(spark):
    rows = [("A", "1h", i, i + 60) for i in (0, 3, 59, 62, 500, 570, 571, 4000)]
    df = spark.createDataFrame(rows, "symbol string, tf string, bar_idx long, release long")
    for fan in (512, 2):
        assert sorted(r.bar_idx for r in greedy_chain(df, "bar_idx", "release", 60, rows=64, fan=fan).collect()) == [0, 62, 500, 570, 4000]


def test_hysteresis_matches_a_loop(spark):
    rng = np.random.default_rng(5)
    kinds = rng.choice(["BULL", "BEAR", "SIDEWAYS"], 400, p=[0.5, 0.3, 0.2])
    df = bars_frame(spark, walk(400)).withColumn("regime", F.element_at(F.array(*[F.lit(str(k)) for k in kinds]), (F.col("bar_idx") + 1).cast("int")))
    confirmed = cand = None
    count, want = 0, []
    for k in kinds:
        if confirmed is None:
            confirmed = k
        elif k == confirmed:
            cand, count = None, 0
        elif k != cand:
            cand, count = k, 1
        else:
            count += 1
            if count >= 2:
                confirmed, cand, count = k, None, 0
        want.append(confirmed)
    assert [r[0] for r in hysteresis(df).orderBy("bar_idx").select("confirmed").collect()] == want


def test_latch_emits_changes_only(spark):
    df = bars_frame(spark, [1, 5, 5, 1, 1, 5])
    out = latch(df, F.col("close") > 3, F.col("close") < 3).orderBy("bar_idx").select("signal").collect()
    assert [r[0] for r in out] == [0, 1, 0, -1, 0, 1]


def test_asof_takes_equal_times_and_skips_later_ones(spark):
    left = spark.createDataFrame([("A", t) for t in (5, 10, 15, 300)], "symbol string, at long").withColumn("x", F.col("at"))
    right = spark.createDataFrame([("A", 10, 1.0), ("A", 16, 2.0), ("B", 1, 9.0)], "symbol string, at long, v double")
    got = asof_join(left, {"r": right}, ["symbol"], "at", block=8).orderBy("at").select("r.v").collect()
    assert [r[0] for r in got] == [None, 1.0, 1.0, 2.0]


def test_nearest_join_tolerance_and_ties(spark):
    rows = spark.createDataFrame([("A", 0), ("A", 60), ("A", 120)], "symbol string, at long")
    req = spark.createDataFrame([("A", 1, 30), ("A", 2, 95), ("A", 3, 400)], "symbol string, rid long, at long")
    got = {r["rid"]: r["match"]["at"] for r in nearest_join(req, rows, ["symbol"], "at", "rid", F.lit(30), 60).collect()}
    assert got == {1: 0, 2: 120}


def test_around_clips_at_the_ends(spark):
    bars = bars_frame(spark, range(1, 11)).select("symbol", "bar_idx", "close")
    ev = spark.createDataFrame([("A", 1, 2), ("A", 2, 9)], "symbol string, event_id long, center long")
    got = around(ev, bars, ["symbol"], "center", 3, 2).groupBy("event_id").agg(F.min("bar_position"), F.max("bar_position")).orderBy("event_id").collect()
    assert [tuple(r) for r in got] == [(1, -2, 2), (2, -3, 0)]


def test_trailing_stop_matches_a_loop(spark):
    path = [100.0, 103.0, 106.0, 104.0, 110.0, 95.0, 120.0]
    df = spark.createDataFrame([(100.0, 2.0, path)], "e double, atr double, path array<double>")
    got = df.select(trailing_stop(F.col("e"), F.col("atr"), F.col("path")).alias("t")).first()["t"]
    stop, af, exit_bar = 94.0, 0.02, None
    for i, p in enumerate(path, 1):
        if p <= stop:
            exit_bar = i
            break
        if (p - 100) / 100 >= 0.02:
            stop = max(stop, min(stop + (p - stop) * af, p * 0.99))
            af = min(af + 0.02, 0.2)
    assert got["exit_bar"] == exit_bar and got["stop"] == pytest.approx(stop)


def test_streaks_and_profit_factor(spark):
    pnl = [1, 2, -1, 3, 4, 5, -2, -3, -1, -1, 2]
    df = spark.createDataFrame([("s", i * 86400, i, float(p)) for i, p in enumerate(pnl)], "strategy string, exit_s long, order_no long, pnl double")
    r = ledger.streaks(df, ["strategy"], F.col("pnl") > 0, ["exit_s", "order_no"], per_slice=2).first()
    assert (r["max_wins"], r["max_losses"]) == (3, 4)
    f = df.select(ledger.profit_factor(F.lit(2.0), F.lit(0.0)).alias("a"), ledger.profit_factor(F.lit(0.0), F.lit(0.0)).alias("b")).first()
    assert math.isinf(f["a"]) and f["b"] == 0.0


def test_drawdown_of_a_known_curve(spark):
    eq = bars_frame(spark, [1.0, 1.1, 0.9, 1.2, 0.8]).withColumnRenamed("close", "value")
    assert ledger.with_drawdown(eq).agg(F.min("drawdown")).first()[0] == pytest.approx(-1 / 3)


def test_feature_contract(spark):
    df = spark.createDataFrame([(1, 2, 3)], "b int, c int, d int")
    rep = quality.contract_report(df, ["a", "b", "c"])
    assert rep == {"missing": ["a"], "extra": ["d"], "reordered": False}
    assert quality.require_columns(df, ["c", "b"]).columns == ["c", "b"]
    with pytest.raises(ValueError):
        quality.require_columns(df, ["a"])


def test_non_finite_rows(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (None,), (2.0,)], "x double")
    assert sorted(r[0] for r in quality.drop_non_finite(df, ["x"]).collect()) == [1.0, 2.0]
    with pytest.raises(Exception, match="bad row ratio"):
        quality.drop_non_finite(df, ["x"], max_bad_ratio=0.5).collect()
    assert quality.drop_non_finite(df, ["x"], max_bad_ratio=0.6).count() == 2


def test_temporal_split_is_half_open(spark):
    df = spark.sql("SELECT explode(sequence(timestamp'2020-01-01', timestamp'2020-01-05', interval 1 hour)) AS ts")
    part = ml.temporal_part(F.col("ts"), {"train": ("2020-01-01", "2020-01-02"), "val": ("2020-01-02", "2020-01-03"), "test": ("2020-01-03", "2020-01-04")})
    n = {r["p"]: r["count"] for r in df.groupBy(part.alias("p")).count().collect()}
    assert n == {"train": 24, "val": 24, "test": 24, None: 25}


def test_stratified_split_keeps_shares(spark):
    df = spark.range(5000).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    out = ml.stratified_part(df, "id", "label").groupBy("label").agg(F.avg((F.col("part") == "test").cast("double"))).collect()
    assert all(abs(r[1] - 0.2) < 0.02 for r in out)


def test_anova_and_tail(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4], "b": [2.0, 3, 4, 5], "c": [5.0, 6, 7, 8]})
    t = stats.with_f_pvalue(stats.variance_decomposition(stats.group_moments(spark.createDataFrame(pdf), ["a", "b", "c"]))).first()
    assert t["f_statistic"] == pytest.approx(10.4) and t["eta_squared"] == pytest.approx(34.6667 / 49.6667, abs=1e-4)
    assert t["p_value"] == pytest.approx(f_upper_tail(10.4, 2, 9))
    # with two numerator degrees of freedom the tail has a closed form
    assert f_upper_tail(10.4, 2, 9) == pytest.approx((1 + 2 * 10.4 / 9) ** -4.5)


def test_ks_against_sorted_arrays(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=500).round(2), rng.normal(0.3, 1.2, 500).round(2)
    got = stats.ks_pairs(spark.createDataFrame(pd.DataFrame({"a": a, "b": b})), ["a", "b"], rows=40).first()["ks"]
    grid = np.unique(np.r_[a, b])
    want = np.abs(np.searchsorted(np.sort(a), grid, "right") / 500 - np.searchsorted(np.sort(b), grid, "right") / 500).max()
    assert got == pytest.approx(want)


def test_mahalanobis_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    mean, inv = ml.gaussian_fit(df, "v")
    got = [r[0] for r in df.withColumn("d", ml.mahalanobis(F.col("v"), mean, inv)).orderBy("id").select("d").collect()]
    d = x - x.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(x.T) + 1e-6 * np.eye(5)), d))
    assert np.allclose(got, want, rtol=1e-8)


def test_auc_and_best_f1(spark):
    rows = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    assert stats.average_ranks_auc(df, "s", "y", rows=2).first()["auc"] == pytest.approx(4.5 / 6)
    best = stats.best_f1(df, "s", "y", rows=2).first()
    assert best["threshold"] == 0.35 and best["recall"] == 1.0


def test_rounding_has_no_negative_zero(spark):
    v = spark.range(1).select(rounded(F.lit(-1e-9)).alias("v")).first()["v"]
    assert math.copysign(1, v) == 1.0


def test_rounding_is_plain(spark):
    assert spark.range(1).select(rounded(F.lit(4.7e-7)).alias("v")).first()["v"] == 0.0


def test_greedy_chain_keeps_one_row_of_a_position(spark):
    from barloom.operators.chains import greedy_chain
    rows = [("A", "1h", i, 7, 9 + i) for i in range(4)] + [("A", "1h", 4, 9, 12), ("A", "1h", 5, 8, 10)]
    df = spark.createDataFrame(rows, "symbol string, tf string, bar_idx long, hour long, until long")
    assert sorted(r.bar_idx for r in greedy_chain(df, "hour", "until", 24).collect()) == [0, 4]


def test_asset_pairs_takes_symbols_from_the_data(spark):
    from barloom.operators.stats import asset_pairs, effective_weights
    rows = [(s, "1h", t, t * 3600, float((t * t * (k + 2)) % 11)) for k, s in enumerate("ABCDEF") for t in range(40)]
    df = spark.createDataFrame(rows, "symbol string, tf string, bar_idx long, ts_s long, ret double")
    got = {(r.left, r.right): r.corr for r in asset_pairs(df).collect()}
    assert len(got) == 15
    x = {s: [r[4] for r in rows if r[0] == s] for s in "AF"}
    assert got["A", "F"] == pytest.approx(np.corrcoef(x["A"], x["F"])[0, 1])
    scores = spark.createDataFrame([(s, 0.5) for s in "ABCDEF"], "symbol string, score double")
    weighted = {r.symbol: r for r in effective_weights(asset_pairs(df), scores, [("A", 3.0), ("F", 1.0)]).collect()}
    assert weighted["B"].contribution == 0
    assert weighted["A"].contribution == pytest.approx(0.5 * weighted["A"].effective_weight * 0.75)
