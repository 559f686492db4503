"""Boosted trees by series against a plain booster, in both ways of summing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import boosting as bo

OPTIONS = dict(depth=2, rate=0.3, ridge=1.0, least=0.5)


def plain(x, y, w, kind, trees, depth, rate, ridge, least):
    """Tree by tree and row by row: nodes are lists of rows, every cut of every column is tried."""
    mean = (w * y).sum() / w.sum()
    margin = np.full(len(y), mean if kind == "squared" else np.log(mean / (1 - mean)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = (w * (margin - y), w.copy()) if kind == "squared" else (w * (p - y), w * p * (1 - p))
        nodes = [list(range(len(y)))]
        for _ in range(depth):
            below = []
            for rows in nodes:
                best, where = 0.0, None
                for c in range(x.shape[1]):
                    for at in range(x[:, c].max() + 1):
                        left = [i for i in rows if x[i, c] <= at]
                        right = [i for i in rows if x[i, c] > at]
                        if h[left].sum() < least or h[right].sum() < least:
                            continue
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                        if round(gain, 9) > best:
                            best, where = round(gain, 9), (left, right)
                below += where or (rows, [])
            nodes = below
        for rows in nodes:
            if rows:
                margin[rows] += -rate * g[rows].sum() / (h[rows].sum() + ridge)
    return margin if kind == "squared" else 1 / (1 + np.exp(-margin))


def frame(spark):
    rng, rows = np.random.default_rng(6), []
    for s in range(3):
        for i in range(90):
            a, b = float(np.round(rng.normal(), 2)), float(rng.integers(0, 4))
            y = a * (s - 1) + (b == 2) + rng.normal() * 0.3
            rows.append((f"s{s}", "1h", i, a if i % 17 else None, b if i % 23 else float("nan"), float(y > 0.4), float(y), 1.0 + i % 2))
    rows += [("one", "1d", i, float(i), 0.0, 1.0, 2.0, 1.0) for i in range(20)]
    return spark.createDataFrame(rows, "symbol string, tf string, i int, a double, b double, label double, y double, w double")


@pytest.mark.parametrize(("kind", "label"), [("logistic", "label"), ("squared", "y")])
def test_models_equal_a_plain_booster(spark, kind, label):
    keys = ["symbol", "tf"]
    df = bo.binned(frame(spark).repartition(4), keys, ["a", "b"], bins=8).cache()
    models = {n: bo.boosted_by_key(df, keys, label, "w", kind, trees=3, bins=8, task_rows=n, **OPTIONS) for n in (1000, 30)}
    for model in models.values():
        got = bo.scored(df, model, keys, kind, slice_rows=25).toPandas()
        assert len(got) == 290
        for _, own in got.groupby(keys):
            own = own.sort_values("i")
            if own["symbol"].iloc[0] == "one":
                assert (own["score"] > 0.999).all() if kind == "logistic" else np.allclose(own["score"], 2)
                continue
            want = plain(np.array(own["bins"].tolist()), own[label].to_numpy(), own["w"].to_numpy(), kind, 3, **OPTIONS)
            assert np.allclose(own["score"], want, atol=1e-9)
    found = bo.gains(models[1000], keys, ["a", "b"]).collect()
    assert {r.feature for r in found} == {"a", "b"} and all(r.gain > 0 for r in found) and all(r.symbol != "one" for r in found)


def test_bins_count_the_edges_below(spark):
    df = frame(spark)
    got = bo.binned(df, ["symbol"], ["a"], fit_on="i < 50", bins=4).where("symbol = 's1'").toPandas()
    edges = df.where("symbol = 's1' AND i < 50").select(F.percentile_approx("a", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000)).first()[0]
    assert [b[0] for b in got["bins"]] == [0 if np.isnan(a) else sum(a > e for e in edges) for a in got["a"]]
