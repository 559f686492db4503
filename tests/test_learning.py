"""Models of many series against MLlib, one fit at a time."""

import numpy as np
from pyspark.ml.feature import VectorAssembler

from barloom.operators import ml
from barloom.plans import learning


def test_every_series_gets_a_row(spark):
    rng, rows, names = np.random.default_rng(4), [], ["a", "b"]
    for s in range(5):
        for i in range(300):
            a, b = rng.normal(s, 1 + s), rng.normal()
            rows.append((f"m{s}", "1h", i, float(a), float(b), float(rng.random() < 1 / (1 + np.exp(-(a - s) + s * b)))))
    rows += [("apart", "1h", i, float(i % 2), 1.0, float(i % 2)) for i in range(100)]  # separable, b constant
    rows += [("up", "1h", i, float(i), 0.0, 1.0) for i in range(50)] + [("down", "1d", i, float(i), 0.0, 0.0) for i in range(50)]
    rows += [("turns", "1h", i, float(i), 0.0, float(i < 45)) for i in range(50)]  # one class until its test rows
    rows += [("short", "1h", i, 0.0, 0.0, None) for i in range(3)]
    schema = "symbol string, tf string, bar_idx long, a double, b double, label double"
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = {(r.symbol, r.tf): (r.n, r.accuracy) for r in learning.series_accuracy(df, names).collect()}
    assert set(got) == {r[:2] for r in rows}
    assert got["up", "1h"] == got["down", "1d"] == (10, 1.0)
    assert got["turns", "1h"] == (10, 0.5) and got["short", "1h"] == (0, None)
    models = {r.symbol: r for r in ml.logistic_by_key(df.where("label IS NOT NULL AND bar_idx < 40"), ["symbol", "tf"], names, "label").collect()}
    for s in ("m0", "m2", "m4", "apart"):
        one = VectorAssembler(inputCols=names, outputCol="features").transform(df.where(f"symbol = '{s}' AND bar_idx < 40"))
        want = ml.logistic().setMaxIter(500).setTol(1e-12).fit(one)
        assert np.allclose(models[s].weights, want.coefficients.toArray(), atol=1e-4)
        assert np.isclose(models[s].intercept, want.intercept, atol=1e-4)
    quiet = learning.series_accuracy(df.where("symbol IN ('up', 'down')"), names)
    assert quiet.count() == 2
