"""Rolling distances and walking-forward fits from moments against rows gathered one by one."""

import numpy as np

from barloom.operators import moments as mo


def test_distances_and_folds_equal_those_from_rows(spark):
    rng, rows = np.random.default_rng(3), []
    for s in ("a", "b"):
        for i in range(230):
            if s == "b" and 60 <= i < 90:
                continue  # blocks may be missing
            x = rng.normal(size=2)
            rows.append((s, i, i // 10, float(x[0]), None if i % 13 == 5 else float(x[1]), float(2 * x[0] - x[1] + 0.1 * rng.normal())))
    df = spark.createDataFrame(rows, "k string, i int, block long, p double, q double, y double").repartition(4)
    got = {(r.k, r.i): r.distance for r in mo.with_rolling_distance(df, ["k"], "block", ["p", "q"], 3).collect()}
    assert len(got) == len(rows)
    for s, i, b, p, q, _ in rows:
        past = np.array([r[3:5] for r in rows if r[0] == s and b - 3 <= r[2] < b and r[4] is not None])
        if len(past) < 2 or q is None:
            assert got[s, i] is None
            continue
        d = np.array([p, q]) - past.mean(0)
        assert np.isclose(got[s, i], np.sqrt(d @ np.linalg.inv(np.cov(past.T) + 1e-6 * np.eye(2)) @ d))
    fits = mo.fold_fits(mo.block_moments(df, ["k"], "block", ["p", "q", "y"]), ["k"], "block", 3, train=5, test=2, step=3).collect()
    assert {(r.k, r.fold) for r in fits} == {(s, f) for s in "ab" for f in range(8) if any(r[0] == s and f * 3 <= r[2] < f * 3 + 5 for r in rows)}
    for r in fits:
        def part(lo, hi, k=r.k):
            return np.array([x[3:] for x in rows if x[0] == k and lo <= x[2] < hi and x[4] is not None], float).reshape(-1, 3)
        a, b = part(r.fold * 3, r.fold * 3 + 5), part(r.fold * 3 + 5, r.fold * 3 + 7)
        x = np.c_[np.ones(len(a)), a[:, :2]]
        w = np.linalg.solve(x.T @ x + np.diag([0, 1, 1]), x.T @ a[:, 2])
        assert (r.n_train, r.n_test) == (len(a), len(b)) and np.allclose([r.intercept, *r.weights], w)
        if len(b):
            assert np.isclose(r.mse, ((b[:, 2] - np.c_[np.ones(len(b)), b[:, :2]] @ w) ** 2).mean())
        else:
            assert r.mse is None
