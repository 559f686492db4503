"""Nearest vectors in tiles against brute force."""

import numpy as np
import pytest

from barloom.operators import nearest as nn


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_nearest_vectors_match_brute_force(spark, monkeypatch, spread):
    """Norms alike, where no cell can be left out, and norms far apart, with many cells and blocks, ties and repeated vectors."""
    monkeypatch.setattr(nn, "BLOCK", 16)
    monkeypatch.setattr(nn, "CELLS", 5)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v *= 1 + spread * rng.integers(0, 8, size=(300, 1))
    v[40:60] = v[40]
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)] + [(None, v[0].tolist(), "x"), (900, None, "x"), (910, [None, *v[0].tolist()[1:]], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string").repartition(4)
    got = {}
    for r in nn.nearest(df, "vec_id", "embedding", "vec_id % 10 = 0", 4).collect():
        got.setdefault(r.query_id, {})[r.place] = (r.vec_id, r.d2)
    assert sorted(got) == list(range(0, 300, 10))
    for q, near in got.items():
        d2 = np.round(((v - v[q]) ** 2).sum(1), 8)
        want = sorted((d, i) for i, d in enumerate(d2.tolist()) if i != q)[:4]
        assert [near[p][0] for p in (1, 2, 3, 4)] == [i for _, i in want]
        assert np.allclose([near[p][1] for p in (1, 2, 3, 4)], [d for d, _ in want])


def test_far_cells_are_left_out_and_small_tables_work(spark):
    rows = [(i, [float(i), 0.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nn.nearest(df, "vec_id", "embedding", "vec_id = 0", 5).collect()
    assert [(r.query_id, r.vec_id, r.place, r.d2) for r in sorted(got, key=lambda r: r.place)] == [(0, 1, 1, 1.0), (0, 2, 2, 4.0)]
    assert nn.nearest(df.limit(0), "vec_id", "embedding", "vec_id = 0", 5).count() == 0
