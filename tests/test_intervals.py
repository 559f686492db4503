"""Interval unions and overlaps against all pairs."""

import random

from pyspark.sql import functions as F

from barloom.operators import intervals as iv


def covered(rows, key):
    return {t for k, a, b in rows if k == key and b is not None for t in range(a, b)}


def test_unions_and_overlaps(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), a := rnd.randrange(400), rnd.choice([a + rnd.randrange(30), a + rnd.randrange(3), None])) for _ in range(160)]
    rows += [("long", 0, 500), ("long", 3, 5), ("long", 490, 510), ("touch", 1, 4), ("touch", 4, 6), ("apart", 1, 4), ("apart", 5, 6), ("apart", 1, 4)]
    df = spark.createDataFrame(rows, "k string, start long, end long").repartition(3)
    got = [tuple(r) for r in iv.merged(df, ["k"], width=50).collect()]
    for key in {r[0] for r in rows}:
        own = sorted(r[1:] for r in got if r[0] == key)
        assert covered(got, key) == covered(rows, key)
        assert all(a[1] < b[0] for a, b in zip(own, own[1:], strict=False)), key
    other = [(k, a, a + rnd.randrange(1, 90)) for k in ("a", "b", "long") for a in (rnd.randrange(450) for _ in range(40))]
    right = spark.createDataFrame(other, "k string, r_start long, r_end long")
    for width in (7, 64, 1000):
        met = iv.overlapping(df.where("end > start"), right, ["k"], width).select("k", "start", "end", "r_start", "r_end")
        want = sorted((k, a, b, x, y) for k, a, b in rows if b is not None and b > a for k2, x, y in other if k == k2 and a < y and x < b)
        assert sorted(tuple(r) for r in met.collect()) == want
    assert iv.merged(df.limit(0), ["k"]).count() == 0 and iv.overlapping(df.limit(0), right, ["k"], 9).agg(F.count("*")).first()[0] == 0
