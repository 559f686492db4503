"""Managed exits against a position walked bar by bar."""

import random

from pyspark.sql import functions as F

from barloom.operators import exits as ex

H = 12


def walked(entry, stop, atr, regime, closes):
    """One position, one bar after the other: stop, then time, then levels, then the trail."""
    risk, left, taken, out = abs(entry - stop), 1.0, set(), []
    level = entry - risk * {"BEAR_MARKET": 0.75, "CRISIS": 0.5}.get(regime, 1.0)
    trail, speed = entry - 3 * atr, 0.02
    for bar, c in enumerate(closes, 1):
        if c <= level:
            return [*out, ("STOP", bar, level, left)]
        if bar >= H:
            return [*out, ("TIME_STOP", bar, c, left)]
        for label, reward, share in ex.LEVELS:
            if regime != "BULL_TREND" and label not in taken and c >= entry + risk * reward:
                taken.add(label)
                out.append((label, bar, entry + risk * reward, left * share))
                left *= 1 - share
        if (c - entry) / entry >= 0.02:
            trail, speed = max(min(max(trail + (c - trail) * speed, trail), c * 0.99), trail), min(speed + 0.02, 0.2)
            level = max(level, trail)
    return [*out, ("OPEN", len(closes), closes[-1], left)] if closes else None


def test_exits_equal_a_walked_position(spark):
    rnd, rows = random.Random(4), []
    for i in range(400):
        entry, closes = 100.0, []
        for _ in range(rnd.choice([0, 1, 5, H - 1, H])):
            closes.append(round((closes[-1] if closes else entry) * (1 + rnd.gauss(0.004, 0.02)), 3))
        rows.append((i, entry, round(entry - rnd.uniform(1, 5), 2), rnd.choice([0.3, 1.0]), rnd.choice(["BULL_TREND", "SIDEWAYS", "BEAR_MARKET", "CRISIS"]), closes))
    df = spark.createDataFrame(rows, "i int, e double, stop double, atr double, regime string, closes array<double>")
    got = {r.i: r.x for r in df.select("i", ex.exits(F.col("e"), F.col("stop"), F.col("atr"), F.col("regime"), F.col("closes"), H).alias("x")).collect()}
    labels = set()
    for i, *row in rows:
        want = walked(*row)
        if want is None:
            assert got[i] is None
            continue
        assert [(x.label, x.bar) for x in got[i]] == [w[:2] for w in want]
        assert all(abs(x.price - w[2]) < 1e-9 and abs(x.size - w[3]) < 1e-12 for x, w in zip(got[i], want, strict=True))
        assert abs(sum(x.size for x in got[i]) - 1) < 1e-12
        labels |= {w[0] for w in want}
    assert labels == {"STOP", "TIME_STOP", "OPEN", "TP1", "TP2", "TP3"}
