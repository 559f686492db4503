"""Books of bars against a loop, and parts of the full scores that must vary."""

from collections import defaultdict

from pyspark.sql import functions as F

from barloom.plans import full_scores as fs

BASE = "/root/testdata/sf0.01"


def test_books_hold_the_ten_best_of_each_side(spark):
    ticks = defaultdict(list)
    for r in spark.read.parquet(f"{BASE}/events.parquet").select("event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), "value").collect():
        ticks[r.event_type, r.s // 3600 * 3600].append(r.value)
    for r in spark.read.parquet(f"{BASE}/lineitem.parquet").collect():
        day = (r.l_shipdate - type(r.l_shipdate)(1970, 1, 1)).days * 86_400
        ticks[r.l_returnflag + r.l_linestatus, day].append((r.l_extendedprice / r.l_quantity, float(r.l_quantity)))
    books = fs.bar_books(spark, BASE).collect()
    assert len(books) == len(ticks)
    long = 0
    for b in books:
        offers = [o if isinstance(o, tuple) else (o, 1.0) for o in ticks[b.symbol, b.ts_s]]
        mid = (max(p for p, _ in offers) + min(p for p, _ in offers)) / 2
        bids = sorted((o for o in offers if o[0] < mid), key=lambda o: (-o[0], -o[1]))
        asks = sorted((o for o in offers if o[0] >= mid), key=lambda o: (o[0], -o[1]))
        long += len(bids) > 10 or len(asks) > 10
        assert [(x.price, x.size) for x in b.bids] == bids[:10] and [(x.price, x.size) for x in b.asks] == asks[:10]
    assert long > 0


def test_parts_and_signals_vary(spark):
    from barloom.plans import load_catalogue

    got = load_catalogue()["opportunity_full"].run(spark, BASE).agg(*[F.countDistinct(x).alias(x) for x in ("w_vol", "w_liq", "w_micro", "w")]).first()
    assert min(got) > 50
    model = load_catalogue()["model_scores_full"].run(spark, BASE).agg(*[F.countDistinct(x) for x in ("gate", "r_ood", "p_ml", "signal_scaled")]).first()
    assert min(model) > 1


def test_leading_rows_in_blocks_of_bounded_size(spark):
    """Each task keeps no more than the first rows of its groups, in blocks smaller than a group, with nulls first and NaN last."""
    from barloom.operators.leading import leading

    rows = [("ab"[i % 2], None if i % 5 == 0 else i % 3 == 0, None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(i * 37 % 101), float(i * 13 % 17)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, side boolean, x double, y double").repartition(3)
    got = defaultdict(list)
    few = leading(df, ["k", "side"], ["x", "y"], 4, held=50).collect()
    for r in few:
        got[r.k, r.side].append((r.x, r.y))
    want = defaultdict(list)
    for k, side, x, y in rows:
        want[k, side].append((x, y))
    def place(o):
        return (o[0] is not None, o[0] != o[0], 0 if o[0] is None or o[0] != o[0] else o[0], o[1])
    assert set(got) == set(want) and len(few) <= 3 * 6 * 4
    for key, offers in want.items():
        assert [place(o) for o in sorted(got[key], key=place)[:4]] == [place(o) for o in sorted(offers, key=place)[:4]]


def test_ticks_of_books_are_not_sorted_before_they_are_few(spark):
    plan = fs.bar_books(spark, BASE)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    window = next(i for i, line in enumerate(plan) if "Window [" in line)
    reduced = next(i for i, line in enumerate(plan) if "MapInArrow" in line)
    assert window < reduced and not any("WindowGroupLimit" in line for line in plan[reduced:])
