"""State of the streams against loops, and its removal."""

import json
import random

from pyspark.sql import functions as F

from barloom.operators.bars import ohlcv
from barloom.sources.tables import line_ticks
from barloom.streaming.states import stream_hysteresis, stream_limits, stream_trailing, stream_watch
from barloom.streaming.run import PROVIDER, start

HOUR = 3_600_000


def watched(spark, tmp_path, batches):
    """Ticks (trade, hour, price) of each batch go through stream_watch, one trigger a batch; (outcomes, state rows at the end)."""
    schema = "symbol string, trade_id long, ts timestamp, event_id long, price double"
    home = str(tmp_path)
    done = 0
    for rows in batches:
        made = spark.createDataFrame([("x", t, h, p) for t, h, p in rows], "symbol string, trade_id long, h double, price double")
        made = made.select("symbol", "trade_id", F.timestamp_millis(((F.col("h") + 24) * HOUR).cast("long")).alias("ts"), (F.col("h") * 1000).cast("long").alias("event_id"), "price")
        made.coalesce(1).write.mode("append").parquet(f"{home}/in")
        run = (stream_watch(spark.readStream.schema(schema).parquet(f"{home}/in")).writeStream.format("parquet").option("path", f"{home}/out")
               .option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start())
        run.awaitTermination()
        done = json.loads(run.lastProgress.json)["stateOperators"][0]["numRowsTotal"] if run.lastProgress else done
    out = spark.read.schema("symbol string, trade_id long, outcome string, ticks int").parquet(f"{home}/out")
    return sorted((r.trade_id, r.outcome) for r in out.collect()), done


def test_a_reported_trade_is_not_opened_again_and_its_state_goes(spark, tmp_path):
    first = [(1, 0.0, 100.0), (1, 0.5, 100.5), (2, 0.0, 100.0), (2, 0.2, 99.0), (2, 0.3, 98.0)]
    second = [(3, 4.0, 100.0)]  # the watch of trades 1 and 2 is over, their spans are not
    third = [(1, 4.5, 50.0), (2, 4.5, 50.0), (4, 12.0, 100.0)]
    last = [(5, 30.0, 100.0)]
    got, kept = watched(spark, tmp_path, [first, second, third, last])
    assert got == [(1, "confirmed"), (2, "false_breakout"), (3, "confirmed"), (4, "confirmed")]
    assert kept == 1  # trade 5


def test_open_and_close_of_daily_bars_follow_the_time_of_day(spark, tmp_path):
    rows = [(1, 1, "2024-01-02 15:00:00", 10.0), (2, 1, "2024-01-02 09:00:00", 20.0), (3, 1, "2024-01-02 12:00:00", 30.0)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, t string, l_extendedprice double").select(
        "*", F.col("t").cast("timestamp").alias("l_shipdate"), F.lit(1.0).alias("l_quantity"), F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus")).drop("t")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    bar = ohlcv(line_ticks(spark, str(tmp_path)), "1d").first()
    assert (bar["open"], bar["close"], bar["high"], bar["low"]) == (20.0, 10.0, 30.0, 10.0)


def arrivals(seed, minutes=900, late=60):
    """(symbol, minute, id, value) in the order of arrival: at most `late` minutes behind the newest one before it."""
    rnd = random.Random(seed)
    rows = [(rnd.choice("ab"), rnd.randrange(minutes), i, rnd.choice([None, *range(-300, 300)])) for i in range(600)]
    return sorted(rows, key=lambda r: r[1] + rnd.random() * late * 0.9)


def streamed(spark, home, make, rows, schema, triggers):
    """Rows of the last trigger's output table; each trigger brings its share of the arrivals."""
    spark.conf.set(*PROVIDER)
    try:
        step = -(-len(rows) // triggers)
        for at in range(0, len(rows), step):
            made = spark.createDataFrame([(s, m, i, None if x is None else float(x)) for s, m, i, x in rows[at:at + step]], "symbol string, m long, event_id long, x double")
            made = made.select("symbol", F.timestamp_seconds(F.col("m") * 60 + 1_700_000_000).alias("ts"), "event_id", "x")
            made.repartition(3).write.mode("append").parquet(f"{home}/in")
            run = start(make(spark.readStream.schema(made.schema).parquet(f"{home}/in")), home)
            run.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER[0])
    return {(r[0], r[1]): tuple(r[2:]) for r in spark.read.schema(schema).parquet(f"{home}/out").collect()}


def in_time(rows, late=60):
    """Rows that the last watermark has passed, in event-time order."""
    last = max(m for _, m, *_ in rows)
    return sorted((r for r in rows if r[1] <= last - late), key=lambda r: (r[0], r[1], r[2]))


def test_limits_fold_in_event_time_order_over_triggers(spark, tmp_path):
    rows, want = arrivals(1), {}
    for symbol in "ab":
        value = peak = 1_000.0
        latched, day, lost = False, None, 0.0
        for _, m, i, x in (r for r in in_time(rows) if r[0] == symbol):
            today = (m * 60 + 1_700_000_000) // 86_400
            lost = (lost if today == day else 0.0) + (x or 0.0)
            day, value = today, value + (x or 0.0)
            peak = max(peak, value)
            latched = latched or (peak - value) / peak >= 0.2
            want[symbol, i] = (value, value <= 0 or -lost / value >= 0.05, latched)
    for triggers in (1, 4):
        make = lambda d: stream_limits(d.withColumnRenamed("x", "pnl"), 0.05, capital=1_000.0, late="60 minutes")
        got = streamed(spark, f"{tmp_path}/{triggers}", make, rows, "symbol string, event_id long, value double, day_hit boolean, latched boolean", triggers)
        assert got == want, triggers
    assert len(want) < len(rows)


def test_hysteresis_and_trailing_stops_do_not_depend_on_triggers(spark, tmp_path):
    rows = [(s, m, i, abs(x or 7) + 1) for s, m, i, x in arrivals(2)]
    regime = F.when(F.col("x") > 200, "up").when(F.col("x") > 100, "flat")
    shapes = {"h": (lambda d: stream_hysteresis(d.withColumn("regime", regime), late="60 minutes"), "symbol string, event_id long, regime string, confirmed string"),
              "t": (lambda d: stream_trailing(d.withColumnRenamed("x", "price"), atr=5.0, late="60 minutes"), "symbol string, event_id long, stop double, hit boolean")}
    for name, (make, schema) in shapes.items():
        once, thrice = (streamed(spark, f"{tmp_path}/{name}{n}", make, rows, schema, n) for n in (1, 3))
        assert once == thrice and set(once) == {(s, i) for s, _, i, _ in in_time(rows)}
    confirmed = last = None
    run, symbol = 0, None
    hysteresis = streamed(spark, f"{tmp_path}/again", *shapes["h"][:1], rows, shapes["h"][1], 2)
    for s, _, i, x in in_time(rows):
        if s != symbol:
            confirmed, last, run, symbol = None, None, 0, s
        now = "up" if x > 200 else "flat" if x > 100 else None
        run = run + 1 if now == last else 1
        last = now
        confirmed = now if confirmed is None or run >= 2 else confirmed
        assert hysteresis[s, i] == (now, confirmed)


def test_trailing_stop_from_an_entry_at_zero(spark, tmp_path):
    rows = [("a", m, m, x) for m, x in enumerate((0, None, 0, 10, 20, -400, 0))]
    make = lambda d: stream_trailing(d.withColumnRenamed("x", "price"), atr=5.0)
    got = streamed(spark, f"{tmp_path}/zero", make, rows, "symbol string, event_id long, stop double, hit boolean", 1)
    first, second = -15 + 25 * 0.02, -15 + 25 * 0.02
    second += (20 - first) * 0.04
    assert [got["a", m] for m in range(7)] == [(-15.0, False), (-15.0, False), (-15.0, False), (first, False), (second, False), (second, True), (-15.0, False)]


def test_confirmed_signals_meet_only_neighbours_in_time(spark, tmp_path):
    """Pairs against a loop, over slot borders and several triggers; the join's key must hold a slot of time, or each signal goes through all of its symbol."""
    from barloom.streaming.joins import confirmed_signals

    rng, start_s = random.Random(5), 1_700_000_400
    rows = sorted((start_s + rng.randrange(0, 20_000), rng.choice("ab"), rng.random() < 0.5, i) for i in range(400))
    rows += [(start_s + 30_000, "a", True, 400), (start_s + 30_600, "a", False, 401), (start_s + 90_000, "b", True, 402), (start_s + 90_000, "b", False, 403)]
    schema = "symbol string, s long, rule boolean, signal_id long"
    for k in range(0, len(rows), 101):
        (spark.createDataFrame([(y, s, r, i) for s, y, r, i in rows[k:k + 101]], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in")))
    ticks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("s"))
    joined = confirmed_signals(ticks.where("rule"), ticks.where("NOT rule"))
    start(joined, str(tmp_path / "run")).awaitTermination()
    got = sorted((r.symbol, r.rule_id, -1 if r.model_id is None else r.model_id, r.lag_s) for r in spark.read.parquet(str(tmp_path / "run/out")).collect() if r.rule_id < 400 or r.model_id)
    want = []
    for s, y, r, i in rows:
        near = [(y, i, j, float(t - s)) for t, z, q, j in rows if not q and z == y and s <= t <= s + 600] if r else []
        want += near if near or not r else [(y, i, -1, None)]
    assert got == sorted(want) and (("a", 400, 401, 600.0) in got) and (("b", 402, 403, 0.0) in got)
    batch = spark.createDataFrame([("a", 0, 1)], "symbol string, s long, signal_id long").withColumn("ts", F.timestamp_seconds("s"))
    plan = confirmed_signals(batch, batch)._jdf.queryExecution().optimizedPlan().toString()
    assert "slot" in next(line for line in plan.splitlines() if "Join" in line)
