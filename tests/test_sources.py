"""Stored inputs and outputs."""

from pyspark.sql import functions as F

from barloom.operators.bars import from_timestamps
from barloom.operators.chunks import with_bar_index
from barloom.sources import files


def bars(spark, symbol="BTC"):
    return spark.sql("SELECT explode(sequence(timestamp'2024-01-01', timestamp'2024-01-03', interval 1 hour)) AS ts").select(
        F.lit(symbol).alias("symbol"), F.lit("1h").alias("tf"), "ts", *[F.lit(v).alias(n) for n, v in (("open", 1.0), ("high", 2.0), ("low", 0.5), ("close", 1.5), ("volume", 10.0))])


def test_bars_round_trip_prunes_and_pushes_down(spark, tmp_path):
    path = str(tmp_path / "bars")
    files.write_bars(bars(spark).unionByName(bars(spark, "ETH")), path)
    df = files.read_bars(spark, path, ["BTC"], "1h", "2024-01-01 05:00:00", "2024-01-01 10:00:00")
    assert df.count() == 6
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tf" in plan and "GreaterThanOrEqual(ts" in plan
    assert with_bar_index(from_timestamps(df)).agg(F.max("bar_idx")).first()[0] == 5


def test_both_file_naming_habits(spark, tmp_path):
    for name in ("BTCUSDT_1h.parquet", "ETH_USDT_4h.parquet"):
        bars(spark).drop("symbol", "tf").toPandas().to_parquet(tmp_path / name, coerce_timestamps="us", allow_truncated_timestamps=True)
    got = files.read_series_files(spark, str(tmp_path)).select("symbol", "tf").distinct().collect()
    assert sorted(tuple(r) for r in got) == [("BTC", "1h"), ("ETH", "4h")]


def test_tables_and_snapshot(spark, tmp_path):
    files.write_table(bars(spark).withColumn("x", F.lit(1.23456)), str(tmp_path / "t"), "csv", ["symbol"], places=2)
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).select("x").distinct().first()[0] == "1.23"
    (tmp_path / "top.csv").write_text("symbol,name,price,market_cap,rank,change_24h,change_7d,change_30d\nBTC,Bitcoin,1.5,2,1,0.1,0.2,0.3\n")
    assert files.read_asset_snapshot(spark, str(tmp_path / "top.csv")).first()["rank"] == 1


def test_patterns_and_knowledge(spark, tmp_path):
    docs = spark.createDataFrame([('{"id":"a","version":"2.0","meta":{"symbol":"BTC","tf":"1h","direction":"long"},"w_box":{"w_box":0.5}}',), ("{broken",)], "document string")
    files.write_patterns(docs, bars(spark), str(tmp_path / "p"))
    got = files.read_knowledge(spark, str(tmp_path / "p/documents")).orderBy(F.col("id").asc_nulls_last()).collect()
    assert got[0]["w_box"]["w_box"] == 0.5 and got[1]["id"] is None
