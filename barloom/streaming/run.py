"""Driving a stream over what is there now and reading the result back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from barloom.operators.lineage import ensure_checkpoint_dir


#: state of `transformWithState` needs a store with column families
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Process everything available, write it to a table next to the checkpoints, return the table."""
    ensure_checkpoint_dir(spark)
    home = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        query = start(stream, home)
    finally:
        spark.conf.set(PROVIDER[0], before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def start(stream: DataFrame, home: str) -> StreamingQuery:
    return (stream.writeStream.format("parquet").outputMode("append").option("path", f"{home}/out")
             .option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start())
