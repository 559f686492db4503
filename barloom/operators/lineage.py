"""Cutting lineage at frames that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CONF = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; only a local session may fall back to its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get(CONF, None) or sc.getConf().get(CONF, None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
    else:
        raise ValueError(f"set {CONF} to a shared folder")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own next to the checkpoints, seen by every executor."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/table-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the frame once to reliable storage and read it from there, so that a
    second reader does not compute it again and a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a global aggregate, which is one row by definition, to every
    row: ``df.transform(attach, df.agg(...))``. Not for frames that can grow."""
    return df.crossJoin(F.broadcast(one_row))
