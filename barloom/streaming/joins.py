"""Joins of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def confirmed_signals(rule: DataFrame, model: DataFrame, within: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """rule(symbol, ts, signal_id), model(symbol, ts, signal_id) -> symbol, rule_id, model_id, lag_s: each rule signal with every
    model signal of its symbol from its time on until `within` later, or once with nulls when there was none.

    Both sides have a watermark and the join a time range, so Spark drops a signal from the state once no partner can come any
    more: rule signals after `within`, model signals as soon as the rule side's watermark has passed them. A signal later than `late` is lost.

    A signal meets all rows that the state holds under its key, so slots of time as long as `within` belong to the key. A rule signal stays in its own
    slot and comes once; a model signal also goes to the slot before its own, where the rule signals are that it may still confirm.
    """
    span = F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {within})")

    def slot(at):
        return F.unix_micros(at) - F.pmod(F.unix_micros(at), span)

    a = rule.select("symbol", F.col("ts").alias("rule_ts"), F.col("signal_id").alias("rule_id")).withWatermark("rule_ts", late)
    b = model.select(F.col("symbol").alias("other"), F.col("ts").alias("model_ts"), F.col("signal_id").alias("model_id")).withWatermark("model_ts", late)
    a = a.withColumn("slot", slot("rule_ts"))
    b = b.withColumn("other_slot", F.explode(F.array(slot("model_ts") - span, slot("model_ts"))))
    near = F.expr(f"symbol = other AND slot = other_slot AND model_ts >= rule_ts AND model_ts <= rule_ts + INTERVAL {within}")
    lag = (F.unix_micros("model_ts") - F.unix_micros("rule_ts")) / 1e6
    return a.join(b, near, "left_outer").select("symbol", "rule_id", "model_id", lag.alias("lag_s"))
