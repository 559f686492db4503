"""Folds of a stream in event-time order, whatever order and trigger its rows come in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: (state or None, microseconds, values) -> (state, one output tuple a row)
Step = Callable[[tuple | None, np.ndarray, list], tuple[tuple, list[tuple]]]


class InOrder(StatefulProcessor):
    """Rows wait in the state store, in parts by stretch of event time, until the watermark has passed them; then they are folded by (time, id).

    A task holds one Arrow batch on the way in and one stretch on the way out, never all that a trigger brought for a key. What stays
    is the folded value and the rows younger than the watermark; stretches go as they are folded. Timers wake a key that has rows due,
    so no other key is touched.
    """

    def __init__(self, state_type: str, value_type: str, step: Step, names: list[str], stretch_s: int):
        self.state_type, self.value_type, self.step, self.names, self.stretch_us = state_type, value_type, step, names, stretch_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", self.state_type)
        self.parts = handle.getMapState("parts", "stretch long", "parts int")
        self.rows = handle.getMapState("rows", "stretch long, part int", f"us array<long>, id array<long>, x array<{self.value_type}>")

    def _put(self, stretch: int, us: list, ids: list, values: list) -> None:
        part = self.parts.getValue((stretch,))[0] if self.parts.containsKey((stretch,)) else 0
        self.rows.updateValue((stretch, part), (us, ids, values))
        self.parts.updateValue((stretch,), (part + 1,))

    def _take(self, stretch: int) -> tuple[np.ndarray, np.ndarray, list]:
        """All rows of a stretch in order; they leave the state."""
        us, ids, values = [], [], []
        for part in range(self.parts.getValue((stretch,))[0]):
            a, b, x = self.rows.getValue((stretch, part))
            us += a
            ids += b
            values += x
            self.rows.removeKey((stretch, part))
        self.parts.removeKey((stretch,))
        us, ids = np.array(us, np.int64), np.array(ids, np.int64)
        order = np.lexsort((ids, us))
        return us[order], ids[order], [values[i] for i in order]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for stretch, part in pdf.groupby(pdf["us"] // self.stretch_us):
                self._put(int(stretch), part["us"].tolist(), part["id"].tolist(), [None if x is pd.NA or x != x else x for x in part["x"].tolist()])
                # a timer fires once the watermark is greater than it
                self.handle.registerTimer(int(part["us"].max()) // 1000 - 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = (timerValues.getCurrentWatermarkInMs() + 1) * 1000
        due = sorted(s for (s,) in list(self.parts.keys()) if s * self.stretch_us < end)
        state = self.folded.get() if self.folded.exists() else None
        for stretch in due:
            us, ids, values = self._take(stretch)
            n = int(np.searchsorted(us, end))
            if n < len(us):
                self._put(stretch, us[n:].tolist(), ids[n:].tolist(), values[n:])
            if n:
                state, out = self.step(state, us[:n], values[:n])
                made = pd.DataFrame(out, columns=self.names[len(key) + 1:])
                for k, value in enumerate([*key, ids[:n]]):
                    made.insert(k, self.names[k], value)
                yield made
        if due:
            self.folded.update(state)

    def close(self) -> None:
        pass


def fold_in_order(rows: DataFrame, key: str, value: str, step: Step, state_type: str, output: str, late: str = "0 seconds", stretch_s: int = 86_400) -> DataFrame:
    """rows(key, ts, event_id, value) -> key, event_id and what `step` gives for each row, in the order of (ts, event_id) within a key.

    A row comes out once the watermark, `late` behind the newest time seen, has passed it; one that comes later than that is lost, as is a row
    without a time. With the default, triggers must bring rows in order among each other, rows within a trigger need not be. `state_type`
    is the type of the value that `step` hands on. Needs the RocksDB state store, which `run.drain` asks for.
    """
    kind = dict(rows.dtypes)[value]
    schema = StructType.fromDDL(f"{key} {dict(rows.dtypes)[key]}, event_id long, {output}")
    timed = rows.where("ts IS NOT NULL").withWatermark("ts", late)
    slim = timed.select(key, "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("id"), F.col(value).alias("x"))
    processor = InOrder(state_type, kind, step, schema.fieldNames(), stretch_s)
    return slim.groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")
