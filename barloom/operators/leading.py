"""The first rows of every group, found where the rows are read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: rows that a task holds at once
HELD = 1 << 20


def _first(rows: pa.Table, keys: Sequence[str], order: Sequence[str], n: int) -> pa.Table:
    """The first n rows of each group; order columns ascend, nulls first and NaN last, as in Spark."""
    group = np.zeros(rows.num_rows, np.int64)
    for k in keys:
        values = pc.dictionary_encode(rows[k].combine_chunks(), null_encoding="encode")
        # numbered anew after each key, so that the codes stay below the rows held times a key's values
        group = np.unique(group * max(len(values.dictionary), 1) + values.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    by = [group]
    for k in order:
        column = rows[k].combine_chunks()
        if column.null_count:
            by.append(pc.is_valid(column).to_numpy(zero_copy_only=False))
        by.append(pc.fill_null(column, 0).to_numpy(zero_copy_only=False))
    at = np.lexsort(by[::-1])
    sorted_group = group[at]
    place = np.arange(len(at))
    starts = np.maximum.accumulate(np.where(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]])[:len(at)], place, 0))
    return rows.take(pa.array(at[place - starts < n]))


def leading(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, held: int = HELD) -> DataFrame:
    """keys and order columns of all rows that can be among the first ``n`` of their group: each task drops what is not among its own first ``n``.

    A task sorts no more than ``held`` rows, however many it reads; if their groups are so many that little goes, they are handed on as they are.
    """
    keys, order = list(keys), list(order)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0
        for batch in batches:
            kept.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= held:
                first = _first(pa.concat_tables(kept), keys, order, n)
                kept, rows = ([], 0) if first.num_rows > held // 2 else ([first], first.num_rows)
                if not kept:
                    yield from first.to_batches(10_000)
        if rows:
            yield from _first(pa.concat_tables(kept), keys, order, n).to_batches(10_000)

    slim = df.select(*keys, *order)
    return slim.mapInArrow(reduce, slim.schema)
