"""Splitting long series so that no task ever holds a whole one.

Every ordered operator of the library is one of two shapes.

* *Bounded frame* (rolling windows, lags, leads): the series is cut by bar
  number into chunks and each chunk also receives the few rows before and
  after it that its frames reach. Windows then partition by (series, chunk).
* *Unbounded prefix* (running sum, running maximum, last seen value): each
  chunk is summarised to one row, the summaries are scanned, and every row
  combines its in-chunk prefix with what came before its chunk.

Bars are unique per (symbol, tf, ts), so a block of ``rows * step_s`` seconds
never holds more than ``rows`` of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barloom.operators.lineage import cut
from barloom.schema import SERIES

ROWS_PER_CHUNK = 8192
BLOCK = 1024


def time_block(rows: int = ROWS_PER_CHUNK) -> Column:
    return F.floor(F.col("ts_s") / (F.col("step_s") * F.lit(rows))).cast("long")


def with_bar_index(bars: DataFrame, rows: int = ROWS_PER_CHUNK, name: str = "bar_idx") -> DataFrame:
    """Number the bars of each series from 0 without sorting a series in one task."""
    return running(
        bars.withColumn("_block", time_block(rows)),
        SERIES, ["_block"], ["ts_s"], {name: ("sum", F.lit(1))},
    ).withColumn(name, (F.col(name) - 1).cast("long")).drop("_block")


def with_halo(df: DataFrame, before: int, after: int = 0, rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add ``chunk`` and copy edge rows to the neighbour chunks that look at them."""
    if before > rows or after > rows:
        raise ValueError("a halo cannot be longer than a chunk")
    home = F.floor(F.col("bar_idx") / rows).cast("long")
    place = F.pmod(F.col("bar_idx"), F.lit(rows))
    targets = [home]
    if before:
        targets.append(F.when(place >= rows - before, home + 1))
    if after:
        targets.append(F.when((place < after) & (home > 0), home - 1))
    placed = df.withColumn("chunk", F.explode(F.array_compact(F.array(*targets))))
    # windows cost far more than their bytes suggest, so the partition count is
    # taken from the session instead of being coalesced by size
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, *SERIES, "chunk")


def drop_halo(df: DataFrame, rows: int = ROWS_PER_CHUNK) -> DataFrame:
    return df.where(F.col("chunk") == F.floor(F.col("bar_idx") / rows)).drop("chunk")


def chunk_window(keys: Sequence[str] = SERIES) -> WindowSpec:
    return Window.partitionBy(*keys, "chunk").orderBy("bar_idx")


def over_chunks(
    df: DataFrame,
    fn: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = BLOCK,
    after: int = 0,
    rows: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Run ``fn(frame, window)`` on every chunk; its frames may reach
    ``before`` rows back and ``after`` rows ahead."""
    return drop_halo(fn(with_halo(df, before, after, rows), chunk_window()), rows)


def _summary(kind: str, value: Column, order: Column) -> Column:
    return {
        "sum": lambda: F.sum(value),
        "max": lambda: F.max(value),
        "min": lambda: F.min(value),
        "first": lambda: F.min_by(value, F.when(value.isNotNull(), order)),
        "last": lambda: F.max_by(value, F.when(value.isNotNull(), order)),
    }[kind]()


def _scan(kind: str, value: Column, w: WindowSpec) -> Column:
    return {
        "sum": lambda: F.sum(value),
        "max": lambda: F.max(value),
        "min": lambda: F.min(value),
        "first": lambda: F.first(value, ignorenulls=True),
        "last": lambda: F.last(value, ignorenulls=True),
    }[kind]().over(w)


def _merge(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(carry, local) if kind == "first" else F.coalesce(local, carry)


def running(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Inclusive running ``sum | max | min | first | last`` (nulls skipped) in (levels, order)
    order within ``keys``.

    ``levels`` are non-null columns, coarse to fine, that never decrease along the
    order. Each level is scanned over its own summaries only, so a task holds
    one finest chunk or one list of summaries, never a whole key.
    """
    keys, levels, order = list(keys), list(levels), list(order)
    names = list(outputs)
    kinds = {n: outputs[n][0] for n in names}
    # read twice, by the summaries and by the rows
    base = cut(df.withColumns({f"_v_{n}": outputs[n][1] for n in names}))

    chunk = keys + levels
    local_w = Window.partitionBy(*chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.struct(*order)
    sums = base.groupBy(*chunk).agg(*[_summary(kinds[n], F.col(f"_v_{n}"), rank).alias(f"_t_{n}") for n in names])

    carries = None
    for depth in range(len(levels), 0, -1):
        part, along = keys + levels[: depth - 1], levels[depth - 1]
        prior = Window.partitionBy(*part).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
        here = sums.select(
            *part, along,
            *[_scan(kinds[n], F.col(f"_t_{n}"), prior).alias(f"_c{depth}_{n}") for n in names],
        )
        carries = here if carries is None else carries.join(here, part + [along], "left")
        if depth > 1:
            sums = sums.groupBy(*part).agg(
                *[_summary(kinds[n], F.col(f"_t_{n}"), F.col(along)).alias(f"_t_{n}") for n in names])
    out = base.join(carries, chunk, "left")
    for n in names:
        value = _scan(kinds[n], F.col(f"_v_{n}"), local_w)
        for depth in range(len(levels), 0, -1):
            value = _merge(kinds[n], F.col(f"_c{depth}_{n}"), value)
        out = out.withColumn(n, value)
    return out.drop(*[f"_v_{n}" for n in names], *[f"_c{d}_{n}" for d in range(1, len(levels) + 1) for n in names])


def running_bars(df: DataFrame, outputs: dict[str, tuple[str, Column]], rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """``running`` over a bars frame that carries ``bar_idx``."""
    return running(
        df.withColumn("_block", F.floor(F.col("bar_idx") / rows)), SERIES, ["_block"], ["bar_idx"], outputs,
    ).drop("_block")
