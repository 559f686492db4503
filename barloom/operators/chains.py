"""Order-dependent selection and price-dependent latches, cut into chunks.

Both are folds over a series whose next step depends on the last one. A chunk is
summarised as a *function* of the state it is entered with; the functions are
short (their size is bounded by the chunk or by the reach of one step), so they
compose along the series cheaply, and a second pass replays every chunk with
its true entry state. No task ever holds more than one chunk of rows, or the
functions of ``FAN`` neighbours: longer series are composed level by level, up
to one function for each ``FAN`` nodes and down again with true entry states.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from barloom.operators.lineage import cut
from barloom.schema import SERIES

ROWS = 8192
#: neighbours whose functions one task composes
FAN = 512


def entry_states(maps: DataFrame, keys: Sequence[str], state_type: str, initial, apply: Callable, join: Callable, fan: int = FAN) -> DataFrame:
    """maps(keys, _chunk, function columns) -> (keys, _chunk, _entry), the state each chunk is entered with.

    ``apply(row, state)`` gives the state behind a chunk, ``join(rows)`` the function columns of consecutive chunks taken together; both get
    dicts, with ``_first`` and ``_last`` for the chunks a function covers. Levels are added until the nodes on top of a series are at most ``fan``.
    """
    keys = list(keys)
    types = dict(maps.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)
    columns = [c for c in maps.columns if c not in (*keys, "_chunk")]
    shape = head + ", _node long, _first long, _last long, " + ", ".join(f"{c} {types[c]}" for c in columns)
    level = cut(maps.select(*keys, F.col("_chunk").alias("_node"), F.col("_chunk").alias("_first"), F.col("_chunk").alias("_last"), *columns))
    levels, top = [level], level.agg(F.max(F.abs("_node"))).first()[0] or 0

    def joined(key, pdf):
        rows = pdf.sort_values("_node").to_dict("records")
        made = {**dict(zip(keys, key)), "_node": key[-1], "_first": rows[0]["_first"], "_last": rows[-1]["_last"], **join(rows)}
        return pd.DataFrame([made])[[*keys, "_node", "_first", "_last", *columns]]

    def walked(key, pdf):
        rows, state, out = pdf.sort_values("_node").to_dict("records"), initial, []
        if "_up" in pdf.columns:
            state = rows[0]["_up"]
        for row in rows:
            out.append(state)
            state = apply(row, state)
        return pd.DataFrame({**{k: v for k, v in zip(keys, key)}, "_node": [r["_node"] for r in rows], "_entry": out})

    while top >= fan:
        level = cut(level.groupBy(*keys, F.floor(F.col("_node") / fan).cast("long").alias("_up_node")).applyInPandas(joined, shape))
        levels.append(level)
        top //= fan
    entries = levels.pop().groupBy(*keys).applyInPandas(walked, f"{head}, _node long, _entry {state_type}")
    while levels:
        parents = entries.select(*keys, F.col("_node").alias("_up_node"), F.col("_entry").alias("_up"))
        below = levels.pop().withColumn("_up_node", F.floor(F.col("_node") / fan).cast("long")).join(parents, [*keys, "_up_node"])
        entries = below.groupBy(*keys, "_up_node").applyInPandas(walked, f"{head}, _node long, _entry {state_type}")
    return entries.withColumnRenamed("_node", "_chunk")


def _free_after(pos: np.ndarray, release: np.ndarray, end: int) -> np.ndarray:
    """For each candidate: how far past the chunk end the chain stays busy if it is taken."""
    out = np.zeros(len(pos), dtype=np.int64)
    nxt = np.searchsorted(pos, release)
    for k in range(len(pos) - 1, -1, -1):
        out[k] = out[nxt[k]] if nxt[k] < len(pos) else max(0, release[k] - end)
    return out


def greedy_chain(cands: DataFrame, pos: str, release: str, reach: int, keys: Sequence[str] = SERIES, rows: int = ROWS, fan: int = FAN) -> DataFrame:
    """Keep a candidate when it is not before the release of the last kept one.

    ``release - pos`` must lie in 1..reach, and reach <= rows. Of candidates at one
    position, the one with the earliest release is looked at."""
    if reach > rows:
        raise ValueError("a step must not jump over a whole chunk")
    keys = list(keys)
    cands = cut(cands.withColumn("_chunk", F.floor(F.col(pos) / rows).cast("long")).withColumn("_uid", F.monotonically_increasing_id()))
    slim = cands.select(*keys, "_chunk", "_uid", F.col(pos).cast("long").alias("_pos"), F.col(release).cast("long").alias("_rel"))
    types = dict(slim.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)

    def summarise(key, pdf):
        pdf = pdf.sort_values(["_pos", "_rel", "_uid"])
        p, r = pdf["_pos"].to_numpy(), pdf["_rel"].to_numpy()
        start, end = int(key[-1]) * rows, (int(key[-1]) + 1) * rows
        after = _free_after(p, r, end)
        entry = np.arange(start, start + reach + 1)
        k = np.searchsorted(p, entry)
        out = np.where(k < len(p), after[np.minimum(k, len(p) - 1)], np.maximum(0, entry - end))
        return pd.DataFrame([[*key, out.tolist()]], columns=[*keys, "_chunk", "_map"])

    # a state is the place up to which the chain is busy, so chunks without candidates need no row
    def apply(row, busy):
        at = max(0, int(busy) - int(row["_first"]) * rows)
        return (int(row["_last"]) + 1) * rows + int(row["_map"][at])

    def join(parts):
        first, *others = parts
        busy = (int(first["_last"]) + 1) * rows + np.asarray(first["_map"])
        for row in others:
            busy = (int(row["_last"]) + 1) * rows + np.asarray(row["_map"])[np.maximum(0, busy - int(row["_first"]) * rows)]
        return {"_map": (busy - (int(parts[-1]["_last"]) + 1) * rows).tolist()}

    def replay(key, pdf):
        pdf = pdf.sort_values(["_pos", "_rel", "_uid"])
        p, r = pdf["_pos"].to_numpy(), pdf["_rel"].to_numpy()
        k = int(np.searchsorted(p, int(pdf["_entry"].iloc[0])))
        kept = []
        while k < len(p):
            kept.append(k)
            k = int(np.searchsorted(p, r[k]))
        return pdf.iloc[kept][["_uid"]]

    maps = slim.groupBy(*keys, "_chunk").applyInPandas(summarise, f"{head}, _chunk long, _map array<long>")
    entries = entry_states(maps, keys, "long", -(1 << 62), apply, join, fan)
    kept = slim.join(entries, [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(replay, "_uid long")
    return cands.join(kept, "_uid").drop("_chunk", "_uid")


def _first_exit(price, up, down, forced, start: int):
    """First place from ``start`` on where a position entered at ``price`` ends."""
    hit = forced[start:] | (up[start:] > price) | (down[start:] < price)
    i = int(np.argmax(hit)) if len(hit) else 0
    return start + i if len(hit) and hit[i] else -1


def _run(state, price, enter, up, down, forced, start: int = 0):
    """Replay from ``start``; state is nan when flat, else the entry price."""
    n, i, signals = len(price), start, []
    while i < n:
        if np.isnan(state):
            ahead = enter[i:]
            j = int(np.argmax(ahead)) if len(ahead) else 0
            if not ahead[j]:
                break
            i += j
            signals.append((i, 1))
            state = price[i]
            i += 1
        else:
            j = _first_exit(state, up, down, forced, i)
            if j < 0:
                break
            signals.append((j, -1))
            state, i = np.nan, j + 1
    return state, signals


def price_latch(rows: DataFrame, chunk_rows: int = ROWS, fan: int = FAN) -> DataFrame:
    """Enter/exit signals of a latch whose exits depend on the entry price.

    ``rows`` carries symbol, tf, bar_idx, price, enter, forced, up, down: a position
    opened at e ends at the first later bar with forced, up > e or down < e. Only
    bars where a signal fires are returned, with ``signal`` 1 or -1."""
    slim = cut(rows.select(*SERIES, "bar_idx", F.floor(F.col("bar_idx") / chunk_rows).cast("long").alias("_chunk"),
                           "price", "enter", "forced", "up", "down"))

    def arrays(pdf):
        pdf = pdf.sort_values("bar_idx")
        return pdf, [pdf[c].to_numpy() for c in ("price", "enter", "up", "down", "forced")]

    def summarise(key, pdf):
        pdf, (price, enter, up, down, forced) = arrays(pdf)
        n = len(price)
        flat = np.empty(n + 1)  # state at the end of the chunk when flat before bar i
        flat[n] = np.nan
        for i in range(n - 1, -1, -1):
            if not enter[i]:
                flat[i] = flat[i + 1]
            else:
                j = _first_exit(price[i], up, down, forced, i + 1)
                flat[i] = price[i] if j < 0 else flat[j + 1]
        # a held position can only end at a new high of `up`, a new low of `down`, or the first forced bar
        top, bottom = np.maximum.accumulate(up), np.minimum.accumulate(down)
        new_top = np.r_[True, top[1:] > top[:-1]] if n else np.array([], bool)
        new_low = np.r_[True, bottom[1:] < bottom[:-1]] if n else np.array([], bool)
        f = int(np.argmax(forced)) if forced.any() else n
        keep = np.flatnonzero((new_top | new_low) & (np.arange(n) <= f))
        keep = keep if f >= n or f in keep else np.append(keep, f)
        return pd.DataFrame([{
            **dict(zip([*SERIES, "_chunk"], key)), "_flat": flat[0], "_top": top[keep].tolist(), "_low": bottom[keep].tolist(),
            "_forced": [bool(k == f) for k in keep], "_out": [float(flat[k + 1]) for k in keep]}])

    def behind(top, low, forced, out, flat, state):
        if state is None or np.isnan(state):
            return np.nan if flat is None else flat
        hit = (top > state) | (low < state) | forced
        if not hit.any():
            return state
        o = out[int(np.argmax(hit))]
        return np.nan if o is None else o

    def function_of(row):
        return np.asarray(row["_top"], float), np.asarray(row["_low"], float), np.asarray(row["_forced"], bool), row["_out"], row["_flat"]

    def apply(row, state):
        return behind(*function_of(row), state)

    def join(parts):
        top, low, forced, out, flat = function_of(parts[0])
        for row in parts[1:]:
            late = function_of(row)
            out, flat = [behind(*late, o) for o in out], behind(*late, flat)
            if not forced.any():
                # what a position still held here can end at: places beyond all before them
                far = (late[0] > top.max(initial=-np.inf)) | (late[1] < low.min(initial=np.inf)) | late[2]
                top, low, forced = (np.concatenate([x, y[far]]) for x, y in zip((top, low, forced), late))
                out += [late[3][i] for i in np.flatnonzero(far)]
        return {"_flat": flat, "_top": top.tolist(), "_low": low.tolist(), "_forced": forced.tolist(), "_out": [np.nan if o is None else float(o) for o in out]}

    def replay(key, pdf):
        pdf, (price, enter, up, down, forced) = arrays(pdf)
        state = pdf["_entry"].iloc[0]
        _, signals = _run(np.nan if state is None else state, price, enter, up, down, forced)
        at = [i for i, _ in signals]
        return pdf.iloc[at][[*SERIES, "bar_idx"]].assign(signal=[s for _, s in signals])

    maps = slim.groupBy(*SERIES, "_chunk").applyInPandas(
        summarise, "symbol string, tf string, _chunk long, _flat double, _top array<double>, _low array<double>, _forced array<boolean>, _out array<double>")
    entries = entry_states(maps, SERIES, "double", np.nan, apply, join, fan)
    return slim.join(entries, [*SERIES, "_chunk"]).groupBy(*SERIES, "_chunk").applyInPandas(
        replay, "symbol string, tf string, bar_idx long, signal int")
