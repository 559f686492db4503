"""Per-series state objects on a stream.

Regimes, limits and trailing stops are folded in event-time order (`ordered.py`): rows wait in the state store until the
watermark has passed them, so neither arrival order nor trigger size changes a result. Watched trades sort the few rows of a trade.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.streaming.ordered import fold_in_order

DAY_US = 86_400_000_000


def _rows(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["ts", "event_id"])


def stream_hysteresis(regimes: DataFrame, periods: int = 2, late: str = "0 seconds") -> DataFrame:
    """regimes(symbol, ts, event_id, regime) -> confirmed regime per row."""
    need = max(periods, 2)

    def step(state, us, values):
        confirmed, last, run = state or (None, None, 0)
        out = []
        for regime in values:
            run = run + 1 if regime == last else 1
            last = regime
            if confirmed is None or run >= need:
                confirmed = regime
            out.append((regime, confirmed))
        return (confirmed, last, run), out

    return fold_in_order(regimes, "symbol", "regime", step, "confirmed string, last string, run int", "regime string, confirmed string", late)


def stream_limits(pnl: DataFrame, day_limit: float, drawdown_limit: float = 0.20, capital: float = 10_000.0, late: str = "0 seconds") -> DataFrame:
    """pnl(symbol, ts, event_id, pnl) -> running value, day loss flag and drawdown latch. A null pnl changes nothing."""

    def step(state, us, values):
        value, peak, day, day_pnl, latched = state or (capital, capital, -1, 0.0, False)
        out = []
        for d, p in zip((us // DAY_US).tolist(), values):
            day_pnl = (day_pnl if d == day else 0.0) + (p or 0.0)
            day, value = d, value + (p or 0.0)
            peak = max(peak, value)
            latched = latched or (peak - value) / peak >= drawdown_limit
            out.append((value, bool(-day_pnl / value >= day_limit) if value > 0 else True, latched))
        return (value, peak, day, day_pnl, latched), out

    return fold_in_order(pnl, "symbol", "pnl", step, "value double, peak double, day long, day_pnl double, latched boolean",
                         "value double, day_hit boolean, latched boolean", late)


def stream_trailing(prices: DataFrame, atr: float, initial: float = 3.0, step: float = 0.02, cap: float = 0.2, start_at: float = 0.02,
                    late: str = "0 seconds") -> DataFrame:
    """prices(symbol, ts, event_id, price): a long trade opens with the first price and after each
    stop; emits the stop in force and whether it was hit. A null price changes nothing; any rise from an entry at 0 is enough."""

    def follow(state, us, values):
        entry, stop, af = state or (None, None, step)
        out = []
        for p in values:
            hit = False
            if p is None:
                pass
            elif entry is None:
                entry, stop, af = p, p - atr * initial, step
            elif p <= stop:
                hit = True
            elif ((p - entry) / entry >= start_at) if entry else p > entry:
                stop = max(stop, min(stop + (p - stop) * af, p * 0.99))
                af = min(af + step, cap)
            out.append((stop, hit))
            if hit:
                entry = None
        return (entry, stop, af), out

    return fold_in_order(prices, "symbol", "price", follow, "entry double, stop double, af double", "stop double, hit boolean", late)


def stream_watch(ticks: DataFrame, hours: float = 2.0, span_hours: float = 6.0) -> DataFrame:
    """ticks(symbol, trade_id, ts, event_id, price): follow each trade from its first tick for
    ``hours`` and report the first reversal or adverse move; event-time timers end quiet trades.

    All ticks of a trade_id lie within ``span_hours``. A reported trade is remembered that long, so
    that later ticks don't open it anew; then its state goes."""
    window_ms, span_ms = int(hours * 3_600_000), int(span_hours * 3_600_000)

    def fold(key, frames, state: GroupState):
        entry, t0, best, n, done = state.get if state.exists else (None, 0, 0.0, 0, False)
        for row in () if state.hasTimedOut else _rows(frames).itertuples():
            now = row.ts.value // 1_000_000
            if entry is None:
                entry, t0 = float(row.price), now
                continue
            if done or now - t0 >= window_ms:
                break
            n, move = n + 1, row.price / entry - 1
            best = max(best, move)
            reason = ("bull_trap" if best > 0.05 and move < best * 0.5 else
                      "false_breakout" if n >= 2 and best <= 0.005 and move <= -0.003 else
                      "adverse_move" if n >= 4 and move < -0.02 else "too_good" if n >= 4 and move > 0.10 else None)
            if reason:
                done = True
                yield pd.DataFrame([[*key, reason, n]], columns=["symbol", "trade_id", "outcome", "ticks"])
        now = state.getCurrentWatermarkMs()
        if not done and t0 + window_ms < now:
            done = True
            yield pd.DataFrame([[*key, "confirmed", 0]], columns=["symbol", "trade_id", "outcome", "ticks"])
        end = t0 + (span_ms if done else window_ms)
        if end < now:
            state.remove()
        else:
            state.update((entry, t0, best, n, done))
            state.setTimeoutTimestamp(max(end, now + 1))

    return ticks.withWatermark("ts", "10 minutes").groupBy("symbol", "trade_id").applyInPandasWithState(
        fold, "symbol string, trade_id long, outcome string, ticks int", "entry double, t0 long, best double, n int, done boolean",
        "append", GroupStateTimeout.EventTimeTimeout)
