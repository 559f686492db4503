"""Building blocks of the SQL the results are checked against."""

from __future__ import annotations

SER = "PARTITION BY symbol, tf"

_LKEYS = "l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity"
_LP = "l_extendedprice / l_quantity"


def event_bars(tf: str, step: int) -> str:
    return f"""SELECT event_type AS symbol, '{tf}' AS tf, {step}::BIGINT AS step_s,
      (epoch_us(ts) // {step}000000) * {step} AS ts_s,
      first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
      last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume, count(*) AS n_ticks
      FROM events GROUP BY ALL"""


LINE_BARS = f"""SELECT l_returnflag || l_linestatus AS symbol, '1d' AS tf, 86400::BIGINT AS step_s,
      (epoch_us(l_shipdate) // 86400000000) * 86400 AS ts_s,
      first({_LP} ORDER BY {_LKEYS}) AS open, max({_LP}) AS high, min({_LP}) AS low,
      last({_LP} ORDER BY {_LKEYS}) AS close, sum(l_quantity) AS volume, count(*) AS n_ticks
      FROM lineitem GROUP BY ALL"""

BARS = f"""WITH raw_bars AS ({event_bars('1h', 3600)} UNION ALL {LINE_BARS}),
bars AS (SELECT *, row_number() OVER ({SER} ORDER BY ts_s) - 1 AS bar_idx FROM raw_bars)"""


def bars_of(select: str, name: str = "bars") -> str:
    return f"""WITH raw_{name} AS ({select}),
{name} AS (SELECT *, row_number() OVER ({SER} ORDER BY ts_s) - 1 AS bar_idx FROM raw_{name})"""


def frame(lo: int, hi: int = 0) -> str:
    def end(v):
        return "CURRENT ROW" if v == 0 else f"{-v} PRECEDING" if v < 0 else f"{v} FOLLOWING"
    return f"({SER} ORDER BY bar_idx ROWS BETWEEN {end(lo)} AND {end(hi)})"


def past() -> str:
    return f"({SER} ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, need: int | None = None, arg: str = "") -> str:
    f = frame(-(n - 1))
    return f"(CASE WHEN count({x}) OVER {f} >= {n if need is None else need} THEN {agg}({x}{arg}) OVER {f} END)"


def sma(x, n, need=None):
    return roll("avg", x, n, need)


def std(x, n, need=None):
    return roll("stddev_samp", x, n, need)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({SER} ORDER BY bar_idx)"


def pct(x: str, n: int = 1) -> str:
    return f"({x} / nullif({lag(x, n)}, 0) - 1)"


def r(x: str, places: int = 6) -> str:
    return f"(round(({x})::DOUBLE, {places}) + 0.0)"


def ema(x: str, span: int) -> str:
    """Closed form over the whole series: fine for the few thousand bars of the check."""
    a = 2.0 / (span + 1)
    d = 1 - a
    return (f"(pow({d!r}, bar_idx) * sum((CASE WHEN bar_idx = 0 THEN {x} ELSE {a!r} * {x} END) * pow({d!r}, -bar_idx)) "
            f"OVER {past()})")


def ema_adjusted(x: str, span: int) -> str:
    d = 1 - 2.0 / (span + 1)
    return f"(sum({x} * pow({d!r}, -bar_idx)) OVER {past()} / sum(pow({d!r}, -bar_idx)) OVER {past()})"


def with_stages(base: str, *stages: tuple[str, str, str]) -> str:
    """Append CTEs (name, source, column list) that keep all source columns."""
    return base + "".join(f",\n{n} AS (SELECT *, {cols} FROM {src})" for n, src, cols in stages)


GAIN_LOSS = (
    f"greatest(coalesce(close - {lag('close')}, 0), 0) AS gain, greatest(coalesce({lag('close')} - close, 0), 0) AS loss"
)
TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr"


def rsi(g: str = "ag", l: str = "al", variant: str = "plain") -> str:
    if variant == "floor":
        return f"(100 - 100 / (1 + {g} / ({l} + 1e-10)))"
    if variant == "inverse":
        return f"(CASE WHEN {g} IS NULL THEN NULL WHEN {l} = 0 THEN 0 ELSE 100 - 100 / (1 + {g} / nullif({l}, 0)) END)"
    return (f"(CASE WHEN {g} IS NULL THEN NULL WHEN {l} = 0 AND {g} = 0 THEN NULL WHEN {l} = 0 THEN 100 "
            f"ELSE 100 - 100 / (1 + {g} / nullif({l}, 0)) END)")
