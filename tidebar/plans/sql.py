"""SQL for comparison: the same queries for a single-node SQL engine, by recursion where Spark uses blocks and folds."""

from __future__ import annotations

from tidebar.functions.columns import SECONDS

_TRUNC = {"1min": "date_trunc('minute', ts)", "1h": "date_trunc('hour', ts)", "1day": "date_trunc('day', ts)", "5min": "date_trunc('hour', ts) + to_minutes(CAST(floor(minute(ts) / 5) * 5 AS INTEGER))", "15min": "date_trunc('hour', ts) + to_minutes(CAST(floor(minute(ts) / 15) * 15 AS INTEGER))"}
LAST_DAY = "coalesce(CAST(ts AS DATE) <> lead(CAST(ts AS DATE)) OVER s, true)"
MINUTE = "(hour(ts) * 60 + minute(ts))"


def num(x: float) -> str:
    return f"{x!r}::DOUBLE"


def candles(timeframe: str, name: str = "c") -> str:
    return f"""{name} AS (
  SELECT event_type AS instrument, {_TRUNC[timeframe]} AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""


def numbered(source: str = "c", name: str = "b") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1 AS i FROM {source})"


def ewm(name: str, source: str, alpha: float, adjust: bool, **columns: str) -> str:
    """A table of means by (instrument, i): weights and sums carried from row to row."""
    d = num(1 - alpha)
    if adjust:
        first = ", ".join(f"CAST({x} AS DOUBLE) AS s_{n}" for n, x in columns.items())
        more = ", ".join(f"{d} * r.s_{n} + b.x_{n} AS s_{n}" for n in columns)
        seed, step, out = f"{first}, 1.0::DOUBLE AS w", f"{more}, {d} * r.w + 1 AS w", ", ".join(f"s_{n} / w AS {n}" for n in columns)
    else:
        seed = ", ".join(f"CAST({x} AS DOUBLE) AS s_{n}" for n, x in columns.items())
        step = ", ".join(f"{d} * r.s_{n} + {num(alpha)} * b.x_{n} AS s_{n}" for n in columns)
        out = ", ".join(f"s_{n} AS {n}" for n in columns)
    own = ", ".join(f"CAST({x} AS DOUBLE) AS x_{n}" for n, x in columns.items())
    return f"""{name}_x AS (SELECT instrument, i, {own} FROM {source}),
{name}_r AS (
  SELECT instrument, i, {seed.replace('CAST(', 'CAST(')} FROM {source} WHERE i = 0
  UNION ALL SELECT b.instrument, b.i, {step} FROM {name}_r r JOIN {name}_x b ON b.instrument = r.instrument AND b.i = r.i + 1),
{name} AS (SELECT instrument, i, {out} FROM {name}_r)"""


def deviation(name: str, source: str, alpha: float, x: str = "close") -> str:
    """m (mean) and sd (bias-corrected deviation) by (instrument, i), centred on the first value."""
    d = num(1 - alpha)
    return f"""{name}_x AS (SELECT instrument, i, {x} - first_value({x}) OVER (PARTITION BY instrument ORDER BY i) AS y, first_value({x}) OVER (PARTITION BY instrument ORDER BY i) AS c FROM {source}),
{name}_r AS (
  SELECT instrument, i, c, y AS s, y * y AS q, 1.0::DOUBLE AS w, 1.0::DOUBLE AS w2 FROM {name}_x WHERE i = 0
  UNION ALL SELECT b.instrument, b.i, b.c, {d} * r.s + b.y, {d} * r.q + b.y * b.y, {d} * r.w + 1, {d} * {d} * r.w2 + 1 FROM {name}_r r JOIN {name}_x b ON b.instrument = r.instrument AND b.i = r.i + 1),
{name} AS (SELECT instrument, i, s / w + c AS m, CASE WHEN i > 0 THEN CASE WHEN q / w - (s / w) * (s / w) <= abs(q / w) * 1e-12 THEN 0.0 ELSE sqrt((q / w - (s / w) * (s / w)) * w * w / (w * w - w2)) END END AS sd FROM {name}_r)"""


def fold(source: str, extra: tuple[str, ...] = (), name: str = "run") -> str:
    """The path by (instrument, i): position and entry bar carried from row to row. source has the decisions of each bar."""
    keys = ["instrument", *extra]
    have = ", ".join(f"b.{k}" for k in keys)
    same = " AND ".join(f"b.{k} = r.{k}" for k in keys)
    return f"""{name} AS (
  SELECT {', '.join(keys)}, i, 0 AS pos, 0 AS since, 0 AS qty FROM {source} WHERE i = 0
  UNION ALL
  SELECT {have}, b.i, w.want, CASE WHEN r.pos = 0 AND w.want <> 0 THEN b.i ELSE r.since END, w.want - r.pos
  FROM {name} r JOIN {source} b ON {same} AND b.i = r.i + 1,
  LATERAL (SELECT CASE WHEN b.force0 THEN 0
    WHEN r.pos <> 0 THEN CASE WHEN (r.pos > 0 AND b.exit_long) OR (r.pos < 0 AND b.exit_short) OR b.i - r.since >= b.max_hold THEN 0 ELSE r.pos END
    ELSE b.entry END AS want) w)"""


def decisions(source: str, unknown: str, session: str, exit_long: str, exit_short: str, long: str, short: str, max_hold: str, extra: tuple[str, ...] = (), name: str = "d") -> str:
    keys = ", ".join(["instrument", *extra])
    s = f"PARTITION BY {keys} ORDER BY i"
    return f"""{name}_0 AS (SELECT *, {session} AS in_s, coalesce(CAST(ts AS DATE) <> lead(CAST(ts AS DATE)) OVER s, true) AS last_bar FROM {source} WINDOW s AS ({s})),
{name}_1 AS (SELECT *, ({unknown}) OR last_bar OR (in_s AND coalesce(NOT lead(in_s) OVER s, false)) AS flat, coalesce({exit_long}, false) AS xl, coalesce({exit_short}, false) AS xs FROM {name}_0 WINDOW s AS ({s})),
{name} AS (SELECT {keys}, i, ts, open, close, coalesce(lag(flat) OVER s, true) AS force0, coalesce(lag(xl) OVER s, false) AS exit_long, coalesce(lag(xs) OVER s, false) AS exit_short,
  CASE WHEN coalesce(lag(in_s) OVER s AND {long}, false) THEN 1 WHEN coalesce(lag(in_s) OVER s AND {short}, false) THEN -1 ELSE 0 END AS entry, {max_hold} AS max_hold
  FROM {name}_1 WINDOW s AS ({s}))"""


def path(source: str = "d", extra: tuple[str, ...] = (), cash: float = 100_000.0, fee: float = 5e-4) -> str:
    """p: every bar with qty, fee, position and equity."""
    keys = ["instrument", *extra]
    same = " AND ".join(f"r.{k} = b.{k}" for k in keys)
    own = ", ".join(f"b.{k}" for k in keys)
    return f"""p AS (
  SELECT {own}, b.i, b.ts, b.open, b.close, r.qty, abs(r.qty) * b.open * {num(fee)} AS fee, r.pos AS position,
    {num(cash)} - sum(r.qty * b.open + abs(r.qty) * b.open * {num(fee)}) OVER (PARTITION BY {own} ORDER BY b.i ROWS UNBOUNDED PRECEDING) + r.pos * b.close AS equity
  FROM run r JOIN {source} b ON {same} AND r.i = b.i)"""


def stats(extra: tuple[str, ...] = (), initial: float = 100_000.0) -> str:
    keys = ", ".join(["instrument", *extra])
    c = num(initial)
    return f"""st_q AS (SELECT *, coalesce(CAST(ts AS DATE) <> lead(CAST(ts AS DATE)) OVER s, true) AS last_bar, equity - greatest(max(equity) OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING), {c}) AS dd,
    position <> 0 AND lag(position) OVER s = 0 AS entered FROM p WINDOW s AS (PARTITION BY {keys} ORDER BY ts)),
st_w AS (SELECT {keys}, min(ts) AS t0, max(ts) AS t1, arg_max(equity, ts) - {c} AS pnl, count(*) AS n, sum(CAST(qty <> 0 AS BIGINT)) AS n_trades, sum(CAST(position <> 0 AS BIGINT)) AS held, sum(CAST(coalesce(entered, false) AS BIGINT)) AS entries,
    sum(abs(qty) * open) AS turn, sum(fee) AS fees, min(dd) AS dd, coalesce(max(CASE WHEN qty <> 0 THEN abs(position) * open END), 0.0) AS peak FROM st_q GROUP BY {keys}),
st_e AS (SELECT {keys}, equity - lag(equity, 1, {c}) OVER (PARTITION BY {keys} ORDER BY ts) AS r FROM st_q WHERE last_bar),
st_f AS (SELECT {keys}, avg(r) AS m, stddev_pop(r) AS sd, count(CASE WHEN r < 0 THEN r END) AS downs, stddev_pop(CASE WHEN r < 0 THEN r END) AS down FROM st_e GROUP BY {keys})
SELECT {keys}, round(pnl, 2) AS pnl,
  round(CASE WHEN peak > 0 AND sd > 0 AND sd > abs(m) * 1e-12 THEN m / sd * sqrt(252) ELSE 0.0 END, 4) AS sharpe,
  round(CASE WHEN peak > 0 AND downs > 1 AND down > 0 THEN m / down * sqrt(252) ELSE 0.0 END, 4) AS sortino,
  round(CASE WHEN peak > 0 THEN least(dd, 0.0) / peak ELSE 0.0 END, 4) AS max_dd,
  round(CASE WHEN peak > 0 THEN CASE WHEN 1 + pnl / peak > 0 THEN pow(1 + pnl / peak, 365.0::DOUBLE / greatest(floor((epoch(t1) - epoch(t0)) / 86400), 1)) - 1 ELSE -1.0 END ELSE 0.0 END, 4) AS cagr,
  CAST(n_trades AS BIGINT) AS n_trades, round(CASE WHEN entries > 0 THEN held / entries ELSE 0.0 END, 2) AS avg_bars_held, round(held / n * 100.0, 2) AS pct_bars_in_pos,
  round(turn, 2) AS turnover, round(fees, 2) AS total_fees, round(peak, 2) AS peak_exposure
FROM st_w JOIN st_f USING ({keys})"""


def seconds(timeframe: str) -> int:
    return SECONDS[timeframe]
