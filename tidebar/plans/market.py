"""Queries over candles made from the events table: candles, features, decayed means, as-of joins, strategies, figures."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.columns import divide, in_hours, in_minutes
from tidebar.operators import asof, candles, ewm, features, stats, strategies
from tidebar.operators import windows as win
from tidebar.operators.candles import KEY
from tidebar.plans import sql

QUERIES: dict = {}
SQL: dict = {}
DIGITS = 6


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


def bars(spark: SparkSession, sf_dir: str, timeframe: str) -> DataFrame:
    return candles.resample(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value"), timeframe)


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> list[Column]:
    """Rounded just above half a last digit, so that an exact tie goes one way in every engine."""
    return [F.round(F.col(c) + F.lit(1e-9), digits).alias(c) for c in columns]


for _tf, _name in (("1h", "candles_1h"), ("15min", "candles_15m"), ("1day", "candles_1d"), ("5min", "candles_5m")):
    query(_name, f"WITH {sql.candles(_tf)} SELECT * FROM c")(lambda spark, sf_dir, tf=_tf: bars(spark, sf_dir, tf))


@query("candles_upscaled", f"WITH {sql.candles('1h')} SELECT * FROM c")
def candles_upscaled(spark, sf_dir):
    return candles.upscale(bars(spark, sf_dir, "15min"), "1h")


@query("daily_trade_candles", """SELECT l_returnflag AS instrument, CAST(l_shipdate AS TIMESTAMP) AS ts, arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber)) AS open, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber)) AS close, count(*) AS volume FROM lineitem GROUP BY 1, 2""")
def daily_trade_candles(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_orderkey", "l_linenumber")
    return candles.resample(items, "1day", "price", "l_returnflag", F.struct("l_orderkey", "l_linenumber"))


_W = "WINDOW s AS (PARTITION BY instrument ORDER BY ts)"


def _frame(n: int, last: str = "CURRENT ROW") -> str:
    return f"OVER (PARTITION BY instrument ORDER BY ts ROWS BETWEEN {n} PRECEDING AND {last})"


@query("feat_returns", f"WITH {sql.candles('1h')} SELECT instrument, ts, " + ", ".join(f"round(close / nullif(lag(close, {n}) OVER s, 0) - 1, 6) AS ret{n}" for n in features.RETURNS) + f" FROM c {_W}")
def feat_returns(spark, sf_dir):
    return bars(spark, sf_dir, "1h").select(KEY, "ts", *[F.round(c, 6).alias(n) for n, c in features.returns().items()])


@query("feat_anatomy", f"""WITH {sql.candles('1h')} SELECT instrument, ts, round((high - low) / nullif(close, 0), 6) AS spread, round((close - open) / nullif(close, 0), 6) AS body, round((high - greatest(open, close)) / nullif(close, 0), 6) AS upper_wick,
  round((least(open, close) - low) / nullif(close, 0), 6) AS lower_wick, round(CASE WHEN high = low THEN 0.0 ELSE abs(close - open) / (high - low) END, 6) AS body_frac,
  round(CASE WHEN high = low THEN 0.5 ELSE (close - low) / (high - low) END, 6) AS close_pos, CAST(sign(close - open) AS DOUBLE) AS dir, round(open / nullif(lag(close) OVER s, 0) - 1, 6) AS gap FROM c {_W}""")
def feat_anatomy(spark, sf_dir):
    return bars(spark, sf_dir, "1h").select(KEY, "ts", *[F.round(c, 6).alias(n) for n, c in features.anatomy().items()])


@query("feat_breakout", f"""WITH {sql.candles('1h')} SELECT instrument, ts, CASE WHEN count(high) {_frame(19)} >= 20 THEN round(close / nullif(max(high) {_frame(19)}, 0) - 1, 6) END AS brk_hi20,
  CASE WHEN count(low) {_frame(19)} >= 20 THEN round(close / nullif(min(low) {_frame(19)}, 0) - 1, 6) END AS brk_lo20,
  CASE WHEN count(high) {_frame(20, '1 PRECEDING')} >= 20 AND close > max(high) {_frame(20, '1 PRECEDING')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS new_hi20,
  CASE WHEN count(low) {_frame(20, '1 PRECEDING')} >= 20 AND close < min(low) {_frame(20, '1 PRECEDING')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS new_lo20 FROM c""")
def feat_breakout(spark, sf_dir):
    return bars(spark, sf_dir, "1h").select(KEY, "ts", *[F.round(c, 6).alias(n) for n, c in features.breakout().items()])


@query("feat_rsi", f"""WITH {sql.candles('1h')}, g AS (SELECT *, close - lag(close) OVER s AS m FROM c {_W}), a AS (SELECT instrument, ts, CASE WHEN count(m) {_frame(13)} >= 14 THEN avg(CASE WHEN m IS NOT NULL THEN greatest(m, 0) END) {_frame(13)} END AS gain,
  CASE WHEN count(m) {_frame(13)} >= 14 THEN avg(CASE WHEN m IS NOT NULL THEN greatest(-m, 0) END) {_frame(13)} END AS loss FROM g)
SELECT instrument, ts, round(CASE WHEN gain + loss = 0 THEN 0.0 ELSE gain / (gain + loss) - 0.5 END, 6) AS rsi14 FROM a""")
def feat_rsi(spark, sf_dir):
    first, strength = features.rsi()
    out = bars(spark, sf_dir, "1h").select("*", *[c.alias(n) for n, c in first.items()])
    return out.select(KEY, "ts", *[F.round(c, 6).alias(n) for n, c in strength.items()])


@query("feat_volatility", f"""WITH {sql.candles('1h')}, g AS (SELECT *, close / nullif(lag(close) OVER s, 0) - 1 AS r FROM c {_W})
SELECT instrument, ts, CASE WHEN count(r) {_frame(19)} >= 20 THEN round(stddev_samp(r) {_frame(19)}, 4) END AS volat20 FROM g""")
def feat_volatility(spark, sf_dir):
    out = bars(spark, sf_dir, "1h").withColumn("r", win.change("close"))
    return out.select(KEY, "ts", F.round(win.rolling(F.stddev_samp, "r", 20), 4).alias("volat20"))


@query("feat_volume", f"""WITH {sql.candles('1h')}, a AS (SELECT instrument, ts, volume AS v, avg(volume) {_frame(19)} AS m, stddev_samp(volume) {_frame(19)} AS sd, avg(volume) {_frame(4)} AS m5, count(*) {_frame(19)} AS n FROM c)
SELECT instrument, ts, round(v / nullif(m, 0), 6) AS vol_norm, CASE WHEN n >= 20 THEN round(CASE WHEN sd = 0 THEN 0.0 ELSE (v - m) / sd END, 6) END AS vol_z, CASE WHEN n >= 20 THEN round(m5 / m - 1, 6) END AS vol_trend FROM a""")
def feat_volume(spark, sf_dir):
    return bars(spark, sf_dir, "1h").select(KEY, "ts", *[F.round(c, 6).alias(n) for n, c in features.volume().items()])


@query("rolling_slope", f"""WITH {sql.candles('1h')}, {sql.numbered()} SELECT instrument, ts, CASE WHEN count(close) {_frame(9)} >= 10 THEN round(regr_slope(close, i) {_frame(9)}, 4) END AS slope10 FROM b""")
def rolling_slope(spark, sf_dir):
    out = strategies.numbered(bars(spark, sf_dir, "1h")).withColumn("x", F.col("i").cast("double"))
    return out.select(KEY, "ts", F.round(win.rolling_slope("close", F.col("x"), 10), 4).alias("slope10"))


@query("quiet_runs", f"""WITH {sql.candles('1h')}, q AS (SELECT *, volume < avg(volume) {_frame(23)} AS quiet FROM c), g AS (SELECT *, sum(CASE WHEN quiet THEN 0 ELSE 1 END) {_frame(1000000)} AS g FROM q)
SELECT instrument, ts, CAST(sum(CASE WHEN quiet THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, g ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS quiet_run FROM g""")
def quiet_runs(spark, sf_dir):
    out = bars(spark, sf_dir, "1h").withColumn("quiet", F.col("volume") < win.rolling(F.avg, "volume", 24, least=1))
    return win.run_lengths(out, "quiet", "quiet_run").select(KEY, "ts", "quiet_run")


@query("day_flags", f"""WITH {sql.candles('1h')}, f AS (SELECT *, {sql.MINUTE} >= 420 AND {sql.MINUTE} < 945 AS in_minutes, hour(ts) >= 9 AND hour(ts) < 16 AS in_hours FROM c)
SELECT instrument, ts, in_minutes, in_hours, {sql.LAST_DAY} AS last_bar, in_minutes AND coalesce(NOT lead(in_minutes) OVER s, false) AS session_end,
  isodow(ts) <= 5 AND {sql.MINUTE} >= 420 AND {sql.MINUTE} < 940 AS main_session FROM f {_W}""")
def day_flags(spark, sf_dir):
    from tidebar.functions.columns import is_main_session

    out = bars(spark, sf_dir, "1h").withColumn("in_minutes", in_minutes(420, 945)).withColumn("in_hours", in_hours(9, 16))
    return out.select(KEY, "ts", "in_minutes", "in_hours", win.last_of_day().alias("last_bar"), win.session_end("in_minutes").alias("session_end"), is_main_session().alias("main_session"))


@query("running_levels", f"""WITH {sql.candles('1h')} SELECT instrument, ts, round(close - max(close) {_frame(1000000)}, 6) AS drawdown, CAST(sum(volume) {_frame(1000000)} AS BIGINT) AS volume_so_far,
  last_value(CASE WHEN volume > 5 THEN volume::DOUBLE END IGNORE NULLS) {_frame(1000000)} AS last_busy FROM c""")
def running_levels(spark, sf_dir):
    return bars(spark, sf_dir, "1h").select(KEY, "ts", F.round(win.drawdown("close"), 6).alias("drawdown"), win.so_far(F.sum, "volume").alias("volume_so_far"), win.last_known(F.when(F.col("volume") > 5, F.col("volume").cast("double"))).alias("last_busy"))


def _ewm_sql(columns: str, *parts: str, last: str = "b", join: tuple[str, ...] = ()) -> str:
    with_ = ",\n".join([sql.candles("1h"), sql.numbered(), *parts])
    joins = " ".join(f"JOIN {j} USING (instrument, i)" for j in join)
    return f"WITH RECURSIVE {with_}\nSELECT {columns} FROM {last} {joins}"


@query("ewm_mean", _ewm_sql("instrument, ts, " + ", ".join(f"round(m{k} + 1e-9, 6) AS ewm_{ewm.tag(a)}" for k, a in enumerate(features.ALPHAS)), *[sql.ewm(f"e{k}", "b", a, False, **{f"m{k}": "close"}) for k, a in enumerate(features.ALPHAS)], join=tuple(f"e{k}" for k in range(4))))
def ewm_mean(spark, sf_dir):
    out = bars(spark, sf_dir, "1h")
    names = {a: f"ewm_{ewm.tag(a)}" for a in features.ALPHAS}
    for a, n in names.items():
        out = ewm.means(out, a, False, **{n: "close"})
    return out.select(KEY, "ts", *rounded(out, *names.values()))


@query("ewm_mean_adjusted", _ewm_sql("instrument, ts, round(m + 1e-9, 6) AS trend", sql.ewm("e", "b", 0.02, True, m="close"), join=("e",)))
def ewm_mean_adjusted(spark, sf_dir):
    out = ewm.means(bars(spark, sf_dir, "1h"), 0.02, True, trend="close")
    return out.select(KEY, "ts", *rounded(out, "trend"))


@query("ewm_std", _ewm_sql("instrument, ts, round(m + 1e-9, 4) AS mean, round(sd + 1e-9, 4) AS std", sql.deviation("e", "b", 0.02), join=("e",)))
def ewm_std(spark, sf_dir):
    out = ewm.mean_and_std(bars(spark, sf_dir, "1h"), 0.02, "close", "mean", "std")
    return out.select(KEY, "ts", *rounded(out, "mean", "std", digits=4))


@query("ewm_sum", f"""WITH RECURSIVE {sql.candles('1h')}, {sql.numbered()}, r AS (SELECT instrument, i, CAST(volume AS DOUBLE) AS s FROM b WHERE i = 0
  UNION ALL SELECT b.instrument, b.i, 0.95::DOUBLE * r.s + b.volume FROM r JOIN b ON b.instrument = r.instrument AND b.i = r.i + 1) SELECT instrument, ts, round(s + 1e-9, 6) AS vsum FROM b JOIN r USING (instrument, i)""")
def ewm_sum(spark, sf_dir):
    out = ewm.sums(bars(spark, sf_dir, "1h"), 0.05, vsum=F.col("volume").cast("double"))
    return out.select(KEY, "ts", *rounded(out, "vsum"))


@query("vw_bands", _ewm_sql("instrument, ts, round(h / v + 1e-9, 6) AS vwh, round(l / v + 1e-9, 6) AS vwl", sql.ewm("e", "b", 0.05, False, h="high * volume", l="low * volume", v="volume"), join=("e",)))
def vw_bands(spark, sf_dir):
    out = strategies.vw_bands(bars(spark, sf_dir, "1h"), 0.05)
    return out.select(KEY, "ts", *rounded(out, "vwh", "vwl"))


def _macd_sql() -> str:
    from itertools import combinations

    at = {a: f"m{k}" for k, a in enumerate(features.ALPHAS)}
    made = ", ".join(f"round(({at[max(p)]} - {at[min(p)]}) / nullif(close, 0) + 1e-9, 6) AS macd_{ewm.tag(max(p))}_{ewm.tag(min(p))}" for p in combinations(features.ALPHAS, 2))
    return _ewm_sql("instrument, ts, " + made, *[sql.ewm(f"e{k}", "b", a, False, **{f"m{k}": "close"}) for k, a in enumerate(features.ALPHAS)], join=tuple(f"e{k}" for k in range(4)))


@query("macd", _macd_sql())
def macd(spark, sf_dir):
    out = features.macd(bars(spark, sf_dir, "1h"))
    return out.select(KEY, "ts", *rounded(out, *[c for c in out.columns if c.startswith("macd")]))


_MOVES = "m AS (SELECT instrument, i - 1 AS i, ts, close, d, d * volume AS dv FROM (SELECT *, close - lag(close) OVER (PARTITION BY instrument ORDER BY ts) AS d FROM b) WHERE i > 0)"


@query("efficiency", _ewm_sql("b.instrument, b.ts, round(e.a / nullif(e.aa, 0) + 1e-9, 6) AS eff, round(e.v / nullif(e.vv, 0) + 1e-9, 6) AS effv", _MOVES, sql.ewm("e", "m", 0.05, False, a="d", aa="abs(d)", v="dv", vv="abs(dv)"), last="b LEFT JOIN e ON e.instrument = b.instrument AND e.i = b.i - 1"))
def efficiency(spark, sf_dir):
    out = ewm.efficiency(ewm.efficiency(bars(spark, sf_dir, "1h"), 0.05, "eff"), 0.05, "effv", weight="volume")
    return out.select(KEY, "ts", *rounded(out, "eff", "effv"))


@query("ewm_slope", _ewm_sql("instrument, ts, round(tanh(CASE WHEN tt - t * t > 1e-12 THEN (ty - t * y) / (tt - t * t) ELSE 0.0 END / (a + 1e-9)) + 1e-9, 4) + 0.0::DOUBLE AS slope", sql.ewm("e", "b", 0.05, False, t="i", y="close", tt="i * i", ty="i * close", a="abs(close)"), join=("e",)))
def ewm_slope(spark, sf_dir):
    out = ewm.slope(bars(spark, sf_dir, "1h"), 0.05, "slope")
    return out.select(KEY, "ts", *rounded(out, "slope", digits=4))


@query("asof_bar_end", f"""WITH {sql.candles('15min', 'p')}, {sql.candles('1h', 'h')}, e AS (SELECT instrument, ts + INTERVAL 1 HOUR AS ts, close AS close_1h, volume::DOUBLE AS volume_1h FROM h)
SELECT p.instrument, p.ts, p.close, e.close_1h, e.volume_1h, e.ts AS known_ts FROM p ASOF LEFT JOIN e ON p.instrument = e.instrument AND p.ts >= e.ts""")
def asof_bar_end(spark, sf_dir):
    hours = bars(spark, sf_dir, "1h").withColumnRenamed("close", "close_1h").withColumn("volume_1h", F.col("volume").cast("double"))
    return asof.on_bar_end(bars(spark, sf_dir, "15min").select(KEY, "ts", "close"), hours, "1h", ["close_1h", "volume_1h"], at="known_ts")


@query("asof_bar_start", f"""WITH {sql.candles('15min', 'p')}, {sql.candles('1h', 'h')} SELECT p.instrument, p.ts, p.close, coalesce(h.open, 1.0) AS pred FROM p ASOF LEFT JOIN h ON p.instrument = h.instrument AND p.ts >= h.ts""")
def asof_bar_start(spark, sf_dir):
    hours = bars(spark, sf_dir, "1h").withColumnRenamed("open", "pred")
    return asof.on_bar_start(bars(spark, sf_dir, "15min").select(KEY, "ts", "close"), hours, ["pred"], fill=1.0)


@query("asof_strict", f"""WITH {sql.candles('15min', 'p')}, {sql.candles('1h', 'h')} SELECT p.instrument, p.ts, h.close AS close_1h FROM p ASOF LEFT JOIN h ON p.instrument = h.instrument AND p.ts > h.ts""")
def asof_strict(spark, sf_dir):
    hours = bars(spark, sf_dir, "1h").withColumnRenamed("close", "close_1h")
    return asof.backward(bars(spark, sf_dir, "15min").select(KEY, "ts"), hours, ["close_1h"], strict=True)


@query("exact_lookup", f"""WITH {sql.candles('15min', 'p')}, {sql.candles('1h', 'h')} SELECT p.instrument, p.ts, coalesce(h.close, 1.0) AS pred FROM p LEFT JOIN h USING (instrument, ts)""")
def exact_lookup(spark, sf_dir):
    hours = bars(spark, sf_dir, "1h").withColumnRenamed("close", "pred")
    return asof.exact(bars(spark, sf_dir, "15min").select(KEY, "ts"), hours, "pred", fill=1.0)


@query("asof_bands", f"""WITH RECURSIVE {sql.candles('15min', 'p')}, {sql.candles('1h')}, {sql.numbered()}, {sql.ewm('e', 'b', 0.05, False, h='high * volume', l='low * volume', v='volume')},
x AS (SELECT instrument, ts + INTERVAL 1 HOUR AS ts, round(h / v + 1e-9, 6) AS vwh, round(l / v + 1e-9, 6) AS vwl FROM b JOIN e USING (instrument, i))
SELECT p.instrument, p.ts, x.vwh, x.vwl FROM p ASOF LEFT JOIN x ON p.instrument = x.instrument AND p.ts >= x.ts""")
def asof_bands(spark, sf_dir):
    bands = strategies.vw_bands(bars(spark, sf_dir, "1h"), 0.05)
    out = asof.on_bar_end(bars(spark, sf_dir, "15min").select(KEY, "ts"), bands, "1h", ["vwh", "vwl"])
    return out.select(KEY, "ts", *rounded(out, "vwh", "vwl"))


_TREND = f"WITH RECURSIVE {sql.candles('1h')}, {sql.numbered()}, {sql.ewm('e', 'b', ewm.span(5), False, m5='close')}, {sql.ewm('f', 'b', ewm.span(20), False, m20='close')}, t AS (SELECT instrument, ts, round(m5 / nullif(m20, 0) - 1, 6) AS trend FROM b JOIN e USING (instrument, i) JOIN f USING (instrument, i))"


@query("cross_trend_match", _TREND + """, o AS (SELECT ts, lag(trend) OVER (ORDER BY ts) AS trend FROM t WHERE instrument = 'click'), x AS (SELECT instrument, ts + INTERVAL 1 HOUR AS ts, trend FROM t WHERE instrument <> 'click'), n AS (SELECT DISTINCT instrument FROM x)
SELECT n.instrument, o.ts, CAST(sign(o.trend) * sign(x.trend) AS DOUBLE) + 0.0::DOUBLE AS trend_match FROM o CROSS JOIN n ASOF LEFT JOIN x ON n.instrument = x.instrument AND o.ts >= x.ts""")
def cross_trend_match(spark, sf_dir):
    """Long form: a row for each bar of the primary series and each other series."""
    trends = ewm.means(bars(spark, sf_dir, "1h"), ewm.span(5), False, __a="close")
    trends = ewm.means(trends, ewm.span(20), False, __b="close").select(KEY, "ts", F.round(divide("__a", "__b") - 1, 6).alias("trend"))
    others = trends.where(F.col(KEY) != "click")
    own = trends.where(F.col(KEY) == "click").select(KEY, "ts", win.lag("trend").alias("own")).drop(KEY)
    probe = own.crossJoin(F.broadcast(others.select(KEY).distinct()))  # one row a series of the universe, a configured list
    return asof.on_bar_end(probe, others, "1h", ["trend"]).select(KEY, "ts", (F.signum("own") * F.signum("trend") + 0.0).alias("trend_match"))


@query("cross_volz", f"""WITH {sql.candles('1h')}, a AS (SELECT instrument, ts, volume AS v, avg(volume) {_frame(19)} AS m, stddev_samp(volume) {_frame(19)} AS sd, count(*) {_frame(19)} AS n FROM c),
z AS (SELECT instrument, ts, CASE WHEN n >= 20 THEN CASE WHEN sd = 0 THEN 0.0 ELSE (v - m) / sd END END AS z FROM a) SELECT ts, round(avg(z), 6) AS volz_mkt, count(z) AS n FROM z GROUP BY ts""")
def cross_volz(spark, sf_dir):
    z = bars(spark, sf_dir, "1h").select(KEY, "ts", features.volume()["vol_z"].alias("z"))
    return z.groupBy("ts").agg(F.round(F.avg("z"), 6).alias("volz_mkt"), F.count("z").alias("n"))


def _base_sql(timeframe: str, c: str = "c", name: str = "base") -> str:
    """A table with the 22 base features of every series by instrument, ts and i."""
    b, e5, e20, g = (f"{name}_{x}" for x in ("b", "e5", "e20", "g"))
    back = ", ".join(f"close / nullif(lag(close, {n}) OVER s, 0) - 1 AS ret{n}" for n in features.RETURNS)
    enough = lambda x, n, value: f"CASE WHEN count({x}) {_frame(n - 1)} >= {n} THEN {value} END"
    before = lambda f, x: f"count({x}) {_frame(20, '1 PRECEDING')} >= 20 AND close {'>' if f == 'max' else '<'} {f}({x}) {_frame(20, '1 PRECEDING')}"
    gain, loss = (enough("m", 14, f"avg(CASE WHEN m IS NOT NULL THEN greatest({x}, 0) END) {_frame(13)}") for x in ("m", "-m"))
    return f"""{sql.candles(timeframe, c)}, {sql.numbered(c, b)}, {sql.ewm(e5, b, 2 / 6, False, e5='close')}, {sql.ewm(e20, b, 2 / 21, False, e20='close')},
{g} AS (SELECT {b}.*, e5, e20, close / nullif(lag(close) OVER s, 0) - 1 AS r, close - lag(close) OVER s AS m FROM {b} JOIN {e5} USING (instrument, i) JOIN {e20} USING (instrument, i) {_W}),
{name} AS (SELECT instrument, i, ts, close, {back}, (high - low) / nullif(close, 0) AS spread, (close - open) / nullif(close, 0) AS body, (high - greatest(open, close)) / nullif(close, 0) AS upper_wick, (least(open, close) - low) / nullif(close, 0) AS lower_wick,
  CASE WHEN high = low THEN 0.0 ELSE abs(close - open) / (high - low) END AS body_frac, CASE WHEN high = low THEN 0.5 ELSE (close - low) / (high - low) END AS close_pos, CAST(sign(close - open) AS DOUBLE) AS dir, open / nullif(lag(close) OVER s, 0) - 1 AS gap,
  e5 / nullif(e20, 0) - 1 AS trend, {enough('high', 20, f'close / nullif(max(high) {_frame(19)}, 0) - 1')} AS brk_hi20, {enough('low', 20, f'close / nullif(min(low) {_frame(19)}, 0) - 1')} AS brk_lo20,
  CASE WHEN {before('max', 'high')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS new_hi20, CASE WHEN {before('min', 'low')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS new_lo20,
  CASE WHEN {gain} + {loss} = 0 THEN 0.0 ELSE {gain} / ({gain} + {loss}) - 0.5 END AS rsi14, {enough('r', 20, f'stddev_samp(r) {_frame(19)}')} AS volat20, volume / nullif(avg(volume) {_frame(19)}, 0) AS vol_norm,
  {enough('volume', 20, f'CASE WHEN stddev_samp(volume) {_frame(19)} = 0 THEN 0.0 ELSE (volume - avg(volume) {_frame(19)}) / stddev_samp(volume) {_frame(19)} END')} AS vol_z, {enough('volume', 20, f'avg(volume) {_frame(4)} / avg(volume) {_frame(19)} - 1')} AS vol_trend FROM {g} {_W})"""


def _r4(*columns: str) -> str:
    return ", ".join(f"round({c} + 1e-9, 4) + 0.0::DOUBLE AS {c}" for c in columns)


def _round4(df: DataFrame, *columns: str) -> list[Column]:
    return [(c + 0.0).alias(n) for n, c in zip(columns, rounded(df, *columns, digits=4), strict=True)]


@query("base_features", f"WITH RECURSIVE {_base_sql('1h')} SELECT instrument, ts, {_r4(*features.BASE)} FROM base")
def base_features(spark, sf_dir):
    out = features.base(bars(spark, sf_dir, "1h"))
    return out.select(KEY, "ts", *_round4(out, *features.BASE))


def _extended_sql(timeframe: str) -> str:
    """All features of the catalogue: decayed means of one alpha carried from row to row together, each from its first value on."""
    tags, steps = {a: ewm.tag(a) for a in features.ALPHAS}, features.STEPS
    inputs = {"m": "close", "w": "v", "wc": "close * v", "wh": "high * v", "wl": "low * v", "e": "c1", "ea": "abs(c1)", "f": "c1 * v", "fa": "abs(c1) * v", **{f"{x}{n}": f"{x}{n}" for x in "cv" for n in steps}}
    moved = ", ".join(f"close - lag(close, {n}) OVER s AS c{n}, v - lag(v, {n}) OVER s AS v{n}" for n in steps)
    parts = [_base_sql(timeframe), f"x0 AS (SELECT *, CAST(volume AS DOUBLE) AS v FROM base_b), x1 AS (SELECT *, {moved}, last_value(CASE WHEN v > 0 THEN v END IGNORE NULLS) {_frame(1000000)} AS ref FROM x0 {_W})"]
    for a, t in tags.items():
        old = f"{sql.num(1 - a)} * r."
        step = ", ".join(f"CASE WHEN r.{n} IS NULL THEN {x} ELSE {old}{n} + {sql.num(a)} * {x} END AS {n}" for n, x in ((n, _of("b", x)) for n, x in inputs.items()))
        parts.append(f"""r_{t} AS (SELECT instrument, i, {', '.join(f'{x} AS {n}' for n, x in inputs.items())}, v AS total FROM x1 WHERE i = 0
  UNION ALL SELECT b.instrument, b.i, {step}, {old}total + b.v AS total FROM r_{t} r JOIN x1 b ON b.instrument = r.instrument AND b.i = r.i + 1)""")
    per = lambda x, y: f"({x}) / nullif({y}, 0)"
    price = {n: f"base.{n}" for n in features.BASE if not n.startswith("vol_")}
    price |= {f"macd_{tags[max(p)]}_{tags[min(p)]}": per(f"r_{tags[max(p)]}.m - r_{tags[min(p)]}.m", "x1.close") for p in combinations(features.ALPHAS, 2)}
    price |= {n: per(f"x1.{x}", f"x1.{y}") + " - 1" for n, x, y in (("hl", "high", "low"), ("co", "close", "open"), ("ch", "close", "high"), ("cl", "close", "low"))}
    price |= {f"cd{n}": per(f"x1.c{n}", "x1.close") for n in steps if n > 1}
    flow = {n: f"base.{n}" for n in features.BASE if n.startswith("vol_")} | {f"vd{n}": per(f"x1.v{n}", "ref") for n in steps}
    for t in tags.values():
        r = f"r_{t}"
        vw = lambda x: f"CASE WHEN {r}.w > 0 THEN {r}.{x} / {r}.w END"  # noqa: B023, E731
        price |= {f"vwap_{t}": per(vw("wc"), "x1.close") + " - 1", f"vwh_{t}": per(vw("wh"), "x1.close") + " - 1", f"vwl_{t}": per(vw("wl"), "x1.close") + " - 1", f"vwhl_{t}": per(f"{vw('wh')} - {vw('wl')}", "x1.close")}
        price |= {f"eff_{t}": per(f"{r}.e", f"{r}.ea"), f"effv_{t}": per(f"{r}.f", f"{r}.fa")} | {f"cd{n}_ewm_{t}": per(f"{r}.c{n}", "x1.close") for n in steps}
        flow |= {f"vm_{t}": per(f"{r}.w", "ref"), f"v_over_vm_{t}": per("x1.v", f"{r}.w"), f"vsum_{t}": per(f"{r}.total", "ref"), f"v_over_vsum_{t}": per("x1.v", f"{r}.total")} | {f"vd{n}_ewm_{t}": per(f"{r}.v{n}", "ref") for n in steps}
    made = price | flow
    parts.append(f"w AS (SELECT x1.instrument, x1.i, x1.ts, {', '.join(f'{x} AS {n}' for n, x in made.items())} FROM x1 JOIN base USING (instrument, i) {' '.join(f'JOIN r_{t} USING (instrument, i)' for t in tags.values())})")
    k = features.SLOPE
    late = {f"{n}_lag{d}": f"lag({n}, {d}) OVER s" for n in price for d in features.LAGS}
    steep = {f"{n}_slope{k}": f"CASE WHEN count({n}) {_frame(k - 1)} >= {k} THEN regr_slope({n}, i + 1) {_frame(k - 1)} END" for n in made}
    parts.append(f"l AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in (late | steep).items())} FROM w {_W})")
    return f"WITH RECURSIVE {', '.join(parts)} SELECT instrument, ts, {_r4(*made, *late, *steep)} FROM l"


def _of(table: str, x: str) -> str:
    """An expression over columns of a table."""
    return re.sub(r"\b(?!abs\b)[a-z]\w*", rf"{table}.\g<0>", x)


@query("extended_features", _extended_sql("1h"))
def extended_features(spark, sf_dir):
    """The whole catalogue."""
    out = features.extended(bars(spark, sf_dir, "1h")).drop("open", "high", "low", "close", "volume")
    return out.select(KEY, "ts", *_round4(out, *[c for c in out.columns if c not in (KEY, "ts")]))


_WIDE = [(n, tf) for n in ("click", "error", "purchase", "signup", "view") for tf in ("15min", "1h")]


def _wide_sql() -> str:
    own, others = _WIDE[0], _WIDE[1:]
    p = features.prefix(*own)
    parts = [_base_sql("15min", "c15", "base_15min"), _base_sql("1h", "c1", "base_1h")]
    lagged = ", ".join(f"lag({n}) OVER s AS {p}_{n}" for n in (*features.BASE, "ts"))
    parts.append(f"w0 AS (SELECT ts, close, {lagged} FROM base_15min WHERE instrument = '{own[0]}' {_W})")
    for k, (name, tf) in enumerate(others, 1):
        q = features.prefix(name, tf)
        parts.append(f"o{k} AS (SELECT ts + to_seconds({sql.seconds(tf)}) AS ended, {', '.join(f'{n} AS {q}_{n}' for n in features.BASE)} FROM base_{tf} WHERE instrument = '{name}')")
        parts.append(f"w{k} AS (SELECT w{k - 1}.*, o{k}.* EXCLUDE (ended), o{k}.ended AS {q}_ts FROM w{k - 1} ASOF LEFT JOIN o{k} ON w{k - 1}.ts >= o{k}.ended)")
    names = [features.prefix(*k) for k in _WIDE]
    made = [f"round(sign({p}_trend) * sign({q}_trend), 4) + 0.0::DOUBLE AS x_{q}_trend_match" for q in names[1:]]
    for at, label in ((1, "x_volz_mkt_{}"), (0, "x_volz_{}_tfs")):
        for value in sorted({k[at] for k in _WIDE}):
            some = [f"{features.prefix(*k)}_vol_z" for k in _WIDE if k[at] == value]
            made.append(f"round((SELECT avg(x) FROM (SELECT unnest([{', '.join(some)}]) AS x)) + 1e-9, 4) + 0.0::DOUBLE AS {label.format(value.replace('min', 'm'))}")
    return f"WITH RECURSIVE {', '.join(parts)} SELECT ts, close, {_r4(*[f'{q}_{n}' for q in names for n in features.BASE])}, {', '.join(f'{q}_ts' for q in names)}, {', '.join(made)} FROM w{len(others)}"


@query("wide_features", _wide_sql())
def wide_features(spark, sf_dir):
    """All instruments in two timeframes, as features of one of them."""
    universe = {(n, tf): bars(spark, sf_dir, tf).where(F.col(KEY) == n) for n, tf in _WIDE}
    out = features.build(universe, _WIDE[0])
    kept = [c for c in out.columns if c in ("ts", "close") or c.endswith("_ts")]
    return out.select(*kept, *_round4(out, *[c for c in out.columns if c not in kept]))


_R9 = "round({}, 9)"
_EWM_PARTS = f"""{sql.candles('1h')}, {sql.numbered()}, {sql.ewm('t', 'b', 0.05, True, trend='close')}, {sql.ewm('v', 'b', 0.05, True, fast='volume')},
x AS (SELECT b.*, round((close / trend - 1) * 100, 9) AS dev, round(abs(trend / lag(trend, 5) OVER s - 1) * 100, 9) AS slope, fast,
  CASE WHEN count(*) {_frame(23)} >= 24 THEN round(1.0::DOUBLE * avg(volume) {_frame(23)}, 9) END AS base FROM b JOIN t USING (instrument, i) JOIN v USING (instrument, i) {_W}),
y AS (SELECT *, coalesce(slope < 5.0 AND fast < base, false) AS quiet FROM x), y1 AS (SELECT *, sum(CASE WHEN quiet THEN 0 ELSE 1 END) {_frame(1000000)} AS g FROM y),
z AS (SELECT *, sum(CASE WHEN quiet THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, g ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM y1),
{sql.decisions('z', 'dev IS NULL', 'hour(ts) >= 9 AND hour(ts) < 16', 'dev >= -0.5', 'dev <= 0.5', 'lag(dev) OVER s <= -3.0 AND lag(run) OVER s >= 2', 'lag(dev) OVER s >= 3.0 AND lag(run) OVER s >= 2', '20')},
{sql.fold('d')}, {sql.path()}"""


def _z_parts(hold: str = "20", entry: str = "1.0", alpha: float = 0.05) -> str:
    return f"""{sql.candles('1h')}, {sql.numbered()}, {sql.deviation('e', 'b', alpha)},
x AS (SELECT b.*, round(CASE WHEN sd = 0 THEN CASE WHEN abs(close - m) > abs(close) * 1e-12 THEN sign(close - m) * 'inf'::DOUBLE END ELSE (close - m) / sd END, 9) AS z FROM b JOIN e USING (instrument, i)),
{sql.decisions('x', 'z IS NULL', f'{sql.MINUTE} >= 420 AND {sql.MINUTE} < 945', 'z >= 0', 'z <= 0', f'lag(z) OVER s <= -{entry}', f'lag(z) OVER s >= {entry}', hold)},
{sql.fold('d')}, {sql.path()}"""


_BOUNDS_PARTS = f"""{sql.candles('1h')}, {sql.numbered()}, {sql.ewm('e', 'b', 0.05, False, h='high * volume', l='low * volume', v='volume')},
x AS (SELECT b.*, h / v AS vwh, l / v AS vwl, round((h / v + l / v) / 2, 9) AS mid FROM b JOIN e USING (instrument, i)),
{sql.decisions('x', 'mid IS NULL', f'{sql.MINUTE} >= 420 AND {sql.MINUTE} < 945', 'close >= mid', 'close <= mid', 'lag(close) OVER s <= round(lag(vwl) OVER s, 9)', 'lag(close) OVER s >= round(lag(vwh) OVER s, 9)', '30')},
{sql.fold('d')}, {sql.path()}"""

_STRATEGIES = {
    "ewm": (_EWM_PARTS, lambda b: strategies.ewm_quiet(b, trend_alpha=0.05, entry_pct=3.0, exit_pct=0.5, max_slope_pct=5.0, slope_window=5, vol_alpha=0.05, vol_window=24, vol_ratio_max=1.0, min_quiet_bars=2, time_stop_bars=20)),
    "z": (_z_parts(), lambda b: strategies.z_score(b, alpha=0.05, z_entry=1.0, max_hold=20)),
    "bounds": (_BOUNDS_PARTS, lambda b: strategies.bounds(strategies.vw_bands(b, 0.05), max_hold=30)),
}
_FILLS_SQL = "SELECT instrument, ts, qty, price, round(fee, 6) AS fee FROM (SELECT instrument, ts, qty, open AS price, fee FROM p) WHERE qty <> 0"
_PATH_SQL = "SELECT instrument, ts, CAST(position AS BIGINT) AS position, round(equity + 1e-7, 4) AS equity FROM p"


def _fills(spark, sf_dir, make):
    b = bars(spark, sf_dir, "1h")
    return strategies.fills(b, make(b)).select(KEY, "ts", "qty", "price", F.round("fee", 6).alias("fee"))


def path_of(spark, sf_dir, which: str = "z") -> DataFrame:
    b = bars(spark, sf_dir, "1h")
    return strategies.path(b, _STRATEGIES[which][1](b))


for _n, (_parts, _make) in _STRATEGIES.items():
    query(f"bt_{_n}_fills", f"WITH RECURSIVE {_parts}\n{_FILLS_SQL}")(lambda spark, sf_dir, make=_make: _fills(spark, sf_dir, make))
    query(f"bt_{_n}_equity", f"WITH RECURSIVE {_parts}\n{_PATH_SQL}")(lambda spark, sf_dir, n=_n: path_of(spark, sf_dir, n).select(KEY, "ts", "position", F.round(F.col("equity") + 1e-7, 4).alias("equity")))
    query(f"bt_{_n}_stats", f"WITH RECURSIVE {_parts},\n{sql.stats()}")(lambda spark, sf_dir, n=_n: stats.strategy(path_of(spark, sf_dir, n)))


def _trips(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir, "1h")
    f = strategies.fills(b, _STRATEGIES["z"][1](b))
    return stats.round_trips(f, b)


_TRIPS_SQL = f"""{_z_parts()}, fl AS (SELECT instrument, i, ts, qty, open AS price, fee, row_number() OVER (PARTITION BY instrument ORDER BY i) AS n FROM p WHERE qty <> 0),
tr AS (SELECT a.instrument, a.ts AS ts_in, b.ts AS ts_out, a.qty AS side, hour(a.ts) AS hour, b.i - a.i AS bars_held, a.qty * (b.price - a.price) AS gross_pnl, a.fee + b.fee AS fees, a.qty * (b.price - a.price) - a.fee - b.fee AS net_pnl
  FROM fl a JOIN fl b ON a.instrument = b.instrument AND b.n = a.n + 1 WHERE a.n % 2 = 1)"""
_PROFILE = "count(*) AS n, round(avg(net_pnl), 4) AS mean, round(sum(net_pnl), 4) AS total, round(avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate"


@query("round_trips", f"WITH RECURSIVE {_TRIPS_SQL} SELECT instrument, ts_in, ts_out, side, CAST(hour AS INTEGER) AS hour, CAST(bars_held AS INTEGER) AS bars_held, round(gross_pnl + 1e-7, 4) AS gross_pnl, round(fees + 1e-9, 6) AS fees, round(net_pnl + 1e-9, 6) AS net_pnl FROM tr")
def round_trips(spark, sf_dir):
    out = _trips(spark, sf_dir)
    return out.select(KEY, "ts_in", "ts_out", "side", "hour", "bars_held", F.round(F.col("gross_pnl") + 1e-7, 4).alias("gross_pnl"), *rounded(out, "fees", "net_pnl"))


@query("trip_columns", f"""WITH RECURSIVE {_z_parts()}, fl AS (SELECT instrument, i, ts, qty, row_number() OVER (PARTITION BY instrument ORDER BY i) AS n FROM p WHERE qty <> 0),
tr AS (SELECT a.instrument, a.i AS a, b.i AS b, a.ts AS ts_in FROM fl a JOIN fl b ON a.instrument = b.instrument AND b.n = a.n + 1 WHERE a.n % 2 = 1)
SELECT tr.instrument, tr.ts_in, CAST(hour(tr.ts_in + INTERVAL 3 HOUR) AS INTEGER) AS local_hour, tr.ts_in > TIMESTAMP '2024-01-15' AS oos, round(x0.z, 6) AS z_in, round(x1.z, 6) AS z_out, c0.open AS open_in, c1.open AS open_out
FROM tr JOIN x x0 ON x0.instrument = tr.instrument AND x0.i = a - 1 JOIN x x1 ON x1.instrument = tr.instrument AND x1.i = b - 1 JOIN b c0 ON c0.instrument = tr.instrument AND c0.i = a JOIN b c1 ON c1.instrument = tr.instrument AND c1.i = tr.b""")
def trip_columns(spark, sf_dir):
    b = bars(spark, sf_dir, "1h")
    path = strategies.z_indicator(b, 0.05).withColumnRenamed("__z", "z")
    out = stats.round_trips(strategies.fills(b, _STRATEGIES["z"][1](b)), path, ("z",), ("open",), train_end="2024-01-15")
    return out.select(KEY, "ts_in", "local_hour", "oos", F.round("z_in", 6).alias("z_in"), F.round("z_out", 6).alias("z_out"), "open_in", "open_out")


@query("profile_by_hour", f"WITH RECURSIVE {_TRIPS_SQL} SELECT CAST(hour AS INTEGER) AS hour, {_PROFILE} FROM tr GROUP BY hour")
def profile_by_hour(spark, sf_dir):
    return stats.profile(_trips(spark, sf_dir), F.col("hour"), "hour")


@query("profile_by_side", f"WITH RECURSIVE {_TRIPS_SQL} SELECT side, {_PROFILE} FROM tr GROUP BY side")
def profile_by_side(spark, sf_dir):
    return stats.profile(_trips(spark, sf_dir), F.col("side"), "side")


@query("profile_by_quartile", f"""WITH RECURSIVE {_TRIPS_SQL}, q AS (SELECT quantile_cont(gross_pnl, 0.25) AS a, quantile_cont(gross_pnl, 0.5) AS b, quantile_cont(gross_pnl, 0.75) AS c FROM tr)
SELECT CASE WHEN gross_pnl <= a THEN 1 WHEN gross_pnl <= b THEN 2 WHEN gross_pnl <= c THEN 3 ELSE 4 END AS bucket, {_PROFILE} FROM tr, q GROUP BY 1""")
def profile_by_quartile(spark, sf_dir):
    return stats.profile(stats.quartiles(_trips(spark, sf_dir), "gross_pnl"), F.col("bucket"), "bucket")


@query("corr_pnl", f"WITH RECURSIVE {_TRIPS_SQL}, c4 AS (SELECT round(corr(bars_held, net_pnl), 6) AS a, round(corr(fees, net_pnl), 6) AS b, round(corr(hour, net_pnl), 6) AS c FROM tr) SELECT 'bars_held' AS feature, a AS corr FROM c4 UNION ALL SELECT 'fees', b FROM c4 UNION ALL SELECT 'hour', c FROM c4")
def corr_pnl(spark, sf_dir):
    return stats.correlations(_trips(spark, sf_dir), ["bars_held", "fees", "hour"], "net_pnl")


@query("buy_hold_stats", f"""WITH {sql.candles('1h')}, ends AS (SELECT instrument, min(ts) AS t0, max(ts) AS t1, arg_min(close, ts) AS a, arg_max(close, ts) AS b FROM c GROUP BY 1),
days AS (SELECT instrument, CAST(ts AS DATE) AS day, arg_max(close, ts) AS close FROM c GROUP BY 1, 2), r AS (SELECT instrument, close / lag(close) OVER s - 1 AS r, close / max(close) OVER s - 1 AS dd FROM days WINDOW s AS (PARTITION BY instrument ORDER BY day)),
g AS (SELECT instrument, avg(r) AS m, stddev_samp(r) AS s, avg(CASE WHEN r < 0 THEN r END) AS dm, stddev_samp(CASE WHEN r < 0 THEN r END) AS ds, min(dd) AS dd FROM r GROUP BY 1)
SELECT instrument, round((b / a - 1) * 100, 4) AS pnl_pct, round(pow(b / a, 365.0::DOUBLE / greatest(floor((epoch(t1) - epoch(t0)) / 86400), 1)) - 1, 4) AS cagr, round(coalesce(m / s * sqrt(252), 0.0), 4) AS sharpe, round(coalesce(dm / ds * sqrt(252), 0.0), 4) AS sortino, round(dd, 4) AS max_dd FROM ends JOIN g USING (instrument)""")
def buy_hold_stats(spark, sf_dir):
    return stats.buy_and_hold(bars(spark, sf_dir, "1h"))


_DAILY = "de AS (SELECT instrument, CAST(ts AS DATE) AS day, arg_max(equity, ts) AS equity FROM p GROUP BY 1, 2)"


@query("daily_equity", f"WITH RECURSIVE {_z_parts()}, {_DAILY} SELECT instrument, CAST(day AS VARCHAR) AS day, round(equity + 1e-7, 4) AS equity FROM de")
def daily_equity(spark, sf_dir):
    """Every day has bars in this table, so that nothing is carried over; tests cover days without."""
    return stats.daily_equity(path_of(spark, sf_dir)).select(KEY, F.col("day").cast("string").alias("day"), F.round(F.col("equity") + 1e-7, 4).alias("equity"))


@query("daily_fills", f"WITH RECURSIVE {_z_parts()} SELECT instrument, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(abs(qty)) AS BIGINT) AS lots, round(sum(abs(qty) * open) + 1e-9, 6) AS turnover FROM p WHERE qty <> 0 GROUP BY 1, 2")
def daily_fills(spark, sf_dir):
    b = bars(spark, sf_dir, "1h")
    f = strategies.fills(b, _STRATEGIES["z"][1](b))
    return f.groupBy(KEY, F.to_date("ts").cast("string").alias("day")).agg(F.sum(F.abs("qty")).alias("lots"), F.round(F.sum(F.abs("qty") * F.col("price")) + 1e-9, 6).alias("turnover"))


@query("chart_stats", f"""WITH RECURSIVE {_z_parts()}, {_DAILY}, pk AS (SELECT instrument, max(CASE WHEN qty <> 0 THEN abs(position) * open END) AS peak, arg_min(equity, ts) AS a, arg_max(equity, ts) AS z FROM p GROUP BY 1),
dr AS (SELECT instrument, (equity - lag(equity) OVER (PARTITION BY instrument ORDER BY day)) / peak AS r FROM de JOIN pk USING (instrument)), ddn AS (SELECT instrument, min(x) AS dd FROM (SELECT instrument, equity - max(equity) OVER (PARTITION BY instrument ORDER BY ts) AS x FROM p) GROUP BY 1),
ag AS (SELECT instrument, avg(r) AS m, stddev_samp(r) AS s, avg(CASE WHEN r < 0 THEN r END) AS dm, stddev_samp(CASE WHEN r < 0 THEN r END) AS ds, sum(CASE WHEN r > 0 THEN r END) AS up, sum(CASE WHEN r < 0 THEN r END) AS down FROM dr GROUP BY 1)
SELECT instrument, round(coalesce((z - a) / peak * 100, 0.0), 4) AS ret_pct, round(up / nullif(abs(down), 0), 4) AS profit_factor, round(coalesce(m / nullif(s, 0) * sqrt(252), 0.0), 4) AS sharpe, round(coalesce(dm / nullif(ds, 0) * sqrt(252), 0.0), 4) AS sortino, round(coalesce(dd / peak, 0.0), 4) AS max_dd
FROM pk JOIN ag USING (instrument) JOIN ddn USING (instrument)""")
def chart_stats(spark, sf_dir):
    return stats.chart_stats(path_of(spark, sf_dir))


@query("daily_closes", f"WITH {sql.candles('1h')} SELECT instrument, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM c GROUP BY 1, 2")
def daily_closes(spark, sf_dir):
    return candles.daily_close(bars(spark, sf_dir, "1h")).withColumn("day", F.col("day").cast("string"))


@query("merge_candles", f"""WITH {sql.candles('1h')}, a AS (SELECT * FROM c WHERE ts < TIMESTAMP '2024-01-20'), f AS (SELECT instrument, ts, open + 1 AS open, high, low, close, volume FROM c WHERE ts >= TIMESTAMP '2024-01-10')
SELECT * FROM a UNION ALL SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.instrument = f.instrument AND a.ts = f.ts)""")
def merge_candles(spark, sf_dir):
    b = bars(spark, sf_dir, "1h")
    cached, fresh = b.where("ts < timestamp_ntz'2024-01-20 00:00:00'"), b.where("ts >= timestamp_ntz'2024-01-10 00:00:00'").withColumn("open", F.col("open") + 1)
    return candles.merge(cached, fresh)


@query("gap_report", f"WITH {sql.candles('1h')}, g AS (SELECT instrument, lag(ts) OVER s AS after_ts, ts AS before_ts FROM c {_W}) SELECT instrument, after_ts, before_ts, CAST((epoch(before_ts) - epoch(after_ts)) / 3600 - 1 AS BIGINT) AS missing FROM g WHERE after_ts IS NOT NULL AND epoch(before_ts) - epoch(after_ts) > 3600")
def gap_report(spark, sf_dir):
    return candles.gaps(bars(spark, sf_dir, "1h"), "1h")


@query("missing_ranges", f"""WITH {sql.candles('1h')}, e AS (SELECT instrument, min(ts) AS a, max(ts) AS z FROM c GROUP BY 1) SELECT instrument, TIMESTAMP '2023-12-15' AS from_ts, least(a, TIMESTAMP '2024-02-10') AS to_ts FROM e WHERE TIMESTAMP '2023-12-15' < a
UNION ALL SELECT instrument, greatest(z, TIMESTAMP '2023-12-15'), TIMESTAMP '2024-02-10' FROM e WHERE TIMESTAMP '2024-02-10' > z""")
def missing_ranges(spark, sf_dir):
    return candles.missing_ranges(bars(spark, sf_dir, "1h"), "2023-12-15", "2024-02-10")


@query("range_filters", f"WITH {sql.candles('1h')} SELECT instrument, ts, close, ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AS half_open, ts > TIMESTAMP '2024-01-15' AS after_train FROM c WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'")
def range_filters(spark, sf_dir):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    out = candles.between(bars(spark, sf_dir, "1h"), t("2024-01-05"), t("2024-01-25"))
    return out.select(KEY, "ts", "close", ((F.col("ts") >= t("2024-01-10")) & (F.col("ts") < t("2024-01-20"))).alias("half_open"), (F.col("ts") > t("2024-01-15")).alias("after_train"))
