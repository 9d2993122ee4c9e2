"""Queries over parts of time: eligible stretches, test periods, trades of two runs side by side, signals of a stream."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from tidebar.operators import model, spec, stats, strategies
from tidebar.operators import windows as win
from tidebar.operators.candles import KEY
from tidebar.operators.tables import shared_dir, written
from tidebar.plans import sql
from tidebar.plans.market import _BOUNDS_PARTS, _EWM_PARTS, _z_parts, bars
from tidebar.plans.research import _EXEC, _SIGNAL_PARTS, executed
from tidebar.streaming import live

QUERIES: dict = {}
SQL: dict = {}
_END = "2024-01-15 00:00:00"


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


@query("eligible_stretches", f"""WITH RECURSIVE {_EWM_PARTS},
el AS (SELECT instrument, ts, run >= 2 AS ok FROM z WHERE ts >= TIMESTAMP '2024-01-08 12:00:00' AND ts < TIMESTAMP '2024-01-22 09:00:00'),
gr AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM el)
SELECT instrument, min(ts) AS start, max(ts) AS "end", count(*) AS bars FROM gr WHERE ok GROUP BY instrument, g""")
def eligible_stretches(spark, sf_dir):
    """Where the quiet-market strategy may enter, as intervals inside a range that is shown."""
    df = strategies.quiet(bars(spark, sf_dir, "1h"), 0.05, 5.0, 5, 0.05, 24, 1.0).withColumn("eligible", F.col("__run") >= 2)
    return win.stretches(df, "eligible", "2024-01-08 12:00:00", "2024-01-22 09:00:00")


#: Without the yearly growth, which a fortnight's is too far from.
_STATS = re.sub(r"round\(CASE WHEN peak > 0 THEN CASE WHEN 1 \+ pnl.*? AS cagr,", "", sql.stats())
_CUT = f"{sql.candles('1h', 'c0')}, c AS (SELECT * FROM c0 WHERE ts > TIMESTAMP '{_END}')"


@query("test_period_z", f"WITH RECURSIVE {_z_parts().replace(sql.candles('1h'), _CUT)},\n{_STATS}")
def test_period_z(spark, sf_dir):
    """After the training's end; the score is warmed up anew."""
    b = model.after_training(bars(spark, sf_dir, "1h"), _END)
    return stats.strategy(strategies.path(b, strategies.z_score(b, alpha=0.05, z_entry=1.0, max_hold=20))).drop("cagr")


_AFTER = f"x AS (SELECT * REPLACE (row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1 AS i) FROM x0 WHERE ts > TIMESTAMP '{_END}')"


@query("test_period_bounds", "WITH RECURSIVE " + _BOUNDS_PARTS.replace("\nx AS (", "\nx0 AS (").replace("USING (instrument, i)),", f"USING (instrument, i)),\n{_AFTER},", 1) + f",\n{_STATS}")
def test_period_bounds(spark, sf_dir):
    """After the training's end; the bands are those of all bars."""
    whole = bars(spark, sf_dir, "1h")
    b = model.after_training(whole, _END, strategies.vw_bands(whole, 0.05))
    return stats.strategy(strategies.path(b, strategies.bounds(b, max_hold=30))).drop("cagr")


@query("trade_timing", f"""WITH RECURSIVE {_EXEC},
pl AS (SELECT instrument, ts, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS n, qty FROM xp),
te AS (SELECT instrument, n AS t, ts, CAST(sign(qty) AS INTEGER) AS side FROM pl WHERE qty <> 0),
li AS (SELECT instrument, CASE WHEN hour(ts) % 2 = 1 THEN n + 2 ELSE n - 1 END AS l, CAST(sign(qty) AS INTEGER) AS side FROM pl WHERE qty <> 0 AND hour(ts) <> 10),
lv AS (SELECT li.instrument, li.l, li.side, pl.ts FROM li JOIN pl ON pl.instrument = li.instrument AND pl.n = li.l),
ld AS (SELECT instrument, l, any_value(side) AS side, any_value(ts) AS ts FROM lv GROUP BY instrument, l HAVING count(DISTINCT side) = 1),
pa AS MATERIALIZED (SELECT l.instrument, l.side, l.l, t.t, l.ts AS live_ts, t.ts AS test_ts, row_number() OVER (PARTITION BY l.instrument, l.side ORDER BY abs(l.l - t.t), l.l, t.t) AS k FROM ld l JOIN te t ON t.instrument = l.instrument AND t.side = l.side AND abs(l.l - t.t) <= 8),
ma AS (SELECT instrument, side, 0::BIGINT AS k, []::BIGINT[] AS ls, []::BIGINT[] AS ts FROM pa GROUP BY 1, 2
  UNION ALL SELECT pa.instrument, pa.side, pa.k, CASE WHEN f THEN list_append(ls, pa.l) ELSE ls END, CASE WHEN f THEN list_append(ts, pa.t) ELSE ts END
  FROM ma JOIN pa ON pa.instrument = ma.instrument AND pa.side = ma.side AND pa.k = ma.k + 1, LATERAL (SELECT NOT list_contains(ls, pa.l) AND NOT list_contains(ts, pa.t) AS f)),
fi AS (SELECT instrument, side, unnest(ls) AS l, unnest(ts) AS t FROM (SELECT instrument, side, arg_max(ls, k) AS ls, arg_max(ts, k) AS ts FROM ma GROUP BY 1, 2))
SELECT l.instrument, l.side, l.ts AS live_ts, t.ts AS test_ts, CAST(l.l - t.t AS BIGINT) AS bars FROM ld l LEFT JOIN fi ON fi.instrument = l.instrument AND fi.side = l.side AND fi.l = l.l LEFT JOIN te t ON t.instrument = fi.instrument AND t.t = fi.t
UNION ALL SELECT instrument, side, NULL, ts, NULL FROM te WHERE NOT EXISTS (SELECT 1 FROM fi WHERE fi.instrument = te.instrument AND fi.side = te.side AND fi.t = te.t)""")
def trade_timing(spark, sf_dir):
    """A log's candles replayed, against trades that came a bar early or two late, or not at all."""
    log = written(spec.event_log(executed(spark, sf_dir)), "log")
    again = written(spec.replayed(log, bars(spark, sf_dir, "1min"), 5, "1 hour").select(KEY, "ts", "qty"), "replayed")
    order = strategies.series()
    n = F.row_number().over(order)
    rows = again.withColumn("n", n)
    moved = rows.where("qty <> 0 and hour(ts) <> 10").select(KEY, F.when(F.hour("ts") % 2 == 1, F.col("n") + 2).otherwise(F.col("n") - 1).alias("n"), F.signum("qty").alias("q"))
    moved = moved.groupBy(KEY, "n").agg(F.min("q").alias("q"), F.max("q").alias("q2")).where("q = q2")
    late = rows.select(KEY, "ts", "n").join(moved, [KEY, "n"], "left").select(KEY, "ts", F.coalesce("q", F.lit(0.0)).alias("qty"))
    return spec.trade_timing(late, again)


@query("stream_signals", f"""WITH RECURSIVE {_SIGNAL_PARTS}
SELECT m.instrument, m.ts, m.live AS in_session, CAST(sg.signal AS INTEGER) AS signal FROM m JOIN sg USING (instrument, i) WHERE m.ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_signals(spark, sf_dir):
    """Ticks as a stream, candles as they close, signals from their state: one stream, run until its input is done."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    ticks = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    to = f"{shared_dir(spark)}/tidebar-stream-{uuid.uuid4().hex}"
    out = live.candle_signals(live.closed_candles(ticks, "1h"))
    out.writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{to}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
