import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidebar.functions.columns import order_id
from tidebar.operators import candles, spec
from tidebar.operators.candles import KEY
from tidebar.plans.market import bars
from tidebar.sources import ingest, store
from tidebar.streaming import live

START = datetime(2024, 1, 1, 7)


def drain(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_closed_candles_are_the_batch_ones(spark, tmp_path):
    ticks = spark.read.parquet(f"{SMALL}/events.parquet")
    ticks.repartition(1).write.parquet(str(tmp_path / "in"))
    got = drain(live.closed_candles(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")), "1day"), "closed", tmp_path)
    want = candles.resample(ticks, "1day").withColumn("ts", F.col("ts").cast("timestamp"))
    assert got.count() > 0 and got.exceptAll(want).count() == 0
    late = want.join(got, [KEY, "ts"], "left_anti")
    assert late.agg(F.min("ts")).first()[0] >= got.agg(F.max("ts")).first()[0]


def test_signal_stream_is_the_fold(spark, tmp_path):
    whole = spec.signals(bars(spark, "/root/testdata/sf0.01", "1h")).where(f"{KEY} in ('click', 'view')")
    rows = whole.select(KEY, F.col("ts").cast("timestamp").alias("ts"), "up", "at_lower", "at_upper", "crossed", (F.col("in_session") & F.col("ready")).alias("live"), F.lit(False).alias("discrepancy"))
    rows.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    got = drain(live.signal_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), "signals", tmp_path)
    want = whole.select(KEY, F.col("ts").cast("timestamp").alias("ts"), F.col("signal").cast("int").alias("signal"))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_halt(spark, tmp_path):
    row = lambda i, bad: ("a", START + timedelta(hours=i), True, True, False, False, True, bad)
    rows = spark.createDataFrame([row(0, False), row(1, True), row(2, False)], f"{KEY} string, ts timestamp, up boolean, at_lower boolean, at_upper boolean, crossed boolean, live boolean, discrepancy boolean")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    assert [r.signal for r in drain(live.signal_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), "halted", tmp_path).collect()] == [1]


def test_orders_once(spark, tmp_path):
    orders = spark.createDataFrame([("a", START, 1), ("a", START, 1), ("a", START, 0)], f"{KEY} string, bar_ts timestamp, signal int")
    orders.repartition(1).write.parquet(str(tmp_path / "in"))
    assert drain(live.once(spark.readStream.schema(orders.schema).parquet(str(tmp_path / "in"))), "orders", tmp_path).count() == 2


def test_orders_in_flight(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    log = [(0, "order", "x", 10.0), (1, "fill", "x", 4.0), (2, "position", None, 4.0), (3, "fill", "x", 6.0), (4, "position", None, 10.0), (5, "position", None, 9.0)]
    log += [(6, "order", "y", -5.0), (15, "candle", None, None), (30, "candle", None, None), (45, "candle", None, None), (60, "candle", None, None), (61, "order_end", "y", None), (62, "position", None, 10.0)]
    rows = spark.createDataFrame([("a", at(m), kind, name, qty) for m, kind, name, qty in log], f"{KEY} string, ts timestamp, type string, order_id string, qty double")
    for part in (rows.where(F.col("ts") < at(30)), rows.where(F.col("ts") >= at(30))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    got = drain(live.reconcile_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))), "flight", tmp_path)
    assert [(r.ts, r.what, r.order_id, r.expected, r.held) for r in got.orderBy("ts").collect()] == [(at(5), "discrepancy", None, 10.0, 9.0), (at(45), "stuck", "y", None, None)]


def test_retries(spark):
    log = [("a", START, 1, 0, "sent"), ("a", START, 1, 0, "rejected"), ("b", START, 1, 0, "rejected"), ("b", START, 1, 1, "filled"), *[("c", START, -1, k, "rejected") for k in range(3)]]
    got = {r[KEY]: r for r in live.retries(spark.createDataFrame(log, f"{KEY} string, bar_ts timestamp, target int, attempt int, status string")).collect()}
    assert set(got) == {"a", "c"} and got["a"].attempt == 1 and not got["a"].failed and got["c"].failed and got["c"].order_id is None
    tried = spark.createDataFrame([("a", START, 1, k) for k in (0, 1, 1)], f"{KEY} string, bar_ts timestamp, target int, attempt int")
    named = {r.attempt: r.order_id for r in tried.withColumn("order_id", order_id(KEY, "bar_ts", "target", "attempt")).collect()}
    assert got["a"].order_id == named[1] != named[0]


def test_store(spark, tmp_path):
    root = str(tmp_path / "cache")
    day = bars(spark, SMALL, "1day").select(F.lit("x").alias("exchange"), KEY, F.lit("1day").alias("timeframe"), "ts", "open", "high", "low", "close", "volume")
    store.write_candles(day, root)
    got = store.read_candles(spark, root, ["click"], "1day", "2024-01-05", "2024-01-09")
    assert got.count() == 5 and got.columns == store.CANDLE.names
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString()
    store.append_fresh(spark, root, day.where(f"{KEY} = 'click'").withColumn("close", F.lit(-1.0)).limit(3), "fresh")
    back = store.read_candles(spark, root)
    assert back.count() == day.count() and back.where("close = -1").count() == 3


def test_grid_files_and_html(spark, tmp_path):
    df = spark.createDataFrame([(0.1, 5, 1.5), (0.2, 9, 2.5)], "alpha double, max_hold int, sortino double")
    store.write_grid(df, str(tmp_path / "g"))
    assert store.best_params(spark, str(tmp_path / "g"), ["max_hold"]) == {"alpha": 0.2, "max_hold": 9, "sortino": 2.5}
    assert "hsl(120" in store.grid_html(df) and "hsl(0" in store.grid_html(df)


def test_events(spark, tmp_path):
    e = spark.createDataFrame([(START, "x", "a", "candle", "r")], "ts timestamp, exchange string, instrument string, type string, run_id string")
    store.append_events(e, str(tmp_path / "log"))
    store.append_events(e, str(tmp_path / "log"))
    assert store.read_events(spark, str(tmp_path / "log")).where("type = 'candle' and ts is not null").count() == 2


def test_paged_source(spark):
    def fetch(instrument, start, end):
        last = min(end, start + 2 * 3600)
        return [(instrument, datetime.fromtimestamp(t), 1.0, 1.0, 1.0, 1.0, 1) for t in range(-(-start // 3600) * 3600, last, 3600)]

    spark.dataSource.register(ingest.source("pages_of_candles", fetch))
    start = int(START.timestamp()) // 3600 * 3600
    df = spark.read.format("pages_of_candles").options(instruments=json.dumps(["a", "b"]), start=start, end=start + 10 * 3600, days=1).load()
    assert df.count() == 20 and df.distinct().count() == 20


def test_resolve_and_config(spark):
    known = spark.createDataFrame([("A", "f1", "TQBR"), ("B", "f2", "TQBR"), ("B", "f3", "TQBR")], "ticker string, figi string, class_code string")
    assert store.resolve(known, ["A"]) == {"A": "f1"}
    assert store.find(known, "B", None).count() == 2 and store.verify(known, "f3")["ticker"] == "B" and store.verify(known, "f9") is None
    for bad in (["B"], ["C"]):
        with pytest.raises(ValueError):
            store.resolve(known, bad)
    assert store.load_env("A=1\n# no\nB='2'", {"A": "0"}) == {"A": "0", "B": "2"}
    with pytest.raises(ValueError):
        store.validated({"exchange": "x"})


def test_ticks_to_signals_over_a_restart(spark, tmp_path):
    """Closed candles feed signals in one stream that stops half-way: the same rows as from a table of candles."""
    ticks = spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("event_type in ('click', 'view')")
    middle = datetime(2024, 1, 14, 11, 30)
    for part in (ticks.where(F.col("ts") < middle), ticks.where(F.col("ts") >= middle)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
        out = live.candle_signals(live.closed_candles(stream, "1h"))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(200)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = spec.signals(candles.resample(ticks, "1h")).select(KEY, F.col("ts").cast("timestamp").alias("ts"), (F.col("in_session") & F.col("ready")).alias("in_session"), F.col("signal").cast("int").alias("signal"))
    last = got.agg(F.max("ts")).first()[0]
    want = want.where(F.col("ts") <= last)
    assert got.count() == want.count() > 1000 and got.exceptAll(want).count() == 0 and got.where("signal != 0").count() > 10


def test_log_holds_each_event_once(spark, tmp_path):
    """A batch that fails after it was written runs again."""
    path, failed = str(tmp_path / "log"), []
    rows = spark.createDataFrame([(f"2024-01-01T00:00:0{i}", "r", "fill", "a", float(i)) for i in range(6)], "ts string, run_id string, type string, instrument string, qty double")
    write = live.record(path)

    def breaks(batch, number):
        write(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost")

    for k in range(3):
        rows.where(f"qty between {2 * k} and {2 * k + 1}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="lost"):
        stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(breaks).trigger(availableNow=True).start().awaitTermination(120)
    live.audit(stream, path, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.qty for r in spark.read.option("recursiveFileLookup", True).json(path).collect()) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and failed == [1]
    live.audit(stream, path, str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination(120)
    assert store.read_events(spark, path).count() == 12  # another query's log stands beside the first one's


def test_stretches(spark):
    from tidebar.operators import windows

    flags = [False, True, True, None, True, False, True, True, True]
    df = spark.createDataFrame([("a", START + timedelta(hours=i), f) for i, f in enumerate(flags)] + [("b", START, True)], f"{KEY} string, ts timestamp, f boolean")
    hours = lambda rows: sorted((r[KEY], (r.start - START).seconds // 3600, (r.end - START).seconds // 3600, r.bars) for r in rows.collect())
    assert hours(windows.stretches(df, "f")) == [("a", 1, 2, 2), ("a", 4, 4, 1), ("a", 6, 8, 3), ("b", 0, 0, 1)]
    assert hours(windows.stretches(df, "f", START + timedelta(hours=2), START + timedelta(hours=8))) == [("a", 2, 2, 1), ("a", 4, 4, 1), ("a", 6, 7, 2)]
    assert windows.stretches(df.limit(0), "f").count() == 0


def test_trades_match_one_to_one(spark):
    def side(qty):
        return spark.createDataFrame([("a", START + timedelta(hours=i), float(q)) for i, q in enumerate(qty)], f"{KEY} string, ts timestamp, qty double")

    test = side([1, 0, 0, -1, 0, 1, 0, 1, 0, 0, 0, 0, 0, 0, 1])
    late = side([0, 1, 0, -1, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0])
    hour = lambda t: None if t is None else (t - START).seconds // 3600
    got = sorted(((r.side, hour(r.live_ts), hour(r.test_ts), r.bars) for r in spec.trade_timing(late, test, most=3).collect()), key=str)
    # 6 is as near to 5 as to 7: the earlier; then 10 takes 7; 14 has nothing within three bars.
    assert got == sorted([(-1, 3, 3, 0), (1, 1, 0, 1), (1, 6, 5, 1), (1, 10, 7, 3), (1, None, 14, None)], key=str)
    assert spec.trade_timing(late.where("qty = 5"), test.where("qty = 5")).count() == 0
    assert sorted(r.bars is None for r in spec.trade_timing(late, test.where("qty < 0"), most=3).collect()) == [False, True, True, True]


def test_rows_come_once_over_failures():
    class Status(Exception):
        pass

    start, waits = int(START.timestamp()) // 86400 * 86400, []

    def fetch(script):
        calls = iter(script)

        def run(instrument, a, b):
            step = next(calls, None)
            for k, t in enumerate(range(a, b, 3600)):
                if step is not None and k == step[1]:
                    raise Status(step[0])
                yield (instrument, datetime.fromtimestamp(t), 0.0, 0.0, 0.0, 0.0, 0)

        return run

    hours = lambda script, delays=ingest.DELAYS: [int(r[1].timestamp() - start) // 3600 for r in ingest.rows(fetch(script), "a", start, start + 36000, delays, waits.append)]
    assert hours([("UNAVAILABLE", 3), ("status UNAVAILABLE", 1), ("RESOURCE_EXHAUSTED", 0), ("UNAVAILABLE", 4)]) == list(range(10)) and waits == [2, 5, 10, 2]
    few = {"UNAVAILABLE": [1], "RESOURCE_EXHAUSTED": [7]}
    waits.clear()
    assert hours([("UNAVAILABLE", 2), ("RESOURCE_EXHAUSTED", 1), ("UNAVAILABLE", 3)], few) == list(range(10)) and waits == [1, 7, 1]
    for script in ([("UNAVAILABLE", 2), ("UNAVAILABLE", 1)], [("INTERNAL", 0)]):
        with pytest.raises(ingest.GaveUp):
            hours(script, few)


def test_a_stream_of_an_api_goes_on_where_it_stopped(spark, tmp_path):
    start = 1_704_067_200
    out = str(tmp_path / "out")
    for hours in (7, 7, 30):  # the time of each run; the second has nothing new
        spark.dataSource.register(ingest.source("breaking_candles", _breaking(str(tmp_path)), lambda hours=hours: start + hours * 3600 + 59))
        stream = spark.readStream.format("breaking_candles").options(instruments=json.dumps(["a", "b"]), start=start, step=3600, days=0.5, delays=json.dumps({"UNAVAILABLE": [0, 0]})).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        rows = spark.read.parquet(out)
        assert rows.count() == 2 * hours == rows.select("instrument", "ts").distinct().count()


def _breaking(folder):
    def fetch(instrument, start, end):
        import os
        from datetime import datetime

        for t in range(-(-start // 3600) * 3600, min(end, start + 3 * 3600 + 1), 3600):
            flag = f"{folder}/{instrument}-{t}"
            if t // 3600 % 24 == 5 and not os.path.exists(flag):
                open(flag, "w").close()
                raise ConnectionError("gone")
            yield (instrument, datetime.fromtimestamp(t), 1.0, 1.0, 1.0, float(t // 3600 % 24), 1)

    return fetch


def test_orders_that_no_fill_closes_are_stuck_once(spark, tmp_path):
    rows = spark.createDataFrame([("x", "order"), ("y", "order"), ("y", "fill")], "order_id string, type string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    watched = live.watch_orders(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), seconds=1)
    q = watched.writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    end = time.time() + 90
    while time.time() < end and not spark.table("watched").count():
        time.sleep(1)
    time.sleep(3)
    q.stop()
    assert [tuple(r) for r in spark.table("watched").collect()] == [("x", "stuck")]


def test_series_replaced_in_a_universe(spark):
    rows = [(n, tf, START + timedelta(hours=h), 1.0) for n in "ab" for tf in ("1h", "15min") for h in range(3)]
    universe = spark.createDataFrame(rows, f"{KEY} string, timeframe string, ts timestamp, close double")
    new = spark.createDataFrame([("a", START, 9.0)], f"{KEY} string, ts timestamp, close double")
    got = sorted((r[KEY], r.timeframe, r.close) for r in candles.replace_series(universe, new, "a", "1h").collect())
    assert got == sorted([("a", "15min", 1.0)] * 3 + [("b", "15min", 1.0)] * 3 + [("b", "1h", 1.0)] * 3 + [("a", "1h", 9.0)])


def test_data_for_charts_and_diagnostics(spark):
    import pandas as pd

    rows = [("a", START + timedelta(days=i), 10.0 + i, 11.0 + i, (1, 0, -1)[i % 3], i % 2, 100.0 - (i % 4)) for i in range(12)]
    path = spark.createDataFrame(rows, f"{KEY} string, ts timestamp_ntz, open double, close double, qty int, position int, equity double")
    got = [r.asDict() for r in store.chart_data(path).orderBy("ts").collect()]
    top = 0.0
    for r, (_, _, o, _, q, _, e) in zip(got, rows, strict=True):
        top = max(top, e)
        assert (r["bought"], r["sold"], r["drawdown"]) == (o if q > 0 else None, o if q < 0 else None, e - top)
    seen = store.diagnostics(path, 0.3, 5.0, "2024-01-08", "2024-01-11", warmup_days=3).orderBy("ts").collect()
    close = pd.Series([r[3] for r in rows if datetime(2024, 1, 5) <= r[1] < datetime(2024, 1, 11)])
    trend = close.ewm(alpha=0.3).mean().tolist()[-3:]
    assert len(seen) == 3 and all(r.trend == pytest.approx(t) and r.lower == pytest.approx(0.95 * t) and r.upper == pytest.approx(1.05 * t) and r.dev_pct == pytest.approx((c / t - 1) * 100) for r, t, c in zip(seen, trend, close.tolist()[-3:], strict=True))


def test_columns_without_values(spark):
    from tidebar.operators import screening

    df = spark.createDataFrame([(1, None, None), (2, "x", None)], "a int, b string, c double")
    assert screening.null_columns(df) == ["c"] and screening.null_columns(df.limit(0)) == ["a", "b", "c"]


def test_universe_in_one_scan(spark, tmp_path):
    rows = [("x", f"f{n}", tf, START + timedelta(hours=h), 1.0, 1.0, 1.0, float(h), 1) for n in range(3) for tf in ("1h", "15min", "1day") for h in range(40)]
    df = spark.createDataFrame(rows, store.CANDLE)
    store.write_candles(df, str(tmp_path / "c"))
    start, end = START + timedelta(hours=2), START + timedelta(hours=30)
    assets = {"A": "f0", "B": "f1"}
    got = store.load_universe(spark, str(tmp_path / "c"), assets, ["1h", "15min"], start, end)
    assert sorted((r[KEY], r.timeframe, r["count"]) for r in got.groupBy(KEY, "timeframe").count().collect()) == [(n, tf, 29) for n in "AB" for tf in ("15min", "1h")]
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = got._jdf.queryExecution().toString()
    assert plan.count("FileScan parquet") == 1 and all(x in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0] for x in ("instrument", "timeframe", "month"))
    own = df.where("instrument = 'f2' and timeframe = '1h'").withColumn("close", F.lit(-1.0))
    swapped = store.load_universe(spark, str(tmp_path / "c"), assets, ["1h", "15min"], start, end, own, ("A", "1h"))
    assert {(r[KEY], r.timeframe, r.close < 0) for r in swapped.collect()} == {("A", "1h", True), ("A", "15min", False), ("B", "1h", False), ("B", "15min", False)}
    assert swapped.count() == 4 * 29
    for bad in ({"primary": own}, {"primary": own, "primary_key": ("C", "1h")}):
        with pytest.raises(ValueError):
            store.load_universe(spark, str(tmp_path / "c"), assets, ["1h"], start, end, **bad)
