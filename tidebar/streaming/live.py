"""The same logic over streams: closed candles, the stateful signal step, audit logs.

A candle is closed once the watermark has passed its end, so the last open ones of a stream are not given out."""

from __future__ import annotations

import statistics
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebar.functions.columns import TIMEFRAMES, order_id
from tidebar.operators.candles import KEY

#: As in spec.
DIGITS = 9


def closed_candles(ticks: DataFrame, timeframe: str, late: str = "10 minutes", price: str = "value", instrument: str = "event_type", tie: str = "event_id") -> DataFrame:
    """Candles of a stream of ticks, in append mode; ticks later than `late` are left out."""
    stream = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    order = F.struct("ts", tie)
    bars = stream.groupBy(F.col(instrument).alias(KEY), F.window("ts", TIMEFRAMES[timeframe]).alias("w"))
    out = bars.agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count(F.lit(1)).alias("volume"))
    return out.select(KEY, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def transition(prev: int, up: bool, at_lower: bool, at_upper: bool, gate_open: bool) -> int:
    """The state table for one row: the same as spec.next_signal for columns; a test holds them together."""
    upper = at_upper and not at_lower
    if prev > 0:
        return 0 if not up or upper else 1
    if prev < 0:
        return 0 if up or at_lower else -1
    return 1 if gate_open and at_lower and up else -1 if gate_open and upper and not up else 0


def step(state: tuple, up: bool, at_lower: bool, at_upper: bool, crossed: bool, live: bool, cooldown: int) -> tuple[int, bool, int, bool]:
    """Signal, open gate, bars since the exit and whether the middle was crossed since, after one more bar."""
    signal, open_, since, seen = state
    new = transition(signal, up, at_lower, at_upper, open_) if live else 0
    if signal != 0 and new == 0:
        return new, False, 0, False
    if open_:
        return new, True, 0, False
    since, seen = since + 1, seen or crossed
    return new, since >= cooldown and seen, since, seen


class SignalStep(StatefulProcessor):
    """Signal, gate and intended position of one instrument; a discrepancy halts it for good, and no row comes out after that."""

    def __init__(self, cooldown: int = 4):
        self.cooldown = cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "signal int, open boolean, since int, crossed boolean, halted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        signal, open_, since, crossed, halted = self.state.get() if self.state.exists() else (0, True, 0, False, False)
        out = []
        for b in pd.concat(list(rows)).sort_values("ts").itertuples(index=False):
            halted = halted or bool(b.discrepancy)
            if halted:
                break
            signal, open_, since, crossed = step((signal, open_, since, crossed), b.up, b.at_lower, b.at_upper, b.crossed, b.live, self.cooldown)
            out.append((key[0], b.ts, int(signal)))
        self.state.update((int(signal), bool(open_), int(since), bool(crossed), bool(halted)))
        yield pd.DataFrame(out, columns=[KEY, "ts", "signal"])

    def handleInitialState(self, key, initial: pd.DataFrame, timer_values) -> None:
        r = initial.iloc[0]
        self.state.update((int(r["signal"]), bool(r["open"]), 0, False, False))

    def close(self) -> None:
        pass


def signal_stream(bars: DataFrame, cooldown: int = 4, initial: DataFrame | None = None) -> DataFrame:
    """A row for every bar, traded or not. bars: instrument, ts, up, at_lower, at_upper, crossed, live, discrepancy; initial:
    instrument, signal, open, from a warm-up. Needs the RocksDB state store."""
    grouped = bars.groupBy(KEY)
    return grouped.transformWithStateInPandas(statefulProcessor=SignalStep(cooldown), outputStructType="instrument string, ts timestamp, signal int", outputMode="Append", timeMode="None", initialState=initial.groupBy(KEY) if initial is not None else None)


class CandleSignals(StatefulProcessor):
    """Signals of one instrument from its closed candles: decayed means as recurrences, the last closes as a list, gate and signal as
    in SignalStep. Means and bands are those of the candle before."""

    def __init__(self, cooldown: int = 4, fast: int = 12, slow: int = 48, window: int = 20, width: float = 2.0):
        self.cooldown, self.alphas, self.window, self.width = cooldown, (2 / (fast + 1), 2 / (slow + 1)), window, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "signal int, open boolean, since int, crossed boolean")
        self.means = handle.getValueState("means", "fast double, slow double")
        self.closes = handle.getListState("closes", "close double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else (0, True, 0, False)
        means = list(self.means.get()) if self.means.exists() else []
        closes = [x[0] for x in self.closes.get()] if self.closes.exists() else []
        out = []
        for b in pd.concat(list(rows)).sort_values("ts").itertuples(index=False):
            ready = len(closes) == self.window
            up = bool(means) and round(means[0], DIGITS) > round(means[1], DIGITS)
            lower = upper = crossed = False
            if ready:
                middle, away = statistics.fmean(closes), self.width * statistics.stdev(closes)
                lower, upper = b.close <= round(middle - away, DIGITS), b.close >= round(middle + away, DIGITS)
                crossed = (b.close - round(middle, DIGITS)) * (closes[-1] - round(middle, DIGITS)) < 0
            minute = b.ts.hour * 60 + b.ts.minute
            live = ready and b.ts.weekday() < 5 and 420 <= minute < 940
            state = step(state, up, lower, upper, crossed, live, self.cooldown)
            out.append((key[0], b.ts, live, int(state[0])))
            means = [(1 - a) * m + a * b.close for a, m in zip(self.alphas, means, strict=True)] if means else [b.close, b.close]
            closes = [*closes, b.close][-self.window :]
        self.state.update((int(state[0]), bool(state[1]), int(state[2]), bool(state[3])))
        self.means.update((float(means[0]), float(means[1])))
        self.closes.put([(float(x),) for x in closes])
        yield pd.DataFrame(out, columns=[KEY, "ts", "in_session", "signal"])

    def close(self) -> None:
        pass


def candle_signals(candles: DataFrame, **options) -> DataFrame:
    """A row for every closed candle of a stream: instrument, ts, in_session and signal, as spec.signals has them for a table. Candles
    may be closed_candles() of ticks, in the same stream. Needs the RocksDB state store."""
    rows = candles.select(KEY, "ts", "close")
    return rows.groupBy(KEY).transformWithStateInPandas(statefulProcessor=CandleSignals(**options), outputStructType=f"{KEY} string, ts timestamp, in_session boolean, signal int", outputMode="Append", timeMode="None")


class OrderTimeouts(StatefulProcessor):
    """Orders that no fill has closed after a time are reported as stuck, once."""

    def __init__(self, millis: int = 30_000):
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "sent boolean")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        kinds = set(pd.concat(list(rows))["type"])
        if "fill" in kinds:
            self.state.clear()
        elif "order" in kinds and not self.state.exists():
            self.state.update((True,))
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.millis)
        yield pd.DataFrame({"order_id": [], "status": []}).astype(str)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stuck = self.state.exists()
        self.state.clear()
        yield pd.DataFrame({"order_id": [key[0]] if stuck else [], "status": ["stuck"] if stuck else []}).astype(str)

    def close(self) -> None:
        pass


def watch_orders(events: DataFrame, seconds: int = 30) -> DataFrame:
    return events.groupBy("order_id").transformWithStateInPandas(statefulProcessor=OrderTimeouts(seconds * 1000), outputStructType="order_id string, status string", outputMode="Append", timeMode="ProcessingTime")


class InFlight(StatefulProcessor):
    """What one instrument's orders have still to fill, and for how many bars they have been waiting."""

    def __init__(self, bars: int = 2, tolerance: float = 1e-9):
        self.bars, self.tolerance = bars, tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "order_id string", "remaining double, bars int")
        self.intended = handle.getValueState("intended", "qty double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        open_ = {k[0]: list(v) for k, v in self.open.iterator()}
        intended, out, ended = self.intended.get()[0] if self.intended.exists() else 0.0, [], set()
        for e in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples(index=False):
            if e.type == "order" and e.order_id not in open_:
                intended += e.qty
                open_[e.order_id] = [e.qty, 0]
            elif e.type == "fill" and e.order_id in open_:
                open_[e.order_id][0] -= e.qty
                if abs(open_[e.order_id][0]) <= self.tolerance:
                    ended.add(e.order_id)
                    del open_[e.order_id]
            elif e.type == "order_end" and e.order_id in open_:
                intended -= open_.pop(e.order_id)[0]
                ended.add(e.order_id)
            elif e.type == "candle":
                for name, waiting in open_.items():
                    waiting[1] += 1
                    if waiting[1] == self.bars + 1:
                        out.append((key[0], e.ts, "stuck", name, None, None))
            elif e.type == "position":
                expected = intended - sum(x for x, _ in open_.values())
                if abs(e.qty - expected) > self.tolerance:
                    out.append((key[0], e.ts, "discrepancy", None, expected, e.qty))
        for name in ended:
            self.open.removeKey((name,))
        for name, waiting in open_.items():
            self.open.updateValue((name,), (float(waiting[0]), int(waiting[1])))
        self.intended.update((float(intended),))
        yield pd.DataFrame(out, columns=[KEY, "ts", "what", "order_id", "expected", "held"]).astype({"expected": float, "held": float})

    def close(self) -> None:
        pass


def reconcile_stream(events: DataFrame, bars: int = 2) -> DataFrame:
    """Discrepancies and stuck orders, as instrument, ts, what, order_id, expected and held; both are to halt the instrument.

    events: instrument, ts, type, order_id, qty. A position (what the broker holds) must be what was ordered less what orders in
    flight have still to fill. A fill that leaves nothing or an order_end (cancelled, rejected, failed, timed out) ends an order;
    one that is in flight for more than `bars` candles is stuck. Needs the RocksDB state store."""
    return events.groupBy(KEY).transformWithStateInPandas(statefulProcessor=InFlight(bars), outputStructType=f"{KEY} string, ts timestamp, what string, order_id string, expected double, held double", outputMode="Append", timeMode="None")


def retries(statuses: DataFrame, most: int = 2) -> DataFrame:
    """What follows on rejections: a row for each decision (instrument, bar_ts, target) whose last attempt was rejected, with the
    next attempt and its order id, or failed where there were `most` retries.

    statuses: instrument, bar_ts, target, attempt (from 0), status. A failure of transport keeps the attempt, so its id too."""
    last = statuses.groupBy(KEY, "bar_ts", "target").agg(F.max("attempt").alias("__last"), F.max(F.when(F.col("status") == "rejected", F.col("attempt"))).alias("__rejected"))
    last = last.where("__rejected = __last").withColumn("attempt", F.col("__last") + 1)
    failed = F.col("attempt") > most
    return last.select(KEY, "bar_ts", "target", F.when(~failed, F.col("attempt")).alias("attempt"), F.when(~failed, order_id(KEY, "bar_ts", "target", "attempt")).alias("order_id"), failed.alias("failed"))


def once(orders: DataFrame, late: str = "1 hour") -> DataFrame:
    """Orders with an id made of what they are (and of their attempt, if they have one); one that comes again within the watermark
    is dropped."""
    named = orders.withColumn("order_id", order_id(KEY, "bar_ts", *[c for c in ("target", "signal", "attempt") if c in orders.columns]))
    return named.withWatermark("bar_ts", late).dropDuplicatesWithinWatermark(["order_id"])


def record(path: str):
    """What writes a batch of events to a JSON log: a batch has a folder of its own, named by the query's checkpoint and the batch, so
    that one that runs again after a failure replaces what it had left."""

    def write(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        batch.write.mode("overwrite").json(f"{path}/query={query}/batch={number}")

    return write


def audit(events: DataFrame, path: str, checkpoint: str):
    """Adds a stream of events to a JSON log, each event once; store.read_events reads it."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(record(path))
