"""Candles from an API that gives them in order and breaks: rows once each, retries by status, a stream with offsets.

fetch(instrument, from, to) iterates over rows (instrument, ts, open, high, low, close, volume) from a time on (epoch seconds,
included) up to another (left out); it may give all of them or a page, and may fail at any row with an error that names a status."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "instrument string, ts timestamp, open double, high double, low double, close double, volume bigint"
DAY = 86_400

# Seconds to wait before each retry, by the status that an error names.
DELAYS = {"RESOURCE_EXHAUSTED": [10, 30, 60, 120], "UNAVAILABLE": [2, 5, 15, 30]}


class GaveUp(RuntimeError):
    """A status outlasted its retries, or an error named none."""


def status_of(error: Exception, delays: dict[str, Sequence[float]]) -> str | None:
    """A failed connection counts as UNAVAILABLE."""
    named = next((s for s in delays if s in str(error)), None)
    return named or ("UNAVAILABLE" if isinstance(error, ConnectionError) and "UNAVAILABLE" in delays else None)


def rows(fetch: Callable, instrument: str, start: int, end: int, delays: dict[str, Sequence[float]] = DELAYS, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """Each row of [start, end) once, in order, over pages and failures.

    After a failure the API is asked again from the last row on, and what it repeats is skipped. Each status has retries of its own;
    all are whole again once a row has come since the last failure. It ends when a page has nothing new."""
    last, used, came = None, dict.fromkeys(delays, 0), False
    while True:
        new = False
        try:
            for row in fetch(instrument, start if last is None else int(last), end):
                at = row[1].timestamp()
                if (last is None or at > last) and start <= at < end:
                    last, new, came = at, True, True
                    yield row
        except Exception as error:
            status = status_of(error, delays)
            if status is None:
                raise GaveUp(f"{instrument}: {error}") from error
            if came:
                used, came = dict.fromkeys(delays, 0), False
            if used[status] >= len(delays[status]):
                raise GaveUp(f"{instrument}: {status} after {len(delays[status])} retries, at {last}") from error
            used[status] += 1
            sleep(delays[status][used[status] - 1])
            continue
        if not new:
            return


class Span(InputPartition):
    def __init__(self, instrument: str, start: int, end: int):
        self.instrument, self.start, self.end = instrument, start, end


def spans(options: dict, start: int, end: int) -> list[Span]:
    """A partition for each instrument and each `days` of [start, end)."""
    step = int(float(options.get("days", "7")) * DAY)
    return [Span(i, a, min(a + step, end)) for i in json.loads(options["instruments"]) for a in range(start, end, step)]


def _read(options: dict, fetch: Callable, span: Span) -> Iterator[tuple]:
    delays = json.loads(options["delays"]) if "delays" in options else DELAYS
    return rows(fetch, span.instrument, span.start, span.end, delays)


class Batch(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable):
        self.options, self.fetch = options, fetch

    def partitions(self) -> list[Span]:
        return spans(self.options, int(self.options["start"]), int(self.options["end"]))

    def read(self, span: Span) -> Iterator[tuple]:
        return _read(self.options, self.fetch, span)


class Stream(DataSourceStreamReader):
    """Offsets are times: a batch is what lies between the last one's and the latest whole `step` seconds, at most `end`. Spark writes
    a batch's offsets before it runs and commits them after, so one that broke is read again in full, and no other is."""

    def __init__(self, options: dict, fetch: Callable, clock: Callable[[], float] = time.time):
        self.options, self.fetch, self.clock = options, fetch, clock

    def initialOffset(self) -> dict:
        return {"at": int(self.options["start"])}

    def latestOffset(self) -> dict:
        step, start = int(self.options.get("step", "60")), int(self.options["start"])
        now = start + max(0, int(self.clock()) - start) // step * step
        return {"at": min(now, int(self.options.get("end", now)))}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return spans(self.options, start["at"], end["at"])

    def read(self, span: Span) -> Iterator[tuple]:
        return _read(self.options, self.fetch, span)


def source(name_: str, fetch: Callable, clock: Callable[[], float] = time.time) -> type[DataSource]:
    """A Spark data source, for tables and streams. Options: instruments (JSON), start, end (epoch seconds; a stream may go without an end),
    days (of a partition), step (of a stream's offsets), delays (JSON, by status)."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Batch(self.options, fetch)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Stream(self.options, fetch, clock)

    return Source
