"""Candles: resampling, merging, gaps, ranges, daily spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidebar.functions.columns import SECONDS, TIMEFRAMES

KEY = "instrument"


def series(*by: str) -> W:
    return W.partitionBy(*(by or (KEY,))).orderBy("ts")


def resample(ticks: DataFrame, timeframe: str, price: str = "value", instrument: str = "event_type", tie: Column | None = None) -> DataFrame:
    """Open, high, low, close and number of ticks of each bar; bars are labelled by their start, which they include.

    The aggregation is partial before its one shuffle. tie orders ticks of equal time."""
    tie = F.col("event_id") if tie is None else tie
    order = F.struct("ts", tie)
    bars = ticks.groupBy(F.col(instrument).alias(KEY), F.window("ts", TIMEFRAMES[timeframe]).alias("w"))
    out = bars.agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count(F.lit(1)).alias("volume"))
    return out.select(KEY, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def upscale(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars of a longer timeframe from shorter ones."""
    out = bars.groupBy(KEY, F.window("ts", TIMEFRAMES[timeframe]).alias("w")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.select(KEY, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def merge(cached: DataFrame, fresh: DataFrame, prefer: str = "cached", by: tuple[str, ...] = (KEY, "ts")) -> DataFrame:
    """Union of both, one row a key; the preferred side wins."""
    first = 0 if prefer == "cached" else 1
    both = cached.withColumn("__side", F.lit(first)).unionByName(fresh.withColumn("__side", F.lit(1 - first)))
    order = W.partitionBy(*by).orderBy("__side")
    return both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__side", "__n")


def between(bars: DataFrame, start, end) -> DataFrame:
    """Both ends included."""
    return bars.where(F.col("ts").between(F.lit(start), F.lit(end)))


def missing_ranges(bars: DataFrame, start: str, end: str) -> DataFrame:
    """What to fetch for [start, end], by what a series' first and last bars cover; holes inside don't show."""
    ends = bars.groupBy(KEY).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    before = F.when(a < F.col("first"), F.struct(a.alias("from_ts"), F.least("first", b).alias("to_ts")))
    after = F.when(b > F.col("last"), F.struct(F.greatest("last", a).alias("from_ts"), b.alias("to_ts")))
    return ends.select(KEY, F.explode(F.array_compact(F.array(before, after))).alias("r")).select(KEY, "r.*")


def gaps(bars: DataFrame, timeframe: str) -> DataFrame:
    """Holes inside a series: the bars around each, and how many are missing."""
    step = SECONDS[timeframe]
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    out = bars.select(KEY, F.lag("ts").over(series()).alias("after_ts"), F.col("ts").alias("before_ts"))
    out = out.where("after_ts is not null").withColumn("missing", ((seconds("before_ts") - seconds("after_ts")) / step - 1).cast("long"))
    return out.where("missing > 0")


def replace_series(universe: DataFrame, primary: DataFrame, instrument: str, timeframe: str) -> DataFrame:
    """The universe with one of its series replaced."""
    rest = universe.where(~((F.col(KEY) == instrument) & (F.col("timeframe") == timeframe)))
    return rest.unionByName(primary.withColumn("timeframe", F.lit(timeframe)), allowMissingColumns=True)


def daily_close(bars: DataFrame) -> DataFrame:
    """Last close and volume of every calendar day from first to last, closes carried over days without bars."""
    days = bars.groupBy(KEY, F.to_date("ts").alias("day")).agg(F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return fill_days(days, ["close"]).withColumn("volume", F.coalesce("volume", F.lit(0)))


def fill_days(days: DataFrame, carried: list[str], by: str = KEY) -> DataFrame:
    """A row for each day of each series; carried columns keep their last value."""
    spine = days.groupBy(by).agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    order = W.partitionBy(by).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    out = spine.join(days, [by, "day"], "left")
    return out.select(by, "day", *[F.last(c, ignorenulls=True).over(order).alias(c) if c in carried else F.col(c) for c in days.columns if c not in (by, "day")])
