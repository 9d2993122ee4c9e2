"""As-of joins by union: rows of both sides are sorted once by time, and each probe takes the last source row before it.

One shuffle, no range join, and nothing is broadcast. Bar starts and bar ends are separate functions: what a longer bar says is
known at its end only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidebar.functions.columns import SECONDS
from tidebar.operators.candles import KEY


def backward(probe: DataFrame, source: DataFrame, columns: list[str], by: list[str] | None = None, strict: bool = False, at: str | None = None) -> DataFrame:
    """Adds the columns of the last source row at or before (strict: before) each probe row; at names its time."""
    by = [KEY] if by is None else by
    side = 1 if strict else 0  # at equal times a source row comes first, unless strict
    named = [f"__c_{c}" for c in columns]
    source = source.select(*by, "ts", F.lit(side).alias("__side"), F.struct(F.col("ts").alias("__at"), *[F.col(c).alias(n) for c, n in zip(columns, named, strict=True)]).alias("__s"))
    left = probe.select(*by, "ts", F.lit(1 - side).alias("__side"), F.struct(*probe.columns).alias("__p"))
    both = left.unionByName(source, allowMissingColumns=True)
    order = W.partitionBy(*by).orderBy("ts", "__side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("__s", F.last("__s", ignorenulls=True).over(order)).where("__p is not null")
    return found.select("__p.*", *[F.col(f"__s.{n}").alias(c) for c, n in zip(columns, named, strict=True)], *([F.col("__s.__at").alias(at)] if at else []))


def backward_all(probe: DataFrame, sources: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Adds, for each named source, the columns of its last row at or before each probe row, and name_ts, its time.

    All sources are sorted with the probe once, day by day: each day starts with what every source had before it, so days are
    apart and no group holds a whole table. The carried values are one row a day and source."""
    names = list(sources)
    structs = {n: F.struct(F.col("ts").alias("__at"), *[F.col(c) for c in columns]) for n, (_, columns) in sources.items()}
    day = F.to_date("ts")
    both = probe.select(day.alias("__day"), "ts", F.lit(2).alias("__side"), F.struct(*probe.columns).alias("__p"))
    days, lasts = probe.select(day.alias("__day")), None
    for n, (df, _) in sources.items():
        both = both.unionByName(df.select(day.alias("__day"), "ts", F.lit(1).alias("__side"), structs[n].alias(f"__s_{n}")), allowMissingColumns=True)
        own = df.groupBy(day.alias("__day")).agg(F.max_by(structs[n], "ts").alias(f"__s_{n}"))
        lasts = own if lasts is None else lasts.unionByName(own, allowMissingColumns=True)
    if lasts is None:
        return probe
    merged = lasts.groupBy("__day").agg(*[F.first(f"__s_{n}", ignorenulls=True).alias(f"__s_{n}") for n in names])
    merged = days.distinct().join(merged, "__day", "full")
    before = W.orderBy("__day").rowsBetween(W.unboundedPreceding, -1)
    carried = merged.select("__day", F.col("__day").cast(probe.schema["ts"].dataType).alias("ts"), F.lit(0).alias("__side"), *[F.last(f"__s_{n}", ignorenulls=True).over(before).alias(f"__s_{n}") for n in names])
    both = both.unionByName(carried, allowMissingColumns=True)
    order = W.partitionBy("__day").orderBy("ts", "__side").rowsBetween(W.unboundedPreceding, 0)
    found = both.select("__p", *[F.last(f"__s_{n}", ignorenulls=True).over(order).alias(f"__s_{n}") for n in names]).where("__p is not null")
    return found.select("__p.*", *[x for n in names for x in (*[F.col(f"__s_{n}.{c}").alias(c) for c in sources[n][1]], F.col(f"__s_{n}.__at").alias(f"{n}_ts"))])


def shifted(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars labelled by their end."""
    return bars.withColumn("ts", F.col("ts") + F.expr(f"interval {SECONDS[timeframe]} seconds"))


def on_bar_end(probe: DataFrame, bars: DataFrame, timeframe: str, columns: list[str], by: list[str] | None = None, at: str | None = None) -> DataFrame:
    """The last bar of another timeframe that had ended when the probe's bar began."""
    return backward(probe, shifted(bars, timeframe), columns, by, at=at)


def on_bar_start(probe: DataFrame, rows: DataFrame, columns: list[str], fill: float | None = None, by: list[str] | None = None) -> DataFrame:
    """The last row that had begun; for what was known before its bar, such as predictions. fill replaces missing values."""
    out = backward(probe, rows, columns, by)
    return out if fill is None else out.fillna(fill, subset=columns)


def exact(probe: DataFrame, rows: DataFrame, column: str, fill: float | None = None) -> DataFrame:
    """Values of the same instrument and time, else fill."""
    out = probe.join(rows.select(KEY, "ts", column), [KEY, "ts"], "left")
    return out if fill is None else out.withColumn(column, F.coalesce(column, F.lit(fill)))
