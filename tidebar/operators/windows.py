"""Window operators over a series: changes, rolling statistics, runs, flags, drawdown.

All take a window spec (by default one series by time) and give a Column; columns of one spec share a shuffle and a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidebar.functions.columns import clean, col, divide
from tidebar.operators.candles import KEY, series

S = series


def lag(x, n: int = 1, over=None) -> Column:
    return F.lag(col(x), n).over(over if over is not None else S())


def change(x, n: int = 1, over=None) -> Column:
    return divide(x, lag(x, n, over)) - 1


def difference(x, n: int = 1, over=None) -> Column:
    return col(x) - lag(x, n, over)


def rolling(f, x, n: int, least: int | None = None, over=None) -> Column:
    """f over the last n rows; missing unless at least `least` (all n by default) of them have values."""
    spec = (over if over is not None else S()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(x)).over(spec) >= (n if least is None else least), f(col(x)).over(spec))


def rolling_slope(y, x, n: int, over=None) -> Column:
    """Least-squares slope of y on x over n rows."""
    spec = (over if over is not None else S()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(y)).over(spec) >= n, clean(F.regr_slope(col(y), col(x)).over(spec)))


def so_far(f, x, over=None) -> Column:
    return f(col(x)).over((over if over is not None else S()).rowsBetween(W.unboundedPreceding, 0))


def last_known(x, over=None) -> Column:
    return F.last(col(x), ignorenulls=True).over((over if over is not None else S()).rowsBetween(W.unboundedPreceding, 0))


def run_lengths(df: DataFrame, flag: str, name: str, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Adds how many rows in a row, this one included, have had the flag."""
    over = W.partitionBy(*by).orderBy("ts")
    flagged = df.withColumn("__f", F.coalesce(F.col(flag), F.lit(False)).cast("int")).withColumn("__g", so_far(F.sum, F.lit(1) - F.col("__f"), over))
    group = W.partitionBy(*by, "__g").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return flagged.withColumn(name, F.sum("__f").over(group)).drop("__f", "__g")


def stretches(df: DataFrame, flag: str, start=None, end=None, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """The longest runs of rows with the flag: by, start, end (times of the first and last row) and bars. With start or end, of the rows in
    [start, end) alone, so that runs are cut off at the range's ends. Rows without a known flag end a run."""
    for at, inside in ((start, lambda t: F.col("ts") >= t), (end, lambda t: F.col("ts") < t)):
        if at is not None:
            df = df.where(inside(F.lit(at).cast(df.schema["ts"].dataType)))
    flagged = df.select(*by, "ts", F.coalesce(F.col(flag), F.lit(False)).alias("__f"))
    group = so_far(F.sum, (~F.col("__f")).cast("int"), W.partitionBy(*by).orderBy("ts"))
    return flagged.withColumn("__g", group).where("__f").groupBy(*by, "__g").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("bars")).drop("__g")


def last_of_day(over=None) -> Column:
    """The next row is of another day; so is the final row's."""
    return F.coalesce(F.to_date("ts") != F.lead(F.to_date("ts")).over(over if over is not None else S()), F.lit(True))


def session_end(inside: Column | str, over=None) -> Column:
    """In session now, out of it next; never on the final row."""
    following = F.lead(col(inside)).over(over if over is not None else S())
    return col(inside) & F.coalesce(~following, F.lit(False))


def drawdown(x, initial: Column | float | None = None, over=None) -> Column:
    """x less its running maximum, which starts at initial."""
    top = so_far(F.max, x, over)
    if initial is not None:
        top = F.greatest(top, F.lit(initial) if not isinstance(initial, Column) else initial)
    return col(x) - top
