"""Performance figures of a strategy's path, of buy and hold, of round trips; profiles by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidebar.functions.columns import correlation, divide
from tidebar.operators import candles, quantiles
from tidebar.operators import windows as win
from tidebar.operators.candles import KEY, series

YEAR = 252**0.5


def _days(first: str, last: str) -> Column:
    seconds = F.unix_seconds(F.col(last).cast("timestamp")) - F.unix_seconds(F.col(first).cast("timestamp"))
    return F.greatest(F.floor(seconds / 86400), F.lit(1))


def strategy(path: DataFrame, initial: float = 100_000.0, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """The 11 figures of each path (rows of strategies.equity): returns are in parts of the largest exposure; n_trades counts fills."""
    order = W.partitionBy(*by).orderBy("ts")
    path = path.select("*", win.last_of_day(order).alias("__last"), win.drawdown("equity", initial, order).alias("__dd"), ((F.col("position") != 0) & (F.lag("position").over(order) == 0)).alias("__entry"))
    # Daily changes stand on the last bar of each day, against that of the day before: one window and one aggregation give all.
    before = F.last(F.when(F.col("__last"), F.col("equity")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    path = path.select("*", F.when(F.col("__last"), F.col("equity") - F.coalesce(before, F.lit(initial))).alias("__r"))
    down = F.when(F.col("__r") < 0, F.col("__r"))
    out = path.groupBy(*by).agg(
        F.min("ts").alias("__t0"), F.max("ts").alias("__t1"), F.max_by("equity", "ts").alias("__end"), F.count(F.lit(1)).alias("__n"),
        F.sum((F.col("qty") != 0).cast("long")).alias("n_trades"), F.sum((F.col("position") != 0).cast("long")).alias("__held"), F.sum(F.coalesce(F.col("__entry"), F.lit(False)).cast("long")).alias("__entries"),
        F.sum(F.abs("qty") * F.col("open")).alias("__turn"), F.sum("fee").alias("__fees"), F.min("__dd").alias("__dd"),
        F.coalesce(F.max(F.when(F.col("qty") != 0, F.abs("position") * F.col("open"))), F.lit(0.0)).alias("__peak"),
        F.avg("__r").alias("__mean"), F.stddev_pop("__r").alias("__std"), F.count(down).alias("__downs"), F.stddev_pop(down).alias("__down"))
    peak, pnl, some = F.col("__peak"), F.col("__end") - F.lit(initial), F.col("__peak") > 0
    grown = 1 + divide(pnl, peak)
    flat = F.col("__std") <= F.abs("__mean") * 1e-12
    ratio = lambda std, ok: F.when(some & ok, divide(F.col("__mean"), std) * YEAR).otherwise(0.0)
    made = {
        "pnl": F.round(pnl, 2),
        "sharpe": F.round(ratio(F.col("__std"), (F.col("__std") > 0) & ~flat), 4),
        "sortino": F.round(ratio(F.col("__down"), (F.col("__downs") > 1) & (F.col("__down") > 0)), 4),
        "max_dd": F.round(F.when(some, divide(F.least(F.col("__dd"), F.lit(0.0)), peak)).otherwise(0.0), 4),
        "cagr": F.round(F.when(some, F.when(grown > 0, F.pow(grown, F.lit(365.0) / _days("__t0", "__t1")) - 1).otherwise(-1.0)).otherwise(0.0), 4),
        "n_trades": F.col("n_trades"),
        "avg_bars_held": F.round(F.coalesce(divide("__held", "__entries"), F.lit(0.0)), 2),
        "pct_bars_in_pos": F.round(divide("__held", "__n") * 100, 2),
        "turnover": F.round("__turn", 2),
        "total_fees": F.round("__fees", 2),
        "peak_exposure": F.round(peak, 2),
    }
    return out.select(*by, *[c.alias(n) for n, c in made.items()])


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """pnl_pct, cagr, sharpe, sortino and max_dd of holding each series; sample deviations, days with bars."""
    ends = bars.groupBy(KEY).agg(F.min("ts").alias("__t0"), F.max("ts").alias("__t1"), F.min_by("close", "ts").alias("__a"), F.max_by("close", "ts").alias("__b"))
    order = W.partitionBy(KEY).orderBy("day")
    days = bars.groupBy(KEY, F.to_date("ts").alias("day")).agg(F.max_by("close", "ts").alias("close"))
    days = days.select(KEY, (divide("close", F.lag("close").over(order)) - 1).alias("__r"), (divide("close", F.max("close").over(order)) - 1).alias("__dd"))
    down = F.when(F.col("__r") < 0, F.col("__r"))
    days = days.groupBy(KEY).agg(F.avg("__r").alias("__m"), F.stddev_samp("__r").alias("__s"), F.avg(down).alias("__dm"), F.stddev_samp(down).alias("__ds"), F.min("__dd").alias("__dd"))
    ratio = lambda m, s: F.coalesce(divide(m, s) * YEAR, F.lit(0.0))
    grown = divide("__b", "__a")
    return ends.join(days, KEY).select(KEY, F.round((grown - 1) * 100, 4).alias("pnl_pct"), F.round(F.pow(grown, F.lit(365.0) / _days("__t0", "__t1")) - 1, 4).alias("cagr"), F.round(ratio("__m", "__s"), 4).alias("sharpe"), F.round(ratio("__dm", "__ds"), 4).alias("sortino"), F.round("__dd", 4).alias("max_dd"))


def daily_equity(path: DataFrame) -> DataFrame:
    """Last equity of every calendar day, carried over days without bars."""
    days = path.groupBy(KEY, F.to_date("ts").alias("day")).agg(F.max_by("equity", "ts").alias("equity"))
    return candles.fill_days(days, ["equity"])


def chart_stats(path: DataFrame) -> DataFrame:
    """Second set of figures, by calendar days, sample deviations and the first equity row: ret_pct, profit_factor (null without losses), sharpe, sortino, max_dd."""
    order = W.partitionBy(KEY).orderBy("day")
    peak = path.groupBy(KEY).agg(F.max(F.when(F.col("qty") != 0, F.abs("position") * F.col("open"))).alias("__peak"), F.min_by("equity", "ts").alias("__a"), F.max_by("equity", "ts").alias("__b"))
    fall = path.select(KEY, win.drawdown("equity").alias("__dd")).groupBy(KEY).agg(F.min("__dd").alias("__dd"))
    daily = daily_equity(path).select(KEY, (F.col("equity") - F.lag("equity").over(order)).alias("__d")).join(peak, KEY).withColumn("__r", divide("__d", "__peak"))
    up, down = F.when(F.col("__r") > 0, F.col("__r")), F.when(F.col("__r") < 0, F.col("__r"))
    daily = daily.groupBy(KEY).agg(F.avg("__r").alias("__m"), F.stddev_samp("__r").alias("__s"), F.avg(down).alias("__dm"), F.stddev_samp(down).alias("__ds"), F.sum(up).alias("__up"), F.sum(down).alias("__down"))
    out = peak.join(daily, KEY).join(fall, KEY)
    ratio = lambda m, s: F.round(F.coalesce(divide(m, s) * YEAR, F.lit(0.0)), 4)
    return out.select(KEY, F.round(F.coalesce(divide(F.col("__b") - F.col("__a"), "__peak") * 100, F.lit(0.0)), 4).alias("ret_pct"), F.round(divide("__up", F.abs("__down")), 4).alias("profit_factor"), ratio("__m", "__s").alias("sharpe"), ratio("__dm", "__ds").alias("sortino"), F.round(F.coalesce(divide("__dd", "__peak"), F.lit(0.0)), 4).alias("max_dd"))


def round_trips(filled: DataFrame, path: DataFrame, decided: tuple[str, ...] = (), known: tuple[str, ...] = (), zone: str = "Europe/Moscow", train_end: str | None = None) -> DataFrame:
    """Entry and exit of each closed position: holding time, profit, fees, hours, and the path's columns at both ends.

    Columns of the path (by instrument and i) in `decided` are those of the bar before a fill, which decided it; `known` ones are
    those of the fill's bar. They get the ends _in and _out. local_hour is the entry's hour in the zone; oos, with train_end,
    whether it came after the training."""
    order = W.partitionBy(KEY).orderBy("i")
    pairs = filled.select(KEY, F.col("i").alias("i_in"), F.col("ts").alias("ts_in"), F.col("qty").alias("side"), "price", "fee", F.row_number().over(order).alias("__n"), *[F.lead(c).over(order).alias(f"__{c}") for c in ("i", "ts", "price", "fee", "qty")])
    pairs = pairs.where("__n % 2 = 1 and __i is not null")
    gross, fees = F.col("side") * (F.col("__price") - F.col("price")), F.col("fee") + F.col("__fee")
    extra = [] if train_end is None else [(F.col("ts_in") > F.lit(train_end).cast("timestamp_ntz")).alias("oos")]
    out = pairs.select(KEY, "i_in", F.col("__i").alias("i_out"), "ts_in", F.col("__ts").alias("ts_out"), "side", F.hour("ts_in").alias("hour"), F.hour(F.from_utc_timestamp("ts_in", zone)).alias("local_hour"), (F.col("__i") - F.col("i_in")).alias("bars_held"), gross.alias("gross_pnl"), fees.alias("fees"), (gross - fees).alias("net_pnl"), *extra)
    for columns, back in ((decided, 1), (known, 0)):
        for end in ("in", "out") if columns else ():
            own = path.select(F.col(KEY).alias("__k"), (F.col("i") + back).alias("__at"), *[F.col(c).alias(f"{c}_{end}") for c in columns])
            out = out.join(own, (F.col(KEY) == F.col("__k")) & (F.col(f"i_{end}") == F.col("__at")), "left").drop("__k", "__at")
    return out.drop("i_in", "i_out")


def profile(trips: DataFrame, key: Column, name: str) -> DataFrame:
    """Number, mean, sum and share of wins of net_pnl by group."""
    return trips.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("net_pnl"), 4).alias("mean"), F.round(F.sum("net_pnl"), 4).alias("total"), F.round(F.avg((F.col("net_pnl") > 0).cast("double")), 4).alias("win_rate"))


def quartiles(df: DataFrame, x: str, name: str = "bucket") -> DataFrame:
    """Adds the quartile of x with its ends: right-closed, the lowest value included, equal edges merged. The edges are one row, by
    exact selection."""
    edges = quantiles.quantiles(df, x, (0.0, 0.25, 0.5, 0.75, 1.0)).agg(F.array_sort(F.collect_set("value")).alias("__e"))
    out = df.crossJoin(F.broadcast(edges))
    place = F.greatest(F.lit(1), F.size(F.filter("__e", lambda e: e < F.col(x))))
    out = out.withColumn(name, F.when(F.col(x).isNotNull(), place))
    return out.select(*df.columns, name, F.get("__e", F.col(name) - 1).alias(f"{name}_lo"), F.get("__e", F.col(name)).alias(f"{name}_hi"))


def correlations(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Pearson correlation of each column with the target over rows that have both: one aggregation, one row a column."""
    made = df.agg(*[correlation(c, target).alias(c) for c in columns])
    return made.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.col(c), 6).alias("corr")) for c in columns])))
