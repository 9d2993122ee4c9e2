"""Parameter grids: one backtest for each combination, as rows rather than loops.

Indicators depend on few of the parameters, so they are computed once for each value of those; the other parameters are joined
to the decisions as a small literal list, and every (series, combination) is folded by itself."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidebar.functions.columns import divide, in_hours, in_minutes, true
from tidebar.operators import ewm, stats, strategies
from tidebar.operators import windows as win
from tidebar.operators.candles import KEY

PARAMS = ["alpha", "z_entry", "max_hold"]
QUIET = ["trend_alpha", "max_slope_pct", "vol_ratio_max", "entry_pct", "exit_pct", "min_quiet_bars", "time_stop_bars"]


def each(df: DataFrame, **lists: list) -> DataFrame:
    """A row for every combination of the lists' values."""
    for name, values in lists.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return df


def _paths(bars: DataFrame, filled: DataFrame, lists: dict[str, list], fee_rate: float, cash: float) -> DataFrame:
    """Every bar of every (series, combination) with qty, fee, position and equity."""
    by = [KEY, *lists]
    frame = each(strategies.numbered(bars).select(KEY, "i", "ts", "open", "close"), **lists)
    path = frame.join(filled, [*by, "i"], "left").fillna(0, subset=["qty"]).withColumn("fee", F.abs("qty") * F.col("open") * F.lit(fee_rate))
    order = W.partitionBy(*by).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    path = path.withColumn("position", F.sum("qty").over(order))
    return path.withColumn("equity", F.lit(cash) - F.sum(F.col("qty") * F.col("open") + F.col("fee")).over(order) + F.col("position") * F.col("close"))


def combinations(**lists: list) -> list[dict]:
    return [dict(zip(lists, values, strict=True)) for values in product(*lists.values())]


def z_grid_path(bars: DataFrame, alphas: list[float], entries: list[float], holds: list[int], session=(420, 945), fee_rate: float = strategies.FEE, cash: float = strategies.CASH) -> DataFrame:
    """The path of every (series, combination)."""
    decided = None
    for a in sorted(set(alphas)):
        df = strategies.z_indicator(bars, a).withColumn("__in", in_minutes(*session))
        df = df.select("*", (F.col("__z").isNull() | win.last_of_day() | win.session_end("__in")).alias("__flat"))
        df = df.select(KEY, "i", F.lit(a).alias("alpha"), F.coalesce(win.lag("__flat"), F.lit(True)).alias("force0"), true(win.lag("__z") >= 0).alias("exit_long"), true(win.lag("__z") <= 0).alias("exit_short"), F.when(win.lag("__in"), win.lag("__z")).alias("__z"))
        decided = df if decided is None else decided.unionByName(df)
    tried = each(decided, z_entry=[float(x) for x in entries], max_hold=[int(x) for x in holds])
    entry = F.when(true(F.col("__z") <= -F.col("z_entry")), 1).when(true(F.col("__z") >= F.col("z_entry")), -1).otherwise(0)
    by = [KEY, *PARAMS]
    filled = strategies.fold(tried.select(*by, "i", "force0", "exit_long", "exit_short", entry.alias("entry")), by)
    return _paths(bars, filled, {"alpha": sorted(set(alphas)), "z_entry": [float(x) for x in entries], "max_hold": [int(x) for x in holds]}, fee_rate, cash)


def z_grid(bars: DataFrame, alphas: list[float], entries: list[float], holds: list[int], **options) -> DataFrame:
    """Parameters and figures of every (series, combination)."""
    return stats.strategy(z_grid_path(bars, alphas, entries, holds, **options), by=(KEY, *PARAMS))


def quiet_grid(bars: DataFrame, lists: dict[str, list], predictions: bool = False, slope_window=15, vol_alpha=0.05, vol_window=240, session=(9, 16), size=1, pred_long=1.002, pred_short=0.998, fee_rate: float = strategies.FEE, cash: float = strategies.CASH) -> DataFrame:
    """Parameters and figures of reversion in quiet markets for every combination of the values of QUIET; the rest is fixed.

    With predictions, bars have `pred`, which gates entries. Means are computed once a trend_alpha, runs of quiet bars once for
    each set of the three parameters that make them; the other four are joined to what they have left."""
    lists = {n: [int(x) if n in ("min_quiet_bars", "time_stop_bars") else float(x) for x in lists[n]] for n in QUIET}
    volume = F.col("volume").cast("double")
    shared = ewm.means(strategies.numbered(bars), vol_alpha, True, __fast=volume)
    shared = shared.withColumn("__avg", win.rolling(F.avg, volume, vol_window)).withColumn("__in", in_hours(*session))
    made = None
    for a in sorted(set(lists["trend_alpha"])):
        df = ewm.means(shared, a, True, __trend="close")
        dev, slope = (divide("close", "__trend") - 1) * 100, F.abs(divide("__trend", win.lag("__trend", slope_window)) - 1) * 100
        df = df.select(KEY, "i", "ts", F.lit(a).alias("trend_alpha"), F.round(dev, strategies.DIGITS).alias("__dev"), F.round(slope, strategies.DIGITS).alias("__slope"), F.round("__fast", strategies.DIGITS).alias("__fast"), "__avg", "__in", *(["pred"] if predictions else []))
        made = df if made is None else made.unionByName(df)
    first = QUIET[:3]
    df = each(made, **{n: lists[n] for n in first[1:]})
    quiet = (F.col("__slope") < F.col("max_slope_pct")) & (F.col("__fast") < F.round(F.col("vol_ratio_max") * F.col("__avg"), strategies.DIGITS))
    df = win.run_lengths(df.withColumn("__quiet", true(quiet)), "__quiet", "__run", (KEY, *first))
    over = W.partitionBy(KEY, *first).orderBy("ts")
    df = df.withColumn("__flat", F.col("__dev").isNull() | win.last_of_day(over) | win.session_end("__in", over))
    before = {n: win.lag(f"__{n}", 1, over).alias(f"__{n}0") for n in ("flat", "dev", "run", "in")}
    df = each(df.select(KEY, "i", *first, *before.values(), *(["pred"] if predictions else [])), **{n: lists[n] for n in QUIET[3:]})
    calm = F.col("__in0") & (F.col("__run0") >= F.col("min_quiet_bars"))
    long, short = calm & (F.col("__dev0") <= -F.col("entry_pct")), calm & (F.col("__dev0") >= F.col("entry_pct"))
    if predictions:
        long, short = long & (F.col("pred") > pred_long), short & (F.col("pred") < pred_short)
    entry = F.when(true(long), size).when(true(short), -size).otherwise(0)
    by = [KEY, *QUIET]
    decided = df.select(*by, "i", F.coalesce("__flat0", F.lit(True)).alias("force0"), true(F.col("__dev0") >= -F.col("exit_pct")).alias("exit_long"), true(F.col("__dev0") <= F.col("exit_pct")).alias("exit_short"), entry.alias("entry"), F.col("time_stop_bars").alias("max_hold"))
    return stats.strategy(_paths(bars, strategies.fold(decided, by), lists, fee_rate, cash), by=tuple(by))


def best(results: DataFrame, n: int = 1, params: list[str] | None = None) -> DataFrame:
    """The first rows by sortino; ties by parameters."""
    return results.orderBy(F.desc("sortino"), KEY, *(PARAMS if params is None else params)).limit(n)
