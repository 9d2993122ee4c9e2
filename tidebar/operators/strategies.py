"""Strategies that depend on their own path, as folds.

What a bar can decide is a column: whether it must be flat, whether a long or short would leave, where an entry would go. Only
position and entry bar are sequential: they are folded over sorted arrays of decisions, one for each stretch between two bars
that force the position flat, in Catalyst. Fills come
out of the fold; positions, cash and equity are running sums over the bars.

Decisions at bar i use bar i - 1 and fill at bar i's open. Bar 0 never trades, an exit bar doesn't enter, and what forces a
position flat on a day's last bar fills at the next day's first open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidebar.functions.columns import divide, in_hours, in_minutes, true
from tidebar.operators import ewm
from tidebar.operators import windows as win
from tidebar.operators.candles import KEY, series

NEVER = 2_000_000_000
FEE = 5e-4
CASH = 100_000.0
DIGITS = 9


def fold(decided: DataFrame, by: list[str]) -> DataFrame:
    """by, i and qty of every fill. decided: by, i, force0, exit_long, exit_short, entry (signed size) and max_hold.

    A bar that forces the position flat starts a block, which depends on nothing before it; it also ends the block before, where
    its fill comes from. Strategies here force that at least once a day, so a block is at most a day of one series."""
    bar = F.struct("i", "force0", "exit_long", "exit_short", "entry", "max_hold")
    order = W.partitionBy(*by).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    block = F.sum(F.col("force0").cast("long")).over(order)
    both = F.when(F.col("force0"), F.array(F.col("__b") - 1, F.col("__b"))).otherwise(F.array("__b"))
    blocks = decided.withColumn("__b", block).withColumn("__b", F.explode(both))
    bars = blocks.groupBy(*by, "__b").agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("since"), F.expr("cast(array() as array<struct<i:int,qty:int>>)").alias("fills"))

    def step(s: Column, b: Column) -> Column:
        leave = ((s["pos"] > 0) & b["exit_long"]) | ((s["pos"] < 0) & b["exit_short"]) | (b["i"] - s["since"] >= b["max_hold"])
        want = F.when(b["force0"], 0).when(s["pos"] != 0, F.when(leave, 0).otherwise(s["pos"])).otherwise(b["entry"])
        fill = F.struct(b["i"].alias("i"), (want - s["pos"]).alias("qty"))
        return F.struct(
            want.alias("pos"),
            F.when((s["pos"] == 0) & (want != 0), b["i"]).otherwise(s["since"]).alias("since"),
            F.when(want != s["pos"], F.array_append(s["fills"], fill)).otherwise(s["fills"]).alias("fills"),
        )

    return bars.select(*by, F.inline(F.aggregate("bars", start, step, lambda s: s["fills"])))


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("i", F.row_number().over(series()) - 1)


def _decided(df: DataFrame, unknown: Column, session: str, exit_long: Column, exit_short: Column, long: Column, short: Column, size: int, max_hold: int | None, keep: list[str]) -> DataFrame:
    """Turns conditions on a bar into what the next bar does. long and short may use `pred`, which is of the filling bar."""
    df = df.select("*", win.last_of_day().alias("__last"), win.session_end(F.col(session)).alias("__end"))
    df = df.select("*", *[x.alias(n) for n, x in {"__flat": unknown | F.col("__last") | F.col("__end"), "__xl": true(exit_long), "__xs": true(exit_short)}.items()])
    before = lambda c: win.lag(c)
    entry = F.when(true(before(F.col(session)) & long), size).when(true(before(F.col(session)) & short), -size).otherwise(0)
    return df.select(*keep, F.coalesce(before("__flat"), F.lit(True)).alias("force0"), true(before("__xl")).alias("exit_long"), true(before("__xs")).alias("exit_short"), entry.cast("int").alias("entry"), F.lit(NEVER if max_hold is None else max_hold).alias("max_hold"))


def quiet(bars: DataFrame, trend_alpha=0.02, max_slope_pct=0.05, slope_window=15, vol_alpha=0.05, vol_window=240, vol_ratio_max=0.9) -> DataFrame:
    """Adds __dev, the deviation from the trend in percent, and __run, for how many bars trend and volume have been quiet."""
    df = ewm.means(numbered(bars), trend_alpha, True, __trend="close")
    df = ewm.means(df, vol_alpha, True, __fast=F.col("volume").cast("double"))
    df = df.withColumn("__dev", F.round((divide("close", "__trend") - 1) * 100, DIGITS)).withColumn("__slope", F.round(F.abs(divide("__trend", win.lag("__trend", slope_window)) - 1) * 100, DIGITS))
    calm = F.col("__fast") < F.round(F.lit(vol_ratio_max) * win.rolling(F.avg, F.col("volume").cast("double"), vol_window), DIGITS)
    df = df.withColumn("__fast", F.round("__fast", DIGITS)).withColumn("__quiet", true((F.col("__slope") < max_slope_pct) & calm))
    return win.run_lengths(df, "__quiet", "__run")


def ewm_quiet(bars: DataFrame, trend_alpha=0.02, entry_pct=0.3, exit_pct=0.05, max_slope_pct=0.05, slope_window=15, vol_alpha=0.05, vol_window=240, vol_ratio_max=0.9, min_quiet_bars=10, time_stop_bars=60, session=(9, 16), size=1, predictions: bool = False, pred_long=1.002, pred_short=0.998) -> DataFrame:
    """Decisions of reversion to a mean in quiet markets; with predictions, bars have `pred`, which gates entries."""
    df = quiet(bars, trend_alpha, max_slope_pct, slope_window, vol_alpha, vol_window, vol_ratio_max).withColumn("__in", in_hours(*session))
    dev, run = win.lag("__dev"), win.lag("__run")
    long, short = (dev <= -entry_pct) & (run >= min_quiet_bars), (dev >= entry_pct) & (run >= min_quiet_bars)
    if predictions:
        long, short = long & (F.col("pred") > pred_long), short & (F.col("pred") < pred_short)
    return _decided(df, F.col("__dev").isNull(), "__in", F.col("__dev") >= -exit_pct, F.col("__dev") <= exit_pct, long, short, size, time_stop_bars, [KEY, "i"])


def z_indicator(bars: DataFrame, alpha: float) -> DataFrame:
    """Adds __sigma and __z, rounded so that engines agree at thresholds: 0/0 is missing, and x/0 beyond every threshold."""
    df = ewm.mean_and_std(numbered(bars), alpha, "close", "__mean", "__sigma")
    away = F.col("close") - F.col("__mean")
    z = F.when(F.col("__sigma") == 0, F.when(F.abs(away) > F.abs(F.col("close")) * 1e-12, F.signum(away) * F.lit(float("inf")))).otherwise(divide(away, "__sigma"))
    return df.withColumn("__z", F.round(z, DIGITS))


def z_score(bars: DataFrame, alpha=0.02, z_entry=2.0, max_hold: int | None = 45, pred_gain=1.0, predictions: bool = False, session=(420, 945), size=1) -> DataFrame:
    """Decisions of reversion by score; with predictions, bars have `pred`, whose expected move shifts the score."""
    df = z_indicator(bars, alpha).withColumn("__in", in_minutes(*session))
    z = win.lag("__z")
    if predictions:
        tilt = F.when(win.lag("__sigma") > 0, divide(F.lit(pred_gain) * (F.col("pred") - 1) * win.lag("close"), win.lag("__sigma"))).otherwise(0.0)
        z = F.round(z - tilt, DIGITS)
    return _decided(df, F.col("__z").isNull(), "__in", F.col("__z") >= 0, F.col("__z") <= 0, z <= -z_entry, z >= z_entry, size, max_hold, [KEY, "i"])


def bounds(bars: DataFrame, max_hold: int | None = None, pred_gain=1.0, predictions: bool = False, session=(420, 945), size=1) -> DataFrame:
    """Decisions of reversion to the middle of volume-weighted bands; bars have vwh and vwl."""
    df = numbered(bars).withColumn("__in", in_minutes(*session)).withColumn("__mid", F.round((F.col("vwh") + F.col("vwl")) / 2, DIGITS))
    shift = F.lit(pred_gain) * (F.col("pred") - 1) * win.lag("close") if predictions else F.lit(0.0)
    low, high = F.round(win.lag("vwl") + shift, DIGITS), F.round(win.lag("vwh") + shift, DIGITS)
    return _decided(df, F.col("__mid").isNull(), "__in", F.col("close") >= F.col("__mid"), F.col("close") <= F.col("__mid"), win.lag("close") <= low, win.lag("close") >= high, size, max_hold, [KEY, "i"])


def vw_bands(bars: DataFrame, alpha: float) -> DataFrame:
    return ewm.weighted(bars, alpha, vwh="high", vwl="low")


def fills(bars: DataFrame, decided: DataFrame, fee_rate: float = FEE) -> DataFrame:
    """instrument, i, ts, qty, price and fee of every fill."""
    out = numbered(bars).select(KEY, "i", "ts", F.col("open").alias("price")).join(fold(decided, [KEY]), [KEY, "i"])
    return out.select(KEY, "i", "ts", "qty", "price", (F.abs("qty") * F.col("price") * F.lit(fee_rate)).alias("fee"))


def equity(bars: DataFrame, filled: DataFrame, cash: float = CASH) -> DataFrame:
    """Every bar with qty, fee, position, cash and equity."""
    return _accounts(numbered(bars).join(filled.select(KEY, "i", "qty", "fee"), [KEY, "i"], "left"), cash)


def path(bars: DataFrame, decided: DataFrame, fee_rate: float = FEE, cash: float = CASH) -> DataFrame:
    """The same from decisions: bars are joined to the fold once. Rows with a qty are the fills, at their bar's open."""
    rows = numbered(bars).join(fold(decided, [KEY]), [KEY, "i"], "left")
    return _accounts(rows.withColumn("fee", F.abs("qty") * F.col("open") * F.lit(fee_rate)), cash)


def _accounts(rows: DataFrame, cash: float) -> DataFrame:
    rows = rows.fillna(0, subset=["qty", "fee"])
    order = W.partitionBy(KEY).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("position", F.sum("qty").over(order)).withColumn("cash", F.lit(cash) - F.sum(F.col("qty") * F.col("open") + F.col("fee")).over(order))
    return rows.withColumn("equity", F.col("cash") + F.col("position") * F.col("close"))
