"""The live layer: signals with a gate, executions with costs, accounting, metrics, event logs and drift.

Sequential parts are folds over blocks that don't depend on each other; everything else is windows and joins. lot_size enters cash and equity alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidebar.functions.columns import divide, is_main_session, true
from tidebar.operators import ewm
from tidebar.operators import windows as win
from tidebar.operators.candles import KEY, series
from tidebar.operators.strategies import NEVER, numbered
from tidebar.operators.tables import written

DIGITS = 9


def next_signal(prev: Column, up: Column, at_lower: Column, at_upper: Column, gate_open: Column) -> Column:
    """The state table. At the lower band is tested first."""
    lower, upper = at_lower, at_upper & ~at_lower
    enter = F.when(gate_open & lower & up, 1).when(gate_open & upper & ~up, -1).otherwise(0)
    return F.when(prev == 0, enter).when(prev > 0, F.when(~up | upper, 0).otherwise(1)).otherwise(F.when(up | lower, 0).otherwise(-1))


def indicators(bars: DataFrame, fast: int = 12, slow: int = 48, window: int = 20, width: float = 2.0) -> DataFrame:
    """Adds up, at_lower, at_upper, crossed and in_session: means and bands are those of the bar before."""
    df = ewm.means(numbered(bars), ewm.span(fast), False, __fast="close")
    df = ewm.means(df, ewm.span(slow), False, __slow="close")
    df = df.select("*", win.rolling(F.avg, "close", window).alias("__mean"), win.rolling(F.stddev_samp, "close", window).alias("__std"))
    near = lambda c: F.round(c, DIGITS)
    df = df.select("*", near(win.lag("__fast")).alias("ema_fast"), near(win.lag("__slow")).alias("ema_slow"), near(win.lag("__mean")).alias("bb_mid"), near(win.lag("__mean") - F.lit(width) * win.lag("__std")).alias("bb_lo"), near(win.lag("__mean") + F.lit(width) * win.lag("__std")).alias("bb_up"))
    crossed = F.signum(F.col("close") - F.col("bb_mid")) * F.signum(win.lag("close") - F.col("bb_mid")) < 0
    return df.select(*bars.columns, "i", true(F.col("ema_fast") > F.col("ema_slow")).alias("up"), true(F.col("close") <= F.col("bb_lo")).alias("at_lower"), true(F.col("close") >= F.col("bb_up")).alias("at_upper"), true(crossed).alias("crossed"), is_main_session().alias("in_session"), F.col("bb_mid").isNotNull().alias("ready"))


def signals(bars: DataFrame, cooldown: int = 4, **options) -> DataFrame:
    """Adds signal to every bar. An exit blocks the gate until `cooldown` bars have passed and the middle was crossed."""
    return gated(indicators(bars, **options), cooldown)


def gated(df: DataFrame, cooldown: int = 4) -> DataFrame:
    """Adds signal to rows of `indicators`, by the state table of `next_signal`.

    For each bar that could enter, windows give the bar it would leave at and the one the gate is open from again. What is left
    to fold is which of these bars are entered: one is for certain if the gate is open by then whichever bars before were
    entered. Such a bar starts a block, so blocks don't depend on each other."""
    live, upper = F.col("in_session") & F.col("ready"), F.col("at_upper") & ~F.col("at_lower")
    # The rows after a bar, nearest last: a frame that grows, where one to the end of the series would be made anew for each row.
    later = W.partitionBy(KEY).orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, -1)
    first = lambda flag, x: F.last(F.when(flag, x), ignorenulls=True).over(later)
    side = F.when(live & F.col("at_lower") & F.col("up"), 1).when(live & upper & ~F.col("up"), -1)
    seen = df.select(KEY, "i", side.alias("side"), (~live | ~F.col("up") | upper).alias("__xl"), (~live | F.col("up") | F.col("at_lower")).alias("__xs"), first(F.col("crossed"), F.col("i")).alias("__c"))
    gone = F.struct("i", (F.greatest(F.col("i") + cooldown, "__c") + F.when(F.col("__c").isNotNull(), 1)).alias("free"))
    gone = F.when(F.col("side") > 0, first(F.col("__xl"), gone)).otherwise(first(F.col("__xs"), gone))
    entries = seen.select(KEY, "i", "side", gone.alias("gone")).where("side is not null").select(KEY, "i", "side", F.col("gone.i").alias("end"), F.coalesce("gone.free", F.lit(NEVER)).alias("free"))
    order = W.partitionBy(KEY).orderBy("i")
    certain = F.col("i") >= F.coalesce(F.max("free").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    entries = entries.withColumn("__b", certain.cast("long")).withColumn("__b", F.sum("__b").over(order.rowsBetween(W.unboundedPreceding, 0)))
    blocks = entries.groupBy(KEY, "__b").agg(F.array_sort(F.collect_list(F.struct("i", "side", "end", "free"))).alias("bars"))
    start = F.struct(F.lit(0).alias("free"), F.expr("cast(array() as array<struct<i:int,signal:int>>)").alias("out"))

    def step(s: Column, b: Column) -> Column:
        held = F.array(F.struct(b["i"].alias("i"), b["side"].alias("signal")), F.struct(b["end"].alias("i"), F.lit(0).alias("signal")))
        taken = F.struct(b["free"].alias("free"), F.concat(s["out"], held).alias("out"))
        return F.when(b["i"] >= s["free"], taken).otherwise(s)

    changes = blocks.select(KEY, F.inline(F.aggregate("bars", start, step, lambda s: s["out"]))).where("i is not null")
    return df.join(changes, [KEY, "i"], "left").withColumn("signal", F.coalesce(win.last_known("signal"), F.lit(0)))


def opening_minutes(minutes: DataFrame, bar: str = "15 minutes", k: int = 5) -> DataFrame:
    """vwap, volume and widest range (in basis points) of the first k one-minute candles of each bar: an equi-join key, no range join."""
    order = W.partitionBy(KEY, "bar_ts").orderBy("ts")
    df = minutes.withColumn("bar_ts", F.window("ts", bar)["start"])
    df = df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return df.groupBy(KEY, F.col("bar_ts").alias("ts")).agg(divide(F.sum(typical * F.col("volume")), F.sum("volume")).alias("vwap"), F.sum("volume").cast("double").alias("volume_k"), F.max(divide(F.col("high") - F.col("low"), "close") * 1e4).alias("range_bps"))


def sigma_daily(bars: DataFrame, days: int = 60) -> DataFrame:
    """instrument, day and the deviation of the last daily returns strictly before it."""
    daily = bars.groupBy(KEY, F.to_date("ts").alias("day")).agg(F.max_by("close", "ts").alias("close"))
    order = W.partitionBy(KEY).orderBy("day")
    daily = daily.withColumn("__r", divide("close", F.lag("close").over(order)) - 1)
    daily = daily.withColumn("__s", win.rolling(F.stddev_samp, "__r", days, over=order))
    return daily.select(KEY, "day", F.lag("__s").over(order).alias("sigma"))


def executions(signalled: DataFrame, minutes: DataFrame, sigma: DataFrame, size: float = 10.0, participation: float = 0.5, min_spread: float = 2.0, spread_ratio: float = 0.1, impact: float = 0.1, commission_bps: float = 5.0, min_commission: float = 0.01, lot_size: float = 1.0, bar: str = "15 minutes") -> DataFrame:
    """Every bar with qty, fill_price, fees, position, cash and equity (from 0). The signal of the bar before is what a bar goes
    for; what its first minutes can't absorb is dropped, so the position is a fold.

    A position never exceeds size, so once bars that go for the same have absorbed size and what they go for, they have it
    wherever they began. The first such bar starts a block; the others after it, and bars that absorb nothing, need no fold."""
    df = signalled.join(opening_minutes(minutes, bar), [KEY, "ts"], "left").withColumn("day", F.to_date("ts")).join(sigma, [KEY, "day"], "left")
    df = df.withColumn("want", F.coalesce(win.lag("signal"), F.lit(0)) * F.lit(size)).withColumn("avail", F.coalesce(F.lit(participation) * F.col("volume_k"), F.lit(0.0)))
    order = W.partitionBy(KEY).orderBy("i")
    up_to = order.rowsBetween(W.unboundedPreceding, 0)
    goals = df.select(KEY, "i", "want", "avail", F.coalesce(F.col("want") != F.lag("want").over(order), F.lit(False)).cast("long").alias("__g"))
    goals = goals.withColumn("__g", F.sum("__g").over(up_to)).withColumn("__a", F.sum("avail").over(W.partitionBy(KEY, "__g").orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    enough = F.lit(abs(size)) + F.abs("want")
    goals = goals.where((F.col("avail") > 0) & (F.col("__a") - F.col("avail") < enough)).withColumn("there", F.col("__a") >= enough)
    goals = goals.withColumn("__b", F.sum(F.col("there").cast("long")).over(up_to))
    rows = goals.groupBy(KEY, "__b").agg(F.array_sort(F.collect_list(F.struct("i", "want", "avail", "there"))).alias("bars"))
    start = F.struct(F.lit(0.0).alias("pos"), F.expr("cast(array() as array<struct<i:int,position:double>>)").alias("out"))

    def step(s: Column, b: Column) -> Column:
        pos = F.when(b["there"], b["want"]).otherwise(s["pos"] + F.greatest(-b["avail"], F.least(b["avail"], b["want"] - s["pos"])))
        return F.struct(pos.alias("pos"), F.array_append(s["out"], F.struct(b["i"].alias("i"), pos.alias("position"))).alias("out"))

    held = rows.select(KEY, F.inline(F.aggregate("bars", start, step, lambda s: s["out"])))
    df = df.join(held, [KEY, "i"], "left").withColumn("position", F.coalesce(win.last_known("position"), F.lit(0.0)))
    df = df.withColumn("qty", F.col("position") - F.coalesce(win.lag("position"), F.lit(0.0)))
    spread = F.greatest(F.lit(min_spread), F.coalesce("range_bps", F.lit(0.0)) * spread_ratio)
    shock = F.lit(impact) * F.coalesce("sigma", F.lit(0.0)) * 1e4 * F.sqrt(F.coalesce(divide(F.abs("qty"), "avail"), F.lit(0.0)))
    price = F.when(F.col("qty") != 0, F.col("vwap") * (1 + F.signum("qty") * (spread / 2 + shock) / 1e4))
    df = df.withColumn("fill_price", price)
    df = df.withColumn("fees", F.when(F.col("qty") != 0, F.greatest(F.lit(min_commission), F.lit(commission_bps) * F.abs("qty") * F.col("fill_price") * lot_size / 1e4)).otherwise(0.0))
    so_far = series().rowsBetween(W.unboundedPreceding, 0)
    paid = F.col("qty") * F.coalesce("fill_price", F.lit(0.0)) * lot_size + F.col("fees")
    df = df.withColumn("cash", -F.sum(paid).over(so_far))
    return df.withColumn("equity", F.col("cash") + F.col("position") * F.col("close") * lot_size).drop("day")


def trades(path: DataFrame) -> DataFrame:
    """Closed trades of an executed path: instrument, trade, bars, lots and pnl, the equity's change over the trade's bars.

    A trade runs from the bar that opens a position to the one that closes it; a bar that turns it over belongs to the next one."""
    order = series()
    prev = F.coalesce(F.lag("position").over(order), F.lit(0.0))
    df = path.select(KEY, "ts", "qty", "position", (F.col("equity") - F.coalesce(F.lag("equity").over(order), F.lit(0.0))).alias("__d"), ((F.col("position") != 0) & (F.signum("position") != F.signum(prev))).cast("int").alias("__open"))
    df = df.withColumn("trade", F.sum("__open").over(order.rowsBetween(W.unboundedPreceding, 0))).where("position != 0 or qty != 0")
    df = df.groupBy(KEY, "trade").agg(F.sum((F.col("position") != 0).cast("long")).alias("bars"), F.max(F.abs("position")).alias("lots"), F.sum("__d").alias("pnl"), (F.max_by("position", "ts") == 0).alias("__done"))
    following = F.lead("trade").over(W.partitionBy(KEY).orderBy("trade")).isNotNull()
    return df.withColumn("__done", F.col("__done") | following).where("__done").drop("__done")


def metrics(path: DataFrame, run_id: str = "run", split: str = "custom", initial: float = 100_000.0, rf: float = 0.0) -> DataFrame:
    """The figures of executed paths, without rows that aren't `ready` (warm-up). Returns are daily, of the last equity of each
    day with bars; trades are those of `trades`."""
    path = path.where("ready") if "ready" in path.columns else path
    order = W.partitionBy(KEY).orderBy("day")
    days = path.groupBy(KEY, F.to_date("ts").alias("day")).agg((F.max_by("equity", "ts") + F.lit(initial)).alias("eq"))
    free = (1 + rf) ** (1 / 252) - 1
    days = days.withColumn("x", divide("eq", F.lag("eq", 1, initial).over(order)) - 1 - F.lit(free)).withColumn("top", F.greatest(F.max("eq").over(order), F.lit(initial)))
    days = days.withColumn("dd", divide("eq", "top") - 1)
    days = days.withColumn("__g", F.sum((F.col("dd") >= 0).cast("int")).over(order))
    days = days.withColumn("under", F.sum((F.col("dd") < 0).cast("int")).over(W.partitionBy(KEY, "__g").orderBy("day")))
    down = F.when(F.col("x") < 0, F.col("x"))
    out = days.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("a"), F.max("day").alias("z"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.stddev_samp(down).alias("d"), F.min("dd").alias("fall"), F.max_by("eq", "day").alias("end"), F.max("under").alias("under"))
    costs = path.groupBy(KEY).agg(F.sum("fees").alias("fees"), F.sum(F.abs("qty") * F.coalesce("fill_price", F.lit(0.0))).alias("notional"))
    done = trades(path)
    by_trade = W.partitionBy(KEY).orderBy("trade")
    done = done.withColumn("__g", F.sum((F.col("pnl") >= 0).cast("int")).over(by_trade))
    done = done.withColumn("losing", F.sum((F.col("pnl") < 0).cast("int")).over(W.partitionBy(KEY, "__g").orderBy("trade")))
    done = done.groupBy(KEY).agg(F.count(F.lit(1)).alias("count"), F.avg((F.col("pnl") > 0).cast("double")).alias("wins"), F.avg("bars").alias("bars"), F.avg("lots").alias("lots"), F.max("losing").alias("losing"))
    out = out.join(costs, KEY).join(done, KEY, "left")
    cagr = F.pow(divide("end", F.lit(initial)), F.lit(252.0) / F.col("n")) - 1
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    made = {
        "run_id": F.lit(run_id), "split": F.lit(split), "start_date": F.col("a").cast("string"), "end_date": F.col("z").cast("string"), "session_days": F.col("n"), "initial_cash": F.lit(float(initial)),
        "final_equity": F.round("end", 2), "total_return": F.round(divide("end", F.lit(initial)) - 1, 6), "cagr": F.round(cagr, 6), "sharpe": F.round(divide("m", "s") * 252**0.5, 4),
        "sortino": F.round(divide("m", "d") * 252**0.5, 4), "calmar": F.round(divide(cagr, F.abs("fall")), 4), "max_drawdown": F.round("fall", 6), "max_drawdown_duration_days": F.col("under"),
        "longest_losing_streak_trades": none("losing"), "trade_count": none("count"), "win_rate": F.round("wins", 4), "avg_holding_bars": F.round("bars", 4), "avg_trade_size_lots": F.round("lots", 4),
        "total_notional": F.round("notional", 2), "total_fees": F.round("fees", 4), "total_commission_bps": F.round(divide("fees", "notional") * 1e4, 4),
    }
    return out.select(KEY, *[c.alias(n) for n, c in made.items()])


def fills_by_order(events: DataFrame) -> DataFrame:
    """Each order of a log with what its fills come to: run_id, order_id, asked, filled, price (mean by quantity), fees and status.

    events: run_id, order_id, type (order or fill), qty, price, fees. Fills without an order keep a row with status orphan."""
    is_fill = F.col("type") == "fill"
    quantity = F.when(is_fill, F.col("qty"))
    out = events.where("type in ('order', 'fill')").groupBy("run_id", "order_id").agg(F.sum(F.when(~is_fill, F.col("qty"))).alias("asked"), F.coalesce(F.sum(quantity), F.lit(0.0)).alias("filled"), divide(F.sum(quantity * F.col("price")), F.sum(quantity)).alias("price"), F.coalesce(F.sum(F.when(is_fill, F.col("fees"))), F.lit(0.0)).alias("fees"))
    status = F.when(F.col("asked").isNull(), "orphan").when(F.col("filled") == 0, "open").when(F.abs("filled") < F.abs("asked"), "partial").otherwise("filled")
    return out.withColumn("status", status)


def event_log(path: DataFrame, run_id: str = "run") -> DataFrame:
    """Candle, signal, fill and position events of an executed path, one JSON-ready row each."""
    event = lambda kind, qty=None, price=None, fees=None: F.struct(F.lit(kind).alias("type"), *[(F.lit(None) if x is None else F.col(x)).cast("double").alias(n) for n, x in (("qty", qty), ("price", price), ("fees", fees))])
    kinds = [event("candle"), event("mark")]
    fill = F.when(F.col("qty") != 0, event("fill", "qty", "fill_price", "fees"))
    return path.select(F.lit(run_id).alias("run_id"), KEY, F.col("ts").alias("bar_ts"), "open", "high", "low", "close", "volume", "signal", F.explode(F.array_compact(F.array(*kinds, fill))).alias("e")).select("run_id", KEY, "bar_ts", "open", "high", "low", "close", "volume", "signal", "e.*")


def reconstruct(events: DataFrame, halts: DataFrame | None = None, lot_size: float = 1.0) -> DataFrame:
    """Canonical rows from a log: one a candle, with fills summed per bar and the accounts run again. Rows from a halt on are cut."""
    bars = events.where("type = 'candle'").select(KEY, F.col("bar_ts").alias("ts"), "open", "high", "low", "close", "volume", "signal")
    filled = events.where("type = 'fill'").groupBy(KEY, F.col("bar_ts").alias("ts")).agg(F.sum("qty").alias("qty"), divide(F.sum(F.col("qty") * F.col("price")), F.sum("qty")).alias("fill_price"), F.sum(F.col("qty") * F.col("price")).alias("__paid"), F.sum("fees").alias("fees"))
    out = bars.join(filled, [KEY, "ts"], "left").fillna(0.0, subset=["qty", "fees", "__paid"])
    if halts is not None:
        out = out.join(halts.groupBy(KEY).agg(F.min("ts").alias("__halt")), KEY, "left").where("__halt is null or ts < __halt").drop("__halt")
    so_far = series().rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("position", F.sum("qty").over(so_far)).withColumn("cash", -F.sum(F.col("__paid") * lot_size + F.col("fees")).over(so_far))
    return out.withColumn("equity", F.col("cash") + F.col("position") * F.col("close") * lot_size).drop("__paid")


def violations(rows: DataFrame, lot_size: float = 1.0, tolerance: float = 1e-6) -> DataFrame:
    """Canonical rows that break an identity: equity, position from row to row, cash from row to row, unique keys."""
    order = series()
    off = lambda a, b: F.abs(a - b) > tolerance
    checks = {
        "equity": off(F.col("equity"), F.col("cash") + F.col("position") * F.col("close") * lot_size),
        "position": off(F.col("position"), F.coalesce(F.lag("position").over(order), F.lit(0.0)) + F.col("qty")),
        "cash": off(F.col("cash"), F.coalesce(F.lag("cash").over(order), F.lit(0.0)) - F.col("qty") * F.coalesce("fill_price", F.lit(0.0)) * lot_size - F.col("fees")),
        "key": F.count(F.lit(1)).over(W.partitionBy(KEY, "ts")) > 1,
    }
    found = rows.select(KEY, "ts", *[c.alias(f"__{n}") for n, c in checks.items()])
    return found.select(KEY, "ts", F.explode(F.array_compact(F.array(*[F.when(F.col(f"__{n}"), F.lit(n)) for n in checks]))).alias("broken"))


def drift(live: DataFrame, test: DataFrame) -> DataFrame:
    """Rows of either side with what differs: signals, positions, equities."""
    a = live.select(KEY, "ts", *[F.col(c).alias(f"live_{c}") for c in ("signal", "position", "equity")])
    b = test.select(KEY, "ts", *[F.col(c).alias(f"test_{c}") for c in ("signal", "position", "equity")])
    out = a.join(b, [KEY, "ts"], "full")
    return out.select(KEY, "ts", F.col("live_signal").eqNullSafe(F.col("test_signal")).alias("same_signal"), (F.col("live_position") - F.col("test_position")).alias("position_diff"), (F.col("live_equity") - F.col("test_equity")).alias("equity_diff"), F.col("live_signal").isNull().alias("only_test"), F.col("test_signal").isNull().alias("only_live"))


def replayed(events: DataFrame, minutes: DataFrame, sigma_days: int = 60, bar: str = "15 minutes", cooldown: int = 4, **execution) -> DataFrame:
    """The strategy run again over the candles that a log holds, so that data revised since don't count as drift. Executions need
    minutes, which a log doesn't hold."""
    logged = events.where("type = 'candle'").select(KEY, F.col("bar_ts").alias("ts"), "open", "high", "low", "close", "volume").dropDuplicates([KEY, "ts"])
    return executions(signals(logged, cooldown), minutes, sigma_daily(logged, sigma_days), bar=bar, **execution)


def trade_timing(live: DataFrame, test: DataFrame, most: int = 8) -> DataFrame:
    """Each side's trades with the other's nearest ones: instrument, side, live_ts, test_ts and bars, by how many bars the live trade came
    later (earlier: negative). Trades without a partner have one time only.

    Trades match one to one, on the same side and at most `most` bars apart, the nearest pairs first (then the earlier live, then
    the earlier test trade). Bars are numbered over both sides' rows. In each round every trade looks at its nearest unmatched
    ones before and after, by windows, and trades that are each other's first choice pair off."""
    key = [KEY, "ts"]
    live, test = written(live.select(*key, "qty"), "live"), written(test.select(*key, "qty"), "test")
    place = live.select(*key).union(test.select(*key)).distinct().withColumn("n", F.row_number().over(series()))
    place = written(place, "places")
    trades = lambda df, who: df.where("qty <> 0").select(*key, F.signum("qty").cast("int").alias("side"), F.lit(who).alias("who"))
    both = written(trades(live, "l").union(trades(test, "t")).join(place, key), "trades")
    left, pairs = both, None
    back = W.partitionBy(KEY, "side").orderBy("n", "who")
    while True:
        seen = left
        for who in ("l", "t"):
            known = F.when(F.col("who") == who, F.col("n"))
            seen = seen.withColumn(f"{who}_before", F.last(known, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0))).withColumn(f"{who}_after", F.first(known, ignorenulls=True).over(back.rowsBetween(0, W.unboundedFollowing)))
        near = lambda who: F.array_min(F.array_compact(F.array(*[F.when(F.abs(F.col(f"{who}_{x}") - F.col("n")) <= most, F.struct(F.abs(F.col(f"{who}_{x}") - F.col("n")).alias("far"), F.col(f"{who}_{x}").alias("n"))) for x in ("before", "after")])))
        seen = seen.withColumn("other", F.when(F.col("who") == "l", near("t")).otherwise(near("l"))["n"])
        one = seen.where("who = 'l' and other is not null").select(KEY, "side", F.col("n").alias("l"), F.col("other").alias("t"))
        two = seen.where("who = 't' and other is not null").select(KEY, "side", F.col("other").alias("l"), F.col("n").alias("t"))
        found = written(one.join(two, [KEY, "side", "l", "t"]), "pairs")
        if not found.limit(1).count():
            break
        pairs = found if pairs is None else pairs.unionByName(found)
        used = found.select(KEY, "side", F.explode(F.array(F.struct(F.lit("l").alias("who"), F.col("l").alias("n")), F.struct(F.lit("t").alias("who"), F.col("t").alias("n")))).alias("x")).select(KEY, "side", "x.*")
        left = written(left.join(used, [KEY, "side", "who", "n"], "left_anti").select(both.columns), "left")
    time = lambda name: place.select(KEY, F.col("n").alias(name), F.col("ts").alias(f"{name}s"))
    alone = left.select(KEY, "side", *[F.when(F.col("who") == w, F.col("ts")).alias(f"{n}_ts") for w, n in (("l", "live"), ("t", "test"))], F.lit(None).cast("long").alias("bars"))
    if pairs is None:
        return alone
    matched = pairs.join(time("l"), [KEY, "l"]).join(time("t"), [KEY, "t"])
    return matched.select(KEY, "side", F.col("ls").alias("live_ts"), F.col("ts").alias("test_ts"), (F.col("l") - F.col("t")).cast("long").alias("bars")).unionByName(alone)


def splits(warmup: tuple[str, str], train: tuple[str, str], validation: tuple[str, str], test: tuple[str, str]) -> Column:
    """The part a bar's time falls into; parts are half-open, in order, and may not overlap."""
    parts = [("warmup", *warmup), ("train", *train), ("validation", *validation), ("test", *test)]
    if any(a >= b for _, a, b in parts) or any(x[2] > y[1] for x, y in zip(parts, parts[1:], strict=False)):
        raise ValueError("parts must be in order and apart")
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    out = F.lit(None).cast("string")
    for name, a, b in parts:
        out = F.when((F.col("ts") >= t(a)) & (F.col("ts") < t(b)), name).otherwise(out)
    return out
