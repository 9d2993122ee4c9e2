"""The feature catalogue of a candle series. Base features are one select over one window: one shuffle, one sort."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import divide, true
from tidebar.operators import asof, ewm
from tidebar.operators import windows as win
from tidebar.operators.candles import KEY, series

# The parameters of the catalogue.
RETURNS = (1, 3, 8, 20)
ALPHAS = (0.01, 0.05, 0.1, 0.5)
LAGS = (1, 2, 4, 8, 16)
STEPS = (1, 2, 4)
SLOPE = 10

OHLC = ("open", "high", "low", "close", "volume")
BASE = ("ret1", "ret3", "ret8", "ret20", "spread", "body", "upper_wick", "lower_wick", "body_frac", "close_pos", "dir", "gap", "trend", "brk_hi20", "brk_lo20", "new_hi20", "new_lo20", "rsi14", "volat20", "vol_norm", "vol_z", "vol_trend")


def returns() -> dict[str, Column]:
    return {f"ret{n}": win.change("close", n) for n in RETURNS}


def anatomy() -> dict[str, Column]:
    o, h, low, c = (F.col(x) for x in OHLC[:4])
    flat = h == low
    return {
        "spread": divide(h - low, c),
        "body": divide(c - o, c),
        "upper_wick": divide(h - F.greatest(o, c), c),
        "lower_wick": divide(F.least(o, c) - low, c),
        "body_frac": F.when(flat, 0.0).otherwise(divide(F.abs(c - o), h - low)),
        "close_pos": F.when(flat, 0.5).otherwise(divide(c - low, h - low)),
        "dir": F.signum(c - o),
        "gap": divide(o, win.lag(c)) - 1,
    }


def breakout() -> dict[str, Column]:
    """new_hi20 and new_lo20 compare with the extremes up to the bar before; during warm-up they are 0."""
    high, low = win.rolling(F.max, "high", 20), win.rolling(F.min, "low", 20)
    earlier = series().rowsBetween(-20, -1)
    before = lambda f, x: F.when(F.count(x).over(earlier) >= 20, f(x).over(earlier))
    return {
        "brk_hi20": divide("close", high) - 1,
        "brk_lo20": divide("close", low) - 1,
        "new_hi20": true(F.col("close") > before(F.max, "high")).cast("double"),
        "new_lo20": true(F.col("close") < before(F.min, "low")).cast("double"),
    }


def volume() -> dict[str, Column]:
    v = F.col("volume").cast("double")
    mean, std = win.rolling(F.avg, v, 20), win.rolling(F.stddev_samp, v, 20)
    return {
        "vol_norm": divide(v, win.rolling(F.avg, v, 20, least=1)),
        "vol_z": F.when(std == 0, 0.0).otherwise(divide(v - mean, std)),
        "vol_trend": divide(win.rolling(F.avg, v, 5), mean) - 1,
    }


def rsi(n: int = 14) -> tuple[dict[str, Column], dict[str, Column]]:
    """Columns to add first, and the feature: gain / (gain + loss) - 1/2 of simple rolling means, 0 if nothing moved."""
    moved = win.difference("close")
    first = {"__gain": F.when(moved.isNotNull(), F.greatest(moved, F.lit(0.0))), "__loss": F.when(moved.isNotNull(), F.greatest(-moved, F.lit(0.0)))}
    gain, loss = win.rolling(F.avg, "__gain", n), win.rolling(F.avg, "__loss", n)
    return first, {f"rsi{n}": F.when(gain + loss == 0, 0.0).otherwise(divide(gain, gain + loss) - 0.5)}


def base(bars: DataFrame) -> DataFrame:
    """Adds the 22 base features."""
    first, strength = rsi()
    out = ewm.means(bars, ewm.span(5), False, __e5="close")
    out = ewm.means(out, ewm.span(20), False, __e20="close")
    out = out.select("*", *[c.alias(n) for n, c in (first | {"__r": win.change("close")}).items()])
    # Means of closes that have all been equal are that close; the sums' rounding would give their trend a sign.
    flat = win.so_far(F.max, "close") == win.so_far(F.min, "close")
    trend = F.when(flat, divide("close", "close")).otherwise(divide("__e5", "__e20")) - 1
    made = returns() | anatomy() | breakout() | volume() | strength | {"trend": trend, "volat20": win.rolling(F.stddev_samp, "__r", 20)}
    return out.select(*bars.columns, *[made[n].alias(n) for n in BASE])


def crossings(mean: str, alphas: tuple[float, ...] = ALPHAS) -> dict[str, Column]:
    """Fast less slow mean, by close, for each pair of alphas; mean: the columns' name by tag."""
    pairs = [(ewm.tag(max(p)), ewm.tag(min(p))) for p in combinations(alphas, 2)]
    return {f"macd_{f}_{s}": divide(F.col(mean.format(f)) - F.col(mean.format(s)), "close") for f, s in pairs}


def macd(bars: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Adds the crossings alone."""
    out = bars
    for a in alphas:
        out = ewm.means(out, a, False, **{f"__m{ewm.tag(a)}": "close"})
    return out.select(*bars.columns, *[x.alias(n) for n, x in crossings("__m{}", alphas).items()])


def extended(bars: DataFrame, alphas: tuple[float, ...] = ALPHAS, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """Adds to base features the decayed ones of every alpha, lags of all price features, and slopes of price and volume ones."""
    price, flow = [n for n in BASE if not n.startswith("vol_")], [n for n in BASE if n.startswith("vol_")]
    out = base(bars)
    o, h, low, c, v = (F.col(x) for x in OHLC)
    v = v.cast("double")

    def add(into: list[str] | None = None, **made: Column) -> None:
        nonlocal out
        out = out.select("*", *[x.alias(n) for n, x in made.items()])
        if into is not None:
            into += made

    add(price, hl=divide(h, low) - 1, co=divide(c, o) - 1, ch=divide(c, h) - 1, cl=divide(c, low) - 1)
    # Volumes are relative to the last one that was traded.
    add(__ref=win.last_known(F.when(v > 0, v)), **{f"__c{n}": win.difference("close", n) for n in STEPS}, **{f"__v{n}": win.difference(v, n) for n in STEPS})
    add(price, **{f"cd{n}": divide(f"__c{n}", c) for n in STEPS if n > 1})
    add(flow, **{f"vd{n}": divide(f"__v{n}", "__ref") for n in STEPS})
    up = F.col("__c1")
    decayed = {"m": c, "w": v, "wc": c * v, "wh": h * v, "wl": low * v, "e": up, "ea": F.abs(up), "f": up * v, "fa": F.abs(up * v)} | {f"{x}{n}": F.col(f"__{x}{n}") for x in "cv" for n in STEPS}
    for a in alphas:
        # One call, so one sort, for all that decays with this alpha.
        t, keep = ewm.tag(a), out.columns
        decay = ewm.Decay(out, a)
        out = decay.sums(**{f"__d_{n}": x for n, x in decayed.items()})
        out = out.select(*keep, *[decay.mean(f"__d_{n}", False).alias(f"__{n}_{t}") for n in decayed], F.col("__d_w").alias(f"__vs_{t}"))
        over = {n: F.when(F.col(f"__w_{t}") > 0, divide(f"__w{n}_{t}", f"__w_{t}")) for n in "chl"}
        add(price, **{f"vwap_{t}": divide(over["c"], c) - 1, f"vwh_{t}": divide(over["h"], c) - 1, f"vwl_{t}": divide(over["l"], c) - 1, f"vwhl_{t}": divide(over["h"] - over["l"], c)})
        add(price, **{f"eff_{t}": divide(f"__e_{t}", f"__ea_{t}"), f"effv_{t}": divide(f"__f_{t}", f"__fa_{t}")}, **{f"cd{n}_ewm_{t}": divide(f"__c{n}_{t}", c) for n in STEPS})
        add(flow, **{f"vm_{t}": divide(f"__w_{t}", "__ref"), f"v_over_vm_{t}": divide(v, f"__w_{t}"), f"vsum_{t}": divide(f"__vs_{t}", "__ref"), f"v_over_vsum_{t}": divide(v, f"__vs_{t}")})
        add(flow, **{f"vd{n}_ewm_{t}": divide(f"__v{n}_{t}", "__ref") for n in STEPS})
    add(price, **crossings("__m_{}", alphas))
    # All features as one array, so that the window holds one value for each lag rather than one for each lag and feature.
    both = price + flow
    out = out.select(*bars.columns, *both, F.array(*both).alias("__0"))
    out = out.select("*", *[win.lag("__0", n).alias(f"__{n}") for n in sorted({*range(1, SLOPE), *lags})])
    late = [F.get(F.col(f"__{n}"), F.lit(k)).alias(f"{x}_lag{n}") for k, x in enumerate(price) for n in lags]
    # A least-squares slope on row numbers is a sum with fixed weights.
    middle = (SLOPE - 1) / 2
    weights = [(middle - n) / sum((middle - m) ** 2 for m in range(SLOPE)) for n in range(SLOPE)]
    steep = [reduce(lambda a, b: a + b, [F.get(F.col(f"__{n}"), F.lit(k)) * F.lit(w) for n, w in enumerate(weights)]).alias(f"{x}_slope{SLOPE}") for k, x in enumerate(both)]
    return out.select(*bars.columns, *both, *late, *steep)


def prefix(instrument: str, timeframe: str) -> str:
    return f"{instrument}_{timeframe.replace('min', 'm')}"


def build(universe: dict[tuple[str, str], DataFrame], primary: tuple[str, str], rich: tuple[str, ...] = ()) -> DataFrame:
    """One wide row a bar of the primary series. Its own features are those of the bar before; others are those of the last bar
    that had ended. Each series also gives the time of the row it came from."""
    out, others = None, {}
    for (name, timeframe), bars in sorted(universe.items(), key=lambda x: x[0] != primary):
        wide = extended(bars) if name in rich and timeframe == primary[1] else base(bars)
        names = [n for n in wide.columns if n not in (KEY, "ts", *OHLC)]
        p = prefix(name, timeframe)
        if (name, timeframe) == primary:
            out = wide.select("ts", "close", *[win.lag(n).alias(f"{p}_{n}") for n in names], win.lag("ts").alias(f"{p}_ts"))
        else:
            columns = [f"{p}_{n}" for n in names]
            others[p] = asof.shifted(wide.select("ts", *[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)]), timeframe), columns
    return cross(asof.backward_all(out, others), universe, primary)


def cross(wide: DataFrame, universe, primary: tuple[str, str]) -> DataFrame:
    """Agreement of trends with the primary one, and mean volume scores per timeframe and per instrument."""
    own = prefix(*primary)
    made = {f"x_{prefix(*k)}_trend_match": F.signum(f"{own}_trend") * F.signum(f"{prefix(*k)}_trend") for k in universe if k != primary}
    for at, label in ((1, "x_volz_mkt_{}"), (0, "x_volz_{}_tfs")):
        for value in sorted({k[at] for k in universe}):
            columns = [f"{prefix(*k)}_vol_z" for k in universe if k[at] == value]
            if len(columns) > 1:
                made[label.format(value.replace("min", "m"))] = row_mean(columns)
    return wide.select("*", *[c.alias(n) for n, c in made.items()])


def row_mean(columns: list[str]) -> Column:
    """Mean of a row's values that aren't missing."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    return divide(total, reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns]))
