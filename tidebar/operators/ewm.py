"""Exponentially weighted windows as prefix sums in blocks: built-in functions only, no recursion.

With d = 1 - alpha, everything rests on the decayed sum D_t = sum of d ** (t - i) * x_i. Rows are numbered in their series and
cut into blocks in which d ** n falls to 1e-30: inside a block D is d ** j times a running sum of x * d ** -j, which can't
overflow, and the one block before adds its total, decayed; older blocks are too faint for a double.

A series' windows are one task's; scan.Long, given as `engine`, has the same results without a task that holds a whole series.

Values start at the first row that has one; there may be no missing values after it. `adjust` has no default: with it a mean
divides by the weights so far, without it the first value has the weight that all before it would have had."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidebar.functions.columns import col, divide
from tidebar.operators.candles import KEY, series


def block_rows(alpha: float) -> int:
    return max(2, math.ceil(69 / -math.log(1 - alpha))) if alpha < 1 else 2


def span(n: float) -> float:
    """The alpha of a span."""
    return 2 / (n + 1)


def tag(alpha: float) -> str:
    """0.05 is a05."""
    return "a" + f"{alpha:g}".partition(".")[2]


class Decay:
    """Adds decayed sums to a frame. Each call costs one sort by its alpha's blocks, whatever the number of columns."""

    def __init__(self, df: DataFrame, alpha: float, by: str = KEY):
        self.d, self.rows, self.by = 1 - alpha, block_rows(alpha), by
        self.alpha = alpha
        self.df = df

    def first(self, name: str, x: Column | str) -> None:
        """Adds the first value so far to the frame."""
        self.df = self.df.withColumn(name, F.first(col(x), ignorenulls=True).over(series(self.by).rowsBetween(W.unboundedPreceding, 0)))

    def lag(self, name: str, x: str) -> None:
        self.df = self.df.withColumn(name, F.lag(x).over(series(self.by)))

    def number(self, name: str) -> None:
        self.df = self.df.withColumn(name, (F.row_number().over(series(self.by)) - 1).cast("double"))

    def sums(self, **columns: Column | str) -> DataFrame:
        """Adds each column's decayed sum under the given name; also name__t, the rows since its first value (from 0), and
        name__first, that value. All columns share their blocks: rows before a column's first value add nothing to its sums."""
        order, df, d = series(self.by), self.df, self.d
        start, before = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
        keep = df.columns
        df = df.select("*", *[col(x).alias(f"__x_{n}") for n, x in columns.items()])
        known = [c for n in columns for c in ((F.count(f"__x_{n}").over(start) - 1).alias(f"{n}__t"), F.first(f"__x_{n}", ignorenulls=True).over(start).alias(f"{n}__first"))]
        df = df.select("*", (F.row_number().over(order) - 1).alias("__i"), *known)
        j, block = F.col("__i") % self.rows, W.partitionBy(self.by, F.floor(F.col("__i") / self.rows)).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
        power = lambda e: F.pow(F.lit(d), e.cast("double"))
        df = df.select("*", *[(power(j) * F.sum(F.coalesce(F.col(f"__x_{n}"), F.lit(0.0)) * power(-j)).over(block)).alias(f"__s_{n}") for n in columns])
        total = lambda n: F.last(F.when(j == self.rows - 1, F.col(f"__s_{n}")), ignorenulls=True).over(before)
        done = [F.when(F.col(f"{n}__t") >= 0, F.col(f"__s_{n}") + power(j + 1) * F.coalesce(total(n), F.lit(0.0))).alias(n) for n in columns]
        return df.select(*keep, *done, *[f"{n}__{x}" for n in columns for x in ("t", "first")])

    def mean(self, name: str, adjust: bool) -> Column:
        """The mean from a decayed sum of this name."""
        t = F.pow(F.lit(self.d), F.col(f"{name}__t").cast("double"))
        if adjust:
            return F.col(name) * F.lit(1 - self.d) / (1 - t * F.lit(self.d))
        return F.col(name) * F.lit(self.alpha) + F.lit(1 - self.alpha) * t * F.col(f"{name}__first")


def _tidy(df: DataFrame, keep: list[str], **out: Column) -> DataFrame:
    return df.select(*keep, *[c.alias(n) for n, c in out.items()])


def means(df: DataFrame, alpha: float, adjust: bool, by: str = KEY, engine: type[Decay] = Decay, **columns: Column | str) -> DataFrame:
    """Adds the mean of each column under the given name."""
    keep, decay = df.columns, engine(df, alpha, by)
    summed = decay.sums(**{f"__m_{n}": x for n, x in columns.items()})
    return _tidy(summed, keep, **{n: decay.mean(f"__m_{n}", adjust) for n in columns})


def sums(df: DataFrame, alpha: float, by: str = KEY, engine: type[Decay] = Decay, **columns: Column | str) -> DataFrame:
    keep = df.columns
    return _tidy(engine(df, alpha, by).sums(**{f"__m_{n}": x for n, x in columns.items()}), keep, **{n: F.col(f"__m_{n}") for n in columns})


def mean_and_std(df: DataFrame, alpha: float, x: Column | str, mean: str, std: str, by: str = KEY, engine: type[Decay] = Decay) -> DataFrame:
    """Adds the adjusted mean and the bias-corrected deviation, which is missing on the first row and 0 on a flat series.

    x is centred on its series' first value, else the difference of squares would cancel."""
    keep, decay = df.columns, engine(df, alpha, by)
    decay.first("__c", x)
    decay.df = decay.df.withColumn("__y", col(x) - F.col("__c"))
    out = decay.sums(__s1="__y", __s2=F.col("__y") * F.col("__y"))
    m1, m2 = decay.mean("__s1", True), decay.mean("__s2", True)
    d, n = F.lit(decay.d), F.col("__s1__t").cast("double") + 1
    w = (1 - F.pow(d, n)) / (1 - d)
    w2 = (1 - F.pow(d, 2 * n)) / (1 - d * d)
    var = (m2 - m1 * m1) * w * w / F.nullif(w * w - w2, F.lit(0.0))
    noise = F.abs(m2) * F.lit(1e-12)
    value = F.when(F.col("__s1__t") > 0, F.when(m2 - m1 * m1 <= noise, F.lit(0.0)).otherwise(F.sqrt(var)))
    return _tidy(out, keep, **{mean: m1 + F.col("__c"), std: value})


def weighted(df: DataFrame, alpha: float, weight: str = "volume", by: str = KEY, engine: type[Decay] = Decay, **columns: Column | str) -> DataFrame:
    """Adds volume-weighted means; missing while the weights' mean isn't positive."""
    keep, decay = df.columns, engine(df, alpha, by)
    w = col(weight).cast("double")
    out = decay.sums(__w=w, **{f"__m_{n}": col(x) * w for n, x in columns.items()})
    below = decay.mean("__w", False)
    return _tidy(out, keep, **{n: F.when(below > 0, divide(decay.mean(f"__m_{n}", False), below)) for n in columns})


def efficiency(df: DataFrame, alpha: float, name: str, x: str = "close", weight: str | None = None, by: str = KEY, engine: type[Decay] = Decay) -> DataFrame:
    """Adds the mean change divided by the mean absolute change, between -1 and 1."""
    keep, decay = df.columns, engine(df, alpha, by)
    decay.lag("__0", x)
    decay.df = decay.df.withColumn("__d", (F.col(x) - F.col("__0")) * (F.col(weight).cast("double") if weight else F.lit(1.0)))
    out = decay.sums(__a="__d", __b=F.abs("__d"))
    return _tidy(out, keep, **{name: divide(decay.mean("__a", False), decay.mean("__b", False))})


def slope(df: DataFrame, alpha: float, name: str, y: str = "close", by: str = KEY, engine: type[Decay] = Decay) -> DataFrame:
    """Adds tanh of the weighted regression slope on the row number, relative to the weighted mean of |y|."""
    keep, decay = df.columns, engine(df, alpha, by)
    decay.number("__n")
    out = decay.sums(__mt="__n", __my=y, __mtt=F.col("__n") * F.col("__n"), __mty=F.col("__n") * F.col(y), __ma=F.abs(y))
    t, v, tt, ty, a = (decay.mean(n, False) for n in ("__mt", "__my", "__mtt", "__mty", "__ma"))
    var = tt - t * t
    value = F.when(var > 1e-12, F.try_divide(ty - t * v, var)).otherwise(0.0)
    return _tidy(out, keep, **{name: F.tanh(value / (a + F.lit(1e-9)))})
