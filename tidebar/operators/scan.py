"""Series of any length: row numbers, running and decayed values by prefix scans over parts, so that no task holds a whole series.

Rows are range-partitioned by (series, time), so a series that is a third of all rows is a third of all parts. Each part is
scanned in itself; its totals (one row a series and part) are chained over the parts before, and what is carried in is added to
the part's rows. Times are unique in a series. Null times come first, null series are a series of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidebar.functions.columns import col
from tidebar.operators import ewm
from tidebar.operators.candles import KEY
from tidebar.operators.tables import written

#: Rows that share a window where a shorter block would do.
ROWS = 1 << 12


def _equal(pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])


def parts(df: DataFrame, by: str = KEY, order: str = "ts") -> DataFrame:
    """Adds __part: ranges of (by, order), written, so that they stay."""
    return written(df.repartitionByRange(F.col(by), F.col(order)).withColumn("__part", F.spark_partition_id()), "parts")


def numbered(df: DataFrame, name: str = "__i", by: str = KEY, order: str = "ts") -> DataFrame:
    """Adds a row's place in its series, from 0; also __part."""
    ranged = parts(df, by, order)
    inside = F.row_number().over(W.partitionBy("__part", by).orderBy(order)) - 1
    counts = ranged.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col(by).alias("__b"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = ranged.withColumn("__in", inside).join(counts, _equal([(by, "__b"), ("__part", "__p")]))
    return out.select(*df.columns, "__part", (F.col("__before") + F.col("__in")).alias(name))


_CHAINED = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda x: F.last(x, ignorenulls=True), "first": lambda x: F.first(x, ignorenulls=True)}


def running(df: DataFrame, by: str = KEY, order: str = "ts", **columns: tuple[str, Column | str]) -> DataFrame:
    """Adds running values: name=(kind, column), kind one of sum, max, min, last and first (known value), over the series so far.

    Missing values are passed over; before the first value the result is missing."""
    ranged = parts(df.select("*", *[col(x).alias(f"__x_{n}") for n, (_, x) in columns.items()]), by, order)
    so_far = W.partitionBy("__part", by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    of_part = {n: F.max_by(f"__x_{n}", F.when(F.col(f"__x_{n}").isNotNull(), F.col(order))) if k == "last" else F.min_by(f"__x_{n}", F.when(F.col(f"__x_{n}").isNotNull(), F.col(order))) if k == "first" else _CHAINED[k](f"__x_{n}") for n, (k, _) in columns.items()}
    totals = ranged.groupBy(by, "__part").agg(*[t.alias(f"__t_{n}") for n, t in of_part.items()])
    before = W.partitionBy(by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col(by).alias("__b"), F.col("__part").alias("__p"), *[_CHAINED[k](f"__t_{n}").over(before).alias(f"__c_{n}") for n, (k, _) in columns.items()])
    out = ranged.select("*", *[_CHAINED[k](f"__x_{n}").over(so_far).alias(f"__o_{n}") for n, (k, _) in columns.items()]).join(totals, _equal([(by, "__b"), ("__part", "__p")]))

    def both(n: str, kind: str) -> Column:
        own, carried = F.col(f"__o_{n}"), F.col(f"__c_{n}")
        if kind == "sum":
            return F.when(own.isNotNull() | carried.isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0)))
        if kind in ("max", "min"):
            return (F.greatest if kind == "max" else F.least)(own, carried)
        return F.coalesce(own, carried) if kind == "last" else F.coalesce(carried, own)

    return out.select(*df.columns, *[both(n, k).alias(n) for n, (k, _) in columns.items()])


class Long(ewm.Decay):
    """Decayed sums of series of any length, with the results of ewm.Decay: give it to the functions of ewm as `decay`.

    Blocks of rows are windows of their own; a block's total reaches the next block by an equi-join on its number."""

    def __init__(self, df: DataFrame, alpha: float, by: str = KEY):
        super().__init__(df, alpha, by)
        self.df = numbered(df, "__i", by).drop("__part")

    def _tied(self, df: DataFrame, other: DataFrame, on: list[str], how: str = "left") -> DataFrame:
        """Joins other, whose keys are renamed, null-safely on the series."""
        renamed = other.select(*[F.col(c).alias(f"__k_{c}") for c in on], *[c for c in other.columns if c not in on])
        out = df.join(renamed, F.col(self.by).eqNullSafe(F.col(f"__k_{self.by}")) & reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__k_{c}") for c in on if c != self.by], F.lit(True)), how)
        return out.drop(*[f"__k_{c}" for c in on])

    def first(self, name: str, x: Column | str) -> None:
        """The series' first value that is there (on all rows, those before it included)."""
        known = self.df.select(self.by, "__i", col(x).alias("__v")).where("__v is not null")
        self.df = self._tied(self.df, known.groupBy(self.by).agg(F.min_by("__v", "__i").alias(name)), [self.by])

    def lag(self, name: str, x: str) -> None:
        """Inside blocks by a window; the row before a block comes from the block before."""
        block = F.floor(F.col("__i") / ROWS)
        own = W.partitionBy(self.by, "__g").orderBy("__i")
        ends = self.df.where(F.col("__i") % ROWS == ROWS - 1).select(self.by, (block + 1).alias("__g"), F.col(x).alias("__e"))
        out = self._tied(self.df.withColumn("__g", block), ends, [self.by, "__g"])
        self.df = out.withColumn(name, F.when(F.col("__i") % ROWS == 0, F.col("__e")).otherwise(F.lag(x).over(own))).drop("__g", "__e")

    def number(self, name: str) -> None:
        self.df = self.df.withColumn(name, F.col("__i").cast("double"))

    def sums(self, **columns: Column | str) -> DataFrame:
        by, d, rows = self.by, self.d, self.rows
        keep = [c for c in self.df.columns if c != "__i"]
        df = self.df.select("*", *[col(x).alias(f"__x_{n}") for n, x in columns.items()]).withColumn("__g", F.floor(F.col("__i") / rows)).withColumn("__j", F.col("__i") % rows)
        power = lambda e: F.pow(F.lit(d), e.cast("double"))
        x = {n: F.coalesce(F.col(f"__x_{n}"), F.lit(0.0)) for n in columns}
        totals = df.groupBy(by, "__g").agg(*[F.sum(x[n] * power(rows - 1 - F.col("__j"))).alias(f"__t_{n}") for n in columns])
        totals = totals.withColumn("__g", F.col("__g") + 1)
        starts = df.groupBy(by).agg(*[F.min(F.when(F.col(f"__x_{n}").isNotNull(), F.struct(F.col("__i").alias("i"), F.col(f"__x_{n}").alias("x")))).alias(f"__f_{n}") for n in columns])
        block = W.partitionBy(by, "__g").orderBy("__i").rowsBetween(W.unboundedPreceding, 0)
        out = df.select("*", *[(power(F.col("__j")) * F.sum(x[n] * power(-F.col("__j"))).over(block)).alias(f"__s_{n}") for n in columns])
        out = self._tied(self._tied(out, totals, [by, "__g"]), starts, [by])
        since = lambda n: F.col("__i") - F.col(f"__f_{n}.i")
        done = [F.when(since(n) >= 0, F.col(f"__s_{n}") + power(F.col("__j") + 1) * F.coalesce(F.col(f"__t_{n}"), F.lit(0.0))).alias(n) for n in columns]
        known = [c for n in columns for c in (F.greatest(since(n), F.lit(-1)).alias(f"{n}__t"), F.when(since(n) >= 0, F.col(f"__f_{n}.x")).alias(f"{n}__first"))]
        return out.select(*keep, *done, *known)
