"""Exact quantiles by selection: no task ever sorts all values.

A mergeable sketch names some splitters, values of the data; one aggregation counts the values between and equal to them, which
says exactly between which two each wanted rank lies, or that it is one of them. Only values between those are kept (at most about
a 60th of them for each rank) for the next round, until few enough are left to be sorted. Equal values never come along: a splitter
is counted, not kept. Groups are selected from all at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidebar.functions.columns import clean, col
from tidebar.operators.tables import written

#: Values of a group that are sorted in one task.
LEAST = 1 << 13
SPLITTERS = 64
ACCURACY = 10_000


def _on(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)], F.lit(True))


def _named(by: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(b).alias(f"{prefix}{b}") for b in by]


def select(values: DataFrame, ranks: DataFrame, by: Sequence[str], least: int = LEAST) -> DataFrame:
    """Rows (by, r, x): the r-th smallest (from 0) x of each group, for distinct ranks (by, r) within the groups' sizes."""
    by = list(by)
    out, ids = None, [*by, "__id"]
    wanted = ranks.select(*by, F.lit("").alias("__id"), F.col("r"), F.col("r").alias("__k"))
    left = values.select(*by, F.lit("").alias("__id"), "x").where("x is not null")
    sizes = left.groupBy(*ids).agg(F.count(F.lit(1)).alias("__m"))
    while True:
        sizes, wanted = written(sizes, "sizes"), written(wanted, "wanted")
        small = sizes.where(F.col("__m") <= least)
        keyed = small.select(*_named(ids, "__s"))
        lists = left.join(keyed, _on(ids, [f"__s{c}" for c in ids]), "left_semi").groupBy(*ids).agg(F.array_sort(F.collect_list("x")).alias("__l"))
        lists = lists.select(*_named(ids, "__s"), "__l")
        found = wanted.join(lists, _on(ids, [f"__s{c}" for c in ids])).select(*by, "r", F.get("__l", F.col("__k").cast("int")).alias("x"))
        out = found if out is None else out.unionByName(found)
        large = sizes.where(F.col("__m") > least).select(*_named(ids, "__s"))
        if not large.limit(1).count():
            return out
        inside = left.join(large, _on(ids, [f"__s{c}" for c in ids]), "left_semi")
        grid = ", ".join(f"{k / SPLITTERS!r}D" for k in range(SPLITTERS + 1))
        cuts = inside.groupBy(*ids).agg(F.array_sort(F.array_distinct(F.expr(f"percentile_approx(x, array({grid}), {ACCURACY})"))).alias("__c"))
        cuts = written(cuts.select(*_named(ids, "__s"), "__c"), "cuts")
        placed = inside.join(cuts, _on(ids, [f"__s{c}" for c in ids])).select(*ids, "x", "__c", F.size(F.filter("__c", lambda c: c < F.col("x"))).alias("__b"))
        placed = placed.withColumn("__e", F.col("x") == F.get("__c", F.col("__b")))
        counts = placed.groupBy(*ids, "__b").agg(F.count(F.lit(1)).alias("__m"), F.count(F.when(F.col("__e"), 1)).alias("__eq"), F.max(F.when(F.col("__e"), F.col("x"))).alias("__at"))
        before = W.partitionBy(*ids).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # some 65 rows a group
        counts = counts.withColumn("__before", F.coalesce(F.sum("__m").over(before), F.lit(0)))
        counts = written(counts.select(*_named(ids, "__s"), "__b", "__m", "__eq", "__at", "__before"), "counts")
        in_ = (F.col("__k") >= F.col("__before")) & (F.col("__k") < F.col("__before") + F.col("__m"))
        hit = wanted.join(counts, _on(ids, [f"__s{c}" for c in ids]) & in_).withColumn("__k", F.col("__k") - F.col("__before")).withColumn("__m", F.col("__m") - F.col("__eq"))
        hit = written(hit.select(*ids, "r", "__k", "__b", "__m", "__at"), "hit")
        out = out.unionByName(hit.where("__k >= __m").select(*by, "r", F.col("__at").alias("x")))
        rest = hit.where("__k < __m")
        inner = F.concat_ws("/", "__id", F.col("__b").cast("string"))
        wanted = rest.select(*by, inner.alias("__id"), "r", "__k")
        sizes = rest.select(*by, inner.alias("__id"), "__m").distinct()
        kept = rest.select(*_named(ids, "__s"), F.col("__b").alias("__sb")).distinct()
        left = placed.where(~F.col("__e")).join(kept, _on([*ids, "__b"], [*[f"__s{c}" for c in ids], "__sb"]), "left_semi")
        left = written(left.select(*by, inner.alias("__id"), "x"), "left")


def quantiles(df: DataFrame, x: Column | str, probabilities: Sequence[float], by: Sequence[str] = (), least: int = LEAST) -> DataFrame:
    """Rows (by, p, value): exact quantiles with linear interpolation over the finite values of each group, as percentile() has them."""
    by = list(by)
    values = df.select(*by, clean(col(x).cast("double")).alias("x")).where("x is not null")
    sizes = written(values.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where("__n > 0"), "sizes")
    places = sizes.select(*by, "__n", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")).withColumn("__q", F.col("p") * (F.col("__n") - 1))
    places = places.withColumn("__lo", F.floor("__q").cast("long")).withColumn("__hi", F.ceil("__q").cast("long"))
    ranks = places.select(*by, F.explode(F.array("__lo", "__hi")).alias("r")).distinct()
    found = written(select(values, ranks, by, least), "ranks")
    ends = [found.select(*_named(by, f"__{e}"), F.col("r").alias(f"__r{e}"), F.col("x").alias(f"__x{e}")) for e in ("a", "b")]
    out = places.join(ends[0], _on([*by, "__lo"], [*[f"__a{b}" for b in by], "__ra"])).join(ends[1], _on([*by, "__hi"], [*[f"__b{b}" for b in by], "__rb"]))
    between = (F.col("__hi") - F.col("__q")) * F.col("__xa") + (F.col("__q") - F.col("__lo")) * F.col("__xb")
    return out.select(*by, "p", F.when(F.col("__lo") == F.col("__hi"), F.col("__xa")).otherwise(between).alias("value"))
