"""Feature screening: correlations in long form, generated pairs, recipes, greedy selection, folds in time."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window as W

from tidebar.functions.columns import OPS, clean, correlation
from tidebar.operators import redundancy

FLOOR = 100
CHUNK = 512
STRETCH = 10_000


def correlations(df: DataFrame, candidates: dict[str, Column], target: str, floor: int = FLOOR) -> DataFrame:
    """name, n and |corr| with the target over rows that have both; 0 under floor rows or where it isn't defined.

    Each row becomes one row a candidate, and one aggregation gives all: partial sums before the shuffle."""
    names = list(candidates)
    out = None
    for at in range(0, len(names), CHUNK):
        part = names[at : at + CHUNK]
        long = df.select(F.col(target).alias("y"), F.posexplode(F.array(*[clean(candidates[n].cast("double")) for n in part])).alias("pos", "x")).where("x is not null and y is not null")
        found = long.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.abs(correlation("x", "y")).alias("c"))
        named = found.select(F.get(F.array(*map(F.lit, part)), F.col("pos")).alias("name"), "n", F.when(F.col("n") >= floor, F.coalesce(clean("c"), F.lit(0.0))).otherwise(0.0).alias("corr"))
        out = named if out is None else out.unionByName(named)
    return out


def prefilter(df: DataFrame, columns: list[str], target: str, least: float = 0.03, floor: int = FLOOR) -> list[str]:
    table = redundancy.values(df, columns, target)
    found = {r.i for r in redundancy.scores(table, len(columns), [None], floor=floor).where(F.col("corr") >= least).collect()}
    return [c for i, c in enumerate(columns) if i in found]


def pair_candidates(names: list[str], done: int = 0) -> dict[tuple[str, str, str], Column]:
    """Every operation on every unordered pair with a member beyond the first `done` names."""
    pairs = [(a, b) for (_, a), (j, b) in combinations(enumerate(names), 2) if j >= done]
    return {(op, a, b): f(F.col(a).cast("double"), F.col(b).cast("double")) for op, f in OPS.items() for a, b in pairs}


def generate(df: DataFrame, target: str, columns: list[str], iterations: int = 2, least: float = 0.02, inter: float = 0.95, new: int = 200, screened: int = 3000, floor: int = FLOOR) -> list[dict]:
    """Ordered recipes {name, op, a, b, train_corr} of pairs that go with the target and not too much with one another.

    Candidates are scored in one scan and compared in another (see redundancy); the driver gets the `screened` best of them, and the
    places of those chosen. Scores that agree to ten digits are ties, which go by operation, then pair."""
    names, recipes, done, ops = list(columns), [], 0, list(OPS)
    table = redundancy.values(df, names, target)
    for it in range(1, iterations + 1):
        width, made = len(names), []
        scored = redundancy.scores(table, width, ops, done, floor).where(F.col("corr") >= least)
        top = scored.orderBy(F.desc(F.round("corr", 10)), "o", "i", "j").limit(screened).collect()
        done = width
        for at in _spread([(r.op, r.i, r.j, r["mean"], r.dev) for r in top], table, width, inter, new, floor):
            r = top[at]
            a, b = names[r.i], names[r.j]
            recipes.append({"name": f"g{it}_{r.op}__{a}__{b}", "op": r.op, "a": a, "b": b, "train_corr": round(float(r["corr"]), 6)})
            names.append(recipes[-1]["name"])
            made.append((r.op, r.i, r.j))
        if not made:
            break
        if it < iterations:
            table = redundancy.extended(table, made)
    return recipes


def _spread(candidates: list[tuple], table: DataFrame, width: int, limit: float, most: int, floor: int) -> list[int]:
    """Places of what a greedy choice takes of the candidates in their order."""
    if not candidates:
        return []
    edges = redundancy.graph(table, width, candidates, limit, floor)
    nodes = table.sparkSession.range(len(candidates)).select(F.col("id").cast("int").alias("id"))
    return [r.id for r in redundancy.first_independent(nodes, edges, most).orderBy("id").collect()]


def apply(df: DataFrame, recipes: list[dict]) -> DataFrame:
    """Adds the recipes' columns in their order, one projection a layer; recipes whose inputs are missing are skipped."""
    left = list(recipes)
    while left:
        have = set(df.columns)
        ready = [r for r in left if r["a"] in have and r["b"] in have]
        if not ready:
            break
        df = df.select("*", *[OPS[r["op"]](F.col(r["a"]).cast("double"), F.col(r["b"]).cast("double")).alias(r["name"]) for r in ready if r["name"] not in have])
        left = [r for r in left if r not in ready]
    return df


def select(df: DataFrame, columns: list[str], target: str, most: int = 300, inter: float = 0.9) -> list[str]:
    """Greedy choice by |corr| with the target after missing values became their column's mean; none with a zero correlation."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    full = df.select(F.col(target), *[F.coalesce(F.col(c), F.lit(means[c])).alias(c) for c in columns])
    table, width = redundancy.values(full, columns, target), len(columns)
    found = redundancy.scores(table, width, [None], floor=1).where("corr > 0").collect()  # a row a column
    top = sorted(found, key=lambda r: (-round(r["corr"], 10), r.i))
    return [columns[top[at].i] for at in _spread([(None, r.i, r.i, r["mean"], r.dev) for r in top], table, width, inter, most, 1)]


def timed_folds(df: DataFrame, k: int, order: str = "ts") -> DataFrame:
    """Adds fold (0 for rows only ever trained on, else 1..k): fold f is validated after training on all rows before it.

    Blocks have n // (k + 1) rows; the last takes the rest. Ranks are within the whole table, so this is for one series' rows:
    a row's rank is that in its day (or stretch of a number), after the rows of the days before (one row a day)."""
    if k < 2:
        raise ValueError("at least two folds")
    day = F.floor(F.col(order) / STRETCH) if isinstance(df.schema[order].dataType, NumericType) else F.to_date(order)
    days = df.groupBy(day.alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = days.select("__day", before.alias("__before"), F.floor(F.sum("__n").over(W.partitionBy()) / (k + 1)).alias("__block"))
    ranked = df.withColumn("__own", day).withColumn("__i", F.row_number().over(W.partitionBy("__own").orderBy(order)) - 1)
    place = F.floor((F.col("__before") + F.col("__i")) / F.greatest(F.col("__block"), F.lit(1)))
    return ranked.join(days, F.col("__own").eqNullSafe(F.col("__day"))).select(*df.columns, F.least(place, F.lit(k)).cast("int").alias("fold"))


def period_corr(df: DataFrame, x: str, y: str, period: Column, least: int = 2) -> DataFrame:
    return df.groupBy(period.alias("period")).agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), correlation(x, y).alias("corr")).where(F.col("n") >= least)


def null_columns(df: DataFrame) -> list[str]:
    """Columns without a value, by one aggregation."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if not counts[c]]
