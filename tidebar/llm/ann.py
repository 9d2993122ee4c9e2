"""Approximate nearest neighbours by inner product: stable projections, a kd-tree, and a chi-square stopping test.

Vectors are projected to a few dimensions by a fixed Gaussian (2-stable) matrix; the square of a projected distance, divided by
that of the true one, is chi-square distributed with as many degrees of freedom. A row that beats an inner product is nearer to
the query than its own and the query's length and that product allow, so rows of any length share the test.

A kd-tree over the projections of a bounded sample (at most SAMPLE rows) cuts space into cells of about CELL rows, at most one
for 16 rows of the sample; every row is put into its cell. A query first searches its own cell. Then it goes to every other cell
that the stopping test doesn't rule out: one nearer, in the projection, than where a neighbour that beats the query's k-th best
would lie with probability CONFIDENCE. In a block of a cell the rows nearest in the projection are verified on the original
vectors first; the k-th best then bounds how far out the rest is verified by the same test. Verifying is one matrix product of the queries with the rows that any of them needs. The column verified counts, for
each query, the rows that the test has left.

Where neighbours are hardly nearer than other rows (as among random vectors in many dimensions), the test rules out few rows
and no cells, and work grows with queries times rows; it does so more slowly the nearer neighbours are.

Cells are dealt in blocks of at most about CELL rows by a row's place in the table, and queries in blocks of at most about CELL
queries, so neither a crowded cell, a repeated id nor many queries meet in one task; a crowded cell just has more blocks.

Nulls and odd rows: vectors that are null, zero, of another length than most, or hold nulls, NaN or infinities take no part, as
queries or candidates. Ties go to the smaller id. Rows that repeat an id are candidates each, and queries each, with
neighbours of their own (so a query that stands twice gives its rows twice); a query's own id is never its candidate. Extra columns are left out. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidebar.llm.common import cut, forget, table

DIMENSIONS = 16
CONFIDENCE = 0.93
SAMPLE = 1 << 15
CELL = 4096
SEED = 11
TOP = 20


def chi_square(x: np.ndarray, dof: int = DIMENSIONS) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.maximum(x, 0) / 2
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(dof // 2))


def chi_square_at(p: float, dof: int = DIMENSIONS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.float64(mid), dof) < p else (low, mid)
    return high


def projection(size: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The fixed matrix."""
    return np.random.Generator(np.random.PCG64(seed)).normal(size=(size, dimensions))


class Cells:
    """A kd-tree: at each level every cell is cut at the median of its widest dimension."""

    def __init__(self, points: np.ndarray, levels: int):
        self.levels, n = levels, points.shape[1] if len(points) else DIMENSIONS
        self.dims, self.cuts = np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
        parts = [points]
        low, high = [np.full(n, -np.inf)], [np.full(n, np.inf)]
        for level in range(levels):
            new, lows, highs = [], [], []
            for i, p in enumerate(parts):
                d = int(np.argmax(p.max(axis=0) - p.min(axis=0))) if len(p) else 0
                c = float(np.median(p[:, d])) if len(p) else 0.0
                self.dims[(1 << level) + i], self.cuts[(1 << level) + i] = d, c
                right = p[:, d] >= c if len(p) else np.zeros(0, bool)
                a, b = high[i].copy(), low[i].copy()
                a[d] = b[d] = c
                new += [p[~right], p[right]]
                lows += [low[i], b]
                highs += [a, high[i]]
            parts, low, high = new, lows, highs
        self.low, self.high = np.array(low), np.array(high)

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.ones(len(points), np.int64)
        for _ in range(self.levels):
            at = 2 * at + (points[np.arange(len(points)), self.dims[at]] >= self.cuts[at])
        return at - (1 << self.levels)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Square of the distance of a point to each cell's box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(axis=1)


def usable(vectors: DataFrame, size: int) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = vectors.where("vec_id is not null and embedding is not null").select("vec_id", v.alias("v")).where(F.size("v") == size)
    out = out.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))))
    return out.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).where("norm > 0")


FOUND = "query_at long, query_id long, vec_id long, score double, verified long"


def _search(matrix: np.ndarray, top: int, limit: float, slice_: int = 256):
    """Searches a block of a cell for a block of queries: at least one row a query, the first with the number of verified rows."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            ids, x = rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy())
            px, lengths = x @ matrix, (x * x).sum(axis=1)
            far = (px * px).sum(axis=1)
            for a in range(0, len(queries), slice_):
                part = queries.iloc[a : a + slice_]
                q, q_ids, q_at, worst = np.stack(part["v"].to_numpy()), part["vec_id"].to_numpy(), part["at"].to_numpy(), part["best"].to_numpy().copy()
                pq, length = q @ matrix, (q * q).sum(axis=1)[:, None]
                away = far + (pq * pq).sum(axis=1)[:, None] - 2 * (pq @ px.T)
                other = ids != q_ids[:, None]
                first = np.argpartition(away, 4 * top, axis=1)[:, : 4 * top] if len(x) > 4 * top else np.tile(np.arange(len(x)), (len(q), 1))
                # The stopping test: how far out could a row lie that beats the k-th best so far?
                reach = lambda: limit * np.maximum(length + lengths - 2 * worst[:, None], 0) * (1 + 1e-9) + 1e-9  # noqa: B023, E731
                nearest_ = np.take_along_axis(other & (away <= reach()), first, 1)
                scores = np.where(nearest_, np.einsum("qd,qkd->qk", q, x[first]), -math.inf)
                if scores.shape[1] >= top:
                    worst = np.maximum(worst, np.partition(scores, -top, axis=1)[:, -top])
                near = other & (away <= reach())
                np.put_along_axis(near, first, nearest_, 1)
                needed = np.flatnonzero(near.any(axis=0))
                scores = np.where(near[:, needed], q @ x[needed].T, -math.inf)
                slack = 1e-12 * (1 + np.sqrt(length[:, 0] * lengths.max()))
                least = np.partition(scores, -top, axis=1)[:, -top] if len(needed) >= top else np.full(len(q), -math.inf)
                i, j = np.nonzero((scores >= (np.maximum(least, worst) - slack)[:, None]) & near[:, needed])
                # Summed alike for every pair, so that equal vectors tie exactly wherever they are.
                exact, found = (q[i] * x[needed[j]]).sum(axis=1), ids[needed[j]]
                order = np.lexsort((found, -exact, i))
                i, exact, found = i[order], exact[order], found[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, exact, found, place = (y[place < top] for y in (i, exact, found, place))
                verified = np.where(place == 0, near.sum(axis=1)[i], 0)
                none = np.setdiff1d(np.arange(len(q)), i)
                out.append(pd.DataFrame({"query_at": q_at[i], "query_id": q_ids[i], "vec_id": pd.array(found, "Int64"), "score": exact, "verified": verified}))
                out.append(pd.DataFrame({"query_at": q_at[none], "query_id": q_ids[none], "vec_id": pd.array([None] * len(none), "Int64"), "score": np.full(len(none), -math.inf), "verified": near.sum(axis=1)[none]}))
        return pd.concat(out) if out else pd.DataFrame({"query_at": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="Int64"), "score": pd.Series(dtype="float64"), "verified": pd.Series(dtype="int64")})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, confidence: float = CONFIDENCE, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score and verified of the top nearest rows of (vec_id, embedding) for each query (vec_id, embedding)."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    common = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not common or common[0]["size"] < 1:
        return empty
    size = common[0]["size"]
    rows, asked = usable(vectors, size), usable(queries, size)
    total = rows.agg(F.count(F.lit(1)).alias("n")).first()
    if not total.n:
        return empty
    matrix = projection(size)
    levels = min(max(0, math.ceil(math.log2(total.n / cell))), int(math.log2(SAMPLE // 16)))

    def projected(batches):
        for b in batches:
            yield pd.DataFrame({"tie": b["tie"], "p": list(np.stack(b["v"].to_numpy()) @ matrix)}) if len(b) else pd.DataFrame({"tie": [], "p": []})

    points = rows.select(F.xxhash64("vec_id", "v").alias("tie"), "v").mapInPandas(projected, "tie long, p array<double>")
    cells = Cells(np.array([r.p for r in points.orderBy("tie").limit(SAMPLE).collect()]), levels)
    limit = chi_square_at(confidence)

    def located(batches):
        for b in batches:
            b["cell"] = cells.of(np.stack(b["v"].to_numpy()) @ matrix) if len(b) else np.empty(0, np.int64)
            yield b

    placed = rows.select("vec_id", "v").mapInPandas(located, "vec_id long, v array<double>, cell long")
    placed = cut(placed.withColumn("at", F.monotonically_increasing_id()), "cells")
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    kept = {r.cell: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest")).collect()}  # a row a cell
    counts = {c: r.n for c, r in kept.items()}
    longest = np.array([kept[c].longest if c in kept else 0.0 for c in range(1 << levels)])
    blocks = np.array([math.ceil(counts.get(c, 0) / cell) for c in range(1 << levels)])
    n_blocks = F.element_at(F.array(*[F.lit(int(x)) for x in blocks]), F.col("cell").cast("int") + 1)
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("at"), n_blocks).cast("int"))

    sent_: list[DataFrame] = []

    def visits(first: bool):
        """Each query with the cells to search and their blocks."""

        def run(batches):
            for b in batches:
                out = []
                for q_at, q_id, v, own, best in zip(b["at"], b["vec_id"], b["v"], b["cell"], b["best"], strict=True):
                    if first:
                        to = np.array([own])
                    else:
                        v2 = np.asarray(v)
                        within = np.maximum(v2 @ v2 + longest - 2 * best, 0)
                        to = np.flatnonzero(cells.distances(v2 @ matrix) <= limit * within * (1 + 1e-9) + 1e-9)
                        to = to[to != own]
                    to = to[blocks[to] > 0]
                    at = np.repeat(to, blocks[to])
                    block = np.concatenate([np.arange(n) for n in blocks[to]]) if len(to) else np.empty(0, np.int64)
                    out += [(q_at, q_id, v, best, c, k) for c, k in zip(at.tolist(), block.tolist(), strict=True)]
                yield pd.DataFrame(out, columns=["at", "vec_id", "v", "best", "cell", "block"]).astype({"v": object})

        return run

    def searched(from_: DataFrame, first: bool) -> DataFrame:
        sent = cut(from_.mapInPandas(visits(first), "at long, vec_id long, v array<double>, best double, cell long, block int"), "visits")
        sent_.append(sent)
        # Queries of a block of rows are dealt in parts too; each part gets the rows.
        parts = sent.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("parts"))
        left = sent.join(parts, ["cell", "block"]).withColumn("part", F.pmod(F.xxhash64("at"), F.col("parts")).cast("int"))
        right = dealt.join(parts, ["cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        key = ["cell", "block", "part"]
        return left.select(*key, "at", "vec_id", "v", "best").groupBy(*key).cogroup(right.select(*key, "vec_id", "v").groupBy(*key)).applyInPandas(_search(matrix, top, limit), FOUND)

    # Queries are known by a number, so that those that repeat an id or a vector have neighbours each.
    home = asked.select("vec_id", "v").mapInPandas(located, "vec_id long, v array<double>, cell long")
    home = cut(home.withColumn("at", F.monotonically_increasing_id()).withColumn("best", F.lit(-math.inf)), "queries")
    of = W.partitionBy("query_at")
    order = of.orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = lambda df: df.select("*", F.row_number().over(order).alias("rank"), F.sum("verified").over(of).alias("all")).where(F.col("rank") <= top)
    near = cut(ranked(searched(home, True)), "near")
    best = near.where((F.col("rank") == top) & F.col("vec_id").isNotNull()).select(F.col("query_at").alias("q"), F.col("score").alias("kth"))
    again = home.drop("best").join(best, F.col("at") == F.col("q"), "left").select("at", "vec_id", "v", "cell", F.coalesce("kth", F.lit(-math.inf)).alias("best"))
    both = near.select("query_at", "query_id", "vec_id", "score", F.when(F.col("rank") == 1, F.col("all")).otherwise(0).alias("verified")).unionByName(searched(again, False))
    out = cut(ranked(both).where("vec_id is not null").select("query_id", "rank", "vec_id", "score", F.col("all").alias("verified")), "nearest")
    forget(near, placed, home, *sent_)
    return out


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
