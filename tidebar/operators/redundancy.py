"""Which of very many candidate features go with a target, and which of those with one another.

A candidate is (op, i, j): an operation on two columns, or (None, i, i), the column itself. Candidates are never columns of a
frame: tasks make them from their rows' columns as they go, some thousand values at a time, and hold only sums. One scan scores
all candidates against the target (more than STATE bytes of sums are spread over several scans of the same written table, each with
some of the candidates). A second one gives the graph of those pairs of candidates whose correlation reaches a limit: a
task holds some blocks of pairs, adds up its rows and hands the sums on in pieces; only pairs over the limit come out, as
rows. The choice is the first independent set of that graph in the candidates' order, found in rounds, all in Spark.

Correlations are Pearson's over rows where both sides are finite; missing and infinite values aren't used. They count as 0 under
`floor` rows or where they aren't defined."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import OPS
from tidebar.operators.tables import written

FLOOR = 100
#: Bytes of sums in a task.
STATE = 1 << 26
#: Values that a task makes at a time.
VALUES = 1 << 21
BLOCK = 256
PIECE = 8

NUMERIC: dict[str | None, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    None: lambda a, b: a,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: a / b,
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "rel": lambda a, b: (a - b) / (a + b),
}


def values(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """Rows of x (the columns' values; NaN for missing) and y, written for several scans."""
    number = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan")))
    return written(df.select(F.array(*map(number, columns)).alias("x"), (number(target) if target else F.lit(0.0)).alias("y")), "values")


def extended(table: DataFrame, made: Sequence[tuple[str, int, int]]) -> DataFrame:
    """A table of values() with more values: operations (op, i, j) on those it has."""
    new = [F.coalesce(OPS[op](F.get("x", F.lit(i)), F.get("x", F.lit(j))), F.lit(float("nan"))) for op, i, j in made]
    return written(table.select(F.concat("x", F.array(*new)).alias("x"), "y"), "values")


def _share(table: DataFrame, whole: int, state: int) -> int:
    """Bytes of sums for one scan: at most `state`, and less where a table in few files wouldn't use all cores otherwise."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return min(state, max(1 << 20, whole * len(table.inputFiles()) // cores))


def _rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width), batch.column("y").to_numpy(zero_copy_only=False)


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two parts' (n, mean x, mean y, xx, yy, xy), the last three centred: those of both."""
    n = a[0] + b[0]
    with np.errstate(all="ignore"):
        w = np.where(n > 0, a[0] * b[0] / n, 0.0)
        share = np.where(n > 0, b[0] / n, 0.0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + w * dx * dx, a[4] + b[4] + w * dy * dy, a[5] + b[5] + w * dx * dy])


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each column of x with y."""
    ok = np.isfinite(x) & np.isfinite(y)[:, None]
    n = ok.sum(axis=0).astype(float)
    at_least = np.maximum(n, 1)
    x0, y0 = np.where(ok, x, 0.0), np.where(np.isfinite(y), y, 0.0)
    mx, my = x0.sum(axis=0) / at_least, y0 @ ok / at_least
    dx = np.where(ok, x0 - mx, 0.0)
    dy = np.where(ok, y0[:, None] - my, 0.0)
    return np.stack([n, mx, my, (dx * dx).sum(axis=0), (dy * dy).sum(axis=0), (dx * dy).sum(axis=0)])


def _correlation(n, xx, yy, xy, floor: int) -> np.ndarray:
    with np.errstate(all="ignore"):
        r = np.abs(xy / np.sqrt(xx * yy))
    return np.where((n >= floor) & np.isfinite(r), np.minimum(r, 1.0), 0.0)


def scores(table: DataFrame, width: int, ops: Sequence[str | None], done: int = 0, floor: int = FLOOR, state: int = STATE) -> DataFrame:
    """Rows (op, i, j, n, corr, mean, dev) of all candidates over a table of values(): each op on each two columns i < j with j >= done
    (None: each column). mean and dev are the candidate's over the rows used."""
    groups: list[list[tuple[int, int, int]]] = [[]]
    size, state = 0, _share(table, 48 * len(ops) * width * (width + 1) // 2, state)
    for o, op in enumerate(ops):
        for i in range(width):
            first = max(i + 1, done)
            many = 1 if op is None else width - first
            if many <= 0:
                continue
            if size + 48 * many > state and groups[-1]:
                groups.append([])
                size = 0
            groups[-1].append((o, i, first))
            size += 48 * many

    def partial(wanted: list[tuple[int, int, int]]):
        def run(batches: Iterable[pa.RecordBatch]):
            total: dict[tuple[int, int], np.ndarray] = {}
            step = max(64, VALUES // width)
            for batch in batches:
                m, y = _rows(batch, width)
                for at in range(0, len(m), step):
                    part, own = m[at : at + step], y[at : at + step]
                    for o, i, first in wanted:
                        with np.errstate(all="ignore"):
                            made = part[:, i : i + 1] if ops[o] is None else NUMERIC[ops[o]](part[:, i : i + 1], part[:, first:])
                        got = _moments(made, own)
                        total[o, i] = _merged(total[o, i], got) if (o, i) in total else got
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].ravel() for k in keys], pa.list_(pa.float64()))], names=["o", "i", "m"])

        return run

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        o, i = int(part["o"].iloc[0]), int(part["i"].iloc[0])
        total = None
        for m in part["m"]:
            m = np.asarray(m).reshape(6, -1)
            total = m if total is None else _merged(total, m)
        n, mean, _, xx, yy, xy = total
        first = i if ops[o] is None else max(i + 1, done)
        dev = np.sqrt(xx / np.maximum(n, 1))
        return pd.DataFrame({"o": o, "i": i, "j": np.arange(first, first + len(n)), "n": n.astype(np.int64), "corr": _correlation(n, xx, yy, xy, floor), "mean": mean, "dev": dev})

    out = None
    for wanted in groups:
        found = table.mapInArrow(partial(wanted), "o int, i int, m array<double>").groupBy("o", "i").applyInPandas(whole, "o int, i int, j int, n long, corr double, mean double, dev double")
        out = found if out is None else out.unionByName(found)
    name = F.get(F.array(*[F.lit(op).cast("string") for op in ops]), F.col("o"))
    return out.select("o", name.alias("op"), "i", "j", "n", "corr", "mean", "dev")


def graph(table: DataFrame, width: int, candidates: Sequence[tuple[str | None, int, int, float, float]], limit: float, floor: int = FLOOR, block: int = BLOCK, state: int = STATE) -> DataFrame:
    """Rows (u, v, corr), u < v, of the candidates (op, i, j, mean, dev), by their places, whose correlation is at least limit. Means and
    deviations only scale the sums."""
    n = len(candidates)
    starts = list(range(0, n, block))
    pairs = [(a, b) for a in starts for b in starts if a <= b]
    most = max(1, _share(table, 48 * block * block * len(pairs), state) // (48 * block * block))
    mean = np.array([c[3] for c in candidates])
    dev = np.array([c[4] if c[4] > 0 else 1.0 for c in candidates])

    def made(part: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        cols = range(at, min(at + block, n))
        with np.errstate(all="ignore"):
            x = np.stack([NUMERIC[op](part[:, i], part[:, j]) for op, i, j, *_ in (candidates[c] for c in cols)], axis=1)
        ok = np.isfinite(x)
        with np.errstate(all="ignore"):
            return np.where(ok, (x - mean[cols]) / dev[cols], 0.0), ok.astype(float)

    def partial(wanted: list[tuple[int, int]]):
        def run(batches: Iterable[pa.RecordBatch]):
            total: dict[tuple[int, int], np.ndarray] = {}
            step = max(64, VALUES // (2 * block))
            for batch in batches:
                m, _ = _rows(batch, width)
                for at in range(0, len(m), step):
                    part = m[at : at + step]
                    for a in sorted({a for a, _ in wanted}):
                        x, p = made(part, a)
                        for b in (b for c, b in wanted if c == a):
                            y, q = (x, p) if a == b else made(part, b)
                            got = np.stack([p.T @ q, x.T @ q, p.T @ y, (x * x).T @ q, p.T @ (y * y), x.T @ y])
                            if (a, b) in total:
                                total[a, b] += got
                            else:
                                total[a, b] = got
            for (a, b), sums in total.items():
                pieces = range(0, sums.shape[1], PIECE)
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(pieces), pa.int32()), pa.array([b] * len(pieces), pa.int32()), pa.array(list(pieces), pa.int32()), pa.array([sums[:, k : k + PIECE].ravel() for k in pieces], pa.list_(pa.float64()))], names=["a", "b", "k", "m"])

        return run

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        a, b, k = (int(part[c].iloc[0]) for c in ("a", "b", "k"))
        total = 0
        for m in part["m"]:
            total = total + np.asarray(m)
        c, sx, sy, sxx, syy, sxy = total.reshape(6, min(PIECE, n - a - k, block - k), -1)
        at_least = np.maximum(c, 1)
        r = _correlation(c, sxx - sx * sx / at_least, syy - sy * sy / at_least, sxy - sx * sy / at_least, floor)
        i, j = np.nonzero(r >= limit)
        u, v = i + a + k, j + b
        keep = u < v
        return pd.DataFrame({"u": u[keep], "v": v[keep], "corr": r[i, j][keep]})

    out = None
    for at in range(0, len(pairs), most):
        found = table.mapInArrow(partial(pairs[at : at + most]), "a int, b int, k int, m array<double>").groupBy("a", "b", "k").applyInPandas(whole, "u int, v int, corr double")
        out = found if out is None else out.unionByName(found)
    return out


def first_independent(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Of nodes (id) those that a walk by rising id takes, which leaves out what an edge (u, v) joins to one taken before; the first `most`.

    Each round takes the nodes without an undecided neighbour before them, and drops those after them."""
    edges = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "edges")
    open_, taken = nodes.select("id").distinct(), None
    while True:
        waits = open_.join(edges.select(F.col("v").alias("id"), F.lit(True).alias("w")).distinct(), "id", "left")
        after = edges.join(waits.where("w is null").select(F.col("id").alias("u")), "u", "left_semi").select(F.col("v").alias("id"), F.lit(True).alias("g")).distinct()
        state = written(waits.join(after, "id", "left").select("id", F.when(F.col("w").isNull(), "taken").when(F.col("g"), "gone").otherwise("open").alias("state")), "state")
        chosen, open_ = state.where("state = 'taken'").select("id"), state.where("state = 'open'").select("id")
        taken = chosen if taken is None else taken.unionByName(chosen)
        next_ = open_.agg(F.min("id").alias("id")).first()["id"]
        if next_ is None or (most is not None and taken.where(F.col("id") < next_).count() >= most):
            break
        edges = written(edges.join(open_.withColumnRenamed("id", "u"), "u", "left_semi").join(open_.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v"), "edges")
    return taken.orderBy("id").limit(most) if most is not None else taken
