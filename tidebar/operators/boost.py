"""Gradient-boosted trees that take missing values, for squared error: histograms by Spark, leaf by leaf.

Columns are cut into bins once; a row is its bins (0 for missing), its label and its prediction so far. Tasks find each row's node,
add up gradients by (node, column, bin) and hand the sums on; the best cut of each node and column, with the side on which
missing values go, comes from the summed histogram. Of the open leaves the one that gains most is split next, until there are
`num_leaves`. A pass over the rows opens the children of all splits chosen so far, so a tree takes about as many passes as it is deep.
The driver holds trees, and a row a node and column.

Rows are sampled for each tree by a hash of their number, columns by a seeded draw. Leaves are shrunk by L1 and L2."""

from __future__ import annotations

import json
import math
import random
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidebar.functions.columns import clean
from tidebar.operators.tables import written

DEFAULTS = {"n_estimators": 20, "learning_rate": 0.1, "max_depth": 3, "num_leaves": 8, "min_child_samples": 20, "subsample": 1.0, "colsample_bytree": 1.0, "reg_alpha": 0.0, "reg_lambda": 0.0, "seed": 0, "max_bins": 63}
#: Trees between two writings of the predictions.
KEPT = 8


@dataclass
class Tree:
    """Nodes by number; node k has the children left[k] and right[k], or none (-1)."""

    column: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [-1])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, column: int, bin_: int, missing_left: bool) -> tuple[int, int]:
        self.column[node], self.bin[node], self.missing_left[node] = column, bin_, missing_left
        self.left[node], self.right[node] = len(self.column), len(self.column) + 1
        for _ in range(2):
            for name, empty in (("column", -1), ("bin", -1), ("missing_left", False), ("left", -1), ("right", -1), ("value", 0.0)):
                getattr(self, name).append(empty)
        return self.left[node], self.right[node]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        column, cut, missing, left, right = (np.array(x) for x in (self.column, self.bin, self.missing_left, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(left[at] >= 0)
            if not len(inner):
                return at
            k = at[inner]
            b = bins[inner, column[k]]
            at[inner] = np.where(np.where(b == 0, missing[k], b <= cut[k]), left[k], right[k])


@dataclass
class Model:
    features: list[str]
    edges: list[list[float]]
    base: float
    rate: float
    trees: list[Tree]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Model:
        m = json.loads(text)
        return Model(m["features"], m["edges"], m["base"], m["rate"], [Tree(**t) for t in m["trees"]])

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.trees:
            out += self.rate * np.array(t.value)[t.nodes(bins)]
        return out


def binned(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin 0 for missing, k + 1 for values over k edges (a value equal to an edge isn't over it)."""
    out = np.zeros(x.shape, np.int16)
    for j, e in enumerate(edges):
        ok = np.isfinite(x[:, j])
        out[ok, j] = 1 + np.searchsorted(np.array(e), x[ok, j], side="left")
    return out


def bin_edges(df: DataFrame, features: list[str], max_bins: int = 63) -> list[list[float]]:
    """Ascending edges between a column's bins: its quantiles, by a mergeable sketch."""
    grid = ", ".join(f"{k / max_bins!r}D" for k in range(1, max_bins))
    got = df.agg(*[F.percentile_approx(clean(F.col(f"`{c}`").cast("double")), F.expr(f"array({grid})"), F.lit(10_000)).alias(f"e{j}") for j, c in enumerate(features)]).first()
    return [sorted(set(got[f"e{j}"] or [])) for j in range(len(features))]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _values(features: list[str]):
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in features])


def kept_rows(number: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Whether each row is in a tree's sample."""
    if share >= 1:
        return np.ones(len(number), bool)
    x = number.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64 < share


def kept_columns(width: int, tree: int, seed: int, share: float) -> list[int]:
    return sorted(random.Random(f"{seed}:{tree}").sample(range(width), max(1, math.ceil(share * width - 1e-9))))


def _shrunk(g: np.ndarray | float, l1: float) -> np.ndarray | float:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_cut(g: np.ndarray, n: np.ndarray, l1: float, l2: float, least: int) -> tuple[float, int, bool, float, float, float, float]:
    """Gain, bin, side of missing (left?), and gradient and rows of both sides, of the best cut of a histogram whose bin 0 is missing; ties go
    to the lower bin, then right. The gain is 0 where no cut leaves `least` rows on both sides."""
    whole = lambda a, b: _shrunk(a, l1) ** 2 / np.where(b + l2 > 0, b + l2, 1.0)
    all_g, all_n, best = g.sum(), n.sum(), (0.0, -1, False, 0.0, 0.0, 0.0, 0.0)
    gains = []
    for left in (False, True):
        gl, nl = np.cumsum(g[1:]) + left * g[0], np.cumsum(n[1:]) + left * n[0]
        ok = (nl >= least) & (all_n - nl >= least)
        gains.append((np.where(ok, whole(gl, nl) + whole(all_g - gl, all_n - nl) - whole(all_g, all_n), 0.0), gl, nl))
    if not len(gains[0][0]):
        return best
    top = max(x[0].max() for x in gains)
    if top <= 1e-12:
        return best
    for b in range(len(gains[0][0])):
        for left, (gain, gl, nl) in zip((False, True), gains, strict=True):
            if gain[b] >= top * (1 - 1e-9):
                return float(gain[b]), b + 1, left, float(gl[b]), float(nl[b]), float(all_g - gl[b]), float(all_n - nl[b])
    return best


def _cuts(rows: DataFrame, model: Model, tree: Tree, wanted: list[int], columns: list[int], p: dict, number: int) -> dict[int, tuple]:
    """For each wanted node its best (gain, column, bin, missing left, gl, nl, gr, nr)."""
    sizes = [len(e) + 2 for e in model.edges]
    since = Model(model.features, model.edges, 0.0, model.rate, model.trees[len(model.trees) - len(model.trees) % KEPT :])
    most = max(sizes)

    def partial(batches):
        g_all, n_all = np.zeros((len(wanted), len(columns), most)), np.zeros((len(wanted), len(columns), most))
        place = np.full(len(tree.column), -1)
        place[wanted] = np.arange(len(wanted))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _matrix(batch.column("bins"), batch.num_rows)
            keep = kept_rows(batch.column("id").to_numpy(), number, p["seed"], p["subsample"])
            at = place[tree.nodes(bins)]
            use = np.flatnonzero(keep & (at >= 0))
            g = (batch.column("pred").to_numpy() + since.raw(bins) - batch.column("y").to_numpy())[use]
            for k, c in enumerate(columns):
                key = at[use] * most + bins[use, c]
                g_all[:, k] += np.bincount(key, g, len(wanted) * most).reshape(len(wanted), most)
                n_all[:, k] += np.bincount(key, minlength=len(wanted) * most).reshape(len(wanted), most)
        i, k = (x.ravel() for x in np.meshgrid(range(len(wanted)), range(len(columns)), indexing="ij"))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(k, pa.int32()), pa.array(list(g_all.reshape(-1, most)), pa.list_(pa.float64())), pa.array(list(n_all.reshape(-1, most)), pa.list_(pa.float64()))], names=["i", "k", "g", "n"])

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        g, n = (np.sum(np.stack(part[c].to_numpy()), axis=0) for c in ("g", "n"))
        c = columns[int(part["k"].iloc[0])]
        cut = best_cut(g[: sizes[c]], n[: sizes[c]], p["reg_alpha"], p["reg_lambda"], p["min_child_samples"])
        return pd.DataFrame([(int(part["i"].iloc[0]), c, *cut, float(g.sum()), float(n.sum()))], columns=["i", "column", "gain", "bin", "missing_left", "gl", "nl", "gr", "nr", "g", "n"])

    found = rows.mapInArrow(partial, "i int, k int, g array<double>, n array<double>").groupBy("i", "k").applyInPandas(whole, "i int, column int, gain double, bin int, missing_left boolean, gl double, nl double, gr double, nr double, g double, n double").collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.i, r.column)):
        node = wanted[r.i]
        if node not in out or r.gain > out[node][0] * (1 + 1e-9):
            out[node] = (r.gain, r.column, r.bin, r.missing_left, r.gl, r.nl, r.gr, r.nr, r.g, r.n)
    return out


def _grown(rows: DataFrame, model: Model, p: dict, number: int) -> Tree:
    columns = kept_columns(len(model.features), number, p["seed"], p["colsample_bytree"])
    tree, cuts, depth = Tree(), {}, {0: 0}
    leaf = lambda g, n: float(-_shrunk(g, p["reg_alpha"]) / (n + p["reg_lambda"])) if n + p["reg_lambda"] > 0 else 0.0
    # Splits are made ahead of the choice: `tree` holds all that were looked at, `chosen` those that the leaf-wise order takes.
    while True:
        open_, chosen, unknown = [0], [], []
        while len(chosen) < p["num_leaves"] - 1 and not unknown:
            unknown = [k for k in open_ if k not in cuts and depth[k] < p["max_depth"]]
            able = [k for k in open_ if k in cuts and cuts[k][0] > 0 and depth[k] < p["max_depth"]]
            if unknown or not able:
                break
            best = max(able, key=lambda k: (cuts[k][0], -k))
            chosen.append(best)
            open_.remove(best)
            open_ += [tree.left[best], tree.right[best]]
        if not unknown:
            break
        cuts |= _cuts(rows, model, tree, unknown, columns, p, number)
        for k in unknown:
            gain, column, bin_, missing_left, gl, nl, gr, nr, g, n = cuts.setdefault(k, (0.0, -1, -1, False, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
            tree.value[k] = leaf(g, n)
            if gain > 0:
                for child, (cg, cn) in zip(tree.split(k, column, bin_, missing_left), ((gl, nl), (gr, nr)), strict=True):
                    tree.value[child], depth[child] = leaf(cg, cn), depth[k] + 1
    for k in range(len(tree.column)):  # what wasn't chosen is a leaf
        if k not in chosen:
            tree.left[k] = tree.right[k] = -1
    return tree


def fit(train: DataFrame, features: list[str], label: str = "target", edges: list[list[float]] | None = None, **params) -> Model:
    """Rows without a finite label are left out. Parameters: see DEFAULTS."""
    p = DEFAULTS | params
    train = train.where(clean(F.col(label).cast("double")).isNotNull())
    edges = edges if edges is not None else bin_edges(train, features, p["max_bins"])

    def cut(batches):
        for b in batches:
            bins = binned(_matrix(b.column("x"), b.num_rows), edges) if b.num_rows else np.empty((0, len(features)), np.int16)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(bins), pa.list_(pa.int16())), b.column("y"), pa.array(np.zeros(b.num_rows))], names=["id", "bins", "y", "pred"])

    raw = written(train.select(F.monotonically_increasing_id().alias("id"), _values(features).alias("x"), F.col(label).cast("double").alias("y")), "train")
    base = raw.agg(F.avg("y")).first()[0]
    model = Model(list(features), edges, base or 0.0, p["learning_rate"], [])
    if base is None:
        return model
    schema = "id long, bins array<smallint>, y double, pred double"
    rows = written(raw.mapInArrow(cut, schema).withColumn("pred", F.lit(base)), "binned")
    for number in range(p["n_estimators"]):
        model.trees.append(_grown(rows, model, p, number))
        if len(model.trees) % KEPT == 0 and number + 1 < p["n_estimators"]:
            since = Model(model.features, edges, 0.0, model.rate, model.trees[-KEPT:])

            def advanced(batches, since=since):
                for b in batches:
                    new = b.column("pred").to_numpy() + (since.raw(_matrix(b.column("bins"), b.num_rows)) if b.num_rows else 0.0)
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("bins"), b.column("y"), pa.array(new)], names=["id", "bins", "y", "pred"])

            rows = written(rows.mapInArrow(advanced, schema), "binned")
    return model


def predict(model: Model, df: DataFrame) -> DataFrame:
    """Adds pred. Values between or beyond the training's fall into the bins where they lie."""
    own = list(df.columns)
    schema = StructType([*df.schema.fields, StructField("pred", DoubleType())])

    def run(batches):
        for b in batches:
            x = _matrix(b.column("__x"), b.num_rows) if b.num_rows else np.empty((0, len(model.features)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], pa.array(model.raw(binned(x, model.edges)))], names=[*own, "pred"])

    return df.select(*[F.col(f"`{c}`") for c in own], _values(model.features).alias("__x")).mapInArrow(run, schema)
