"""Boosted trees against plain loops, the adaptive search, validation folds, saved models."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import boost, model, tpe


def grown(x, y, pred, rows, columns, edges, p):
    """A tree by trying every cut of every leaf: a list of (rows by position, value)."""
    shrink = lambda g: math.copysign(max(abs(g) - p["reg_alpha"], 0.0), g)
    score = lambda g, n: shrink(g) ** 2 / (n + p["reg_lambda"]) if n + p["reg_lambda"] > 0 else 0.0
    g = pred - y
    bins = boost.binned(x, edges)

    def best(at):
        use = at[np.isin(at, rows)]
        out = None
        for c in columns:
            for b in range(1, len(edges[c]) + 2):
                for missing_left in (False, True):
                    left = np.where(bins[:, c] == 0, missing_left, bins[:, c] <= b)
                    a, z = use[left[use]], use[~left[use]]
                    if min(len(a), len(z)) < p["min_child_samples"]:
                        continue
                    gain = score(g[a].sum(), len(a)) + score(g[z].sum(), len(z)) - score(g[use].sum(), len(use))
                    if gain > 1e-12 and (out is None or gain > out[0] * (1 + 1e-9)):
                        out = (gain, at[left[at]], at[~left[at]])
        return out

    leaves = [(np.arange(len(x)), 0)]
    cuts = {0: best(leaves[0][0])}
    while len(leaves) < p["num_leaves"]:
        able = [k for k, (_, d) in enumerate(leaves) if d < p["max_depth"] and cuts[id_(leaves, k)] is not None]
        if not able:
            break
        k = max(able, key=lambda k: cuts[id_(leaves, k)][0])
        _, a, z = cuts[id_(leaves, k)]
        depth = leaves.pop(k)[1] + 1
        for part in (a, z):
            leaves.append((part, depth))
            cuts[tuple(part)] = best(part)
    value = np.zeros(len(x))
    for at, _ in leaves:
        use = at[np.isin(at, rows)]
        n = len(use) + p["reg_lambda"]
        value[at] = -shrink(g[use].sum()) / n if n > 0 else 0.0
    return value


def id_(leaves, k):
    return 0 if len(leaves) == 1 and leaves[k][1] == 0 else tuple(leaves[k][0])


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 5))
    x[:, 3] = rng.integers(0, 3, 160)
    y = np.where(x[:, 0] > 0.3, 1.0, -0.5) + 0.5 * x[:, 1] * (x[:, 3] > 1) + rng.normal(size=160) / 10
    x[rng.random(160) < 0.3, 0] = np.nan
    y[np.isnan(x[:, 0])] += 0.8
    x[rng.random(160) < 0.1, 1] = np.nan
    x[:, 4] = np.nan
    return x, y


@pytest.mark.parametrize("params", [{}, {"num_leaves": 5, "max_depth": 4, "reg_alpha": 0.7, "reg_lambda": 2.0, "min_child_samples": 7}, {"subsample": 0.7, "colsample_bytree": 0.5, "seed": 3, "min_child_samples": 5}, {"n_estimators": 10, "max_depth": 2, "min_child_samples": 1}])
def test_trees_as_brute_force(spark, table, params):
    x, y = table
    p = boost.DEFAULTS | {"n_estimators": 4, "max_bins": 9} | params
    data = pd.DataFrame(x, columns=list("abcde")).assign(y=y)
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None).values.tolist(), "a double, b double, c double, d double, e double, y double").coalesce(1)
    fitted = boost.fit(df, list("abcde"), "y", **p)
    pred = np.full(len(x), y.mean())
    for t in range(p["n_estimators"]):
        rows = np.flatnonzero(boost.kept_rows(np.arange(len(x)), t, p["seed"], p["subsample"]))
        columns = boost.kept_columns(5, t, p["seed"], p["colsample_bytree"])
        pred = pred + p["learning_rate"] * grown(x, y, pred, rows, columns, fitted.edges, p)
    got = np.array([r.pred for r in boost.predict(fitted, df).collect()])
    assert np.allclose(got, pred, atol=1e-9)
    again = boost.Model.from_json(fitted.to_json())
    assert np.array_equal(again.raw(boost.binned(x, again.edges)), got)


def test_samples_and_odd_tables(spark):
    kept = boost.kept_rows(np.arange(100_000), 5, 1, 0.7)
    assert abs(kept.mean() - 0.7) < 0.01 and (kept != boost.kept_rows(np.arange(100_000), 6, 1, 0.7)).any()
    empty = spark.createDataFrame([], "x double, target double")
    assert boost.predict(boost.fit(empty, ["x"]), empty).count() == 0
    flat = spark.createDataFrame([(None, 2.0)] * 30 + [(float("nan"), None)], "x double, target double")
    out = boost.predict(boost.fit(flat, ["x"]), flat.withColumn("pred_", F.lit(1))).collect()
    assert len(out) == 31 and all(r.pred == pytest.approx(2.0) for r in out)


def test_search_beats_random_draws():
    def objective(p):
        return -((math.log(p["learning_rate"] / 0.05)) ** 2 + (p["max_depth"] - 6) ** 2 / 4 + (p["subsample"] - 0.8) ** 2 * 10 + (p["num_leaves"] - 40) ** 2 / 400 + (math.log10(p["reg_alpha"]) + 3) ** 2 / 4)

    wins = 0
    for seed in range(10):
        params, score, history = tpe.search(objective, trials=60, seed=seed)
        assert len(history) == 60 and (params, score) == tpe.search(objective, trials=60, seed=seed)[:2]
        for p, _ in history:
            assert 3 <= p["max_depth"] <= 8 and 8 <= p["num_leaves"] <= min(256, 2 ** p["max_depth"]) and p["n_estimators"] % 50 == 0 and 0.01 <= p["learning_rate"] <= 0.2000001
            assert isinstance(p["num_leaves"], int) and abs(p["subsample"] * 20 - round(p["subsample"] * 20)) < 1e-9
        rng = random.Random(seed)
        wins += score > max(objective(tpe.suggest(tpe.SPACE, [], rng)) for _ in range(60))
    assert wins >= 8


def test_repeated_parameters_are_pruned():
    ran = []
    best, score, history = tpe.search(lambda p: ran.append(p) or float(p["x"]), {"x": tpe.Range(0, 3, whole=True)}, trials=20)
    assert len(ran) == len({r["x"] for r in ran}) <= 4 and sum(s is None for _, s in history) == 20 - len(ran) and score == best["x"]
    assert tpe.search(lambda p: float("nan"), {"x": tpe.Range(0, 1)}, trials=3)[1] == -math.inf


def test_validation_and_tuning(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"ts": range(240), "x": rng.normal(size=240)})
    data["target"] = 2 * data["x"] + rng.normal(size=240) / 5
    data["flat"] = 1.0
    df = spark.createDataFrame(data).coalesce(1)
    p = {"n_estimators": 3, "min_child_samples": 5, "max_depth": 2}
    got = model.cv_corr(df, ["x"], 3, **p)
    for f, c in enumerate(got, 1):
        train, hold = df.where(F.col("ts") < 60 * f), df.where((F.col("ts") >= 60 * f) & (F.col("ts") < (60 * (f + 1) if f < 3 else 240)))
        pred = [r.pred for r in boost.predict(boost.fit(train, ["x"], **p), hold.orderBy("ts")).collect()]
        assert c == pytest.approx(np.corrcoef(pred, data["target"][60 * f : 60 * f + len(pred)])[0, 1], abs=1e-9) and c > 0.7
    assert model.cv_corr(df, ["flat"], 2, n_estimators=1) == [-1.0, -1.0]
    space = {"max_depth": tpe.Range(1, 2, whole=True), "learning_rate": tpe.Range(0.1, 0.5, log=True)}
    params, score = model.tune(df, ["x"], trials=3, k=2, space=space, n_estimators=2, min_child_samples=5)
    assert set(params) == {"max_depth", "learning_rate", "n_estimators", "min_child_samples"} and score == pytest.approx(np.mean(model.cv_corr(df, ["x"], 2, **params)))


def test_complete_rows_means_and_test_periods(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", float("nan")), ("c", None)], "k string, x double")
    assert [r.k for r in model.complete(df).collect()] == ["a"]
    assert model.mean_prediction(df, "x") == 1.5 and model.mean_prediction(df.limit(0), "x") is None
    bars = spark.sql("select 'i' as instrument, timestamp_ntz'2024-01-01' + make_interval(0,0,0,id) as ts, double(id) as close from range(6)")
    ready = bars.select("instrument", "ts", (F.col("close") * 2).alias("band"))
    out = model.after_training(bars, "2024-01-03", ready).orderBy("ts").collect()
    assert [(r.close, r.band) for r in out] == [(3.0, 6.0), (4.0, 8.0), (5.0, 10.0)]
    assert model.after_training(bars, "2024-01-03").columns == bars.columns
