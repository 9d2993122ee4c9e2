"""Operators for series, tables and candidate sets of any size, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import ewm, quantiles, redundancy, scan, screening


def greedy(scores, related, most, limit):
    taken = []
    for i in sorted(range(len(scores)), key=lambda i: -scores[i]):
        if len(taken) < most and not any(related[i, j] >= limit for j in taken):
            taken.append(i)
    return taken


@pytest.fixture(scope="module")
def long_series(spark):
    """One series with most rows, short ones, a null one, one without values; parts are small."""
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    rng = np.random.default_rng(4)
    rows = []
    for name, n in (("big", 9000), ("small", 40), ("one", 1), (None, 30)):
        close = np.round(100 + np.cumsum(rng.normal(size=n)), 4)
        rows += [(name, i, None if name == "small" and i < 3 else float(c), int(v)) for i, (c, v) in enumerate(zip(close, rng.integers(0, 5, n), strict=True))]
    rows += [("none", i, None, 1) for i in range(5)]
    data = pd.DataFrame(rows, columns=["instrument", "ts", "close", "volume"]).astype({"instrument": object})
    df = spark.createDataFrame(rows, "instrument string, ts long, close double, volume long").repartition(7)
    yield df, data
    for k, v in before.items():
        spark.conf.set(k, v)


def by_key(df, *columns):
    return {(r.instrument, r.ts): [r[c] for c in columns] for r in df.collect()}


def test_numbers_and_running_values(long_series):
    df, data = long_series
    got = by_key(scan.numbered(df, "i"), "i")
    assert all(v == [k[1]] for k, v in got.items()) and len(got) == len(data)
    parts = {r["__part"]: r["count"] for r in scan.numbered(df.where("instrument = 'big'"), "i").groupBy("__part").count().collect()}
    assert len(parts) > 1 and max(parts.values()) < 0.6 * 9000
    out = scan.running(df, total=("sum", "volume"), top=("max", "close"), low=("min", "close"), last=("last", F.when(F.col("volume") > 3, F.col("close"))), first=("first", "close"))
    got = by_key(out, "total", "top", "low", "last", "first")
    for name, part in data.groupby("instrument", dropna=False):
        close = part["close"].astype(float)
        want = pd.DataFrame({"total": part["volume"].cumsum(), "top": close.cummax().ffill(), "low": close.cummin().ffill(), "last": close.where(part["volume"] > 3).ffill(), "first": close.bfill().where(close.notna().cummax())})
        if close.notna().any():
            want["first"] = close.dropna().iloc[0]
            want.loc[~close.notna().cummax(), "first"] = np.nan
        for ts, w in zip(part["ts"], want.itertuples(index=False), strict=True):
            key = (None if pd.isna(name) else name, ts)
            assert all((g is None and pd.isna(x)) or g == pytest.approx(x, abs=1e-9) for g, x in zip(got[key], w, strict=True))


@pytest.mark.parametrize("alpha", [0.5, 0.02])
def test_long_decays_are_those_of_windows(long_series, alpha):
    df, _ = long_series
    df = df.where("instrument is null or instrument != 'none'")

    def made(engine):
        out = ewm.means(df, alpha, True, engine=engine, a="close")
        out = ewm.means(out, alpha, False, engine=engine, b="close")
        out = ewm.sums(out, alpha, engine=engine, c=F.col("volume").cast("double"))
        out = ewm.weighted(out, alpha, engine=engine, d="close")
        out = ewm.mean_and_std(out, alpha, "close", "e", "f", engine=engine)
        out = ewm.efficiency(out, alpha, "g", engine=engine)
        return by_key(ewm.slope(out, alpha, "h", engine=engine), *"abcdefgh")

    one, two = made(ewm.Decay), made(scan.Long)
    assert one.keys() == two.keys()
    for k, want in one.items():
        assert all((a is None and b is None) or a == pytest.approx(b, rel=1e-7, abs=1e-7) for a, b in zip(two[k], want, strict=True)), (k, two[k], want)


@pytest.mark.parametrize("least", [1 << 13, 50])
def test_quantiles_as_percentile(spark, least):
    rng = np.random.default_rng(6)
    rows = [("skew", float(x)) for x in np.exp(rng.normal(0, 40, 3000))] + [("ties", float(x)) for x in rng.integers(0, 3, 2000)] + [("flat", 2.0)] * 500 + [(None, -0.5), (None, 4.0)]
    rows += [("one", 7.0), ("skew", None), ("ties", float("nan")), ("void", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    ps = [0.0, 0.013, 0.25, 0.5, 0.75, 0.9999, 1.0]
    got = {(r.k, r.p): r.value for r in quantiles.quantiles(df, "x", ps, ["k"], least).collect()}
    want = df.where("not isnan(x)").groupBy("k").agg(F.expr(f"percentile(x, array({', '.join(map(str, ps))}))").alias("q")).where("q is not null").collect()
    assert len(got) == 7 * 5
    for r in want:
        for p, q in zip(ps, r.q, strict=True):
            assert got[r.k, p] == pytest.approx(q, rel=1e-12)
    whole = quantiles.quantiles(df, "x", [0.5], least=least).first().value
    assert whole == df.where("not isnan(x)").agg(F.expr("percentile(x, 0.5)")).first()[0]
    assert quantiles.quantiles(df.limit(0), "x", [0.5], ["k"]).count() == 0


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame(rng.normal(size=(700, 6)), columns=list("abcdef"))
    data["c"] = data["a"] + rng.normal(size=700) / 10
    data["d"] = 3.0
    data.loc[:50, "b"] = np.nan
    data.loc[100:, "f"] = np.nan
    data["y"] = data["a"] * data["b"] + rng.normal(size=700)
    data.loc[3:9, "y"] = np.nan
    data.loc[10, "e"] = 0.0
    df = spark.createDataFrame(data).repartition(5)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns]), data


def candidate(data, op, a, b):
    with np.errstate(all="ignore"):
        x = redundancy.NUMERIC[op](data[a].to_numpy(), data[b].to_numpy())
    return np.where(np.isfinite(x), x, np.nan)


def corr(x, y, floor):
    ok = np.isfinite(x) & np.isfinite(y)
    if ok.sum() < floor:
        return 0.0
    with np.errstate(all="ignore"):
        r = abs(np.corrcoef(x[ok], y[ok])[0, 1])
    return r if np.isfinite(r) and min(x[ok].std(), y[ok].std()) > 1e-12 else 0.0


@pytest.mark.parametrize("state", [1 << 26, 500])
def test_scores_of_all_candidates(matrix, state):
    df, data = matrix
    names, ops = list("abcdef"), ["mul", "div", "rel", None]
    table = redundancy.values(df, names, "y")
    got = {(r.op, r.i, r.j): (r.n, r["corr"]) for r in redundancy.scores(table, 6, ops, floor=150, state=state).collect()}
    assert len(got) == 3 * 15 + 6
    for (op, i, j), (n, r) in got.items():
        x, y = candidate(data, op, names[i], names[j]), data["y"].to_numpy()
        assert n == (np.isfinite(x) & np.isfinite(y)).sum() and r == pytest.approx(corr(x, y, 150), abs=1e-9)
    later = redundancy.scores(table, 6, ["add"], done=4).collect()
    assert sorted((r.i, r.j) for r in later) == [(i, j) for i in range(6) for j in range(max(i + 1, 4), 6)]


@pytest.mark.parametrize("block", [256, 4])
def test_graph_holds_the_pairs_over_the_limit(matrix, block):
    df, data = matrix
    names = list("abcdef")
    table = redundancy.values(df, names, "y")
    scored = redundancy.scores(table, 6, ["mul", "add", "sub"], floor=1).orderBy(F.desc("corr"), "o", "i", "j").collect()
    got = {(r.u, r.v): r["corr"] for r in redundancy.graph(table, 6, [(r.op, r.i, r.j, r["mean"], r.dev) for r in scored], 0.5, 150, block, state=48 * block * block).collect()}
    made = [candidate(data, r.op, names[r.i], names[r.j]) for r in scored]
    want = {(u, v): c for u in range(len(made)) for v in range(u + 1, len(made)) if (c := corr(made[u], made[v], 150)) >= 0.5}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(c, abs=1e-9) for k, c in want.items()) and len(want) > 10


@pytest.mark.parametrize("most", [None, 7])
def test_independent_set_as_sequential(spark, most):
    rng = np.random.default_rng(9)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 300, (900, 2)) if a != b} | {(i, i + 1) for i in range(250, 299)}
    near = np.zeros((300, 300))
    for a, b in pairs:
        near[a, b] = near[b, a] = 1
    want = greedy([-i for i in range(300)], near, most or 300, 0.5)
    nodes = spark.range(300).select(F.col("id").cast("int").alias("id"))
    got = redundancy.first_independent(nodes, spark.createDataFrame(list(pairs), "u int, v int"), most)
    assert sorted(r.id for r in got.collect()) == want
    assert redundancy.first_independent(nodes.limit(0), spark.createDataFrame([], "u int, v int")).count() == 0


def test_generated_features_as_a_sequential_choice(spark, matrix):
    """Two iterations with small limits, against loops over pandas columns."""
    df, data = matrix
    data = data.copy()
    names, recipes, done = list("abcde"), [], 0
    for it in (1, 2):
        found = []
        for o, op in enumerate(screening.OPS):
            for i in range(len(names)):
                for j in range(max(i + 1, done), len(names)):
                    c = corr(candidate(data, op, names[i], names[j]), data["y"].to_numpy(), 100)
                    if c >= 0.05:
                        found.append((-round(c, 10), o, i, j, op, c))
        done, kept = len(names), []
        for _, _, i, j, op, c in sorted(found)[:40]:
            x = candidate(data, op, names[i], names[j])
            if len(kept) < 5 and not any(corr(x, k, 100) >= 0.9 for k, *_ in kept):
                kept.append((x, f"g{it}_{op}__{names[i]}__{names[j]}", c))
        for x, n, c in kept:
            data[n] = x
            names.append(n)
            recipes.append((n, round(float(c), 6)))
    got = screening.generate(df, "y", list("abcde"), least=0.05, inter=0.9, new=5, screened=40)
    assert [(r["name"], r["train_corr"]) for r in got] == recipes and len(recipes) == 10


def test_selection_and_prefilter(matrix):
    df, data = matrix
    filled = data.fillna({c: data[c].mean() for c in "abcdef"})
    score = {c: corr(filled[c].to_numpy(), filled["y"].to_numpy(), 1) for c in "abcdef"}
    order = sorted((c for c in "abcdef" if score[c] > 0), key=lambda c: -score[c])
    want = []
    for c in order:
        if not any(corr(filled[c].to_numpy(), filled[k].to_numpy(), 1) >= 0.9 for k in want):
            want.append(c)
    assert screening.select(df, list("abcdef"), "y") == want
    whole = {c: corr(data[c].to_numpy(), data["y"].to_numpy(), 100) for c in "abcdef"}
    assert screening.prefilter(df, list("abcdef"), "y", 0.02) == [c for c in "abcdef" if whole[c] >= 0.02]
