from datetime import datetime, timedelta
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.functions.columns import in_minutes, is_main_session, order_id
from tidebar.operators import asof, candles, ewm, features, grid, model, screening, spec, stats, strategies
from tidebar.operators import windows as win
from tidebar.operators.candles import KEY
from tidebar.streaming import live

START = datetime(2024, 1, 1, 6)


@pytest.fixture(scope="module")
def walk():
    """Two series of 400 bars of 15 minutes each."""
    rng, rows = np.random.default_rng(5), []
    for name in ("a", "b"):
        close = 100 + np.cumsum(rng.normal(size=400))
        for i, c in enumerate(close):
            rows.append((name, START + timedelta(minutes=15 * i), c + rng.normal() / 5, c + 1, c - 1, float(c), int(rng.integers(0, 9))))
    return pd.DataFrame(rows, columns=[KEY, "ts", "open", "high", "low", "close", "volume"])


@pytest.fixture(scope="module")
def bars(spark, walk):
    return spark.createDataFrame(walk).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def frame(df):
    return df.toPandas().sort_values([KEY, "ts"]).reset_index(drop=True)


@pytest.mark.parametrize("alpha", [0.01, 0.5])
@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_mean_as_pandas(bars, walk, alpha, adjust):
    got = frame(ewm.means(bars, alpha, adjust, m="close"))["m"]
    want = walk.groupby(KEY)["close"].transform(lambda x: x.ewm(alpha=alpha, adjust=adjust).mean())
    assert np.allclose(got, want, atol=1e-9)


def test_ewm_std_as_pandas(bars, walk):
    got = frame(ewm.mean_and_std(bars, 0.05, "close", "m", "s"))
    want = walk.groupby(KEY)["close"].transform(lambda x: x.ewm(alpha=0.05).std())
    assert np.allclose(got["s"], want, atol=1e-8, equal_nan=True)


def test_extended_catalogue(bars):
    made = [n for n in features.extended(bars).columns if n not in (KEY, "ts", *features.OHLC)]
    assert len(made) == len(set(made)) == 537 and ewm.tag(0.05) == "a05"


def test_extended_values(bars, walk):
    got = frame(features.extended(bars, alphas=(0.05, 0.5), lags=(2,)))
    one = walk[walk[KEY] == "a"].reset_index(drop=True)
    got = got[got[KEY] == "a"].reset_index(drop=True)
    c, v = one["close"], one["volume"].astype(float)
    mean = lambda x: x.ewm(alpha=0.05, adjust=False).mean()
    ref = v.where(v > 0).ffill()
    want = {"vwap_a05": mean(c * v) / mean(v).where(lambda s: s > 0) / c - 1, "cd2_ewm_a05": mean(c.diff(2)) / c, "vd1": v.diff() / ref, "vm_a05": mean(v) / ref, "vsum_a05": v.ewm(alpha=0.05).sum() / ref, "macd_a5_a05": (c.ewm(alpha=0.5, adjust=False).mean() - mean(c)) / c}
    for n, x in want.items():
        assert np.allclose(got[n].astype(float), x.replace([np.inf, -np.inf], np.nan), atol=1e-9, equal_nan=True), n
    assert np.allclose(got["cd2_ewm_a05_lag2"].astype(float), got["cd2_ewm_a05"].astype(float).shift(2), equal_nan=True)


def test_ewm_prefix(bars):
    """What comes later changes nothing before."""
    whole = ewm.means(bars, 0.05, True, m="close")
    half = ewm.means(bars.where(F.col("ts") < F.lit(START + timedelta(hours=50)).cast("timestamp_ntz")), 0.05, True, m="close")
    assert half.select(KEY, "ts", F.round("m", 9)).exceptAll(whole.select(KEY, "ts", F.round("m", 9))).count() == 0


def test_flat_series_has_no_score(spark):
    flat = spark.createDataFrame([("a", START + timedelta(minutes=i), 5.0, 5.0, 5.0, 5.0, 1) for i in range(20)], [KEY, "ts", "open", "high", "low", "close", "volume"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert strategies.z_indicator(flat, 0.1).where("__z is not null").count() == 0
    assert features.base(flat).where("body_frac != 0 or close_pos != 0.5").count() == 0


def test_trend_has_no_sign_before_closes_vary(spark):
    """While all closes are equal both means are that close, whatever it is; after that the trend is the change's, and missing at a close of 0."""
    rows = [(f"s{k}", START + timedelta(hours=i), *[float(c)] * 4, 1) for k in range(40) for i, c in enumerate([0.07 + 3.31 * k] * 5 + [500.0, 0.5])]
    rows += [("zero", START, *[0.0] * 4, 1)]
    out = features.base(spark.createDataFrame(rows, [KEY, "ts", *features.OHLC])).select(KEY, "ts", "trend").toPandas()
    some, late = out[KEY] != "zero", out["ts"] >= START + timedelta(hours=5)
    assert (out.loc[some & ~late, "trend"] == 0).all() and (out.loc[some & late, "trend"] != 0).all()
    assert out.loc[~some, "trend"].isna().all()


@pytest.mark.parametrize("make", [features.base, lambda b: strategies.vw_bands(b, 0.05), lambda b: win.run_lengths(b.withColumn("f", F.col("volume") > 3), "f", "run"), lambda b: spec.indicators(b)])
def test_no_lookahead(bars, make):
    """Bars after a time are changed; nothing up to it changes."""
    cut = F.lit(START + timedelta(hours=60)).cast("timestamp_ntz")
    changed = bars.withColumns({c: F.when(F.col("ts") > cut, F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    a, b = (make(x).where(F.col("ts") <= cut).drop("in_session") for x in (bars, changed))
    flat = lambda df: df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    assert flat(a).exceptAll(flat(b)).count() == 0


def simulate(b, z, hold, entry, fee=5e-4):
    """A loop of our own for one series."""
    pos, since, fills, session = 0, 0, [], [420 <= t.hour * 60 + t.minute < 945 for t in b["ts"]]
    for i in range(1, len(b)):
        p = i - 1
        last = b["ts"][p].date() != b["ts"][i].date()
        if np.isnan(z[p]) or last or session[p] and not session[i]:
            want = 0
        elif pos:
            want = 0 if pos > 0 and z[p] >= 0 or pos < 0 and z[p] <= 0 or i - since >= hold else pos
        else:
            want = 0 if not session[p] else 1 if z[p] <= -entry else -1 if z[p] >= entry else 0
        if want != pos:
            fills.append((i, want - pos))
            since, pos = (i, want) if pos == 0 else (since, want)
    return fills


def test_fold_as_a_loop(bars, walk):
    filled = strategies.fills(bars, strategies.z_score(bars, alpha=0.05, z_entry=1.0, max_hold=7)).toPandas()
    z = frame(strategies.z_indicator(bars, 0.05))
    for name in ("a", "b"):
        b = walk[walk[KEY] == name].reset_index(drop=True)
        want = simulate(b, z[z[KEY] == name]["__z"].to_numpy(dtype=float), 7, 1.0)
        got = filled[filled[KEY] == name].sort_values("i")
        assert list(zip(got["i"], got["qty"], strict=True)) == want


def test_predictions_tilt_and_gate(bars):
    """1.0 is neutral, missing blocks entries."""
    plain = strategies.fold(strategies.z_score(bars, 0.05, 1.0, 9), [KEY])
    neutral = strategies.fold(strategies.z_score(bars.withColumn("pred", F.lit(1.0)), 0.05, 1.0, 9, predictions=True), [KEY])
    assert plain.exceptAll(neutral).count() == 0 and neutral.count() == plain.count()
    assert strategies.fold(strategies.z_score(bars.withColumn("pred", F.lit(None).cast("double")), 0.05, 1.0, 9, predictions=True), [KEY]).count() == 0


def test_equity_identity(bars):
    path = strategies.equity(bars, strategies.fills(bars, strategies.z_score(bars, 0.05, 1.0, 9)))
    assert path.where(F.abs(F.col("equity") - F.col("cash") - F.col("position") * F.col("close")) > 1e-9).count() == 0
    got = stats.strategy(path).collect()
    assert {r.n_trades for r in got} == {r["count"] for r in path.where("qty != 0").groupBy(KEY).count().collect()}


def test_asof_ties_and_sides(spark):
    t = lambda m: START + timedelta(minutes=m)
    probe = spark.createDataFrame([("a", t(0)), ("a", t(10)), ("a", t(15))], f"{KEY} string, ts timestamp_ntz")
    source = spark.createDataFrame([("a", t(10), 1.0), ("a", t(12), 2.0)], f"{KEY} string, ts timestamp_ntz, x double")
    get = lambda **o: [r.x for r in asof.backward(probe, source, ["x"], **o).orderBy("ts").collect()]
    assert get() == [None, 1.0, 2.0] and get(strict=True) == [None, None, 2.0]


def test_resample_edges(spark):
    rows = [(1, START, "a", 1.0), (2, START + timedelta(minutes=14, seconds=59), "a", 3.0), (3, START + timedelta(minutes=15), "a", 2.0)]
    got = candles.resample(spark.createDataFrame(rows, "event_id int, ts timestamp_ntz, event_type string, value double"), "15min").orderBy("ts").collect()
    assert [(r.open, r.close, r.volume) for r in got] == [(1.0, 3.0, 2), (2.0, 2.0, 1)]


def test_days_without_bars_are_filled(spark):
    rows = [("a", START, 1.0, 2), ("a", START + timedelta(days=3), 4.0, 5)]
    got = candles.daily_close(spark.createDataFrame(rows, f"{KEY} string, ts timestamp_ntz, close double, volume long")).orderBy("day").collect()
    assert [(r.close, r.volume) for r in got] == [(1.0, 2), (1.0, 0), (1.0, 0), (4.0, 5)]


def test_merge_prefers(spark):
    old, new = (spark.createDataFrame([("a", START, x)], f"{KEY} string, ts timestamp_ntz, close double") for x in (1.0, 2.0))
    assert candles.merge(old, new).first().close == 1.0 and candles.merge(old, new, "fresh").first().close == 2.0


@pytest.mark.parametrize(("minute", "inside"), [(419, False), (420, True), (939, True), (940, False)])
@pytest.mark.parametrize("day", [5, 6])
def test_session(spark, minute, inside, day):
    at = datetime(2024, 1, day) + timedelta(minutes=minute)
    df = spark.createDataFrame([(at,)], "ts timestamp_ntz").select(is_main_session().alias("m"), in_minutes(420, 940).alias("i")).first()
    assert df.m == (inside and day == 5) and df.i == inside


def test_state_table(spark):
    """All 36 inputs: the column form and the row form agree, and only the allowed changes happen."""
    cases = [(p, u, low, up, g) for p, u, (low, up), g in product((-1, 0, 1), (True, False), ((True, False), (False, True), (False, False)), (True, False))]
    assert len(cases) == 36
    df = spark.createDataFrame(cases, "p int, u boolean, lo boolean, hi boolean, g boolean")
    for r in df.withColumn("new", spec.next_signal(*[F.col(c) for c in ("p", "u", "lo", "hi", "g")])).collect():
        assert r.new == live.transition(r.p, r.u, r.lo, r.hi, r.g)
        assert r.p == 0 or r.new in (0, r.p)
        assert r.p != 0 or r.new == 0 or r.g


def test_both_bands_at_once_is_the_lower():
    assert live.transition(0, True, True, True, True) == 1 and live.transition(0, False, True, True, True) == 0


def test_accounts(spark):
    rows = [("a", START + timedelta(hours=i), 1.0, 2.0, 1.0, 1.5, 5, 0, q, p, f, pos, cash, cash + pos * 1.5) for i, (q, p, f, pos, cash) in enumerate([(0.0, None, 0.0, 0.0, 0.0), (2.0, 1.5, 0.1, 2.0, -3.1), (-2.0, 2.0, 0.1, 0.0, 0.8)])]
    path = spark.createDataFrame(rows, f"{KEY} string, ts timestamp_ntz, open double, high double, low double, close double, volume long, signal int, qty double, fill_price double, fees double, position double, cash double, equity double")
    assert spec.violations(path).count() == 0
    assert [r.broken for r in spec.violations(path.withColumn("cash", F.col("cash") + (F.col("qty") < 0).cast("int"))).collect()].count("cash") == 1
    again = spec.reconstruct(spec.event_log(path))
    assert spec.drift(path, again).where("not same_signal or abs(position_diff) > 1e-9 or abs(equity_diff) > 1e-9").count() == 0
    halt = spark.createDataFrame([("a", START + timedelta(hours=2))], f"{KEY} string, ts timestamp_ntz")
    assert spec.reconstruct(spec.event_log(path), halt).count() == 2


def test_partial_fill(spark):
    bar = spark.createDataFrame([("a", i, START + timedelta(hours=i), 10.0, 1) for i in range(3)], f"{KEY} string, i int, ts timestamp_ntz, close double, signal int")
    minutes = spark.createDataFrame([("a", START + timedelta(hours=1, minutes=m), 10.0, 10.0, 10.0, v) for m, v in ((0, 4), (1, 4))], f"{KEY} string, ts timestamp_ntz, high double, low double, close double, volume long")
    sigma = spark.createDataFrame([], f"{KEY} string, day date, sigma double")
    got = [(r.qty, r.position) for r in spec.executions(bar, minutes, sigma, bar="1 hour").orderBy("i").collect()]
    assert got == [(0.0, 0.0), (4.0, 4.0), (0.0, 4.0)]  # half of 8 lots, then no volume at all


def test_splits_must_be_apart():
    with pytest.raises(ValueError):
        spec.splits(("2024-01-01", "2024-01-03"), ("2024-01-02", "2024-01-04"), ("2024-01-04", "2024-01-05"), ("2024-01-05", "2024-01-06"))


def test_order_ids(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "x string, y int").select(order_id("x", "y").alias("k"))
    keys = [r.k for r in df.collect()]
    assert keys[0] == keys[1] != keys[2] and all(len(k) == 16 for k in keys)


def test_generated_recipes_apply(spark):
    rng = np.random.default_rng(2)
    data = pd.DataFrame(rng.normal(size=(400, 2)), columns=["a", "b"]).assign(ts=range(400))
    data["target"] = data["a"] * data["b"]
    df = spark.createDataFrame(data)
    recipes = screening.generate(df, "target", ["a", "b"], iterations=1, least=0.5)
    assert recipes[0]["op"] == "mul" and screening.apply(df, recipes).where("abs(g1_mul__a__b - target) > 1e-12").count() == 0
    assert screening.select(screening.apply(df, recipes), ["a", "g1_mul__a__b"], "target", 1) == ["g1_mul__a__b"]


def test_folds_and_model(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"ts": range(200), "x": rng.normal(size=200)})
    data["target"] = 2 * data["x"] + rng.normal(size=200) / 10
    df = spark.createDataFrame(data)
    assert [r["count"] for r in screening.timed_folds(df, 3).groupBy("fold").count().orderBy("fold").collect()] == [50, 50, 50, 50]
    with pytest.raises(ValueError):
        screening.timed_folds(df, 1)
    fitted = model.fit(df, ["x"], n_estimators=30)
    model.save(fitted, str(tmp_path / "m"), {"n": 1}, df, ["x"])
    again, meta = model.load(spark, str(tmp_path / "m"))
    assert meta == {"n": 1, "feature_cols": ["x"]} and model.predict(again, df, ["x"]).agg(F.corr("pred", "target")).first()[0] > 0.8
    with pytest.raises(ValueError):
        model.predict(fitted, df.drop("x"), ["x"])


def test_grid_is_single_runs(bars):
    whole = grid.z_grid(bars, [0.05], [1.0, 1.5], [5, 9])
    one = stats.strategy(strategies.equity(bars, strategies.fills(bars, strategies.z_score(bars, 0.05, 1.5, 9))))
    assert whole.where("z_entry = 1.5 and max_hold = 9").select(one.columns).exceptAll(one).count() == 0
    assert whole.count() == 8


def test_quartiles(spark):
    got = stats.quartiles(spark.createDataFrame([(float(x),) for x in (1, 1, 1, 1, 2, 3, 4)], "x double"), "x").orderBy("x").collect()
    want = pd.qcut(pd.Series([1, 1, 1, 1, 2, 3, 4]), 4, duplicates="drop")
    assert [r.bucket for r in got] == list(want.cat.codes + 1)


def test_blocks_of_folds_are_the_whole_fold(bars):
    """Blocks between bars that force the position flat give the fills that one array of a whole series gives."""
    decided = strategies.z_score(bars, 0.05, 1.0, 9).collect()
    want, by_series = [], {}
    for r in sorted(decided, key=lambda r: (r[KEY], r.i)):
        pos, since = by_series.get(r[KEY], (0, 0))
        leave = pos > 0 and r.exit_long or pos < 0 and r.exit_short or r.i - since >= r.max_hold
        to = 0 if r.force0 else (0 if leave else pos) if pos else r.entry
        if to != pos:
            want.append((r[KEY], r.i, to - pos))
        by_series[r[KEY]] = (to, r.i if not pos and to else since)
    assert sorted((r[KEY], r.i, r.qty) for r in strategies.fold(strategies.z_score(bars, 0.05, 1.0, 9), [KEY]).collect()) == want and want


def test_fills_by_order(spark):
    rows = [("r", "a", "order", 10.0, None, None), ("r", "a", "fill", 4.0, 5.0, 0.1), ("r", "a", "fill", 6.0, 10.0, 0.2), ("r", "b", "order", -3.0, None, None), ("r", "b", "fill", -1.0, 7.0, 0.1), ("r", "c", "order", 2.0, None, None), ("r", "d", "fill", 1.0, 1.0, 0.0), ("r", "a", "signal", None, None, None)]
    got = {r.order_id: r for r in spec.fills_by_order(spark.createDataFrame(rows, "run_id string, order_id string, type string, qty double, price double, fees double")).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "filled", "b": "partial", "c": "open", "d": "orphan"}
    assert (got["a"].price, round(got["a"].fees, 6), got["c"].filled) == (8.0, 0.3, 0.0)


def test_asof_of_many_sources_is_one_by_one(bars):
    first, second = sorted(r[KEY] for r in bars.select(KEY).distinct().collect())[:2]
    probe, source = bars.where(F.col(KEY) == first).select("ts", "close"), bars.where(F.col(KEY) == second)
    late = source.where("pmod(hash(ts), 50) = 7").select("ts", F.col("close").alias("late"))
    got = asof.backward_all(probe, {"v": (source.select("ts", F.col("open").alias("o")), ["o"]), "l": (late, ["late"])}).orderBy("ts").collect()
    one = asof.backward(asof.backward(probe.withColumn("k", F.lit(0)), source.select(F.lit(0).alias("k"), "ts", F.col("open").alias("o")), ["o"], ["k"]), late.withColumn("k", F.lit(0)), ["late"], ["k"], at="l_ts").orderBy("ts").collect()
    assert [(r.ts, r.close, r.o, r.late, r.l_ts) for r in got] == [(r.ts, r.close, r.o, r.late, r.l_ts) for r in one] and any(r.late for r in got)


def test_draws_differ_and_latest_model(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(60)], "x double, target double")
    assert model.latest(spark, str(tmp_path / "none")) is None
    out, meta = model.predictions(df, str(tmp_path / "none"), 1.0)
    assert meta is None and {r.pred for r in out.collect()} == {1.0}
    for name, at in (("a", "2024-02-01"), ("b", "2024-01-01")):
        model.save(model.fit(df, ["x"], n_estimators=1), str(tmp_path / "m" / name), {"timestamp": at}, df, ["x"])
    assert model.latest(spark, str(tmp_path / "m")).endswith("/a")
    out, meta = model.predictions(df, str(tmp_path / "m"), 1.0)
    assert meta["timestamp"] == "2024-02-01" and out.where("pred is null").count() == 0
    assert model.predictions(df.drop("x"), str(tmp_path / "m"), 1.0)[1] is None


def test_gate_in_blocks_is_the_loop(spark):
    """Random flags, with a long stretch that is never crossed: the same as the state table row by row."""
    r = np.random.default_rng(5)
    n = 600
    rows = [("a" if k < n else "b", k % n, *(bool(x) for x in (r.random(6) < (0.5, 0.3, 0.3, 0.2, 0.85, 1)))) for k in range(2 * n)]
    rows = [(*x[:5], x[5] and not (x[0] == "b" and 100 < x[1] < 300), *x[6:]) for x in rows]
    df = spark.createDataFrame(rows, "instrument string, i int, up boolean, at_lower boolean, at_upper boolean, crossed boolean, in_session boolean, ready boolean").withColumn("ts", F.timestamp_seconds(F.col("i") * 60))
    for cooldown in (0, 4):
        got = {(x.instrument, x.i): x.signal for x in spec.gated(df, cooldown).collect()}
        assert len(got) == 2 * n
        for name in "ab":
            signal, open_, since, crossed = 0, True, 0, False
            for _, i, up, lower, upper, cross, inside, _ in (x for x in rows if x[0] == name):
                new = live.transition(signal, up, lower, upper, open_) if inside else 0
                if signal and not new:
                    open_, since, crossed = False, 0, False
                elif not open_:
                    since, crossed = since + 1, crossed or cross
                    open_ = since >= cooldown and crossed
                signal = new
                assert got[name, i] == signal


def test_executions_in_blocks_are_the_loop(spark):
    """Little volume, so that positions are reached over many bars or not at all."""
    r = np.random.default_rng(6)
    signal, volume = r.choice([-1, 0, 0, 1], 100).repeat(6), r.choice([0, 0, 2, 3, 5, 30], 600)
    at = lambda c: F.timestamp_seconds(F.col(c) * 3600).cast("timestamp_ntz")
    df = spark.createDataFrame([("a", i, int(signal[i]), 100.0) for i in range(600)], "instrument string, i int, signal int, close double").withColumn("ts", at("i"))
    minutes = spark.createDataFrame([("a", i, 100.0, 100.0, 100.0, int(volume[i])) for i in range(600) if volume[i]], "instrument string, i int, high double, low double, close double, volume long").withColumn("ts", at("i")).drop("i")
    sigma = spark.createDataFrame([], "instrument string, day date, sigma double")
    got = spec.executions(df, minutes, sigma, bar="1 hour").orderBy("i").toPandas()
    pos, want = 0.0, 0.0
    for i in range(600):
        qty = max(-volume[i] / 2, min(volume[i] / 2, want - pos))
        pos += qty
        assert (got.qty[i], got.position[i]) == (qty, pos)
        want = 10.0 * signal[i]
