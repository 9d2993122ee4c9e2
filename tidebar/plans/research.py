"""Queries over grids, screening, models and the live layer."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import OPS, order_id
from tidebar.operators import features, grid, model, screening, spec, strategies
from tidebar.operators import windows as win
from tidebar.operators.candles import KEY
from tidebar.plans import sql
from tidebar.plans.market import _W, _base_sql, _frame, bars, rounded

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


_GRID = {"alphas": [0.05, 0.1], "entries": [1.0, 1.5], "holds": [10, 20]}
_KEYS = ("alpha", "z_entry", "max_hold")


def _grid_sql() -> str:
    each = " UNION ALL ".join(f"SELECT b.*, {sql.num(a)} AS alpha, round(CASE WHEN sd = 0 THEN CASE WHEN abs(close - m) > abs(close) * 1e-12 THEN sign(close - m) * 'inf'::DOUBLE END ELSE (close - m) / sd END, 9) AS z FROM b JOIN e{k} USING (instrument, i)" for k, a in enumerate(_GRID["alphas"]))
    rest = " UNION ALL ".join(f"SELECT {sql.num(z)} AS z_entry, {h} AS max_hold" for z in _GRID["entries"] for h in _GRID["holds"])
    parts = [sql.candles("1h"), sql.numbered(), *[sql.deviation(f"e{k}", "b", a) for k, a in enumerate(_GRID["alphas"])], f"x AS (SELECT u.*, g.z_entry, g.max_hold FROM ({each}) u, ({rest}) g)"]
    parts.append(sql.decisions("x", "z IS NULL", f"{sql.MINUTE} >= 420 AND {sql.MINUTE} < 945", "z >= 0", "z <= 0", "lag(z) OVER s <= -z_entry", "lag(z) OVER s >= z_entry", "max_hold", extra=("alpha", "z_entry")).replace("PARTITION BY instrument, alpha, z_entry ORDER", "PARTITION BY instrument, alpha, z_entry, max_hold ORDER"))
    return "WITH RECURSIVE " + ",\n".join([*parts, sql.fold("d", _KEYS), sql.path("d", _KEYS), sql.stats(_KEYS)])


@query("grid_small", _grid_sql())
def grid_small(spark, sf_dir):
    return grid.z_grid(bars(spark, sf_dir, "1h"), **_GRID)


@query("grid_best", f"SELECT * FROM ({_grid_sql()}) ORDER BY sortino DESC, instrument, alpha, z_entry, max_hold LIMIT 3")
def grid_best(spark, sf_dir):
    return grid.best(grid.z_grid(bars(spark, sf_dir, "1h"), **_GRID), 3)


_QUIET = {"trend_alpha": [0.05, 0.1], "max_slope_pct": [5.0, 10.0], "vol_ratio_max": [1.0], "entry_pct": [3.0, 5.0], "exit_pct": [0.5], "min_quiet_bars": [1, 2], "time_stop_bars": [10, 20]}


def _quiet_sql() -> str:
    values = lambda names: ", ".join(f"(SELECT unnest([{', '.join(sql.num(x) if isinstance(x, float) else str(x) for x in _QUIET[n])}]) AS {n})" for n in names)
    each = " UNION ALL ".join(f"SELECT b.*, {sql.num(a)} AS trend_alpha, trend, fast FROM b JOIN t{k} USING (instrument, i) JOIN v USING (instrument, i)" for k, a in enumerate(_QUIET["trend_alpha"]))
    run = "PARTITION BY instrument, trend_alpha, max_slope_pct, vol_ratio_max"
    gate = lambda op, sign, pred: f"lag(dev) OVER s {op} {sign}entry_pct AND lag(run) OVER s >= min_quiet_bars AND pred {pred}"
    parts = [sql.candles("1h"), sql.numbered(), *[sql.ewm(f"t{k}", "b", a, True, trend="close") for k, a in enumerate(_QUIET["trend_alpha"])], sql.ewm("v", "b", 0.05, True, fast="volume"),
        f"x0 AS ({each})",
        "x AS (SELECT *, 1 + (i % 3 - 1) * 0.01::DOUBLE AS pred, round((close / trend - 1) * 100, 9) AS dev, round(abs(trend / lag(trend, 5) OVER s - 1) * 100, 9) AS slope, CASE WHEN count(*) OVER f >= 24 THEN avg(volume) OVER f END AS mean FROM x0 WINDOW s AS (PARTITION BY instrument, trend_alpha ORDER BY i), f AS (PARTITION BY instrument, trend_alpha ORDER BY i ROWS 23 PRECEDING))",
        f"y AS (SELECT *, coalesce(slope < max_slope_pct AND round(fast, 9) < round(vol_ratio_max * mean, 9), false) AS quiet FROM x, {values(['max_slope_pct', 'vol_ratio_max'])})",
        f"y1 AS (SELECT *, sum(CASE WHEN quiet THEN 0 ELSE 1 END) OVER ({run} ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM y)",
        f"z AS (SELECT *, sum(CASE WHEN quiet THEN 1 ELSE 0 END) OVER ({run}, g ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM y1)",
        f"w AS (SELECT * FROM z, {values(grid.QUIET[3:])})",
        sql.decisions("w", "dev IS NULL", "hour(ts) >= 9 AND hour(ts) < 16", "dev >= -exit_pct", "dev <= exit_pct", gate("<=", "-", "> 1.002"), gate(">=", "", "< 0.998"), "time_stop_bars", extra=tuple(grid.QUIET)),
        sql.fold("d", tuple(grid.QUIET)), sql.path("d", tuple(grid.QUIET)), sql.stats(tuple(grid.QUIET))]
    return "WITH RECURSIVE " + ",\n".join(parts)


@query("grid_quiet", _quiet_sql())
def grid_quiet(spark, sf_dir):
    """All seven parameters of the quiet-market strategy, with predictions; pred is made of the bar's number."""
    b = strategies.numbered(bars(spark, sf_dir, "1h")).withColumn("pred", 1 + (F.col("i") % 3 - 1) * F.lit(0.01)).drop("i")
    return grid.quiet_grid(b, _QUIET, True, slope_window=5, vol_window=24)


def _train(spark, sf_dir, timeframe="1h") -> DataFrame:
    """Base features of the bar before, and the target."""
    made = features.base(bars(spark, sf_dir, timeframe))
    return made.select(KEY, "ts", "close", *[win.lag(n).alias(n) for n in features.BASE], model.target().alias("target"))


_LAGGED = f"""WITH {sql.candles('1h')}, r AS (SELECT *, close / nullif(lag(close) OVER s, 0) AS target, close / nullif(lag(close) OVER s, 0) - 1 AS r1, (high - low) / nullif(close, 0) AS spread, (close - open) / nullif(close, 0) AS body FROM c {_W}),
t AS (SELECT instrument, ts, target, lag(r1) OVER s AS ret1, lag(spread) OVER s AS spread, lag(body) OVER s AS body FROM r {_W})"""


@query("target_corr", _LAGGED + " SELECT 'ret1' AS name, count(CASE WHEN ret1 IS NOT NULL AND target IS NOT NULL THEN 1 END) AS n, round(abs(corr(ret1, target)), 6) AS corr FROM t UNION ALL SELECT 'spread', count(CASE WHEN spread IS NOT NULL AND target IS NOT NULL THEN 1 END), round(abs(corr(spread, target)), 6) FROM t UNION ALL SELECT 'body', count(CASE WHEN body IS NOT NULL AND target IS NOT NULL THEN 1 END), round(abs(corr(body, target)), 6) FROM t")
def target_corr(spark, sf_dir):
    out = screening.correlations(_train(spark, sf_dir), {c: F.col(c) for c in ("ret1", "spread", "body")}, "target")
    return out.select("name", "n", *rounded(out, "corr"))


def _pairs_sql() -> str:
    each = []
    for a, b in (("ret1", "spread"), ("ret1", "body"), ("spread", "body")):
        for op in OPS:
            x = {"mul": f"{a} * {b}", "div": f"{a} / nullif({b}, 0)", "add": f"{a} + {b}", "sub": f"{a} - {b}", "rel": f"({a} - {b}) / nullif({a} + {b}, 0)"}[op]
            each.append(f"SELECT '{op}__{a}__{b}' AS name, count(CASE WHEN {x} IS NOT NULL AND target IS NOT NULL THEN 1 END) AS n, CASE WHEN count(CASE WHEN {x} IS NOT NULL AND target IS NOT NULL THEN 1 END) >= 100 THEN round(abs(corr({x}, target)), 5) ELSE 0.0 END AS corr FROM t")
    return _LAGGED + " " + " UNION ALL ".join(each)


@query("pair_candidates", _pairs_sql())
def pair_candidates(spark, sf_dir):
    made = {f"{op}__{a}__{b}": c for (op, a, b), c in screening.pair_candidates(["ret1", "spread", "body"]).items()}
    return screening.correlations(_train(spark, sf_dir), made, "target").select("name", "n", F.round("corr", 5).alias("corr"))


@query("recipe_apply", _LAGGED + " SELECT instrument, ts, round(ret1 * spread, 6) + 0.0::DOUBLE AS g1, round((ret1 * spread) / nullif(body, 0), 4) + 0.0::DOUBLE AS g2, round((spread - body) / nullif(spread + body, 0), 6) + 0.0::DOUBLE AS g3 FROM t")
def recipe_apply(spark, sf_dir):
    recipes = [{"name": "g1", "op": "mul", "a": "ret1", "b": "spread"}, {"name": "g2", "op": "div", "a": "g1", "b": "body"}, {"name": "g3", "op": "rel", "a": "spread", "b": "body"}, {"name": "g4", "op": "add", "a": "g1", "b": "absent"}]
    out = screening.apply(_train(spark, sf_dir), recipes)
    return out.select(KEY, "ts", F.round("g1", 6).alias("g1"), F.round("g2", 4).alias("g2"), F.round("g3", 6).alias("g3"))


def _greedy_sql(scores: list[str], pairs: dict[tuple[int, int], str], source: str, least: str, most: int, limit: float) -> str:
    """chosen: place (from 1) and score of what a greedy choice takes, in its order. scores and pairs are aggregates over source."""
    numbers = lambda xs: ", ".join(map(str, xs))
    return f"""sc AS (SELECT unnest([{numbers(range(1, len(scores) + 1))}]) AS place, unnest([{numbers(scores)}]) AS score FROM {source}),
pw AS (SELECT unnest([{numbers(i + 1 for i, _ in pairs)}]) AS a, unnest([{numbers(j + 1 for _, j in pairs)}]) AS b, unnest([{numbers(pairs.values())}]) AS r FROM {source}),
nr AS (SELECT a, list(b) AS near FROM (SELECT a, b FROM pw WHERE r >= {limit} AND NOT isnan(r) UNION ALL SELECT b, a FROM pw WHERE r >= {limit} AND NOT isnan(r)) GROUP BY a),
rk AS (SELECT place, score, coalesce(near, []) AS near, row_number() OVER (ORDER BY score DESC, place) AS k FROM sc LEFT JOIN nr ON place = a WHERE {least} AND NOT isnan(score)),
gr AS (SELECT 0::BIGINT AS k, []::INTEGER[] AS taken UNION ALL SELECT rk.k, CASE WHEN len(taken) < {most} AND NOT list_has_any(taken, near) THEN list_append(taken, place) ELSE taken END FROM gr JOIN rk ON rk.k = gr.k + 1),
ch AS (SELECT unnest(taken) AS place, generate_subscripts(taken, 1) AS rank FROM (SELECT arg_max(taken, k) AS taken FROM gr)),
chosen AS (SELECT place, rank, score FROM ch JOIN sc USING (place))"""


_SEEDS = ["ret1", "spread", "body", "gap"]


def _generated_sql() -> str:
    made = [(op, a, b) for op in OPS for a, b in combinations(_SEEDS, 2)]
    form = {"mul": "{a} * {b}", "div": "{a} / nullif({b}, 0)", "add": "{a} + {b}", "sub": "{a} - {b}", "rel": "({a} - {b}) / nullif({a} + {b}, 0)"}
    columns = ", ".join(f"{form[op].format(a=a, b=b)} AS x{i}" for i, (op, a, b) in enumerate(made))
    enough = lambda x, y: f"CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) >= 100 THEN abs(corr({x}, {y})) END"
    pairs = {(i, j): enough(f"x{i}", f"x{j}") for i in range(len(made)) for j in range(i + 1, len(made))}
    names = ", ".join(f"({i}, 'g1_{op}__{a}__{b}', '{op}', '{a}', '{b}')" for i, (op, a, b) in enumerate(made, 1))
    lagged = ", ".join(f"lag({n}) OVER s AS {n}" for n in _SEEDS)
    return f"""WITH RECURSIVE {_base_sql('1h')}, t0 AS (SELECT close / nullif(lag(close) OVER s, 0) AS target, {lagged} FROM base {_W}), t1 AS (SELECT target, {columns} FROM t0),
{_greedy_sql([enough(f'x{i}', 'target') for i in range(len(made))], pairs, 't1', 'score >= 0.02', 200, 0.95)}
SELECT name, op, a, b, round(score, 6) AS train_corr FROM chosen JOIN (VALUES {names}) v(place, name, op, a, b) USING (place)"""


@query("generated_features", _generated_sql())
def generated_features(spark, sf_dir):
    """The first iteration, with the operator's own limits."""
    recipes = screening.generate(_train(spark, sf_dir), "target", _SEEDS, iterations=1)
    return spark.createDataFrame([tuple(r.values()) for r in recipes], "name string, op string, a string, b string, train_corr double")


def _selected_sql(most: int) -> str:
    n = len(features.BASE)
    lagged = ", ".join(f"lag({x}) OVER s AS {x}" for x in features.BASE)
    full = ", ".join(f"coalesce({x}, avg({x}) OVER ()) AS {x}" for x in features.BASE)
    pairs = {(i, j): f"abs(corr({features.BASE[i]}, {features.BASE[j]}))" for i in range(n) for j in range(i + 1, n)}
    return f"""WITH RECURSIVE {_base_sql('1h')}, t0 AS (SELECT close / nullif(lag(close) OVER s, 0) AS target, {lagged} FROM base {_W}), t1 AS (SELECT target, {full} FROM t0),
{_greedy_sql([f'abs(corr({x}, target))' for x in features.BASE], pairs, 't1', 'score > 0', most, 0.9)}
SELECT CAST(rank AS INTEGER) AS place, ([{', '.join(f"'{x}'" for x in features.BASE)}])[place] AS feature FROM chosen"""


@query("selected_features", _selected_sql(300))
def selected_features(spark, sf_dir):
    """Of all base features, with the operator's own limits."""
    chosen = screening.select(_train(spark, sf_dir), list(features.BASE), "target")
    return spark.createDataFrame(list(enumerate(chosen, 1)), "place int, feature string")


@query("timed_folds", f"WITH {sql.candles('1h')}, o AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM c WHERE instrument = 'click') SELECT ts, CAST(least(floor(i / floor(n / 6)), 5) AS INTEGER) AS fold FROM o")
def timed_folds(spark, sf_dir):
    return screening.timed_folds(bars(spark, sf_dir, "1h").where(F.col(KEY) == "click").select("ts"), 5)


@query("period_corr", _LAGGED + " SELECT CAST(week(ts) AS INTEGER) AS period, count(CASE WHEN ret1 IS NOT NULL AND target IS NOT NULL THEN 1 END) AS n, round(corr(ret1, target), 6) AS corr FROM t GROUP BY 1 HAVING count(CASE WHEN ret1 IS NOT NULL AND target IS NOT NULL THEN 1 END) >= 2")
def period_corr(spark, sf_dir):
    out = screening.period_corr(_train(spark, sf_dir), "ret1", "target", F.weekofyear("ts"))
    return out.select("period", "n", *rounded(out, "corr"))


@query("gbt_predictions")
def gbt_predictions(spark, sf_dir):
    """Of boosted trees over all base features, those of the first bars with missing values included."""
    names = list(features.BASE)
    train, holdout = model.split(_train(spark, sf_dir), "2024-01-22")
    return model.predict(model.fit(train, names, n_estimators=10), holdout, names).select(KEY, "ts", "target", "pred")


_SIGNAL_PARTS = f"""{sql.candles('1h')}, {sql.numbered()}, {sql.ewm('f', 'b', 2 / 13, False, fast='close')}, {sql.ewm('w', 'b', 2 / 49, False, slow='close')},
j AS (SELECT b.*, fast, slow, CASE WHEN count(*) {_frame(19)} >= 20 THEN avg(close) {_frame(19)} END AS mean, CASE WHEN count(*) {_frame(19)} >= 20 THEN stddev_samp(close) {_frame(19)} END AS std FROM b JOIN f USING (instrument, i) JOIN w USING (instrument, i)),
k AS (SELECT *, lag(close) OVER s AS close0, round(lag(fast) OVER s, 9) > round(lag(slow) OVER s, 9) AS u, round(lag(mean) OVER s, 9) AS mid, round(lag(mean) OVER s - 2.0::DOUBLE * lag(std) OVER s, 9) AS lo, round(lag(mean) OVER s + 2.0::DOUBLE * lag(std) OVER s, 9) AS up FROM j {_W}),
m AS (SELECT *, coalesce(u, false) AS rising, coalesce(close <= lo, false) AS is_low, coalesce(close >= up, false) AND NOT coalesce(close <= lo, false) AS is_top, coalesce(sign(close - mid) * sign(close0 - mid) < 0, false) AS crossing,
  isodow(ts) <= 5 AND {sql.MINUTE} >= 420 AND {sql.MINUTE} < 940 AND mid IS NOT NULL AS live FROM k),
sg AS (
  SELECT instrument, i, 0 AS signal, true AS gate, 0 AS since, false AS crossed FROM m WHERE i = 0
  UNION ALL
  SELECT m.instrument, m.i, n.new, CASE WHEN n.gone THEN false WHEN s.gate THEN true ELSE s.since + 1 >= 4 AND (s.crossed OR m.crossing) END,
    CASE WHEN n.gone OR s.gate THEN 0 ELSE s.since + 1 END, CASE WHEN n.gone OR s.gate THEN false ELSE s.crossed OR m.crossing END
  FROM sg s JOIN m ON m.instrument = s.instrument AND m.i = s.i + 1,
  LATERAL (SELECT CASE WHEN NOT m.live THEN 0 WHEN s.signal = 0 THEN CASE WHEN s.gate AND m.is_low AND m.rising THEN 1 WHEN s.gate AND m.is_top AND NOT m.rising THEN -1 ELSE 0 END
    WHEN s.signal > 0 THEN CASE WHEN NOT m.rising OR m.is_top THEN 0 ELSE 1 END ELSE CASE WHEN m.rising OR m.is_low THEN 0 ELSE -1 END END AS new0) o,
  LATERAL (SELECT o.new0 AS new, s.signal <> 0 AND o.new0 = 0 AS gone) n)"""


@query("spec_signals", f"WITH RECURSIVE {_SIGNAL_PARTS} SELECT m.instrument, m.ts, m.live AS in_session, CAST(sg.signal AS INTEGER) AS signal FROM m JOIN sg USING (instrument, i)")
def spec_signals(spark, sf_dir):
    out = spec.signals(bars(spark, sf_dir, "1h"))
    return out.select(KEY, "ts", (F.col("in_session") & F.col("ready")).alias("in_session"), F.col("signal").cast("int").alias("signal"))


@query("sigma_daily", f"""WITH {sql.candles('1h')}, d AS (SELECT instrument, CAST(ts AS DATE) AS ts, arg_max(close, ts) AS close FROM c GROUP BY 1, 2), r AS (SELECT instrument, ts, close / nullif(lag(close) OVER s, 0) - 1 AS r FROM d {_W}),
q AS (SELECT instrument, ts, CASE WHEN count(r) {_frame(4)} >= 5 THEN stddev_samp(r) {_frame(4)} END AS sd FROM r) SELECT instrument, CAST(ts AS VARCHAR) AS day, round(lag(sd) OVER s, 4) AS sigma FROM q {_W}""")
def sigma_daily(spark, sf_dir):
    return spec.sigma_daily(bars(spark, sf_dir, "1h"), 5).select(KEY, F.col("day").cast("string").alias("day"), F.round("sigma", 4).alias("sigma"))


@query("opening_minutes", f"""WITH {sql.candles('1min')}, n AS (SELECT *, {sql._TRUNC['1h']} AS bar, row_number() OVER (PARTITION BY instrument, {sql._TRUNC['1h']} ORDER BY ts) AS n FROM c)
SELECT instrument, bar AS ts, round(sum((high + low + close) / 3 * volume) / nullif(sum(volume), 0) + 1e-9, 6) AS vwap, CAST(sum(volume) AS DOUBLE) AS volume_k, round(max((high - low) / nullif(close, 0) * 1e4), 4) AS range_bps FROM n WHERE n <= 5 GROUP BY 1, 2""")
def opening_minutes(spark, sf_dir):
    out = spec.opening_minutes(bars(spark, sf_dir, "1min"), "1 hour")
    return out.select(KEY, "ts", *rounded(out, "vwap"), "volume_k", F.round("range_bps", 4).alias("range_bps"))


def executed(spark, sf_dir) -> DataFrame:
    hours = bars(spark, sf_dir, "1h")
    return spec.executions(spec.signals(hours), bars(spark, sf_dir, "1min"), spec.sigma_daily(hours, 5), bar="1 hour")


_EXEC = f"""{_SIGNAL_PARTS},
mi AS (SELECT event_type AS instrument, date_trunc('minute', ts) AS ts, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2),
mn AS (SELECT *, date_trunc('hour', ts) AS bar, row_number() OVER (PARTITION BY instrument, date_trunc('hour', ts) ORDER BY ts) AS n FROM mi),
om AS (SELECT instrument, bar AS ts, sum((high + low + close) / 3 * volume) / nullif(sum(volume), 0) AS vwap, CAST(sum(volume) AS DOUBLE) AS vk, max((high - low) / nullif(close, 0) * 1e4) AS range_bps FROM mn WHERE n <= 5 GROUP BY 1, 2),
dd AS (SELECT instrument, CAST(ts AS DATE) AS ts, arg_max(close, ts) AS close FROM c GROUP BY 1, 2), dr AS (SELECT instrument, ts, close / nullif(lag(close) OVER s, 0) - 1 AS r FROM dd {_W}),
ds AS (SELECT instrument, ts, CASE WHEN count(r) {_frame(4)} >= 5 THEN stddev_samp(r) {_frame(4)} END AS sd FROM dr), sd AS (SELECT instrument, ts AS day, lag(sd) OVER s AS sigma FROM ds {_W}),
ex AS (SELECT m.instrument, m.i, m.ts, m.close, sg.signal, coalesce(lag(sg.signal) OVER (PARTITION BY m.instrument ORDER BY m.i), 0) * 10.0::DOUBLE AS want, coalesce(0.5::DOUBLE * om.vk, 0.0) AS avail, om.vwap, coalesce(om.range_bps, 0.0) AS range_bps, coalesce(sd.sigma, 0.0) AS sigma
  FROM m JOIN sg USING (instrument, i) LEFT JOIN om ON om.instrument = m.instrument AND om.ts = m.ts LEFT JOIN sd ON sd.instrument = m.instrument AND sd.day = CAST(m.ts AS DATE)),
po AS (SELECT instrument, i, CAST(greatest(-avail, least(avail, want)) AS DOUBLE) AS qty, CAST(greatest(-avail, least(avail, want)) AS DOUBLE) AS pos FROM ex WHERE i = 0
  UNION ALL SELECT ex.instrument, ex.i, greatest(-avail, least(avail, want - po.pos)), po.pos + greatest(-avail, least(avail, want - po.pos)) FROM po JOIN ex ON ex.instrument = po.instrument AND ex.i = po.i + 1),
pr AS (SELECT ex.*, po.qty, po.pos AS position, CASE WHEN po.qty <> 0 THEN vwap * (1 + sign(po.qty) * (greatest(2.0, range_bps * 0.1::DOUBLE) / 2 + 0.1::DOUBLE * sigma * 1e4 * sqrt(coalesce(abs(po.qty) / nullif(avail, 0), 0.0))) / 1e4) END AS fill_price FROM ex JOIN po USING (instrument, i)),
pf AS (SELECT *, CASE WHEN qty <> 0 THEN greatest(0.01, 5.0::DOUBLE * abs(qty) * fill_price / 1e4) ELSE 0.0 END AS fees FROM pr),
xp AS (SELECT *, -sum(qty * coalesce(fill_price, 0.0) + fees) OVER (PARTITION BY instrument ORDER BY i ROWS UNBOUNDED PRECEDING) AS cash FROM pf)"""


@query("spec_execution", f"WITH RECURSIVE {_EXEC} SELECT instrument, ts, CAST(signal AS INTEGER) AS signal, qty + 0.0::DOUBLE AS qty, round(fill_price, 4) AS fill_price, round(fees, 4) AS fees, position + 0.0::DOUBLE AS position, round(cash, 4) + 0.0::DOUBLE AS cash, round(cash + position * close, 4) + 0.0::DOUBLE AS equity FROM xp")
def spec_execution(spark, sf_dir):
    return executed(spark, sf_dir).select(KEY, "ts", F.col("signal").cast("int").alias("signal"), (F.col("qty") + 0.0).alias("qty"), *[F.round(c, 4).alias(c) for c in ("fill_price", "fees")], (F.col("position") + 0.0).alias("position"), *[F.round(c, 4).alias(c) for c in ("cash", "equity")])


_TRADES = """pa AS (SELECT xp.instrument, xp.i, xp.ts, qty, position, fees, abs(qty) * coalesce(fill_price, 0.0) AS notional, cash + position * xp.close AS equity FROM xp JOIN m ON m.instrument = xp.instrument AND m.i = xp.i WHERE m.mid IS NOT NULL),
t0 AS (SELECT *, equity - coalesce(lag(equity) OVER s, 0.0) AS d, CAST(position <> 0 AND sign(position) <> sign(coalesce(lag(position) OVER s, 0.0)) AS INTEGER) AS o FROM pa WINDOW s AS (PARTITION BY instrument ORDER BY i)),
t1 AS (SELECT *, sum(o) OVER (PARTITION BY instrument ORDER BY i ROWS UNBOUNDED PRECEDING) AS trade FROM t0),
t2 AS (SELECT instrument, trade, count(CASE WHEN position <> 0 THEN 1 END) AS bars, max(abs(position)) AS lots, sum(d) AS pnl, arg_max(position, i) = 0 AS done FROM t1 WHERE position <> 0 OR qty <> 0 GROUP BY 1, 2),
t3 AS (SELECT * FROM (SELECT *, lead(trade) OVER (PARTITION BY instrument ORDER BY trade) AS later FROM t2) WHERE done OR later IS NOT NULL)"""


@query("spec_trades", f"WITH RECURSIVE {_EXEC}, {_TRADES} SELECT instrument, CAST(trade AS BIGINT) AS trade, bars, lots, round(pnl, 4) + 0.0::DOUBLE AS pnl FROM t3")
def spec_trades(spark, sf_dir):
    out = spec.trades(executed(spark, sf_dir).where("ready"))
    return out.select(KEY, "trade", "bars", "lots", (F.round("pnl", 4) + 0.0).alias("pnl"))


@query("spec_metrics", f"""WITH RECURSIVE {_EXEC}, {_TRADES},
d0 AS (SELECT instrument, CAST(ts AS DATE) AS day, arg_max(equity, i) + 100000.0::DOUBLE AS eq FROM pa GROUP BY 1, 2),
d1 AS (SELECT *, eq / lag(eq, 1, 100000.0::DOUBLE) OVER s - 1 AS x, eq / greatest(max(eq) OVER (PARTITION BY instrument ORDER BY day ROWS UNBOUNDED PRECEDING), 100000.0::DOUBLE) - 1 AS dd FROM d0 WINDOW s AS (PARTITION BY instrument ORDER BY day)),
d2 AS (SELECT *, sum(CAST(dd >= 0 AS INTEGER)) OVER (PARTITION BY instrument ORDER BY day ROWS UNBOUNDED PRECEDING) AS g FROM d1),
d3 AS (SELECT *, sum(CAST(dd < 0 AS INTEGER)) OVER (PARTITION BY instrument, g ORDER BY day ROWS UNBOUNDED PRECEDING) AS under FROM d2),
d4 AS (SELECT instrument, count(*) AS n, min(day) AS a, max(day) AS z, avg(x) AS m, stddev_samp(x) AS s, stddev_samp(CASE WHEN x < 0 THEN x END) AS d, min(dd) AS fall, arg_max(eq, day) AS last, max(under) AS under FROM d3 GROUP BY 1),
c0 AS (SELECT instrument, sum(fees) AS fees, sum(notional) AS notional FROM pa GROUP BY 1),
t4 AS (SELECT *, sum(CAST(pnl >= 0 AS INTEGER)) OVER (PARTITION BY instrument ORDER BY trade ROWS UNBOUNDED PRECEDING) AS g FROM t3),
t5 AS (SELECT *, sum(CAST(pnl < 0 AS INTEGER)) OVER (PARTITION BY instrument, g ORDER BY trade ROWS UNBOUNDED PRECEDING) AS losing FROM t4),
t6 AS (SELECT instrument, count(*) AS trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS wins, avg(bars) AS bars, avg(lots) AS lots, max(losing) AS losing FROM t5 GROUP BY 1),
a0 AS (SELECT *, pow(last / 100000.0::DOUBLE, 252.0::DOUBLE / n) - 1 AS grown FROM d4 JOIN c0 USING (instrument) LEFT JOIN t6 USING (instrument))
SELECT instrument, 'run' AS run_id, 'custom' AS split, CAST(a AS VARCHAR) AS start_date, CAST(z AS VARCHAR) AS end_date, n AS session_days, 100000.0::DOUBLE AS initial_cash, round(last, 2) AS final_equity, round(last / 100000.0::DOUBLE - 1, 6) AS total_return,
  round(grown, 6) AS cagr, round(m / nullif(s, 0) * sqrt(252), 4) AS sharpe, round(m / nullif(d, 0) * sqrt(252), 4) AS sortino, round(grown / nullif(abs(fall), 0), 4) AS calmar, round(fall, 6) AS max_drawdown, CAST(under AS BIGINT) AS max_drawdown_duration_days,
  CAST(coalesce(losing, 0) AS BIGINT) AS longest_losing_streak_trades, CAST(coalesce(trades, 0) AS BIGINT) AS trade_count, round(wins, 4) AS win_rate, round(bars, 4) AS avg_holding_bars, round(lots, 4) AS avg_trade_size_lots,
  round(notional, 2) AS total_notional, round(fees, 4) AS total_fees, round(fees / nullif(notional, 0) * 1e4, 4) AS total_commission_bps FROM a0""")
def spec_metrics(spark, sf_dir):
    return spec.metrics(executed(spark, sf_dir))


@query("reconstruct", f"WITH RECURSIVE {_EXEC} SELECT instrument, ts, CAST(signal AS INTEGER) AS signal, qty + 0.0::DOUBLE AS qty, position + 0.0::DOUBLE AS position, round(cash, 4) + 0.0::DOUBLE AS cash FROM xp")
def reconstruct(spark, sf_dir):
    out = spec.reconstruct(spec.event_log(executed(spark, sf_dir)))
    return out.select(KEY, "ts", F.col("signal").cast("int").alias("signal"), (F.col("qty") + 0.0).alias("qty"), (F.col("position") + 0.0).alias("position"), F.round("cash", 4).alias("cash"))


@query("violations", f"WITH {sql.candles('1h')} SELECT instrument, ts, 'equity' AS broken FROM c WHERE hour(ts) = 11")
def violations(spark, sf_dir):
    """Rows of a log whose equity was changed at one hour of each day."""
    rows = spec.reconstruct(spec.event_log(executed(spark, sf_dir)))
    return spec.violations(rows.withColumn("equity", F.col("equity") + F.when(F.hour("ts") == 11, 1.0).otherwise(0.0)))


@query("drift", f"WITH RECURSIVE {_EXEC} SELECT instrument, ts, CASE WHEN hour(ts) = 13 THEN false ELSE true END AS same_signal, CASE WHEN hour(ts) = 13 THEN NULL WHEN hour(ts) = 11 THEN -1.0::DOUBLE ELSE 0.0 END AS position_diff, CASE WHEN hour(ts) <> 13 THEN 0.0::DOUBLE END AS equity_diff, false AS only_test, hour(ts) = 13 AS only_live FROM xp")
def drift(spark, sf_dir):
    """A path against its log's rows, of which some are gone and some have another position."""
    live = executed(spark, sf_dir)
    again = spec.reconstruct(spec.event_log(live)).where("hour(ts) != 13")
    again = again.withColumn("position", F.col("position") + F.when(F.hour("ts") == 11, 1.0).otherwise(0.0))
    out = spec.drift(live, again)
    return out.select(KEY, "ts", "same_signal", F.round("position_diff", 6).alias("position_diff"), (F.round("equity_diff", 4) + 0.0).alias("equity_diff"), "only_test", "only_live")


@query("order_ids", f"WITH {sql.candles('1day')} SELECT instrument, ts, substr(sha1(instrument || '|' || CAST(volume AS VARCHAR)), 1, 16) AS order_id FROM c")
def order_ids(spark, sf_dir):
    return bars(spark, sf_dir, "1day").select(KEY, "ts", order_id(KEY, "volume").alias("order_id"))


@query("splits", f"WITH {sql.candles('1h')} SELECT part, count(*) AS n FROM (SELECT CASE WHEN ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-05' THEN 'warmup' WHEN ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15' THEN 'train' WHEN ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-20' THEN 'validation' WHEN ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29' THEN 'test' END AS part FROM c) GROUP BY part")
def splits(spark, sf_dir):
    part = spec.splits(("2024-01-01", "2024-01-05"), ("2024-01-05", "2024-01-15"), ("2024-01-15", "2024-01-20"), ("2024-01-22", "2024-01-29"))
    return bars(spark, sf_dir, "1h").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))

