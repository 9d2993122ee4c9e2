"""Queries of the operators for series, tables and candidate sets of any size: prefix scans, selection, redundancy graphs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tidebar.functions.columns import OPS
from tidebar.operators import ewm, features, model, quantiles, redundancy, scan, screening
from tidebar.operators import windows as win
from tidebar.operators.candles import KEY
from tidebar.plans import sql
from tidebar.plans.market import _MOVES, _W, _base_sql, bars, rounded
from tidebar.plans.research import _train

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


_LONG = [
    sql.candles("15min"), sql.numbered(), sql.ewm("e0", "b", 0.05, False, m="close", h="high * volume", v="volume"), sql.ewm("e1", "b", 0.02, True, t="close"), sql.deviation("e2", "b", 0.02),
    _MOVES, sql.ewm("e3", "m", 0.05, False, a="d", aa="abs(d)"),
    sql.ewm("e4", "b", 0.05, False, t="CAST(i AS DOUBLE)", y="close", tt="CAST(i AS DOUBLE) * i", ty="close * i", a="abs(close)"),
]


@query("long_decays", "WITH RECURSIVE " + ",\n".join(_LONG) + """
SELECT b.instrument, b.ts, CAST(b.i AS BIGINT) AS place, round(e0.m + 1e-9, 6) AS mean, round(e0.h / e0.v + 1e-9, 6) AS vwh, round(e1.t + 1e-9, 6) AS trend, round(e2.m + 1e-9, 4) AS centre, round(e2.sd + 1e-9, 4) AS std,
  round(e3.a / nullif(e3.aa, 0) + 1e-9, 6) AS eff, round(tanh(CASE WHEN e4.tt - e4.t * e4.t > 1e-12 THEN (e4.ty - e4.t * e4.y) / (e4.tt - e4.t * e4.t) ELSE 0.0 END / (e4.a + 1e-9)) + 1e-9, 4) + 0.0::DOUBLE AS slope
FROM b JOIN e0 ON e0.instrument = b.instrument AND e0.i = b.i JOIN e1 ON e1.instrument = b.instrument AND e1.i = b.i JOIN e2 ON e2.instrument = b.instrument AND e2.i = b.i LEFT JOIN e3 ON e3.instrument = b.instrument AND e3.i = b.i - 1 JOIN e4 ON e4.instrument = b.instrument AND e4.i = b.i""")
def long_decays(spark, sf_dir):
    """All kinds of decayed values by prefix scans: no task holds a series."""
    out = scan.numbered(bars(spark, sf_dir, "15min"), "place").drop("__part")
    out = ewm.means(out, 0.05, False, engine=scan.Long, mean="close")
    out = ewm.weighted(out, 0.05, engine=scan.Long, vwh="high")
    out = ewm.means(out, 0.02, True, engine=scan.Long, trend="close")
    out = ewm.mean_and_std(out, 0.02, "close", "centre", "std", engine=scan.Long)
    out = ewm.efficiency(out, 0.05, "eff", engine=scan.Long)
    out = ewm.slope(out, 0.05, "slope", engine=scan.Long)
    return out.select(KEY, "ts", "place", *rounded(out, "mean", "vwh", "trend"), *rounded(out, "centre", "std", digits=4), *rounded(out, "eff"), (F.round(F.col("slope") + 1e-9, 4) + 0.0).alias("slope"))


@query("long_running", f"""WITH {sql.candles('15min')} SELECT instrument, ts, CAST(sum(volume) OVER s AS BIGINT) AS volume_so_far, max(high) OVER s AS top, min(low) OVER s AS bottom,
  round(close - max(close) OVER s + 1e-9, 6) AS fall, last_value(CASE WHEN volume > 2 THEN volume END IGNORE NULLS) OVER s AS last_busy, first_value(CASE WHEN volume > 2 THEN close END IGNORE NULLS) OVER s AS first_busy
FROM c WINDOW s AS (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def long_running(spark, sf_dir):
    """Running sums, extremes and known values by prefix scans."""
    busy = F.col("volume") > 2
    out = scan.running(bars(spark, sf_dir, "15min"), volume_so_far=("sum", "volume"), top=("max", "high"), bottom=("min", "low"), peak=("max", "close"), last_busy=("last", F.when(busy, F.col("volume"))), first_busy=("first", F.when(busy, F.col("close"))))
    out = out.withColumn("fall", F.col("close") - F.col("peak"))
    return out.select(KEY, "ts", "volume_so_far", "top", "bottom", *rounded(out, "fall"), "last_busy", "first_busy")


_PROBABILITIES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)


@query("exact_quantiles", "SELECT l_returnflag, l_linestatus, p, round(value + 1e-9, 4) AS value FROM (SELECT l_returnflag, l_linestatus, unnest([" + ", ".join(map(sql.num, _PROBABILITIES)) + "]) AS p, unnest(quantile_cont(l_extendedprice::DOUBLE, [" + ", ".join(map(str, _PROBABILITIES)) + "])) AS value FROM lineitem GROUP BY 1, 2)")
def exact_quantiles(spark, sf_dir):
    """Of prices by return flag and line status; one group has half of the rows."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("double").alias("price"))
    out = quantiles.quantiles(items, "price", _PROBABILITIES, ["l_returnflag", "l_linestatus"], least=1024)
    return out.select("l_returnflag", "l_linestatus", "p", F.round(F.col("value") + 1e-9, 4).alias("value"))


def _candidates_sql() -> str:
    """x: the rows' base features of the bar before by number (0 on), and the target, in long form; cand: all first-round candidates' scores."""
    lagged = ", ".join(f"round(lag({n}) OVER s, 9) AS {n}" for n in features.BASE)
    n = len(features.BASE)
    pairs = ", ".join(f"({i}, {j})" for i, j in combinations(range(n), 2))
    ops = ", ".join(f"({k}, '{op}')" for k, op in enumerate(OPS))
    form = {"mul": "a * b", "div": "CASE WHEN b <> 0 THEN a / b END", "add": "a + b", "sub": "a - b", "rel": "CASE WHEN a + b <> 0 THEN (a - b) / (a + b) END"}
    made = "CASE op " + " ".join(f"WHEN '{op}' THEN {form[op]}" for op in OPS) + " END"
    names = ", ".join(f"'{x}'" for x in features.BASE)
    return f"""{_base_sql('1h')}, t0 AS (SELECT instrument, ts, close / nullif(lag(close) OVER s, 0) AS target, {lagged} FROM base {_W}),
t1 AS (SELECT row_number() OVER () AS r, target, [{', '.join(features.BASE)}] AS f FROM t0),
pr(i, j) AS (VALUES {pairs}), op(o, op) AS (VALUES {ops}),
v0 AS (SELECT r, target, o, op, i, j, f[i + 1]::DOUBLE AS a, f[j + 1]::DOUBLE AS b FROM t1, pr, op),
v1 AS MATERIALIZED (SELECT r, target, o, op, i, j, {made} AS x FROM v0),
cand AS (SELECT o, op, i, j, count(CASE WHEN x IS NOT NULL AND target IS NOT NULL THEN 1 END) AS n, abs(corr(x, target)) AS c FROM v1 GROUP BY ALL),
nm AS (SELECT [{names}] AS names)"""


@query("candidate_scores", f"WITH RECURSIVE {_candidates_sql()} SELECT op, names[i + 1] AS a, names[j + 1] AS b, n, round(CASE WHEN n >= 100 AND NOT isnan(c) THEN c ELSE 0.0 END, 5) AS corr FROM cand, nm")
def candidate_scores(spark, sf_dir):
    """Every operation on every two base features, with the target, in one scan."""
    table = redundancy.values(_rows(spark, sf_dir), features.BASE, "target")
    out = redundancy.scores(table, len(features.BASE), list(OPS))
    name = lambda c: F.get(F.array(*map(F.lit, features.BASE)), F.col(c))
    return out.select("op", name("i").alias("a"), name("j").alias("b"), "n", F.round("corr", 5).alias("corr"))


def _rows(spark, sf_dir):
    """Rounded, so that engines agree on what is zero, and may not divide."""
    rows = _train(spark, sf_dir)
    return rows.select(*[F.round(c, 9).alias(c) if c in features.BASE else F.col(c) for c in rows.columns])


def recipes_frame(spark, recipes):
    return spark.createDataFrame([(k, *r.values()) for k, r in enumerate(recipes, 1)], "place int, name string, op string, a string, b string, train_corr double")


@query("generated_base", f"""WITH RECURSIVE {_candidates_sql()},
rk AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round(c, 10) DESC, o, i, j) AS k FROM cand WHERE n >= 100 AND NOT isnan(c) AND c >= 0.02 QUALIFY k <= 3000),
ms AS (SELECT k, avg(x) AS mean, greatest(stddev_pop(x), 1e-300) AS dev FROM v1 JOIN rk USING (o, i, j) GROUP BY k),
vs AS MATERIALIZED (SELECT k, list(CASE WHEN x IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ORDER BY r) AS m, list(coalesce((x - mean) / dev, 0.0::DOUBLE) ORDER BY r) AS z, list(coalesce(power((x - mean) / dev, 2), 0.0::DOUBLE) ORDER BY r) AS zz
  FROM v1 JOIN rk USING (o, i, j) JOIN ms USING (k) GROUP BY k),
ps AS (SELECT p.k AS u, q.k AS v, list_inner_product(p.m, q.m) AS n, list_inner_product(p.z, q.m) AS sx, list_inner_product(p.m, q.z) AS sy, list_inner_product(p.zz, q.m) AS xx, list_inner_product(p.m, q.zz) AS yy, list_inner_product(p.z, q.z) AS xy FROM vs p JOIN vs q ON p.k < q.k),
ed AS MATERIALIZED (SELECT u, v FROM ps WHERE n >= 100 AND (n * xx - sx * sx) * (n * yy - sy * sy) > 0 AND abs(n * xy - sx * sy) >= 0.95 * sqrt((n * xx - sx * sx) * (n * yy - sy * sy))),
nr AS (SELECT v, list(u) AS near FROM ed GROUP BY v),
od AS MATERIALIZED (SELECT k, coalesce(near, []) AS near FROM rk LEFT JOIN nr ON v = k),
gr AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS taken UNION ALL SELECT od.k, CASE WHEN len(taken) < 200 AND NOT list_has_any(taken, near) THEN list_append(taken, od.k) ELSE taken END FROM gr JOIN od ON od.k = gr.k + 1),
ch AS (SELECT unnest(taken) AS k, generate_subscripts(taken, 1) AS place FROM (SELECT arg_max(taken, k) AS taken FROM gr))
SELECT CAST(place AS INTEGER) AS place, 'g1_' || op || '__' || names[i + 1] || '__' || names[j + 1] AS name, op, names[i + 1] AS a, names[j + 1] AS b, round(c, 6) AS train_corr FROM ch JOIN rk USING (k), nm""")
def generated_base(spark, sf_dir):
    """The first iteration over all base features, with the operator's own limits."""
    return recipes_frame(spark, screening.generate(_rows(spark, sf_dir), "target", list(features.BASE), iterations=1))


@query("generated_twice")
def generated_twice(spark, sf_dir):
    """Two iterations over all base features, with the operator's own limits; the second one's candidates are those of the first one's choice."""
    return recipes_frame(spark, screening.generate(_rows(spark, sf_dir), "target", list(features.BASE)))


@query("generated_extended")
def generated_extended(spark, sf_dir):
    """Two iterations over all base and extended features (some 780,000 candidates, then those of the first choice), with the operator's own limits."""
    made = features.extended(bars(spark, sf_dir, "1h"))
    names = [c for c in made.columns if c not in (KEY, "ts", "open", "high", "low", "close", "volume")]
    rows = made.select(KEY, "ts", *[win.lag(n).alias(n) for n in names], model.target().alias("target"))
    return recipes_frame(spark, screening.generate(rows, "target", names))
