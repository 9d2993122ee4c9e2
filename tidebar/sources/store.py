"""Candle storage: a partitioned parquet cache, CSV, event logs, grids, charts' data, and a pluggable paged source."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.operators import candles
from tidebar.operators.candles import KEY

_TYPES = {"string": T.StringType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType(), "array<double>": T.ArrayType(T.DoubleType())}


def _schema(text: str) -> T.StructType:
    """A schema of name and type pairs, without a session."""
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (x.split() for x in text.split(", "))])


CANDLE = _schema("exchange string, instrument string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint")
CANONICAL = _schema("exchange string, instrument string, timestamp timestamp, open double, high double, low double, close double, volume double, signal int, target_position double, triggering_signal int, trade_qty_from_prev double, fill_price_from_prev double, fees_from_prev double, position double, cash double, equity double")
EVENT = _schema("ts timestamp, exchange string, instrument string, type string, run_id string, bar_ts timestamp, open double, high double, low double, close double, volume double, signal int, qty double, price double, fees double, order_id string, recent_closes array<double>, message string")
PARTITIONS = ["exchange", KEY, "timeframe", "year", "month"]


def write_candles(bars: DataFrame, root: str) -> None:
    """Overwrites the months that bars touch, and no others."""
    out = bars.withColumns({"year": F.year("ts"), "month": F.month("ts")}).repartition(*[F.col(c) for c in PARTITIONS])
    out.sortWithinPartitions("ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(root)


def read_candles(spark: SparkSession, root: str, instruments: list[str] | None = None, timeframe: str | None = None, start=None, end=None) -> DataFrame:
    """Both ends included; filters on months prune folders, those on times reach the files."""
    out = spark.read.schema(T.StructType([*CANDLE.fields, T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())])).parquet(root)
    if instruments is not None:
        out = out.where(F.col(KEY).isin(instruments))
    if timeframe is not None:
        out = out.where(F.col("timeframe") == timeframe)
    for edge, later in ((start, True), (end, False)):
        if edge is not None:
            t = F.lit(edge).cast("timestamp_ntz")
            month = F.col("year") * 12 + F.col("month")
            limit = F.year(t) * 12 + F.month(t)
            out = out.where((F.col("ts") >= t) & (month >= limit)) if later else out.where((F.col("ts") <= t) & (month <= limit))
    return out.select(*CANDLE.names)


def load_universe(spark: SparkSession, root: str, assets: dict[str, str], timeframes: list[str], start, end, primary: DataFrame | None = None, primary_key: tuple[str, str] | None = None) -> DataFrame:
    """Candles of all assets (name to instrument) and timeframes in one pruned scan, under the assets' names. With primary, its bars take the
    place of the series primary_key (name, timeframe)."""
    if (primary is None) != (primary_key is None):
        raise ValueError("primary and primary_key go together")
    if primary_key is not None and (primary_key[0] not in assets or primary_key[1] not in timeframes):
        raise ValueError(f"{primary_key} isn't in the universe")
    names = {instrument: name for name, instrument in assets.items()}
    if len(names) < len(assets):
        raise ValueError("two names of one instrument")
    out = read_candles(spark, root, list(names), None, start, end).where(F.col("timeframe").isin(timeframes))
    named = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col(KEY))
    out = out.withColumn(KEY, named)
    if primary is None:
        return out
    return candles.replace_series(out, candles.between(primary.drop("timeframe").withColumn(KEY, F.lit(primary_key[0])), F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")), *primary_key)


def append_fresh(spark: SparkSession, root: str, fresh: DataFrame, prefer: str = "cached") -> None:
    """Merges new bars into the months they touch. The merged rows are written beside the cache first, as Spark can't overwrite what it reads."""
    months = fresh.select(*PARTITIONS[:3], F.year("ts").alias("year"), F.month("ts").alias("month")).distinct()
    known = spark.read.parquet(root).join(F.broadcast(months), PARTITIONS, "left_semi").select(*CANDLE.names)  # a row a series and month fetched
    merged = candles.merge(known, fresh.select(*CANDLE.names), prefer, tuple([*PARTITIONS[:3], "ts"]))
    beside = root.rstrip("/") + "__merging"
    merged.write.mode("overwrite").parquet(beside)
    write_candles(spark.read.parquet(beside), root)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, open, high, low, close, volume, with a fixed schema."""
    return spark.read.schema("timestamp timestamp_ntz, open double, high double, low double, close double, volume bigint").csv(path, header=True)


def find(instruments: DataFrame, ticker: str, class_code: str | None = "TQBR") -> DataFrame:
    """Instruments of a ticker; of every class without a class_code."""
    found = instruments.where(F.col("ticker") == ticker)
    return found if class_code is None else found.where(F.col("class_code") == class_code)


def verify(instruments: DataFrame, figi: str) -> dict | None:
    """What is known of an id; None if nothing is."""
    row = instruments.where(F.col("figi") == figi).first()
    return None if row is None else row.asDict()


def resolve(instruments: DataFrame, tickers: list[str], class_code: str = "TQBR") -> dict[str, str]:
    """The id of each ticker; none or several are an error."""
    found: dict[str, list[str]] = {t: [] for t in tickers}
    for r in instruments.where(F.col("ticker").isin(tickers) & (F.col("class_code") == class_code)).select("ticker", "figi").collect():
        found[r.ticker].append(r.figi)
    wrong = {t: f for t, f in found.items() if len(f) != 1}
    if wrong:
        raise ValueError(f"not exactly one instrument: {wrong}")
    return {t: f[0] for t, f in found.items()}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of a log's files, in folders of streams' batches or not."""
    return spark.read.schema(EVENT).option("recursiveFileLookup", True).json(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def write_grid(results: DataFrame, path: str, sort: str = "sortino") -> None:
    """One CSV file; a grid has a row a combination."""
    results.orderBy(F.desc(sort), *[c for c in results.columns if c != sort]).coalesce(1).write.mode("overwrite").csv(path, header=True)


def best_params(spark: SparkSession, path: str, integers: list[str]) -> dict:
    """The first row by sortino, whole numbers made integers again."""
    row = spark.read.csv(path, header=True, inferSchema=True).orderBy(F.desc("sortino")).limit(1).collect()[0].asDict()
    return {k: int(v) if k in integers and v is not None else v for k, v in row.items()}


_SORT = """let last = -1;
function sorted_by(i) {
  const body = document.querySelector("tbody"), rows = [...body.rows], text = r => r.cells[i].textContent, down = last === i;
  rows.sort((a, b) => (isNaN(text(a)) || isNaN(text(b)) ? text(a).localeCompare(text(b)) : text(a) - text(b)) * (down ? -1 : 1));
  last = down ? -1 : i;
  body.append(...rows);
}"""


def grid_html(results: DataFrame, limit: int = 5000) -> str:
    """A table whose number cells are shaded from red to green within their column and that is sorted by a click on a column's head:
    the first limit rows by sortino where there is one."""
    rows, names = (results.orderBy(F.desc("sortino"), *[c for c in results.columns if c != "sortino"]) if "sortino" in results.columns else results).limit(limit).collect(), results.columns
    ends = {}
    for c in names:
        values = [r[c] for r in rows if isinstance(r[c], (int, float))]
        ends[c] = (min(values), max(values)) if values else None

    def cell(r, c):
        v, end = r[c], ends[c]
        if end is None or not isinstance(v, (int, float)):
            return f"<td>{html.escape(str(v))}</td>"
        share = 0.5 if end[0] == end[1] else (v - end[0]) / (end[1] - end[0])
        return f'<td style="background:hsl({120 * share:.0f},60%,75%)">{v}</td>'

    head = "".join(f'<th onclick="sorted_by({i})">{html.escape(c)}</th>' for i, c in enumerate(names))
    return f"<script>{_SORT}</script><table><thead><tr>{head}</tr></thead><tbody>" + "".join("<tr>" + "".join(cell(r, c) for c in names) + "</tr>" for r in rows) + "</tbody></table>"


def chart_data(path: DataFrame) -> DataFrame:
    """What a four-panel chart shows of each bar: price, fills, equity, drawdown."""
    from tidebar.operators import windows as win

    return path.select(KEY, "ts", "close", F.when(F.col("qty") > 0, F.col("open")).alias("bought"), F.when(F.col("qty") < 0, F.col("open")).alias("sold"), "position", "equity", win.drawdown("equity").alias("drawdown"))


def diagnostics(bars: DataFrame, alpha: float, entry_pct: float, start, end, warmup_days: int = 5) -> DataFrame:
    """Price, trend, bands of entry and deviation in [start, end), warmed up on the days before."""
    from tidebar.operators import ewm

    t = lambda x: F.lit(x).cast("timestamp_ntz")
    seen = bars.where((F.col("ts") >= t(start) - F.expr(f"interval {warmup_days} days")) & (F.col("ts") < t(end)))
    out = ewm.means(seen, alpha, True, trend="close").where(F.col("ts") >= t(start))
    return out.select(KEY, "ts", "close", "trend", (F.col("trend") * (1 - entry_pct / 100)).alias("lower"), (F.col("trend") * (1 + entry_pct / 100)).alias("upper"), ((F.col("close") / F.col("trend") - 1) * 100).alias("dev_pct"))


def load_env(text: str, environ: dict[str, str]) -> dict[str, str]:
    """KEY=VALUE lines; what the environment has already wins."""
    pairs = (line.partition("=") for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs} | environ


def validated(config: dict) -> dict:
    """Checks a run's configuration where it is loaded."""
    needed = {"exchange": str, "instruments": list, "timeframe": str, "participation": float, "cooldown": int}
    wrong = [f"{k}: {kind.__name__} needed" for k, kind in needed.items() if not isinstance(config.get(k), kind)]
    if not wrong and not 0 < config["participation"] <= 1:
        wrong.append("participation: in (0, 1]")
    if wrong:
        raise ValueError("; ".join(wrong))
    return config
