"""Shared helpers: reading tables, words as Spark columns, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: With this Spark deletes a query's shuffle files as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables that cut() has written and nothing has emptied yet; the second by the DataFrame that reads them.
_WRITTEN: set[str] = set()
_PATH: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Paths of what the innermost running settled() has cut: each thread has its own.
_OWN: ContextVar[set[str] | None] = ContextVar("own", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text, empty for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. Where that is unset, a local session gets a folder of its
    own (tests); a cluster has none that every executor could read."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.conf.get("spark.master", "") or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidebar-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidebar-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so that a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN.add(path)
    _PATH[out] = path
    if (own := _OWN.get()) is not None:
        own.add(path)
    return out


def _empty(spark: SparkSession, path: str) -> None:
    spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)
    _WRITTEN.discard(path)


def forget(*tables: DataFrame | None) -> None:
    """Empties tables that cut() has written, once nothing reads them any more; other DataFrames stay."""
    for df in tables:
        if df is not None and _PATH.get(df) in _WRITTEN:
            _empty(df.sparkSession, _PATH[df])


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives, cut; the tables that it has cut on the way are emptied."""
    outer = _OWN.set(own := set())
    try:
        out = cut(make(), name)
    finally:
        _OWN.reset(outer)
    for path in (own - {_PATH[out]}) & _WRITTEN:
        _empty(out.sparkSession, path)
    if (around := _OWN.get()) is not None:
        around.add(_PATH[out])
    return out
