"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; each of its documents is expected `target / source size` times. Documents of a
source stand in the order of their size, so that the expected copies' prefix sum is `rank * rate`; one random offset is added
to it, and a document is emitted once for each integer that its stretch of the sum crosses. Ordered by size, the taken words
differ from the target by less than the words of the source's longest document.

The prefix sum is distributed: rows are range-partitioned by (source, size, id, hash), ranked inside their partition, and
shifted by the counts of the partitions before it; no source needs to fit into a task.

Nulls and odd rows: a null text has size 0, which is taken as 0 words however often it is drawn; a null source is a source of
its own, last in the order; null ids come first. Repeated rows are ranked one after the other, as equals: which of them gets
the extra copy doesn't show. A source without words has the target 0. Extra columns pass through `mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidebar.llm.common import WORD, cut, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
SEED = 7


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = SEED) -> DataFrame:
    """One row a source: __source, source_size, target, __rate and __offset, from (source, size).

    Targets share out `share` times all words by weight; none exceeds `limit` times its source. A source is at its limit iff
    limit / weight is at most the level at which the rest share what the sources with smaller limits have left."""
    by_name, by_level = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("__level", "__place")
    out = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    out = out.withColumn("__place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__place") % len(weights) + 1).cast("int"))
    out = out.withColumn("__weight", weight.cast("double")).withColumn("__cap", F.col("source_size") * F.lit(limit))
    out = out.withColumn("__level", F.col("__cap") / F.col("__weight"))
    below, rest = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    whole = F.sum("source_size").over(W.partitionBy()) * F.lit(share)
    out = out.withColumn("__fill", (whole - F.coalesce(F.sum("__cap").over(below), F.lit(0.0))) / F.sum("__weight").over(rest))
    # The level is where the first source stays below its limit; if all reach it, they keep it.
    level = F.coalesce(F.min(F.when(F.col("__level") > F.col("__fill"), F.struct("__level", "__place", "__fill"))).over(W.partitionBy())["__fill"], F.max("__level").over(W.partitionBy()))
    out = out.withColumn("target", F.least("__cap", level * F.col("__weight")))
    random = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return out.select(F.col("source").alias("__source"), "source_size", "target", rate.alias("__rate"), random.alias("__offset"))


def copies(sizes: DataFrame, **options) -> DataFrame:
    """Adds source_size, target and __copies to rows of (doc_id, source, size, __tie); __tie orders rows of equal id."""
    order = [F.col(c).asc_nulls_last() if c == "source" else F.col(c) for c in ("source", "size", "doc_id", "__tie")]
    ranged = cut(sizes.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "mixing")
    part = ranged.withColumn("__in", F.row_number().over(W.partitionBy("__part", "source").orderBy(*order[1:])))
    counts = ranged.groupBy("source", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("source").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("__s"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    shifts = counts.join(targets(ranged.select("source", "size"), **options), F.col("__s").eqNullSafe(F.col("__source")))
    out = part.join(shifts, (F.col("__part") == F.col("__p")) & F.col("source").eqNullSafe(F.col("__s")))
    rank = F.col("__before") + F.col("__in")
    crossed = F.floor(rank * F.col("__rate") + F.col("__offset")) - F.floor((rank - 1) * F.col("__rate") + F.col("__offset"))
    return out.withColumn("__copies", crossed.cast("long"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, __tie) of documents."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("__tie"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as it is drawn; columns as they were."""
    columns = docs.columns
    # Rows of equal id, source and text are equals for the draw, so their copies are added up and dealt out evenly by a number among them.
    drawn = copies(sized(docs), **options).groupBy("doc_id", "source", "__tie").agg(F.sum("__copies").alias("__k"), F.count(F.lit(1)).alias("__n"))
    drawn = cut(drawn.where("__k > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__src"), F.col("__tie").alias("__t"), "__k", "__n"), "drawn")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__src")) & (F.xxhash64("text") == F.col("__t"))
    out = docs.join(drawn, same)
    share = F.col("__k")
    if drawn.where("__n > 1").limit(1).count():  # else texts needn't move for it
        i = F.row_number().over(W.partitionBy("__id", "__src", "__t").orderBy(F.lit(1)))
        out = out.withColumn("__i", i)
        share = F.floor(F.col("__i") * F.col("__k") / F.col("__n")) - F.floor((F.col("__i") - 1) * F.col("__k") / F.col("__n"))
    out = out.withColumn("__c", share.cast("int")).where("__c > 0").withColumn("__e", F.explode(F.sequence(F.lit(1), F.col("__c"))))
    return out.select(*[F.col(f"`{c}`") for c in columns])


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies(sized(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("__copies") * F.col("size")).alias("taken"))
