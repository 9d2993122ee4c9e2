"""Importance resampling towards a target distribution, by hashed n-grams of words.

A document's weight is the floored mean of its n-grams' gains: log ratios of two multinomials over hashed n-grams, one of the
target texts, one of all documents, both smoothed by one count a bucket. With a Gumbel number drawn from a document's id its
weight becomes a score, and the documents of the highest scores are a draw without replacement, by the weights.

Long texts are cut into chunks of about CHUNK characters that end where a word does, dealt out over all tasks; a chunk carries
the n - 1 words after it, so that each n-gram belongs to the chunk in which it starts, and to no other. Chunks' counts and gains
are summed by document. N-grams are hashed once, into a table of bucket numbers that both passes read; the driver gets a row
a bucket. Ranks are those of range partitions plus the rows of the partitions before, so no task sorts all documents.
All of it is built-in functions.

Nulls and odd rows: a null or empty text has no n-grams, weight 0, and isn't drawn (it has fewer words than `least`). A null id
draws the number of an empty one and comes last among ties. Repeated rows count and are drawn each for itself. Without target
texts the gains are those of no target counts. Empty documents give no rows. Extra columns pass through `resample`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidebar.llm.common import cut, forget, table

#: Inside of a character class: what isn't part of a word.
_NOT = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
TOKEN = f"[^{_NOT}]+"
BUCKETS = 10_000
ORDER = 1
PERCENT = 10
LEAST = 20
SEED = 2024
CHUNK = 1 << 15


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def chunks(texts: DataFrame, order: int = ORDER, chunk: int = CHUNK) -> DataFrame:
    """Replaces __text by (__own, __carry): arrays of a chunk's words and of the first order - 1 words after it. Texts of at most
    chunk characters are one chunk each; those of longer ones are dealt out anew."""
    long_ = F.length("__text") > chunk
    rest = [c for c in texts.columns if c != "__text"]
    short = texts.where(~long_).select(*rest, tokens(F.col("__text")).alias("__own"), F.array().cast("array<string>").alias("__carry"))
    # Possessive, so that matching takes no stack; a piece goes on to the end of the word it would have cut.
    pieces = F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{chunk}}}[^{_NOT}]*+"), F.lit(0))
    cut_ = texts.where(long_).withColumn("__p", F.filter(pieces, lambda p: p.rlike(TOKEN)))
    if order > 1:  # every piece has a word, so the carry lies in the next order - 1 pieces
        cut_ = cut_.withColumn("__heads", F.transform("__p", lambda p: F.regexp_extract(p, f"^(?:[{_NOT}]*[^{_NOT}]++){{1,{order - 1}}}", 0)))
        carry = lambda i: F.slice(tokens(F.array_join(F.slice("__heads", i + 2, order - 1), " ")), 1, order - 1)
    else:
        carry = lambda i: F.array().cast("array<string>")
    cut_ = cut_.select(*rest, F.posexplode_outer(F.transform("__p", lambda p, i: F.struct(p.alias("p"), carry(i).alias("c")))).alias("__i", "__c"))
    # A text without words is one chunk without any.
    none = F.array().cast("array<string>")
    cut_ = cut_.repartition("__at", "__i").select(*rest, tokens(F.coalesce("__c.p", F.lit(""))).alias("__own"), F.coalesce("__c.c", none).alias("__carry"))
    return short.unionByName(cut_)


def _run_of(k: int):
    """The k words from a place on; a default argument would count as the place's index."""
    return lambda i: F.array_join(F.slice("__w", i, k), " ")


def hashed(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """Rows of (__at, __words, __grams, other columns) for each chunk of the texts (text, other columns); __at numbers the texts."""
    rest = [F.col(f"`{c}`") for c in texts.columns if c != "text"]
    out = texts.select(*rest, F.monotonically_increasing_id().alias("__at"), lowered(F.col("text")).alias("__text"))
    out = chunks(out, order, chunk).withColumn("__w", F.concat("__own", "__carry"))
    grams = [F.col("__own")]
    for k in range(2, order + 1):
        n = F.least(F.size("__own"), F.size("__w") - (k - 1))
        starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        grams.append(F.transform(starts, _run_of(k)))
    bucket = F.transform(F.concat(*grams), lambda g: (F.crc32(g.cast("binary")) % buckets).cast("int"))
    return out.select(*rest, "__at", F.size("__own").cast("long").alias("__words"), bucket.alias("__grams"))


def _counts(grams: DataFrame, buckets: int) -> list[int]:
    out = [0] * buckets
    for r in grams.select(F.explode_outer("__grams").alias("b")).where("b is not null").groupBy("b").count().collect():
        out[r.b] = r["count"]
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """1000 times the log ratio of each bucket, floored."""
    n = len(raw)
    whole, wanted = float(sum(raw) + n), float(sum(target) + n)
    return [math.floor(1000 * math.log((t + 1) * whole / ((s + 1) * wanted))) for s, t in zip(raw, target, strict=True)]


def scores(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """Rows of (__at, __tie, doc_id, n_words, n_features, weight, score) for each document of (doc_id, text); target has a text."""
    grams = cut(hashed(docs.select("doc_id", "text", F.xxhash64("text").alias("__tie")), order, buckets, chunk), "grams")
    gain = gains(_counts(grams, buckets), _counts(hashed(target.select("text"), order, buckets, chunk), buckets))
    table_ = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")
    summed = F.aggregate("__grams", F.lit(0).cast("long"), lambda a, g: a + F.get(table_, g))
    by_doc = grams.select("__at", "doc_id", "__tie", "__words", F.size("__grams").cast("long").alias("__n"), summed.alias("__gain"))
    by_doc = by_doc.groupBy("__at").agg(F.first("doc_id").alias("doc_id"), F.first("__tie").alias("__tie"), F.sum("__words").alias("n_words"), F.sum("__n").alias("n_features"), F.sum("__gain").alias("__gain"))
    weight = F.expr("case when n_features > 0 then (__gain - pmod(__gain, n_features)) div n_features else 0L end")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))  , 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    out = by_doc.select("__at", "__tie", "doc_id", "n_words", "n_features", weight.alias("weight"), (weight + gumbel).alias("score"))
    out = cut(out, "scores")
    forget(grams)
    return out


def draw(scored: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """Adds rank to the rows of scores(): from 1 for the highest percent of those with at least `least` words, else null."""
    order = [F.desc("__may"), F.desc("score"), F.col("doc_id").asc_nulls_last(), F.asc("__at")]
    ranged = scored.withColumn("__may", F.col("n_words") >= least).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged, "ranged")
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.count(F.when(F.col("__may"), 1)).alias("__m"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    counts = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__m").over(W.partitionBy()).alias("__all"))
    out = ranged.withColumn("__in", F.row_number().over(W.partitionBy("__part").orderBy(*order))).join(counts, F.col("__part") == F.col("__p"))
    place = F.col("__before") + F.col("__in")
    rank = F.when(F.col("__may") & (place <= F.expr(f"__all * {int(percent)} div 100")), place)
    return out.select(*scored.columns, rank.cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, **options) -> DataFrame:
    """The documents that are drawn, with all their columns."""
    ranked = draw(scores(docs.select("doc_id", "text"), target, **options), percent, least)
    drawn = ranked.groupBy("doc_id", "__tie").agg(F.count("rank").alias("__k"), F.count(F.lit(1)).alias("__n")).where("__k > 0")
    drawn = cut(drawn.select(F.col("doc_id").alias("__id"), F.col("__tie").alias("__t"), "__k", "__n"), "drawn")
    out = docs.join(drawn, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__t")))
    if drawn.where("__k < __n").limit(1).count():  # of equal rows only some are drawn
        out = out.withColumn("__i", F.row_number().over(W.partitionBy("__id", "__t").orderBy(F.lit(1)))).where("__i <= __k")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
