"""Quality rules: counts of words, symbols and repetition, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed word unigrams and bigrams: one of trusted documents, one of the raw corpus.
A document's score is its mean log ratio per n-gram; documents under a fixed threshold are rejected. All of it is built-in
Spark functions. The raw counts cover every document; the trusted ones come from at most `max_trusted` labelled documents,
those with the smallest hash of their id, so that their ids can be broadcast (8 bytes each).

Nulls and odd rows: a null or blank text has no words, zero counts, a null score and fails the base rule. Null ids are scored
but are never trusted. Repeated rows count once each. Without trusted documents there is no ratio: the score is null and the
base rule alone decides. Extra columns pass
through; ones named as a result give way to it, and internal names start with two underscores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import table, words

#: A power of two.
BUCKETS = 1 << 16
MAX_TRUSTED = 20_000
THRESHOLD = -0.15
WINDOW = 8
_SYMBOLS = "[^#*$%&|<>]+"
_SPACE = " \t\n\x0b\x0c\r"


def _hashes(df: DataFrame) -> DataFrame:
    """Adds __w, the words, __h, their hashes, and __2, the hashes of word pairs."""
    df = df.withColumn("__w", words(F.col("text"))).withColumn("__h", F.expr("transform(__w, x -> xxhash64(x))"))
    return df.withColumn("__2", F.expr("slice(transform(__h, (x, i) -> xxhash64(x, get(__h, i + 1))), 1, greatest(size(__h) - 1, 0))"))


def _grams(buckets: int) -> Column:
    """Buckets of the unigrams, then of the bigrams."""
    return F.expr(f"concat(transform(__h, x -> int(x & {buckets - 1}L)), transform(__2, x -> int(x & {buckets - 1}L)))")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float] | None:
    """Log ratio of each bucket, smoothed by one count a bucket spread as the raw corpus; None without trusted n-grams.

    trusted: the distinct ids of the trusted documents, few enough to broadcast. The driver gets one row a bucket."""
    own = F.broadcast(trusted.select(F.col("doc_id").alias("__id"), F.lit(1).alias("__t")))
    grams = _hashes(docs.select("doc_id", "text")).select("doc_id", _grams(buckets).alias("__g")).join(own, F.col("doc_id") == F.col("__id"), "left")
    # explode_outer: for explode, Spark would infer a filter on the array and compute it twice.
    rows = grams.select("__t", F.explode_outer("__g").alias("__b")).where("__b is not null").groupBy("__b").agg(F.count(F.lit(1)).alias("n"), F.count("__t").alias("t")).collect()
    raw, good = sum(r.n for r in rows), sum(r.t for r in rows)
    if not good:
        return None
    ratios = [0.0] * buckets
    for r in rows:
        share = (r.n + 1) / (raw + buckets)
        ratios[r["__b"]] = math.log((r.t + buckets * share) / (good + buckets) / share)
    return ratios


def trusted_ids(labels: DataFrame, limit: int = MAX_TRUSTED) -> DataFrame:
    """At most limit distinct ids of documents labelled good."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept to every document."""
    ratios = log_ratios(docs, trusted_ids(labels, max_trusted), buckets)
    out = _hashes(docs)
    # A window's hash is that of its halves: pairs of words make fours, pairs of fours make eights.
    out = out.withColumn("__4", F.expr("transform(__2, (x, i) -> xxhash64(x, get(__2, i + 2)))"))
    out = out.withColumn("__v", F.expr(f"slice(transform(__4, (x, i) -> xxhash64(x, get(__4, i + 4))), 1, greatest(size(__h) - {WINDOW - 1}, 0))"))
    # Only where a window repeats: sort windows with their places, keep those equal to a neighbour, and add up the words they newly cover.
    out = out.withColumn("__s", F.expr("case when size(array_distinct(__v)) < size(__v) then array_sort(transform(__v, (x, i) -> struct(x as v, i as i))) end"))
    out = out.withColumn("__p", F.expr("array_sort(transform(filter(__s, (e, k) -> e.v <=> get(__s, k - 1).v or e.v <=> get(__s, k + 1).v), e -> e.i))"))
    repeated = F.expr(f"coalesce(aggregate(__p, struct(0L as n, int(-{WINDOW}) as last), (a, p) -> struct(a.n + least({WINDOW}, p - a.last) as n, p as last), a -> a.n), 0L)")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    out = out.withColumn("__l", lines).withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, _SYMBOLS, "")).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": repeated.cast("long"),
    })
    if ratios is None:
        score = F.lit(None).cast("double")
    else:
        ratio = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
        add = lambda a, x: a + F.get(ratio, x.bitwiseAND(F.lit(buckets - 1)).cast("int"))
        score = F.when(F.size("__h") > 0, F.aggregate("__2", F.aggregate("__h", F.lit(0.0), add), add) / (F.size("__h") + F.size("__2")))
    out = out.withColumn("score", score).withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("score").isNull() | (F.col("score") >= threshold)))
    # The results pass through a generator of one row: a filter on them would else be moved below and compute them, arrays and all, once an element.
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return out.select(*kept, F.explode_outer(F.array(F.struct(*names))).alias("__r")).select(*kept, "__r.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules(docs, table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
