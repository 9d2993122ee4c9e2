"""Passages of at least WINDOW words that stand anywhere else, by super-k-mers.

A window is WINDOW consecutive words. Its minimiser is the least hash of the runs of MINIMISER words in it; consecutive windows
that share one form a super-k-mer, whose words travel as one string to the minimiser's bucket. Windows of equal words share
their minimiser, so they meet there, where sorting counts them. In detail:

1. Super-k-mers are found as (document, place, minimiser), without words: word hashes are Spark's, minima are numpy's.
2. A window that repeats has a minimiser that stands at two places; only super-k-mers of such minimisers get their words, and
   equal strings become one with a count. Text that stands nowhere else isn't moved.
3. A bucket's windows are counted exactly, by words, in a stream of buckets. A bucket of over HOT different strings is counted
   one window at a time instead, by the window's SHA-256 (128 bits of it), in Spark, with partial sums, so that it spreads out.
4. Strings with repeated windows are joined back to the places they came from; what a document's repeated windows cover
   is removed from it.

Strings that are equal, as copies and common passages make them, are one row before they meet in a bucket; joins back to their
places are sort-merge joins that adaptive execution splits. Rows are known by their id and a hash of their text.

Nulls and odd rows: a null or empty text has no words and keeps none. Rows that repeat an id are rows of their own: equal texts
remove each other's windows whatever their ids are, null ones included. Words over and over in one document are windows
that repeat. Empty tables give no rows. Extra columns pass through `without_repeats`, where results take the place of columns of their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import cut, forget, table, words

WINDOW = 35
MINIMISER = 10
HOT = 4096
#: Windows of a super-k-mer at most; longer ones (words over and over) go on in the next.
MOST = 64
#: Words that a task sorts at once, if its buckets are smaller.
WORDS = 1 << 18
_KEY = ["__id", "__tie"]
_RANGES = "array<struct<a:int,b:int>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def minimisers(hashes: np.ndarray, window: int = WINDOW, width: int = MINIMISER) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the words, the least hash of the runs of width words in it, of which the window has window - width + 1; and
    the hashes of all runs. The words are as many as a window at least."""
    h = hashes.astype(np.uint64)
    runs = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        runs = _mixed(runs + h[k : len(h) - width + 1 + k])
    # Minima of 1, 2, 4, ... runs; the last two may overlap.
    n, have, least = window - width + 1, 1, runs
    while have < n:
        step = min(have, n - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least, runs


def _super_k_mers(window: int, width: int):
    """Rows (__id, __tie, start, n, mini, places) of batches (__id, __tie, h): n windows from word start on share the minimiser mini,
    which stands at two places at least if places is 2, else (1) at one in this document."""

    def run(batches):
        for batch in batches:
            h = batch.column("h")
            offsets = h.offsets.to_numpy()
            values = h.values.to_numpy(zero_copy_only=False)
            rows, starts, lengths, minis, places = [], [], [], [], []
            for i in range(len(h)):
                least, runs = minimisers(values[offsets[i] : offsets[i + 1]], window, width)
                first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
                size = np.diff(np.append(first, len(least)))
                if size.max() > MOST:
                    parts = -(-size // MOST)
                    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    first, size = np.repeat(first, parts) + inner * MOST, np.minimum(np.repeat(size, parts) - inner * MOST, MOST)
                rows.append(np.full(len(first), i))
                starts.append(first)
                lengths.append(size)
                minis.append(least[first])
                runs.sort()
                places.append(1 + np.isin(minis[-1], runs[1:][runs[1:] == runs[:-1]]))
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column("__id").take(at), batch.column("__tie").take(at), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(lengths).astype(np.int32)), pa.array(np.concatenate(minis).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32))], names=["__id", "__tie", "start", "n", "mini", "places"])

    return run


def repeated_windows(texts: list[str], counts: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """For each text, the places of its windows that stand twice or more in all texts, each text counting as often as it says."""
    number: dict[str, int] = {}
    split = [t.split(" ") for t in texts]
    ids = np.array([number.setdefault(w, len(number)) for ws in split for w in ws], np.int64)
    size = np.array([len(ws) for ws in split])
    n = np.maximum(size - window + 1, 0)
    of = np.repeat(np.arange(len(texts)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[of] + inner
    if not len(at):
        return [at for _ in texts]
    # Sorted by a rolling hash of the numbers; windows of equal hash are then compared word by word.
    hash_ = np.zeros(len(ids) - window + 1, np.uint64)
    mixed = _mixed(ids.astype(np.uint64) + np.uint64(1))
    for k in range(window):
        hash_ = hash_ * np.uint64(0x100000001B3) + mixed[k : len(hash_) + k]
    order = np.argsort(hash_[at], kind="stable")
    sorted_ = hash_[at][order]
    equal = np.concatenate(([False], sorted_[1:] == sorted_[:-1]))
    views = np.lib.stride_tricks.sliding_window_view(ids, window)
    pairs = np.flatnonzero(equal)
    for k in range(0, len(pairs), 1 << 14):
        p = pairs[k : k + (1 << 14)]
        if not (views[at[order[p]]] == views[at[order[p - 1]]]).all():
            _, group = np.unique(views[at], axis=0, return_inverse=True)  # different windows of one hash: by the words themselves
            group = group.reshape(-1)
            break
    else:
        group = np.empty(len(at), np.int64)
        group[order] = np.cumsum(~equal) - 1
    total = np.bincount(group, weights=np.asarray(counts, np.float64)[of])
    found = total[group] >= 2
    ends = np.cumsum(n)
    return [inner[e - k : e][found[e - k : e]] for e, k in zip(ends, n, strict=True)]


def covered(places: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Half-open ranges of words that windows at these ascending places cover."""
    if not len(places):
        return []
    first = np.flatnonzero(np.concatenate(([True], np.diff(places) > window)))
    last = np.append(first[1:] - 1, len(places) - 1)
    return [(int(a), int(b) + window) for a, b in zip(places[first], places[last], strict=True)]


def _counted(window: int):
    """Rows (key, ranges) of a stream of (mini, key, s, times) in the order of mini: what the repeated windows of each string cover."""

    def run(batches):
        held: list[tuple[bytes, str, int]] = []
        size, last = 0, None

        def flush():
            found = repeated_windows([x[1] for x in held], [x[2] for x in held], window)
            out = [(x[0], [{"a": a, "b": b} for a, b in covered(p, window)]) for x, p in zip(held, found, strict=True) if len(p)]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["key", "ranges"])

        for batch in batches:
            for mini, key, s, times in zip(*(batch.column(c).to_pylist() for c in ("mini", "key", "s", "times")), strict=True):
                if mini != last and size >= WORDS:
                    yield flush()
                    held, size = [], 0
                held.append((key, s, times))
                size += s.count(" ") + 1
                last = mini
        if held:
            yield flush()

    return run


def _digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _by_window(strings: DataFrame, window: int) -> DataFrame:
    """As _counted, in Spark: one row a window."""
    split = F.split("s", " ")
    each = F.transform(F.sequence(F.lit(1), F.size("ws") - (window - 1)), lambda i: _digest(F.array_join(F.slice("ws", i, window), " ")))
    rows = strings.select("key", "times", split.alias("ws")).select("key", "times", F.posexplode(each).alias("i", "w"))  # all strings have a window
    twice = rows.groupBy("w").agg(F.sum("times").alias("n")).where("n >= 2").select(F.col("w").alias("w2"))
    found = rows.join(twice, F.col("w") == F.col("w2"), "left_semi").groupBy("key").agg(F.collect_list("i").alias("i"))
    return found.select("key", F.transform("i", lambda i: F.struct(i.alias("a"), (i + window).cast("int").alias("b"))).cast(_RANGES).alias("ranges"))


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__tie"), "text")


def repeats(docs: DataFrame, window: int = WINDOW, width: int = MINIMISER, hot: int = HOT) -> DataFrame:
    """Rows (__id, __tie, ranges) of documents (doc_id, text) with windows that repeat: disjoint, ascending half-open ranges of their words."""
    texts = _identified(docs)
    hashes = texts.select("__id", "__tie", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).where(F.size("h") >= window)
    kind = docs.schema["doc_id"].dataType.simpleString()
    places = cut(hashes.mapInArrow(_super_k_mers(window, width), f"__id {kind}, __tie long, start int, n int, mini long, places int"), "super-k-mers")
    twice = places.groupBy("mini").agg(F.sum("places").alias("n")).where("n >= 2").select(F.col("mini").alias("m2"))
    places_ = places.join(twice, F.col("mini") == F.col("m2"), "left_semi")
    # Rows that repeat id and text have the same places each; one list does for all of them.
    lists = places_.groupBy("__id", "__tie", "start").agg(F.first("n").alias("n"), F.first("mini").alias("mini"))
    lists = lists.groupBy("__id", "__tie").agg(F.collect_list(F.struct("start", "n", "mini")).alias("p"))
    lists = lists.select(F.col("__id").alias("__id2"), F.col("__tie").alias("__tie2"), "p")
    with_words = texts.join(lists, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__tie") == F.col("__tie2"))).select("__id", "__tie", words(F.col("text")).alias("ws"), "p")
    string = F.transform("p", lambda p: F.struct(p["start"].alias("start"), p["mini"].alias("mini"), F.array_join(F.slice("ws", p["start"] + 1, p["n"] + (window - 1)), " ").alias("s")))
    strings = with_words.select("__id", "__tie", F.explode(string).alias("x")).select("__id", "__tie", "x.*").withColumn("key", _digest(F.col("s")))
    strings = cut(strings, "strings")
    forget(places)
    one = strings.groupBy("key").agg(F.first("mini").alias("mini"), F.first("s").alias("s"), F.count(F.lit(1)).alias("times"))
    one = cut(one, "buckets")
    sizes = one.groupBy("mini").agg(F.count(F.lit(1)).alias("n"))
    crowded = cut(sizes.where(F.col("n") > hot).select(F.col("mini").alias("m2")), "crowded")
    is_hot = F.col("mini") == F.col("m2")
    some = one.join(crowded, is_hot, "left_anti").repartition("mini").sortWithinPartitions("mini").select("mini", "key", "s", "times")
    found = some.mapInArrow(_counted(window), f"key binary, ranges {_RANGES}").unionByName(_by_window(one.join(crowded, is_hot, "left_semi"), window))
    found = cut(found.select(F.col("key").alias("k2"), "ranges"), "found")
    back = strings.select("__id", "__tie", "start", "key").join(found, F.col("key") == F.col("k2"))
    moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b")))
    back = back.select("__id", "__tie", F.explode(moved).alias("r")).distinct().groupBy("__id", "__tie").agg(F.array_sort(F.collect_list("r")).alias("r"))
    none = F.struct(F.array().cast(_RANGES).alias("done"), F.lit(None).cast("struct<a:int,b:int>").alias("open"))
    merged = F.aggregate(
        "r", none,
        lambda acc, r: F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), r.alias("open")))
        .when(r["a"] <= acc["open"]["b"], F.struct(acc["done"].alias("done"), F.struct(acc["open"]["a"].alias("a"), F.greatest(acc["open"]["b"], r["b"]).alias("b")).alias("open")))
        .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), r.alias("open"))),
        lambda acc: F.concat(acc["done"], F.array(acc["open"])),
    )
    out = cut(back.select("__id", "__tie", merged.cast(_RANGES).alias("ranges")), "repeats")
    forget(strings, one, crowded, found)
    return out


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """Adds n_words, n_removed, ranges (of removed words) and kept_text, the other words joined by one space, to each document."""
    ranges = repeats(docs.select("doc_id", "text"), **options)
    ranges = ranges.select(F.col("__id").alias("__id2"), F.col("__tie").alias("__tie2"), F.col("ranges").alias("__r"))
    out = docs.join(ranges, F.col("doc_id").eqNullSafe(F.col("__id2")) & (F.xxhash64("text") == F.col("__tie2")), "left")
    out = out.withColumn("__ws", words(F.col("text"))).withColumn("__r", F.coalesce("__r", F.array().cast(_RANGES)))
    end = F.array(F.struct(F.size("__ws").alias("a"), F.size("__ws").alias("b")))
    gaps = F.transform(F.concat("__r", end), lambda r, i: F.slice("__ws", F.coalesce(F.get(F.col("__r"), i - 1)["b"], F.lit(0)) + 1, r["a"] - F.coalesce(F.get(F.col("__r"), i - 1)["b"], F.lit(0))))
    results = {
        "n_words": F.size("__ws").cast("long"),
        "n_removed": F.aggregate("__r", F.lit(0).cast("long"), lambda a, r: a + r["b"] - r["a"]),
        "ranges": F.col("__r"),
        "kept_text": F.array_join(F.flatten(gaps), " "),
    }
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results], *[v.alias(k) for k, v in results.items()])


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
