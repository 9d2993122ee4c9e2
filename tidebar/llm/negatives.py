"""Hard negatives: for each anchor and each of its nearest rows of the same label, the nearest rows of other labels within a window
of the positive's score.

Scores are inner products of whole numbers, found by matrix products in float64, which are exact below 2^53 (each block checks
its own bound; above it the product is made in 64-bit integers). Anchors are numbered and broadcast in blocks of at most BLOCK
bytes; all rows, dealt out evenly, are multiplied with each block. A task keeps the best few for each anchor as batches pass, so it
holds one batch and one slice of products; what tasks keep is merged by anchor. A first pass finds the positives, a second one,
with their scores broadcast, the negatives within each positive's window.

Nulls and odd rows: rows with a null label, a null vector, a null, NaN or infinite component, or of another length than most
take no part. A null id is never an anchor and comes last among ties. Rows that repeat an id, or a vector, are rows of their own:
each is a candidate of the other, and anchors that repeat an id have results each. An anchor without positives, or a positive
without negatives in its window, gives no rows. Products that don't fit into 64 bits raise an error. Extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidebar.llm.common import cut, forget, table

POSITIVES = 5
NEGATIVES = 10
#: Percent of the positive's score.
WINDOW = (30, 90)
SCALE = 256
#: Bytes of a block of anchors, at 8 a component.
BLOCK = 1 << 25
#: Products held at a time.
SLICE = 1 << 21
#: Rows of a partition.
ROWS = 1 << 14
_LAST = (1 << 63) - 1
_BEST = "anchor long, slot int, score long, id long, at long"


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows (id, label, v, at) that take part: v holds floor(scale * x)."""
    usable = vectors.where("label is not null and embedding is not null").withColumn("x", F.transform("embedding", lambda x: x.cast("double")))
    usable = usable.where(F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))))
    common = usable.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = common[0]["size"] if common else 0
    usable = usable.where((F.size("x") == size) & (F.size("x") > 0))
    id_ = F.coalesce(F.col("vec_id").cast("long"), F.lit(_LAST))
    return usable.select(id_.alias("id"), F.col("label").cast("long").alias("label"), F.transform("x", lambda x: F.floor(x * scale)).alias("v"), F.monotonically_increasing_id().alias("at"))


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as 64-bit integers."""
    most = int(a.shape[1]) * max(int(a.max()), -int(a.min())) * max(int(b.max()), -int(b.min()))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    raise ValueError(f"inner products of up to {most} don't fit into 64 bits")


def first(key: np.ndarray, score: np.ndarray, id_: np.ndarray, at: np.ndarray, top: int) -> list[np.ndarray]:
    """The top rows of each key by falling score, then id, then place."""
    order = np.lexsort((at, id_, -score, key))
    sorted_ = key[order]
    keep = order[np.arange(len(key)) - np.searchsorted(sorted_, sorted_) < top]
    return [x[keep] for x in (key, score, id_, at)]


def _keep(scores: np.ndarray, mask: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's top scores under the mask; of ties at the border the first columns."""
    if scores.shape[1] > top:
        masked = np.where(mask, scores, np.iinfo(np.int64).min)
        border = np.partition(masked, -top, axis=1)[:, -top][:, None]
        over, level = mask & (masked > border), mask & (masked == border)
        mask = over | (level & (level.cumsum(axis=1) <= top - over.sum(axis=1)[:, None]))
    return np.nonzero(mask)


def _search(anchors, top: int, slots: int, wanted):
    """Over batches of rows: the best of each (anchor, slot) in a task. anchors: a broadcast of (at, label, v, own); wanted gives the mask
    of a slot from (scores, same label, other row, the slot's column of own)."""

    def run(batches):
        at_a, label_a, v_a, own = anchors.value
        best = [np.empty(0, np.int64) for _ in range(4)]  # key, score, id, at
        for batch in batches:
            n = batch.num_rows
            if not n or not len(at_a):
                continue
            id_b, label_b, at_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "at"))
            order = np.lexsort((at_b, id_b))  # columns stand in the order of ties
            id_b, label_b, at_b, v_b = id_b[order], label_b[order], at_b[order], _matrix(batch.column("v"), n)[order]
            step, found = max(1, SLICE // n), [best]
            for k in range(0, len(at_a), step):
                s = products(v_a[k : k + step], v_b)
                same, other = label_a[k : k + step, None] == label_b, at_a[k : k + step, None] != at_b
                for slot in range(slots):
                    i, j = _keep(s, wanted(s, same, other, own[k : k + step, slot : slot + 1] if own is not None else None), top)
                    found.append([(k + i) * slots + slot, s[i, j], id_b[j], at_b[j]])
            best = first(*(np.concatenate(x) for x in zip(*found, strict=True)), top)
        key, score, id_, at = best
        yield pa.RecordBatch.from_arrays([pa.array(at_a[key // slots] if len(key) else key), pa.array((key % slots).astype(np.int32)), pa.array(score), pa.array(id_), pa.array(at)], names=["anchor", "slot", "score", "id", "at"])

    return run


def _merged(best: DataFrame, top: int) -> DataFrame:
    of = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "at")
    return best.withColumn("rank", F.row_number().over(of)).where(F.col("rank") <= top)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, and positive_rank, from (vec_id, label, embedding);
    is_anchor is a condition on vec_id."""
    spark = vectors.sparkSession
    rows = cut(whole(vectors, scale), "rows")
    chosen = F.coalesce(is_anchor, F.lit(False))
    anchors = rows.withColumn("vec_id", F.when(F.col("id") != _LAST, F.col("id"))).where(chosen).drop("vec_id")
    # Numbered across partitions: the place in the partition after the counts of those before.
    anchors = cut(anchors.withColumn("n", F.monotonically_increasing_id()).withColumn("part", F.shiftright("n", 33)), "anchors")
    counts = {r.part: r["count"] for r in anchors.groupBy("part").count().collect()}  # a row a partition
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    starts = spark.createDataFrame(list(before.items()), "p long, before long")
    numbered = anchors.join(starts, F.col("part") == F.col("p")).withColumn("n", F.col("before") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1)))
    parts = max(1, -(-rows.count() // ROWS))
    dealt = rows.select("id", "label", "v", "at").repartition(max(parts, 2 * spark.sparkContext.defaultParallelism), F.xxhash64("at"))
    low, high = window
    size = (rows.select(F.size("v").alias("n")).first() or [1])[0]
    step = max(1, block // (8 * size))
    out = None
    for start in range(0, max(total, 1), step):
        got = numbered.where(F.col("n").between(start, start + step - 1)).select("at", "label", "v", "id").toArrow()
        at_a, v_a = got.column("at").to_numpy(), _matrix(got.column("v"), got.num_rows)
        sent = spark.sparkContext.broadcast((at_a, got.column("label").to_numpy(), v_a, None))
        near = dealt.mapInArrow(_search(sent, positives, 1, lambda s, same, other, own: same & other), _BEST)
        near = cut(_merged(near, positives).select("anchor", F.col("rank").alias("slot"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
        scores = np.full((len(at_a), positives), 0, np.int64)
        there = np.zeros((len(at_a), positives), bool)
        place = np.argsort(at_a, kind="stable")
        p = near.toArrow()  # at most step * positives rows
        i = place[np.searchsorted(at_a[place], p.column("anchor").to_numpy())] if p.num_rows else np.empty(0, np.int64)
        scores[i, p.column("slot").to_numpy() - 1], there[i, p.column("slot").to_numpy() - 1] = p.column("positive_score").to_numpy(), True
        # 100 * score between low and high percent of the positive's: whole bounds, rounded inwards; none where there is no positive.
        bounds = np.stack([np.where(there, -(-low * scores // 100), 1), np.where(there, high * scores // 100, 0)], axis=2)
        again = spark.sparkContext.broadcast((at_a, got.column("label").to_numpy(), v_a, bounds))
        far = dealt.mapInArrow(_search(again, negatives, positives, lambda s, same, other, own: ~same & (s >= own[:, :, 0]) & (s <= own[:, :, 1])), _BEST)
        far = _merged(far, negatives).select("anchor", (F.col("slot") + 1).alias("slot"), "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
        names = anchors.select(F.col("at").alias("anchor"), F.col("id").alias("anchor_id"))
        found = cut(far.join(near, ["anchor", "slot"]).join(names, "anchor"), "negatives")
        sent.unpersist()
        again.unpersist()
        forget(near)
        out = found if out is None else out.unionByName(found)
    forget(rows, anchors)
    named = lambda c: F.when(F.col(c) != _LAST, F.col(c)).alias(c)
    return out.select(named("anchor_id"), named("positive_id"), "rank", named("negative_id"), "positive_score", "negative_score", F.col("slot").alias("positive_rank"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return mine(vectors, F.col("vec_id") % 100 == 0)
