"""Near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

A document is its set of word shingles, as sorted 64-bit hashes. Documents with equal sets are one node. One hash of each
shingle serves all bins: its leading bits name the bin, the smallest hash of a bin is the bin's value; an empty bin copies the
value of the first filled bin of its own fixed random sequence. Bands of bins make buckets. In each bucket a hub, the member
that meets most others over all its buckets, is paired with every other member, so a bucket of g members gives g - 1 pairs.
Pairs are confirmed on the full sets. Members of a bucket that none of its hubs is linked with are paired with its next hub, up
to HUBS times. Confirmed links are merged to components. Buckets that then hold several components and pairs not yet compared
are compared in full: in blocks of members whose intersections are counted by matrix products, so that no row is made for a
pair; only members of different components count, and buckets of the same members are one. New links merge the components.

Hot groups: a bucket's rows and its hub meet in parts of about SPLIT rows, a hub's set goes once to each part of about BLOCK of
its partners (not to each pair), and joins by a component's name are left joins that adaptive execution splits.

So components are those of all pairs that share a bucket. Bins per band follow from the similarity: as many as leave a chance
of at most MISS that two documents just at it share no bucket (0.85: 32 bands of 8 bins, 4e-5; 0.8: 42 of 6, 3e-6).

Nulls and odd rows: a text without words (or null) is linked with nothing and is a component of its own. Repeated rows and
texts are one node. A component's id is its smallest document id; null ids count only where there is no other. Extra columns
play no part in `components`; `one_of_each` keeps them, and one row of each component: of its smallest id, and where rows share
that id, of its smallest node, then of the smallest hash of the text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidebar.llm.common import cut, forget, settled, table

PERCENT = 85
SHINGLE = 3
BIN_BITS = 8
MISS = 5e-5
HUBS = 2
#: Size of a block of members: their shingles, and _EACH for each member.
BLOCK = 1 << 18
_EACH = 256
#: Rows of a bucket that meet its hub in one part.
SPLIT = 1024
_SLICE = 2048
_BINS = 1 << BIN_BITS
_LAST = (1 << 63) - 1

_random = np.random.Generator(np.random.PCG64(2017))
_MIX = _random.integers(1, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _random.integers(1, 1 << 63, 32, np.uint64)
#: Where an empty bin looks for a value: a few places first, then more.
_PROBES = _random.integers(0, _BINS, (_BINS, 1024)).astype(np.int16)
_BAND = np.concatenate((_BAND, _random.integers(1, 1 << 63, _BINS - len(_BAND), np.uint64)))
_EDGES = (np.arange(_BINS, dtype=np.uint64) << np.uint64(64 - BIN_BITS)).astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of the whole sequence if it has fewer words than a shingle."""
    own = (text or "").encode("utf-8", "replace").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    n = min(width, len(own))
    x = np.full(len(own) - n + 1, n, np.uint64)
    for i in range(n):
        x = x + h[i : len(h) - n + 1 + i] * _MIX[i]
    return np.unique(_mixed(x))


def signature(found: np.ndarray) -> np.ndarray:
    """The value of each bin of a set that isn't empty."""
    at = np.searchsorted(found, _EDGES)
    ends = np.append(at[1:], len(found))
    full = at < ends
    out = np.where(full, found[np.minimum(at, len(found) - 1)], np.uint64(0))
    for width in (16, _PROBES.shape[1]):
        empty = np.flatnonzero(~full) if width == 16 else empty[~hit]
        if not len(empty):
            return out
        tried = full[_PROBES[empty, :width]]
        first = tried.argmax(axis=1)
        hit = tried[np.arange(len(empty)), first]
        out[empty[hit]] = out[_PROBES[empty, first][hit]]
    out[empty[~hit]] = found[0]
    return out


def bins_per_band(percent: int) -> int:
    """The most bins a band can have if documents at this similarity are to share a bucket but for a chance of MISS."""
    return max((r for r in range(2, len(_MIX) + 1) if (1 - (percent / 100) ** r) ** (_BINS // r) <= MISS), default=1)


def band_keys(found: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    n = bins_per_band(percent)
    bands = _BINS // n
    rows = signature(found)[: bands * n].reshape(bands, n) * _MIX[:n]
    return _mixed(rows.sum(axis=1, dtype=np.uint64) + _BAND[:bands]).view(np.int64)


def _node(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def sketches(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, tie (a hash of the text), n_shingles, node (a hash of the set) and bands of every document; null and empty for an empty set."""

    def run(batches):
        for b in batches:
            sets = [shingles(x.as_py(), width) for x in b.column("text")]
            bands = pa.array([band_keys(x, percent) if len(x) else [] for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array([len(x) for x in sets], pa.int64()), pa.array([_node(x) if len(x) else None for x in sets], pa.binary()), bands], names=["doc_id", "tie", "n_shingles", "node", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(run, "doc_id long, tie long, n_shingles long, node binary, bands array<long>")


def _sets(docs: DataFrame, ends: DataFrame, width: int) -> DataFrame:
    """node and set of the documents whose ids are in ends (__id)."""
    texts = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "text").join(ends, F.col("doc_id") == F.col("__id"), "left_semi")

    def sets(batches):
        for b in batches:
            found = [shingles(x.as_py(), width) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "set"])

    return texts.mapInArrow(sets, "node binary, set binary")


def _confirmed(docs: DataFrame, pairs: DataFrame, percent: int, width: int) -> DataFrame:
    """Those of the pairs (hub, node, h_id, id, n) whose full sets are similar enough. Only documents in a pair are read again."""
    # Written first: where few documents are left, Spark sees the small table and needn't move the texts.
    pairs = cut(pairs, "pairs")
    ends = cut(pairs.select(F.explode(F.array("h_id", "id")).alias("__id")).distinct(), "ends")
    own = cut(_sets(docs, ends, width), "sets")
    sizes = pairs.groupBy("hub").agg(F.ceil(F.sum(F.col("n") + _EACH) / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    partners = pairs.join(sizes, "hub").select("hub", "node", part).join(own, "node")
    hubs = sizes.join(own, F.col("hub") == F.col("node")).select(F.col("hub").alias("h"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("set").alias("h_set"))

    def similar(key, hub, found):
        keep = []
        if hub.num_rows:
            x = np.frombuffer(hub.column("h_set")[0].as_buffer(), np.uint64)
            for s in found.column("set"):
                y = np.frombuffer(s.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
        kept = found.column("node").filter(pa.array(keep, pa.bool_())) if keep else pa.chunked_array([], pa.binary())
        return pa.table({"hub": pa.array([key[0].as_py()] * len(kept), pa.binary()), "node": kept.cast(pa.binary())})

    out = hubs.groupBy("h", "part").cogroup(partners.groupBy("hub", "part")).applyInArrow(similar, "hub binary, node binary")
    out = cut(out.distinct(), "links")
    forget(own)
    return out


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of left with each of right."""
    (a, rows), (b, columns) = ((np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x])) for x in (left, right))
    known = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)

    def places(x, at):
        to = np.searchsorted(known, x)
        held = known[np.minimum(to, len(known) - 1)] == x
        order = np.argsort(to[held], kind="stable")
        return to[held][order], at[held][order]

    if len(known):
        (a, rows), (b, columns) = places(a, rows), places(b, columns)
        for start in range(0, len(known), _SLICE):
            sides = []
            for x, at, n in ((a, rows, len(left)), (b, columns, len(right))):
                i, j = np.searchsorted(x, (start, start + _SLICE))
                side = np.zeros((n, min(_SLICE, len(known) - start)), np.float32)
                side[at[i:j], x[i:j] - start] = 1
                sides.append(side)
            out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _joined(docs: DataFrame, live: DataFrame, reach: DataFrame, percent: int, width: int, hubs: int) -> DataFrame | None:
    """Links (a, b) between components that the stars have left apart; live: buckets, reach: node and label of every node."""
    own = cut(live.select("key", "node", "id", "n").join(reach.select(F.col("node").alias("__n"), F.col("label.node").alias("part")), F.col("node") == F.col("__n")).drop("__n"), "parts")
    parts = own.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n") + _EACH).alias("w"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    whole = parts.groupBy("key").agg(F.sum("c").alias("size"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("w", "part")).alias("most"), F.sum("w").alias("w"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    # Where every member is a component of its own and was a hub or the last one left, all pairs have been compared.
    whole = whole.where(f"parts > 1 and not (size <= {hubs + 1} and parts = size)").groupBy("x", "y", "size").agg(F.min(F.struct("key", "most", "w")).alias("k")).select("k.*")
    # Members of a bucket's largest component needn't be compared with each other: the others, in `few` blocks, meet all blocks.
    few = F.expr(f"if(w <= {BLOCK}, 1L, ceil((w - most.w) / {BLOCK}))")
    many = F.expr(f"if(w <= {BLOCK}, 0L, ceil(most.w / {BLOCK}))")
    whole = cut(whole.select(F.col("key").alias("__k"), F.col("most.part").alias("most"), few.alias("few"), many.alias("many")), "open")
    if not whole.limit(1).count():
        forget(own)
        return None
    block = F.expr("if(many > 0 and part = most, few + pmod(xxhash64(node), many), pmod(xxhash64(node), few))")
    rows = own.join(whole, F.col("key") == F.col("__k")).withColumn("block", block)
    pairs = F.expr("transform(sequence(0L, if(block < few, few + many, few) - 1), x -> struct(least(x, block) as i, greatest(x, block) as j))")
    rows = cut(rows.select("key", "node", "id", "part", "block", F.explode(pairs).alias("p")).select("key", "node", "id", "part", "block", "p.*"), "blocks")
    ends = cut(rows.select(F.col("id").alias("__id")).distinct(), "ends")
    sets = cut(_sets(docs, ends, width).withColumnRenamed("node", "__n").dropDuplicates(["__n"]), "sets")

    def compare(key, found):
        i, j = key[1].as_py(), key[2].as_py()
        block = found.column("block").to_numpy()
        part = np.array(found.column("part").to_pylist(), object)
        set_of = [np.frombuffer(x.as_buffer(), np.uint64) for x in found.column("set").combine_chunks()] if len(found) else []
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links, root = [], {}

        def top(x):
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        if len(left) and len(right):
            names, number = np.unique(part, return_inverse=True)
            both = _shared([set_of[x] for x in left], [set_of[x] for x in right])
            sizes = np.array([len(x) for x in set_of])
            near = (100 * both >= percent * (sizes[left][:, None] + sizes[right] - both)) & (number[left][:, None] != number[right])
            a, b = np.nonzero(near)
            for x, y in np.unique(np.stack((number[left[a]], number[right[b]]), axis=1), axis=0).tolist():
                if (x := top(x)) != (y := top(y)):
                    root[x] = y
                    links.append((names[x], names[y]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    out = cut(rows.join(sets, F.col("node") == F.col("__n")).select("key", "i", "j", "block", "part", "set").groupBy("key", "i", "j").applyInArrow(compare, "a binary, b binary").distinct(), "joined")
    forget(own, rows, sets)
    return out


def merged(links: DataFrame, names: DataFrame) -> DataFrame:
    """Components of links (a, b): each node's label, the smallest name in reach. names: node and label of every linked node."""
    ways = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "ways")
    labels = names
    while True:
        told = ways.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("told"))
        nearer = cut(labels.join(told, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("told", "label")).alias("label")), "nearer")
        far = nearer.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        jumped = cut(nearer.join(far, F.col("label")["node"] == F.col("__n"), "left").select("node", "old", F.least("label", F.coalesce("__l", "label")).alias("label")), "labels")
        changed = jumped.where("old != label").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def _salted(of: DataFrame) -> DataFrame:
    """A row for each part of a bucket; of has the number of its parts."""
    return of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def _labelled(docs: DataFrame, percent: int, width: int, hubs: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all documents, and node and label (id, node) of every node."""
    found = cut(sketches(docs, width, percent), "sketches")
    nodes = cut(found.where("node is not null").groupBy("node").agg(F.coalesce(F.min("doc_id"), F.lit(_LAST)).alias("id"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands")), "nodes")
    # Smaller sets can't be so similar without being equal.
    rows = nodes.where(f"n * (100 - {percent}) >= {percent}").select("node", "id", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    first = cut(rows.join(shared, "key"), "buckets")
    central = first.groupBy(F.col("node").alias("__n")).agg(F.sum("size").alias("met"))
    parts = F.ceil(F.col("size") / SPLIT).cast("int").alias("parts")
    live = first.join(central, F.col("node") == F.col("__n")).select("key", "node", "id", "n", "met", parts)
    live = cut(live.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "buckets")
    forget(first)
    place = F.struct("met", F.xxhash64("node").alias("tie"), "node", "id", "n")
    # Rows that no hub of their bucket has been linked with; at first all.
    alone, last, found_links = live, None, []
    for _ in range(hubs):
        # The next hub of each bucket with such rows: the most central member after the last one.
        free = live.join(_salted(alone.select("key", "parts").distinct()).drop("parts"), ["key", "salt"], "left_semi").withColumn("place", place)
        if last is not None:
            free = free.join(_salted(last).drop("parts"), ["key", "salt"]).where("place < hub").drop("hub")
        hub = cut(free.groupBy("key", "parts").agg(F.max("place").alias("hub")), "hubs")
        to = _salted(hub).select("key", "salt", F.col("hub.node").alias("hub"), F.col("hub.id").alias("h_id"), F.col("hub.n").alias("h_n"))
        star = cut(alone.select("key", "salt", "parts", "node", "id", "n").join(to, ["key", "salt"]).where("node != hub"), "star")
        near = star.where(f"100 * least(n, h_n) >= {percent} * greatest(n, h_n)").select("hub", "node", "h_id", "id", "n").distinct()
        links = _confirmed(docs, near, percent, width)
        found_links.append(links)
        still = cut(star.join(links, ["hub", "node"], "left_anti").select("key", "salt", "parts", "node", "id", "n"), "alone")
        forget(star)
        alone, last = still, hub
        if not alone.limit(1).count():
            break
    links = reduce(DataFrame.unionByName, found_links).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    ends = links.select(F.explode(F.array("a", "b")).alias("__n")).distinct()
    own = F.struct("id", "node")
    labels = merged(links, cut(nodes.join(ends, F.col("node") == F.col("__n"), "left_semi").select("node", own.alias("label")), "names"))
    reach = cut(nodes.select(F.col("node").alias("__n"), own.alias("own")).join(labels, F.col("node") == F.col("__n"), "left").select(F.col("__n").alias("node"), F.coalesce("label", "own").alias("label")), "reach")
    joins = _joined(docs, live, reach, percent, width, hubs)
    forget(live)
    if joins is not None and joins.limit(1).count():
        ends = joins.select(F.explode(F.array("a", "b")).alias("__n")).distinct()
        over = merged(joins, cut(nodes.join(ends, F.col("node") == F.col("__n"), "left_semi").select("node", own.alias("label")), "names"))
        over = over.select(F.col("node").alias("__p"), F.col("label").alias("over"))
        reach = cut(reach.join(over, F.col("label.node") == F.col("__p"), "left").select("node", F.coalesce("over", "label").alias("label")), "reach")
    return found.drop("bands"), reach


def components(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, hubs: int = HUBS) -> DataFrame:
    """doc_id, n_shingles, node and component_id of every document; links need 100 * intersection >= percent * union."""
    found, reach = _labelled(docs, percent, width, hubs)
    reach = reach.select(F.col("node").alias("__n"), F.col("label.id").alias("__least"))
    out = found.join(reach, F.col("node") == F.col("__n"), "left")
    least = F.when(F.col("__n").isNull(), F.col("doc_id")).when(F.col("__least") != _LAST, F.col("__least"))
    return out.select("doc_id", "n_shingles", "node", least.alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, hubs: int = HUBS) -> DataFrame:
    """The documents, of each component only one row; all rows without words, but for equal ones."""

    def choose() -> DataFrame:
        found, reach = _labelled(docs, percent, width, hubs)
        first = reach.where("node = label.node").select(F.col("node").alias("__n"), F.col("label.id").alias("__least"))
        chosen = found.join(first, (F.col("node") == F.col("__n")) & (F.coalesce("doc_id", F.lit(_LAST)) == F.col("__least")))
        chosen = chosen.groupBy("doc_id", "node").agg(F.min("tie").alias("tie"))
        return chosen.select("doc_id", "tie").unionByName(found.where("node is null").select("doc_id", "tie").distinct())

    kept = settled(choose, "kept").select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"))
    text = F.xxhash64("text")
    out = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (text == F.col("__tie")), "left_semi")
    # Equal rows leave one. Without such rows, texts needn't move again.
    if not docs.groupBy("doc_id", text.alias("__t")).count().where("count > 1").limit(1).count():
        return out
    return out.withColumn("__i", F.row_number().over(W.partitionBy("doc_id", text).orderBy(F.lit(1)))).where("__i = 1").drop("__i")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
