import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.compare import same
from tidebar.llm import importance, negatives, passages, queries

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@pytest.mark.parametrize("name", ["op11_importance", "op12_hard_negatives", "op13_repeated_passages"])
def test_as_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.SQL[name], sf_dir)


def grams(text, order):
    ws = TOKEN.findall((text or "").translate(LOWER))
    return len(ws), [" ".join(ws[i : i + k]) for k in range(1, order + 1) for i in range(len(ws) - k + 1)]


def resampled(rows, wanted, order, buckets, percent, least):
    """(doc_id, n_features, weight, score, rank) by plain loops; ranks of equal rows are those in their order."""
    of = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(of, grams(x, order)[1]))
    for x in wanted:
        t.update(map(of, grams(x, order)[1]))
    whole, target = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(whole) / ((s[b] + 1) * float(target))))
    out = []
    for k, x in rows:
        n, g = grams(x, order)
        weight = sum(gain(of(y)) for y in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(may[: percent * len(may) // 100]):
        r[5] = i + 1
    return [(r[0], *r[2:]) for r in out]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(60)] + ["Ab", "x1"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 90)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n "), (103, "--- ... ;"), (None, rows[3][1]), (None, None), (5, rows[5][1]), (5, "other text of an id " * 8)]
    rows += [(104, "long-word" * 3000), (105, ", ".join(rng.choice(vocabulary) for _ in range(6000)) + " " * 500), (106, "é" * 5000 + " tail" * 30)]
    return rows


@pytest.mark.parametrize(("order", "chunk"), [(1, 1 << 15), (1, 50), (3, 64), (2, 1)])
def test_importance_as_brute_force(spark, odd_texts, order, chunk):
    wanted = ["w1é w2é w3é w1é", None, "ab x1 ab"]
    docs = spark.createDataFrame(odd_texts, "doc_id long, text string")
    target = spark.createDataFrame([(x,) for x in wanted], "text string")
    got = importance.draw(importance.scores(docs, target, order=order, buckets=97, chunk=chunk), percent=40, least=5).collect()
    want = resampled(odd_texts, wanted, order, 97, 40, 5)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got], key=key) == sorted(want, key=key)


def test_importance_keeps_columns_and_takes_empty_tables(spark, odd_texts):
    docs = spark.createDataFrame([(*r, 7) for r in odd_texts], "doc_id long, text string, rank int").withColumnRenamed("rank", "n_words")
    target = spark.createDataFrame([("w1é w2é",)], "text string")
    drawn = importance.resample(docs, target, percent=50, least=5, buckets=97)
    assert drawn.columns == docs.columns and drawn.count() == 50 * sum(grams(x, 1)[0] >= 5 for _, x in odd_texts) // 100
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.scores(docs, target.limit(0)).count() == len(odd_texts)
    repeated = spark.createDataFrame([(1, "a b c d e f")] * 10, "doc_id long, text string")
    assert importance.resample(repeated, target, percent=50, least=5).count() == 5


def mined(rows, positives=5, negatives_=10, window=(30, 90)):
    rows = [(k, y, [math.floor(256 * float(x)) for x in v]) for k, y, v in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = Counter(len(v) for *_, v in rows).most_common(1)[0][0] if rows else 0
    rows = [r for r in rows if len(r[2]) == size]
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = []
    for i, (a, y, v) in enumerate(rows):
        if a is None or a % 100:
            continue
        scores = [(sum(p * q for p, q in zip(v, w, strict=True)), k, z) for j, (k, z, w) in enumerate(rows) if j != i]
        for ps, p, _ in sorted((x for x in scores if x[2] == y), key=order)[:positives]:
            fit = sorted((x for x in scores if x[2] != y and window[0] * ps <= 100 * x[0] <= window[1] * ps), key=order)[:negatives_]
            out += [(a, p, r + 1, x[1], ps, x[0]) for r, x in enumerate(fit)]
    return out


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(2)
    rows = [(int(i), int(rng.integers(0, 3)), [float(x) for x in rng.normal(0.3, 1, 8)]) for i in range(0, 900, 4)]
    rows += [(1, 0, None), (2, None, [0.5] * 8), (3, 1, [float("nan")] + [0.1] * 7), (5, 1, [float("inf")] + [0.1] * 7), (6, 1, [None] + [0.1] * 7), (7, 1, [0.1] * 5), (9, 1, []), (10, 1, [0.0] * 8)]
    rows += [(None, 1, [0.9] * 8), (None, 2, [0.8] * 8), (100, rows[25][1], rows[25][2]), (100, 2, [0.4] * 8)] + [(1001 + 2 * i, 2, [0.7] * 8) for i in range(30)] + [(1000, 1, [-1.0] * 8), (1100, 1, [1.0] * 8)]
    return rows


@pytest.mark.parametrize("block", [1 << 25, 3 * 8 * 8])
def test_hard_negatives_as_brute_force(spark, odd_vectors, block):
    from pyspark.sql import functions as F

    vectors = spark.createDataFrame([(*r, "x") for r in odd_vectors], "vec_id long, label int, embedding array<double>, rank string").repartition(5)
    got = negatives.mine(vectors, F.col("vec_id") % 100 == 0, block=block).collect()
    got = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(mined(odd_vectors), key=key) and len(got) > 100
    assert negatives.mine(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(vectors, F.col("vec_id") == 12345).count() == 0


def test_products_are_exact():
    big = np.array([[(1 << 29) + 1, 3], [-(1 << 30), 5]])
    assert negatives.products(big, big).tolist() == [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in big] for a in big]
    with pytest.raises(ValueError, match="64 bits"):
        negatives.products(big * 8, big * 8)


def reduced(rows, window):
    """(doc_id, n_words, n_removed, kept) by a table of all windows."""
    split = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(ws[i : i + window]) for ws in split for i in range(len(ws) - window + 1))
    out = []
    for (k, _), ws in zip(rows, split, strict=True):
        gone = {j for i in range(len(ws) - window + 1) if seen[tuple(ws[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((k, len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone)))
    return out


@pytest.fixture(scope="module")
def passages_(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    shared, short, edge = words(60), words(34), words(35)
    rows = [(i, f"{words(rng.randrange(0, 80))} {shared}\n{words(rng.randrange(0, 80))}") for i in range(40)]
    rows += [(50 + i, f"{words(40)} {short} {words(3)}") for i in range(3)] + [(60 + i, f"{edge} {words(2)}") for i in range(2)]
    whole = words(200)
    rows += [(70, whole), (71, whole), (72, whole.upper()), (73, "x " * 300), (74, "a b c " * 40), (75, None), (76, ""), (77, "one two"), (78, words(400))]
    rows += [(None, whole), (None, None), (78, words(90)), (79, words(50)), (79, rows[-1][1]), (80, f"{edge[:-1]}# {edge}"), (81, "\t".join(shared.split()[10:50]))]
    near = whole.split()
    for i in range(30):
        near[rng.randrange(200)] = f"edit{i}"
        rows.append((100 + i, " ".join(near)))
    rows += [(200, rows[0][1]), (200, rows[0][1])]
    return rows


@pytest.mark.parametrize(("window", "width", "hot"), [(35, 10, 4096), (35, 10, 0), (35, 10, 5), (12, 3, 8)])
def test_passages_as_brute_force(spark, passages_, window, width, hot):
    docs = spark.createDataFrame([(*r, 1) for r in passages_], "doc_id long, text string, n_words int")
    got = passages.without_repeats(docs, window=window, width=width, hot=hot).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got], key=key) == sorted(reduced(passages_, window), key=key)
    assert passages.without_repeats(docs.limit(0), window=window, width=width).count() == 0


def test_windows_of_one_hash_are_compared(monkeypatch):
    monkeypatch.setattr(passages, "_mixed", lambda x: x * np.uint64(0))
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    found = passages.repeated_windows([" ".join(a), " ".join(b), " ".join(a[2:39])], [1, 1, 1])
    assert [x.tolist() for x in found] == [[2, 3, 4], [], [0, 1, 2]]
