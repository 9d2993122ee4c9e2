import numpy as np

from tidebar.llm import ann


def test_queries_that_repeat_an_id_have_neighbours_each(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(203, 16))
    ids = [*range(200), 20, 40, 7]
    x[200] = x[20]  # an exact repeat; 40 and 7 repeat with other vectors
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 10, confidence=0.999999).collect()
    rows = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)
    want = []
    for q, v in zip(ids, x, strict=True):
        if q % 20 == 0:
            scores = sorted((-float((v * w).sum()), k) for k, w in zip(ids, x, strict=True) if k != q)
            want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(scores[:10])]
    assert len(rows) == len(want) == 12 * 10
    for a, b in zip(rows, sorted(want), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9
