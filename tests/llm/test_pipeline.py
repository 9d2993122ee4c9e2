from collections import Counter

import corpus_pipeline as pipeline
import pytest

from tests.llm.test_graph_operators import components_of
from tests.llm.test_text_operators import base_counts, own_ranks
from tidebar.llm import quality
from tidebar.llm.common import cut


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        out.append((name, docs.columns, docs.collect()))
    return out


def test_columns_stay(stages):
    assert all(c == ["doc_id", "text", "lang", "source", "n_chars"] for _, c, _ in stages[:-1])


def test_decisions(spark, stages):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = {n: r for n, _, r in stages}
    kept = {r.doc_id for r in rows["quality_rules"]}
    assert all(base_counts(r.text or "")[-1] is False for r in docs if r.doc_id in kept) and quality.THRESHOLD < 0
    want, _ = components_of([(r.doc_id, r.text) for r in rows["quality_rules"]], 5, 80)
    assert {r.doc_id for r in rows["near_duplicates"]} == set(want)
    assert {r.doc_id for r in rows["pseudonyms"]} == set(want)
    drawn = Counter(r.doc_id for r in rows["mix_sources"])
    assert set(drawn) <= set(want) and max(drawn.values()) <= 2
    other, text = own_ranks(), {r.doc_id: r.text for r in rows["mix_sources"]}
    assert all(r.ids == other.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows["byte_bpe"])


def test_run_is_the_stages(spark, stages):
    assert Counter(r.doc_id for r in pipeline.run(spark, "/root/testdata/sf0.001").collect()) == Counter(r.doc_id for r in stages[-1][2])


def test_stages_on_odd_rows(spark):
    rows = [(1, "a b c", "en", "x", 5), (None, None, None, None, None), (2, "", "en", None, 0), (3, "w " * 30, "en", "x", 60), (3, "w " * 30, "en", "x", 60)]
    odd = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    ids = {n: sorted((r.doc_id for r in stage(spark, odd, "/root/testdata/sf0.001").collect()), key=lambda k: (k is None, k)) for n, stage in pipeline.STAGES}
    assert ids["quality_rules"] == []  # too few words, or the same ones over and over
    assert ids["near_duplicates"] == [1, 2, 3, None]
    assert ids["pseudonyms"] == ids["byte_bpe"] == [1, 2, 3, 3, None]
    # The source's 63 words are to be 94: each document once or twice; those without words are their own source's, whose target is none.
    assert set(ids["mix_sources"]) == {1, 3} and 4 <= len(ids["mix_sources"]) <= 5
    for _, stage in pipeline.STAGES:
        assert stage(spark, odd.limit(0), "/root/testdata/sf0.001").count() == 0
