"""From raw documents to token ids, in five stages.

Quality rules drop what they reject; of each group of near-duplicates one document stays; personal data becomes pseudonyms;
sources are mixed to target weights (documents repeat as they are drawn); the result is encoded by byte-level BPE. Each stage's
result is written as Parquet in the shared folder and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import mixing, neardup, pii, quality, tokens
from tidebar.llm.common import forget, settled, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.rules(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8."""
    return neardup.one_of_each(docs, percent=80, width=5)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, report=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = tokens.encode(docs, public_tokenizers.path(tokens.RANKS))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("mix_sources", mix_sources), ("byte_bpe", byte_bpe)]

#: The n-gram hash of the first stage and the tokenizer of the last aren't in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
