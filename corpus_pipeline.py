"""The corpus pipeline: stages that each apply one corpus operator to what the one before kept.

language  documents whose language can't be told go
lines     lines of repeated runs go, and documents of which no line is left
near      one document of each group of near duplicates (similarity of 0.8 or more) stays
mix       documents are repeated until the expected tokens of the labelled domains match the targets;
          none is dropped, so rates are at least 1 and the total grows
tokens    what is left is encoded, and decoded for control

Defined cases, in every stage: null or empty texts have no language and go in the first; a null doc_id is kept
and is never a near duplicate; null lang or source are values of their own; rows that share a doc_id are
documents of their own, which mixing repeats alike; very long texts are worked on whole; other columns,
whatever their names, are carried along up to the last stage; no documents give no rows, and without labels
mixing repeats none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codepend.llm import bpe, lang_id, line_dedup, minhash_dedup, mixing
from codepend.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.retained(docs, lang_id.learn(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.shortened(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.distinct_documents(docs, 80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"), min_rate=1.0, grow=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("lines", lines), ("near", near), ("mix", mix), ("tokens", tokens)]

#: A classifier, a similarity search and a tokenizer are no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
