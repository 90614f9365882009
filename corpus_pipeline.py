"""Five corpus stages over the documents table, each written as Parquet and read again by the next.

1. language: texts whose language cannot be told, or that lie far from all known ones, go;
2. quality: texts that the labelled ones mark as poor go;
3. near_duplicates: one document of each SimHash group stays;
4. mixing: sources are mixed to their targets, and a text becomes the words the mix takes of it;
5. tokens: texts become byte-level BPE ids, checked by decoding them.

All stages but the last return the columns of documents. Rows are told apart by id and
text, so those without an id, or with one that repeats, are judged like all others. Empty
tables pass through all.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.llm import byte_bpe, language, mixing, quality, simhash
from tradeloom.llm.shared import fresh, table
from tradeloom.plans.workspace import stored

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; learned from those of this stage that name theirs."""
    return language.accepted(docs, language.fit(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as good, learned from the labels of documents of this stage."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.accepted(docs, quality.fit_documents(docs, labels))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose fingerprints of three words differ in at most three bits."""
    return simhash.representatives(docs, shingle=3, distance=3)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of them; those it takes nothing of go."""
    row = fresh(docs, "row")
    told = docs.withColumn(row, simhash.row_key("doc_id", "text"))
    taken = mixing.mixed(told, mixing.mix(told, key=row), key=row).drop(row)
    return taken.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every document."""
    return byte_bpe.round_trip(docs, RANKS, PATTERN).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed_sources),
    ("tokens", token_ids),
]
# SQL cannot express the classifiers and the tokenizer; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
