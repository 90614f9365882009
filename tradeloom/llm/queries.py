"""The corpus operators as registered queries over whole tables.

Each query takes its rows from its operator and only renames columns or takes
digests, counts and checksums of the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.llm import byte_bpe, chat, hosts, language, licenses, mixing, periodic, phrases, pitman_yor, quality, simhash, token_files, vectors
from tradeloom.llm.shared import id_remainder, table
from tradeloom.llm.sql import ORACLES  # noqa: F401  (read beside QUERIES)


def op1_license_scan(spark: SparkSession, root: str) -> DataFrame:
    return licenses.scan(table(spark, root, "documents")).select(
        "doc_id",
        F.array_join("identifiers", ",").alias("identifiers"),
        F.array_join("licenses", ",").alias("licenses"),
        F.col("unmatched").cast("bigint").alias("unmatched"),
    )


def op2_simhash(spark: SparkSession, root: str) -> DataFrame:
    found = simhash.groups(table(spark, root, "documents"), shingle=3, distance=3)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op3_host_rules(spark: SparkSession, root: str) -> DataFrame:
    return hosts.verdicts(table(spark, root, "documents")).drop("rate")


def op4_language_id(spark: SparkSession, root: str) -> DataFrame:
    documents, held_out = table(spark, root, "documents"), id_remainder("doc_id", 4) == 2
    model = language.fit(documents.where(~held_out))
    return language.predict(documents, model).select(
        "doc_id", held_out.alias("held_out"), F.col("lang").alias("lang_pred"), "score", "rejected"
    )


def op5_lm_scores(spark: SparkSession, root: str) -> DataFrame:
    held_out = id_remainder("doc_id", 7) == 2
    documents = table(spark, root, "documents").select("doc_id", "text", (~held_out).alias("taught"))
    return pitman_yor.score(documents).select(
        "doc_id", (~F.col("taught")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"
    )


def op6_byte_bpe(spark: SparkSession, root: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.round_trip(table(spark, root, "documents"), ranks, pattern).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op7_quality(spark: SparkSession, root: str) -> DataFrame:
    held_out = id_remainder("doc_id", 5) == 0
    labels = table(spark, root, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    return quality.classify(table(spark, root, "documents"), labels).select(
        "doc_id", held_out.alias("held_out"), "score", F.col("kept").cast("int").alias("predicted")
    )


def op8_embedding_duplicates(spark: SparkSession, root: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, root, "embeddings"), threshold=0.95).select(
        "vec_id",
        "n_links",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"),
    )


def op9_mixing(spark: SparkSession, root: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, root, "documents"))).withColumnRenamed("key", "doc_id")


def op10_token_files(spark: SparkSession, root: str) -> DataFrame:
    path = token_files.file_set(
        table(spark, root, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )
    return token_files.read(spark, path).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op11_chat_formatting(spark: SparkSession, root: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    added = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    rows = table(spark, root, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_back(rows, public_tokenizers.path("byte_bpe_50k.json"))


def op12_collocations(spark: SparkSession, root: str) -> DataFrame:
    return phrases.collocations(table(spark, root, "documents"), least=30, top=2000)


def op13_periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    planted = F.crc32(F.col("doc_id").cast("string"))
    found = periodic.runs(table(spark, root, "documents"), keep=["doc_id"], plant=planted)
    lines = F.transform("runs", lambda run: F.concat_ws(",", run["start"], run["length"], run["period"]))
    best = found.withColumn("best", periodic.longest()).withColumn("lines", F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_simhash": op2_simhash,
    "op3_host_rules": op3_host_rules,
    "op4_language_id": op4_language_id,
    "op5_lm_scores": op5_lm_scores,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality": op7_quality,
    "op8_embedding_duplicates": op8_embedding_duplicates,
    "op9_mixing": op9_mixing,
    "op10_token_files": op10_token_files,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_collocations": op12_collocations,
    "op13_periodic_runs": op13_periodic_runs,
}
