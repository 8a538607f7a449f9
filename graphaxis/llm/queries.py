"""One query per operator, over its whole table, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphaxis.llm import op1_minhash, op2_lines, op3_toxicity, op4_bpe, op5_mixing, op6_quality, op7_embeddings, op8_secrets, op9_language, op10_weak_labels

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_minhash.groups(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_lines.digests(table(spark, sf_dir, "documents"))


def op3_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op3_toxicity.score(docs, op3_toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op4_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_mixing.mix(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality.judge(table(spark, sf_dir, "documents"), carry=("doc_id",))


def op7_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_embeddings.cluster(table(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_secrets.digests(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", op9_language.held_out(F.col("doc_id")))
    return op9_language.identify(docs, op9_language.learn(docs), keep=("doc_id", "held_out"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op10_weak_labels.score(docs, op10_weak_labels.train(docs))


QUERIES: dict[str, Query] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity_severity": op3_toxicity_severity,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_mixing_sources": op5_mixing_sources,
    "op6_quality_rules": op6_quality_rules,
    "op7_embedding_forest": op7_embedding_forest,
    "op8_secret_scan": op8_secret_scan,
    "op9_language_id": op9_language_id,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLES: dict[str, str] = {
    "op6_quality_rules": op6_quality.ORACLE,
}
