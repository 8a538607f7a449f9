"""A corpus from raw documents to token ids: five stages, each stored before the next reads it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphaxis.llm import op1_minhash, op2_lines, op4_bpe, op5_mixing, op6_quality
from graphaxis.llm.scratch import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own and their host's rules."""
    return op6_quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one occurrence of each group of like lines."""
    return op2_lines.shortened(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return op1_minhash.keep(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words in the proportions of the target weights."""
    return op5_mixing.materialised_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with offsets, and the digests of the ids and of what they decode to."""
    return op4_bpe.encoded_with_digests(docs, RANKS)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: Line dedup and MinHash are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
