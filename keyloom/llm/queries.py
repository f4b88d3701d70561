"""The queries of this package: name to function of (spark, sf_dir), and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, exact_dedup, language_id, mixing, pii, sentencepiece_nbest, simhash, suffix_dedup, token_counts, toxicity
from .common import documents

#: Shares of tokens that the mixture is to have, by domain (quality and toxicity as the labels mark them).
TARGETS = {"quality1_toxic0": 0.82, "quality0_toxic0": 0.10, "quality1_toxic1": 0.07, "quality0_toxic1": 0.01}


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir), length=200)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(documents(spark, sf_dir), words=3, radius=3)


def op5_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.segmentations(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), n=3)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(documents(spark, sf_dir), labels(spark, sf_dir), TARGETS, tokenizer_file=public_tokenizers.path("byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir), threshold=0.7)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), keep="largest")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_suffix_dedup, op3_language_id, op4_simhash, op5_sentencepiece_nbest,
        op6_mixing, op7_toxicity, op8_exact_dedup, op9_embedding_dedup, op10_pii,
    )
}
ORACLE_SQL: dict[str, str] = {"op8_exact_dedup": exact_dedup.ORACLE, "op9_embedding_dedup": embedding_dedup.ORACLE}
