"""Corpus pipeline: stages over documents, each written and read again by the next.

Language identification, exact dedup, SimHash near dedup at a similarity of word shingles, mixing to target weights, and SentencePiece
segmentation. The stages are not expressible in SQL; tests/llm holds each against a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import exact_dedup, language_id, mixing, near_dedup, sentencepiece_nbest
from keyloom.llm.common import fresh_path
from keyloom.llm.queries import TARGETS


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with ``lang`` set to it."""
    return language_id.known_language_documents(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest identifier stays."""
    return exact_dedup.kept_documents(docs, keep="largest")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least identifier.

    Texts are near-duplicates if their shingles of five words have a similarity of 0.8 or more. SimHash
    fingerprints are dealt to shards by blocks of their bits, BK-trees of the shards find near ones at a wide radius,
    and the shingles of what components hold decide. The three bits of ``op4_simhash`` are that query's own, and far tighter.
    """
    return near_dedup.similar_documents(docs, words=5, similarity=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates draw them, so that domains have their target shares."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mixed_documents(docs, labels, TARGETS, tokenizer_file=public_tokenizers.path("byte_bpe_50k.json"))


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's best segmentations into pieces."""
    return sentencepiece_nbest.segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), n=3)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_languages),
    ("exact_dedup", exact_duplicates),
    ("simhash", near_duplicates),
    ("mixing", mixture),
    ("sentencepiece", segmentations),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
