"""Stages of the corpus pipeline: operators applied to a documents table.

Each takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
`documents` (the last one: the tokens of each document).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import minhash, mixing, pieces, pii, quality
from .common import table
from .queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (learned from `labels`) rejects go."""
    return quality.reject(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.keep_one(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced in the texts."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a row per copy, none for documents that the mix leaves out."""
    return mixing.training_order(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids and the decoded text of every copy, as op9 reports them."""
    return pieces.op9_pieces(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("pii", sanitise),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]
