"""The registered queries of the operators: one `opN_<name>` each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import OP13_SQL, op13_clusters
from .common import table
from .hnsw import op3_nearest
from .idfiles import op4_token_files
from .mixing import OP1_SQL, op1_mixing
from .masked_lm import op5_masked_lm
from .minhash import op2_minhash
from .neardup_vectors import op7_vectors
from .phrases import op12_fingerprints
from .pieces import op9_pieces
from .pii import op6_pii
from .quality import op8_quality
from .runs import op11_runs
from .substring import op10_substrings


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies (a parameter of the operators)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_mixing(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_minhash(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_nearest(table(spark, sf_dir, "embeddings"))


def op4_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_masked_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_masked_lm(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_pii(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_vectors(table(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_substrings(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_runs(table(spark, sf_dir, "documents"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_fingerprints(table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_near_dedup": op2_near_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_id_files": op4_id_files,
    "op5_masked_language_model": op5_masked_language_model,
    "op6_personal_data": op6_personal_data,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLE: dict[str, str] = {"op1_source_mixing": OP1_SQL.strip(), "op13_centroid_clusters": OP13_SQL.strip()}
