"""Readers for the parquet tables a job starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import sf_path

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(sf_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register every table as a temp view so `spark.sql` can use them."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
