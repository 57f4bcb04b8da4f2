"""The corpus pipeline: quality filter, near-dedup, sanitising, mixing, tokenising.

Each stage is `(spark, docs, sf_dir) -> DataFrame`; its result is written as
Parquet under the shared checkpoint folder and read again as the next stage's
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavepanel.llm.common import stored, table
from wavepanel.llm import stages

STAGES = stages.STAGES

# The quality model and the near-duplicate signatures cannot be written in SQL;
# tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
