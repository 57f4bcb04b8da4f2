"""Dimension tables: price index and job codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.deflate import base_index

PRICE_SCHEMA = "Date DATE, CPI DOUBLE, CPI_2021_Index DOUBLE"
JOB_COLUMNS = ["job_code", "title", "job_group", "job_subgroup", "employee_category",
               "salary_range_summary", "salary_range_detail", "job_summary", "job_responsibilities",
               "education", "flsa_status", "institution_job", "supervisory_required", "scaled_job",
               "job_codes_detail", "knowledges", "skills", "direct_link"]
JOB_KEEP = ["job_group", "job_subgroup", "education", "salary_range_summary",
            "supervisory_required", "institution_job"]


def load_price_index(spark: SparkSession, path: str, base_date=None) -> DataFrame:
    """Price series CSV with a declared schema; optionally recompute the
    index against `base_date` (null column when the base month is missing)."""
    df = spark.read.option("header", True).schema(PRICE_SCHEMA).csv(path)
    if base_date is not None:
        df = base_index(df.drop("CPI_2021_Index"), base_date)
    return df


def load_job_dimension(spark: SparkSession, path: str) -> DataFrame:
    """Job CSV (a file or a folder) -> one row per upper-cased code (first row
    in file order), keeping the descriptive columns that exist."""
    raw = spark.read.option("header", True).csv(path)
    keep = [c for c in JOB_KEEP if c in raw.columns]
    # file order: by path, split of the file, and position, which grows inside a split
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = raw.select(F.upper("job_code").alias("jobcode"), at.alias("_at"), F.struct(*keep).alias("_row") if keep else F.lit(0).alias("_row"))
    first = rows.groupBy("jobcode").agg(F.min_by("_row", "_at").alias("_row"))
    return first.select("jobcode", *[F.col(f"_row.{c}").alias(c) for c in keep])
