"""Shared by the two operators on embeddings: usable vectors and packed blocks of them."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(v: Column) -> Column:
    """Not null, finite, not zero."""
    return (v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists(v, lambda x: x != 0))


def dimension(rows: DataFrame) -> int:
    """The most frequent length of `v`, the larger on ties (0 without rows).  Only that one number reaches the driver."""
    top = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).agg(F.max(F.struct("c", "n")).alias("m")).first()["m"]
    return top["n"] if top else 0


def usable(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v array<double>) of the vectors that take part: not null, finite, not
    zero, and of the table's dimension."""
    rows = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    rows = rows.where(sound(F.col("v")))
    return rows.where(F.size("v") == dimension(rows))


def matrix(column) -> np.ndarray:
    """A list column of numbers as a matrix (one dimension per table)."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    n = len(column)
    return flat.to_numpy().reshape(n, -1) if n else np.zeros((0, 0))


@contextmanager
def settings(spark, values: dict):
    """The session's settings changed for a while."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def small_batches(spark, rows: int):
    """Arrow batches of a few rows, for tables whose rows are blocks of vectors."""
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": rows}):
        yield
