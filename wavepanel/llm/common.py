"""Shared pieces of the operators: stored tables, row keys, connected components."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, sf_path

NULL_ID = (1 << 63) - 1


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES: ten thousand rows of text have no
    bound of their own.  A smaller limit of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(sf_path(sf_dir, name))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns never clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A non-null 64-bit key of (doc_id, text), a null text being ''.  Equal rows share it and get equal results."""
    ident = F.col(f"`{doc_id}`")
    return F.xxhash64(ident, F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(ident, F.lit(NULL_ID)))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` under the cluster's shared checkpoint folder and read it again:
    lineage is cut and a lost executor costs no recomputation."""
    bounded_batches(df.sparkSession)
    return materialize(df, "llm-" + re.sub(r"\W+", "-", name))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of text in the table: one number, used to size buckets."""
    return int(df.select(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0)


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """Connected components of an undirected edge list: rows (node, component),
    component being the smallest node reached.

    Alternating star contraction: each round links every node's larger
    neighbours to its smallest neighbour, then its smaller neighbours likewise.
    Both steps are grouped minima and joins (a hub's edges are combined map-side
    and skewed join partitions are split), each round is a stored table, and the
    number of rounds is logarithmic in the longest chain.  Only one row of
    counts per round reaches the driver.
    """
    cur = stored(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
                 .where(F.col("u") != F.col("v")).distinct(), f"{name}-edges")
    while True:
        nested = cur.select(F.col("v").alias("u")).distinct()      # nodes that are a child somewhere
        state = cur.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("d")).first()
        if state["n"] == state["d"] and cur.join(nested, "u", "left_semi").limit(1).count() == 0:
            break                                                   # a forest of stars: done
        # large star: every neighbour larger than the node goes to the node's smallest neighbour
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("m").alias("u"), "v").distinct()
        # small star: every node's smaller neighbours, and the node, go to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v"))
        cur = stored(small.where(F.col("u") != F.col("v")).distinct(), f"{name}-round")
    roots = cur.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return cur.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
