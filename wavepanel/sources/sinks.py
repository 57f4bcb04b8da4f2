"""Sinks (A10, A13, A14, A15, A18).

Every writer is a distributed DataFrame write: no rows pass through the
driver.  The panel is stored partitioned by snapshot date, so a query on
one snapshot reads one directory (partition pruning).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, fill: str | None = None) -> None:
    """CSV with a header; `columns` fixes the column set and order
    (missing ones written empty) and `fill` replaces nulls in text columns."""
    if columns:
        df = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    if fill is not None:
        df = df.na.fill(fill, [c for c, t in df.dtypes if t == "string"])
    df.write.mode("overwrite").option("header", True).csv(path)


def write_panel(df: DataFrame, path: str, date_col: str = "Date",
                max_records_per_file: int = 5_000_000) -> None:
    """The cleaned panel as Parquet, one directory per snapshot date.

    Rows are rebalanced on the date: partitions hold few dates each, and AQE
    splits a partition beyond its advisory size, so a snapshot is written by as
    many tasks as its bytes ask for.  Files are split by rows.
    """
    (df.hint("rebalance", date_col).write.mode("overwrite")
       .option("maxRecordsPerFile", max_records_per_file)
       .partitionBy(date_col).parquet(path))


def read_panel(spark: SparkSession, path: str, build: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Read the stored panel; when it is absent and `build` is given,
    build it, store it, and read the stored copy (lineage cut at the files)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if build is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        write_panel(build(), path)
        return spark.read.parquet(path)


# Rows of one entity above this multiple of a bucket's fair share keep the panel from being laid out by entity.
BUCKET_SKEW = 4


def write_entity_panel(df: DataFrame, path: str, id_col: str = "id", sort: list[str] | None = None, buckets: int | None = None) -> bool:
    """A14, laid out by entity: Parquet files bucketed by the entity id and sorted
    by id and `sort`, one file per bucket.  Joins, windows and aggregates on the
    id need no exchange then (`read_entity_panel`).

    A bucket is read by one task, so a panel in which one entity holds more than
    BUCKET_SKEW times a bucket's share of the rows is written without buckets,
    and its readers shuffle as usual.  Says whether the layout was kept.
    `buckets` defaults to the session's number of shuffle partitions.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = [id_col, *(sort or [])]
    stored = materialize(df, "panel")
    sizes = stored.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    even = (sizes["most"] or 0) <= max(BUCKET_SKEW * (sizes["rows"] or 0) / buckets, MIN_BUCKET_ROWS)
    if even:
        # tables are how Spark knows of buckets; the files are the table's only content
        name = f"wavepanel_write_{uuid.uuid4().hex[:12]}"
        (stored.repartition(buckets, id_col).write.mode("overwrite").bucketBy(buckets, id_col).sortBy(*sort).option("path", path)
         .format("parquet").saveAsTable(name))
        spark.sql(f"drop table {name}")
    else:
        stored.write.mode("overwrite").parquet(path)
    layout = json.dumps({"id": id_col, "sort": sort, "buckets": buckets if even else 0, "schema": stored.schema.json()})
    spark.createDataFrame([(layout,)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + LAYOUT)
    return even


MIN_BUCKET_ROWS = 100_000
LAYOUT = ".layout"


def read_entity_panel(spark: SparkSession, path: str) -> DataFrame:
    """The panel as `write_entity_panel` left it.  Its layout is read from the
    file beside it and declared to the session as an external table."""
    layout = json.loads(spark.read.text(path.rstrip("/") + LAYOUT).first()["value"])
    if not layout["buckets"]:
        return spark.read.schema(StructType.fromJson(json.loads(layout["schema"]))).parquet(path)
    name = "wavepanel_" + hashlib.md5(path.encode()).hexdigest()[:16]
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(layout["schema"])))
        by = ", ".join(f"`{c}`" for c in layout["sort"])
        spark.sql(f"create table {name} ({columns}) using parquet clustered by (`{layout['id']}`) sorted by ({by}) "
                  f"into {layout['buckets']} buckets location '{path}'")
    return spark.table(name)


def write_text_lines(lines: DataFrame, path: str) -> None:
    """One text line per row (a single string column)."""
    lines.write.mode("overwrite").text(path)
