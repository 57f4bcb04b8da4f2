"""Distributed running totals (E16, E18, row numbers).

Rows are range-partitioned on their order and stored once with the number of
their partition and their place in it.  Each partition gives one total; the
totals before a partition are added up on the driver (one number per
partition); the scan inside a partition is local.  No window runs over all
rows, and a value that many rows share is split as long as the order ends with
something that tells rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

PART, AT = "__part", "__at"
PLACES = (1 << 33) - 1                # low bits of monotonically_increasing_id: the place in the partition


def ordered(df: DataFrame, order: list[Column]) -> DataFrame:
    """`df` stored in `order`, with the partition (PART, ascending with the
    order) and the place in it (AT, from 0) of every row.  Both are written
    by the task that sorted the rows, so every later reader sees the same ones."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    return materialize(placed.withColumn(AT, place).withColumn(PART, F.shiftrightunsigned(F.col(AT), 33).cast("int"))
                       .withColumn(AT, F.col(AT).bitwiseAND(F.lit(PLACES))), "ordered")


def totals_before(stored: DataFrame, value: Column) -> tuple[list[tuple], object]:
    """([(partition, total before it, its total)] in order, the grand total): one short row per partition."""
    rows = stored.groupBy(PART).agg(F.coalesce(F.sum(value), F.lit(0)).alias("t")).collect()
    out, so_far = [], 0
    for r in sorted(rows, key=lambda r: r[PART]):
        out.append((r[PART], so_far, r["t"]))
        so_far = so_far + r["t"]
    return out, so_far


def _with_base(stored: DataFrame, value: Column, kind: str) -> DataFrame:
    before, _ = totals_before(stored, value)
    cast = float if kind == "double" else int
    table = stored.sparkSession.createDataFrame([(p, cast(b)) for p, b, _ in before], f"{PART} int, __base {kind}")
    return stored.join(F.broadcast(table), PART)           # a row per partition


def running_count(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with the number (from 1) of every row in `order`: place in the
    partition plus rows before it.  No scan over rows at all."""
    based = _with_base(ordered(df, order), F.lit(1), "long")
    return based.withColumn(name, F.col("__base") + F.col(AT) + 1).drop(PART, AT, "__base")


def running_total(df: DataFrame, order: list[Column], value: Column, name: str, kind: str = "long") -> DataFrame:
    """`df` with the total of `value` over the rows up to each row in `order`,
    itself included (null values count nothing).  `kind` is long or double."""
    local = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    based = _with_base(ordered(df, order), value, kind)
    return (based.withColumn(name, F.col("__base") + F.coalesce(F.sum(value).over(local), F.lit(0)).cast(kind))
            .drop(PART, AT, "__base"))


def until(df: DataFrame, value: str, ties: list[Column], target: float) -> DataFrame:
    """Rows in descending `value` (then `ties`) until their total reaches
    `target`; the row that crosses it is kept, rows without a value are not.

    Partitions that end below the target are kept whole, and only the one in
    which it is reached is scanned.  Values fall, so inside a partition the total
    is highest where they turn negative.
    """
    v = F.col(value)
    stored = ordered(df.where(v.isNotNull()), [v.desc(), *ties])
    rise, _ = totals_before(stored, F.greatest(v, F.lit(0)))
    edge = next((p for p, base, total in rise if base + total >= target), None)
    if target <= 0:
        return df.limit(0)
    if edge is None:
        return stored.drop(PART, AT)
    base = next(b for p, b, _ in rise if p == edge)        # no negative value stands before the partition that crosses
    local = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    crossing = (stored.where(F.col(PART) == edge)
                .withColumn("__run", F.lit(base) + F.coalesce(F.sum(F.greatest(v, F.lit(0))).over(local), F.lit(0)))
                .where(F.col("__run") < F.lit(target)).drop("__run"))
    return stored.where(F.col(PART) < edge).unionByName(crossing).drop(PART, AT)
