"""Trends from one small table: exact distinct counts that merge.

Entities are numbered densely once.  The cube holds, for every (date, keys,
block of 32,768 entity numbers), the set of entities as a bitmap and the sums of
the measures; a row of the panel belongs to one block.  A trend by any of the
keys is a union of bitmaps per block and a sum of their sizes: equal to
`count_distinct`, without expanding or shuffling a row of the panel.

Numbers run along the entities' last unit, so the entities of a unit stand in
few blocks and its bitmaps are full rather than many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import CLEAN, PanelCols
from ..functions.numeric import safe_div
from . import prefix

SUMS = ["total_fte", "total_salary_nominal", "total_salary_real"]


def number_entities(df: DataFrame, cols: PanelCols = CLEAN, along: str | None = None) -> DataFrame:
    """(id, entity_no): 1, 2, 3, ... along the entities' last value of `along`
    (default: the division), then id.  A null id has no number."""
    along = along or cols.division
    each = (df.where(F.col(cols.id).isNotNull()).groupBy(cols.id)
            .agg(F.max(F.struct(F.col(cols.date).alias("d"), F.col(along).alias("u")))["u"].alias("_u")))
    return prefix.running_count(each, [F.col("_u"), F.col(cols.id)], "entity_no").select(cols.id, "entity_no")


def entity_cube(df: DataFrame, keys: list[str], cols: PanelCols = CLEAN, along: str | None = None) -> DataFrame:
    """(date, keys, block, entities, sums, records): a row per cell and block of
    entity numbers.  Null keys are cells of their own; rows without an id count
    in the sums (their block is null)."""
    x = df.join(number_entities(df, cols, along), cols.id, "left")
    no = F.col("entity_no")
    return x.groupBy(cols.date, *keys, F.bitmap_bucket_number(no).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(no)).alias("entities"),
        F.sum(cols.weight).alias("total_fte"), F.sum(cols.weighted).alias("total_salary_nominal"),
        F.sum(cols.real_weighted).alias("total_salary_real"), F.count(F.lit(1)).alias("records"))


def roll_up(cube: DataFrame, by: list[str]) -> DataFrame:
    """Cells merged by any of their columns: employees (distinct entities), sums, records."""
    blocks = cube.groupBy(*by, "block").agg(F.bitmap_or_agg("entities").alias("entities"), *[F.sum(c).alias(c) for c in [*SUMS, "records"]])
    own = F.when(F.col("block").isNotNull(), F.bitmap_count("entities")).otherwise(F.lit(0))
    return blocks.groupBy(*by).agg(F.sum(own).alias("employees"), *[F.sum(c).alias(c) for c in [*SUMS, "records"]])


def cube_trend(cube: DataFrame, cols: PanelCols = CLEAN, by: list[str] | None = None) -> DataFrame:
    """`aggregate.trend` from the cube: per snapshot (and `by` keys, null keys
    dropped) headcount, FTE, nominal and real pay."""
    keys = [cols.date, *(by or [])]
    out = roll_up(cube.na.drop(subset=keys), keys).drop("records")
    return out.withColumn("salary_per_fte_real", safe_div("total_salary_real", "total_fte"))
