"""Plan-to-record matching with a tolerance.

For each plan line (in plan order) inside its (unit, title) group, take the
not-yet-used record with the smallest |salary - target| if it is within the
tolerance (the reference tries < 5 then < 100; with candidates sorted by
difference that is "the first unused candidate under the wide tolerance").

The walk is sequential only where lines compete.  Salaries are cut into cells
two tolerances wide; lines of a group whose cells are at least three apart have
no record in common, so each run of nearer cells is a piece of its own, found by
a window over the *distinct* cells of a group.  Records reach a piece by an
equi-join on the cells that its lines can reach.  A piece is matched in one task
on two sorted arrays -- its lines and its records -- with pointers to the next
free record on either side: no pair of a line and a record is ever a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MATCHED = "line long, record long, matched_salary double"
SALTS = 64


def assign(target: np.ndarray, salary: np.ndarray, record: np.ndarray, tolerance: float) -> np.ndarray:
    """For each target in turn the position of the nearest record not taken yet
    (ties to the smaller record), -1 if none is nearer than `tolerance`.

    Records of one salary form a stack in ascending id; `up` and `down` lead from
    a salary to the nearest one with records left, with path halving.
    """
    order = np.lexsort((record, salary))
    values, first, count = np.unique(salary[order], return_index=True, return_counts=True)
    head, end = first.tolist(), (first + count).tolist()
    n = len(values)
    values, ids, at = values.tolist(), record[order].tolist(), order.tolist()
    up, down = list(range(n + 1)), list(range(n + 1))      # down is shifted by one: 0 is "none"

    def find(link: list, i: int) -> int:
        while link[i] != i:
            link[i] = link[link[i]]
            i = link[i]
        return i

    out = np.full(len(target), -1, np.int64)
    for k, (t, near) in enumerate(zip(target.tolist(), np.searchsorted(values, target).tolist())):
        high, low = find(up, near), find(down, near) - 1
        best = None
        for g in (low, high):
            if 0 <= g < n and abs(values[g] - t) < tolerance:
                option = (abs(values[g] - t), ids[head[g]], g)
                best = option if best is None else min(best, option)
        if best is None:
            continue
        g = best[2]
        out[k] = at[head[g]]
        head[g] += 1
        if head[g] == end[g]:
            up[g], down[g + 1] = g + 1, g
    return out


def pieces(plan: DataFrame, width: float) -> DataFrame:
    """(department, title, cell, piece, lines) for every cell that a line of the
    plan can reach: runs of line cells at most two apart, with the number of their
    lines, and the cells beside them."""
    group = Window.partitionBy("department", "title").orderBy("cell")
    upto = group.rowsBetween(Window.unboundedPreceding, 0)
    cells = (plan.where(F.col("salary").isNotNull() & F.col("department").isNotNull() & F.col("title").isNotNull())
             .groupBy("department", "title", F.floor(F.col("salary") / F.lit(width)).alias("cell")).agg(F.count(F.lit(1)).alias("n")))
    runs = (cells.withColumn("_new", F.coalesce((F.col("cell") - F.lag("cell").over(group) > 2).cast("int"), F.lit(1)))
            .withColumn("piece", F.sum("_new").over(upto))
            .withColumn("lines", F.sum("n").over(Window.partitionBy("department", "title", "piece"))))
    return (runs.select("department", "title", "piece", "lines", F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)])).alias("cell"))
            .distinct())


def tolerance_match(plan: DataFrame, records: DataFrame, unit: str, title: str, salary: str, record_id: str,
                    tolerance: float = 100.0) -> DataFrame:
    """Match plan lines (`line`, `department`, `title`, `salary`) to records.

    Returns every plan line with `record` / `matched_salary` (null = no match)
    and a `status` of MATCH or NO MATCH.  Lines and records without unit, title
    or salary match nothing; line numbers are distinct.
    """
    t, width = float(tolerance), 2.0 * float(tolerance)
    reach = pieces(plan, width)
    lines = (plan.select("department", "title", F.col("line").cast("long").alias("line"), F.col("salary").cast("double").alias("target"),
                         F.floor(F.col("salary") / F.lit(width)).alias("cell"))
             .join(reach, ["department", "title", "cell"]))
    r = (records.select(F.col(unit).alias("department"), F.col(title).alias("title"), F.col(salary).cast("double").alias("paid"),
                        F.col(record_id).cast("long").alias("record"), F.floor(F.col(salary) / F.lit(width)).alias("cell"))
         .join(reach, ["department", "title", "cell"])
         .withColumn("_salt", F.pmod(F.xxhash64("record"), F.lit(SALTS))))
    # Records of one salary are alike but for their id, and the k lines of a piece use at most
    # k of them: the k smallest ids are exact.  A first cut inside salted parts keeps a popular
    # salary out of one window.
    for part in (["_salt"], []):
        near = Window.partitionBy("department", "title", "piece", "paid", *part).orderBy("record")
        r = r.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= F.col("lines"))

    def match(key, lines_table: pa.Table, records_table: pa.Table) -> pa.Table:
        at = np.argsort(lines_table["line"].to_numpy(), kind="stable")
        line, target = lines_table["line"].to_numpy()[at], lines_table["target"].to_numpy()[at]
        record, paid = records_table["record"].to_numpy(), records_table["paid"].to_numpy()
        took = assign(target, paid, record, t)
        hit = took >= 0
        return pa.table({"line": line[hit], "record": record[took[hit]], "matched_salary": paid[took[hit]]})

    keys = ("department", "title", "piece")
    matched = (lines.select(*keys, "line", "target").groupBy(*keys)
               .cogroup(r.select(*[F.col(c).alias(f"_{c}") for c in keys], "record", "paid").groupBy(*[f"_{c}" for c in keys])).applyInArrow(match, MATCHED))
    out = plan.join(matched, "line", "left")
    return out.withColumn("status", F.when(F.col("record").isNull(), F.lit("NO MATCH")).otherwise(F.lit("MATCH")))


def pipe_lines(df: DataFrame, cols: list[str]) -> DataFrame:
    """One pipe-delimited text line per row (null -> empty)."""
    return df.select(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
                     .alias("value"))
