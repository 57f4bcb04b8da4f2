"""Raw snapshot exports -> one typed frame.

Snapshots are CSV, Parquet or workbook exports; a date (YYYY-MM) stands in the
name of the file, or of the folder of part files directly above it.  A snapshot
may come in several files: all of them are kept.  Layouts differ between
releases.  Every file is read as rows of cells by position, and the header of
each file says which cells make up a target column: a table of (file, header),
made by tasks, meets the rows by a join.  The driver sees the distinct headers
and column names (metadata), never a list of files.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lookups import COLUMNS_TO_DROP, LEGACY_RENAMES, NEW_RENAMES
from ..functions.text import matches_ci
from ..operators import prefix
from ..session import materialize
from .workbooks import read_workbooks

MONTH = r"(?<!\d)\d{4}-\d{2}(?!\d)"
PART_FILE = r"^part-\d+"            # a writer's part file: its name says nothing, its folder's does
LOCK_FILE = r"/~\$[^/]*$"           # left by a program that has a workbook open

# Target raw schema after normalisation (types of the cleaning job's input).
RAW_TYPES = {
    "last_name": "string", "first_name": "string", "date_of_hire": "date",
    "division": "string", "department": "string", "title": "string", "jobcode": "string",
    "employee_category": "string", "appt_type_length": "string",
    "full_time_equivalent": "double", "current_annual_contracted_salary": "double",
}


def snapshot_name(path_col) -> "F.Column":
    """The part of a path that names the snapshot: the file's name if it has a
    month, else its folder's name (null if neither has one)."""
    parts = F.split(path_col, "/")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    named = lambda k: F.when(at(k).rlike(MONTH) & ~at(k).rlike(PART_FILE), at(k))
    return F.coalesce(named(-1), named(-2))


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """Files under a folder, by the `binaryFile` source (the content is read only where it is used)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def snapshot_files(spark: SparkSession, folder: str) -> DataFrame:
    """A1: (path, uri, name) of the snapshot files in `folder` and in its folders
    of part files.  Listed with the `binaryFile` source, whose content column is
    pruned, so no file is read."""
    inside = F.expr("substring(path, length(regexp_extract(path, '^[a-z0-9]+:/*', 0)) + 1)")
    return (_listed(spark, folder).select("path", F.col("_metadata.file_path").alias("uri"), snapshot_name(inside).alias("name"))
            .where(F.col("name").isNotNull() & ~F.col("path").rlike(LOCK_FILE)))


def list_snapshot_files(spark: SparkSession, folder: str) -> list[str]:
    """The snapshot files' paths by name (metadata for display and tests)."""
    return [r.path for r in snapshot_files(spark, folder).orderBy("name", "path").collect()]


def normalize_name(c: str, hyphens: bool = False) -> str:
    """A5: strip, lower-case, spaces -> '_'; A6: with `hyphens` also '-' -> '_'."""
    c = c.strip().lower().replace(" ", "_")
    return c.replace("-", "_") if hyphens else c


def detect_layout(columns: list[str]) -> str:
    """A4: 'new' if a new-layout marker column is present, 'legacy' if a legacy
    marker is, else 'unknown' (treated as legacy).  Names are normalised first."""
    cols = {normalize_name(c) for c in columns}
    if "compensation_basis" in cols or "pay_rate_type" in cols:
        return "new"
    if "pay_basis" in cols or "appointment_type_and_length" in cols:
        return "legacy"
    return "unknown"


def normalize_columns(df: DataFrame, hyphens: bool = False) -> DataFrame:
    """All column names normalised, nothing renamed or dropped."""
    return df.toDF(*[normalize_name(c, hyphens) for c in df.columns])


def normalize_frame(df: DataFrame, layout: str | None = None) -> DataFrame:
    """A5: normalised names, marker columns dropped, renames by layout; when two
    source columns map to one target the first non-null wins (coalesce)."""
    df = normalize_columns(df)
    layout = layout or detect_layout(df.columns)
    df = df.drop(*[c for c in COLUMNS_TO_DROP if c in df.columns])
    renames = NEW_RENAMES if layout == "new" else LEGACY_RENAMES
    targets: dict[str, list[str]] = {}
    for src, dst in renames.items():
        if src in df.columns:
            targets.setdefault(dst, []).append(src)
    out = df
    for dst, srcs in targets.items():
        expr = F.coalesce(*[F.col(f"`{s}`") for s in srcs]) if len(srcs) > 1 else F.col(f"`{srcs[0]}`")
        out = out.withColumn(f"__{dst}", expr).drop(*srcs)
    for dst in targets:
        out = out.withColumnRenamed(f"__{dst}", dst)
    return out


def snapshot_date(path_col) -> "F.Column":
    """A3: first YYYY-MM in the snapshot's name -> first day of that month.  Null
    for a name without one; a month that does not exist is an error, never a
    dropped file."""
    ym = F.regexp_extract(snapshot_name(path_col), f"({MONTH})", 1)
    day = F.try_to_date(F.concat(ym, F.lit("-01")), "yyyy-MM-dd")
    bad = F.raise_error(F.concat(F.lit("no such month in the snapshot name: "), path_col)).cast("date")
    return F.when(ym != "", F.when(day.isNull(), bad).otherwise(day))


def to_target(df: DataFrame, types: dict[str, str] = RAW_TYPES) -> DataFrame:
    """Cast to the declared types (unparseable values become null, real
    nulls stay null); NaN measures become null; missing columns are added."""
    out = df
    for c, t in types.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
        elif t == "date":
            out = out.withColumn(c, F.coalesce(F.col(c).try_cast("date"),
                                               F.try_to_date(F.col(c).cast("string"))))
        else:
            out = out.withColumn(c, F.col(c).try_cast(t))
        if t == "double":
            out = out.withColumn(c, F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(F.col(c)))
    return out


def column_plan(header: list[str]) -> dict[str, list[int]]:
    """A4/A5: target column -> the positions in the header whose first non-null
    cell it takes, in the order of the renames.  A repeated name gets a suffix
    (`.1`, `.2`), an empty one its position; layout markers are left out."""
    seen: dict[str, int] = {}
    names = []
    for i, c in enumerate(header):
        c = c if c and c.strip() else f"Unnamed: {i}"
        n = seen[c] = seen.get(c, -1) + 1
        names.append(normalize_name(f"{c}.{n}" if n else c))
    renames = NEW_RENAMES if detect_layout(names) == "new" else LEGACY_RENAMES
    plan: dict[str, list[int]] = {}
    for source, target in renames.items():
        plan.setdefault(target, []).extend(i for i, n in enumerate(names) if n == source)
    for i, n in enumerate(names):
        if n not in renames and n not in COLUMNS_TO_DROP:
            plan.setdefault(n, []).append(i)
    return {target: at for target, at in plan.items() if at}


# Each reader gives (rows, heads): rows (uri, block, pos, cells), pos growing inside a split (uri, block);
# heads (uri, header).

def csv_cells(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """CSV files of any layouts in one scan: columns by position, as many as the
    longest header has.  Headers are the first non-empty lines of the files."""
    place = [F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select("value", *place, F.monotonically_increasing_id().alias("pos"))
    first = (lines.where((F.col("block") == 0) & (F.trim("value") != "")).groupBy("uri").agg(F.min_by("value", "pos").alias("line")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [next(csv.reader([line.removeprefix("\ufeff")])) for line in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.list_(pa.string()))], names=["uri", "header"])

    heads = materialize(first.mapInArrow(split, "uri string, header array<string>"), "headers")
    width = heads.agg(F.max(F.size("header")).alias("n")).first()["n"] or 1
    raw = (spark.read.option("recursiveFileLookup", "true").option("header", True)
           .schema(", ".join(f"c{i} string" for i in range(width))).csv(folder))
    rows = raw.select(*place, F.monotonically_increasing_id().alias("pos"), F.array(*[f"c{i}" for i in range(width)]).alias("cells"))
    return rows, heads


def parquet_cells(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Parquet files of any schemas: a row per (file, row group) is dealt out, and
    each task streams its row groups as text cells (types are declared later, and
    one column may have several)."""
    def opened(uri: str):
        from pyarrow import fs, parquet
        store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", uri))
        return parquet.ParquetFile(store.open_input_file(inner))

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with opened(uri) as f:
                    sizes = [f.metadata.row_group(i).num_rows for i in range(f.num_row_groups)] or [0]
                    names = f.schema_arrow.names
                at = [sum(sizes[:i]) for i in range(len(sizes))]
                yield pa.RecordBatch.from_pydict({"uri": [uri] * len(sizes), "part": range(len(sizes)), "at": at, "header": [names] * len(sizes)},
                                                 pa.schema([("uri", pa.string()), ("part", pa.int32()), ("at", pa.int64()), ("header", pa.list_(pa.string()))]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, part, at in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                with opened(uri) as f:
                    for rows in f.iter_batches(4096, [part] if f.num_row_groups else []):
                        text = [c.cast(pa.string()).to_pylist() for c in rows.columns]
                        yield pa.RecordBatch.from_arrays([pa.array([uri] * rows.num_rows), pa.array([0] * rows.num_rows, pa.int64()),
                                                          pa.array(range(at, at + rows.num_rows), pa.int64()),
                                                          pa.array([list(r) for r in zip(*text)], pa.list_(pa.string()))], names=["uri", "block", "pos", "cells"])
                        at += rows.num_rows

    listed = _listed(spark, folder).select(F.col("_metadata.file_path").alias("uri")).where(F.col("uri").endswith(".parquet"))
    groups = materialize(listed.mapInArrow(footers, "uri string, part int, at long, header array<string>"), "footers")
    dealt = groups.select("uri", "part", "at").repartition(F.col("uri"), F.col("part"))
    return (dealt.mapInArrow(read, "uri string, block long, pos long, cells array<string>"),
            groups.where("part = 0").select("uri", "header"))


def workbook_cells(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The first sheets of the workbooks, read once and stored."""
    files = (_listed(spark, folder).select(F.col("_metadata.file_path").alias("uri"), "path", "content")
             .where(F.lower("path").rlike(r"\.xls[xm]$") & ~F.col("path").rlike(LOCK_FILE)))
    rows = materialize(read_workbooks(files).select("uri", F.lit(0).cast("long").alias("block"), "pos", "cells"), "workbooks")
    return rows.where("pos >= 0"), rows.where("pos < 0").select("uri", F.col("cells").alias("header"))


READERS = {"csv": csv_cells, "parquet": parquet_cells, "xlsx": workbook_cells}


def read_snapshots(spark: SparkSession, folder: str, fmt: str = "csv", since=None, keep: str = "all") -> DataFrame:
    """All snapshot files of a folder as one frame with
    `Date` and `_row_seq` (0, 1, 2, ... by file name, path and position in the file).

    `fmt` is csv, parquet or xlsx.  keep="all" (default) keeps every file of a
    date; keep="last" only the last by name (the cohort study's loader, where a
    later export replaces an earlier one); `since` leaves out earlier dates
    without changing the row numbers.  A split of a file is read in order by one
    task, so a row's number is the number of rows in the splits before it (a
    distributed running total over one short row per split) plus its place in its
    own.  Dates and layouts are columns of that table: rows meet them by one join.
    Raises for a folder without snapshots.
    """
    rows, heads = READERS[fmt](spark, folder)
    files = snapshot_files(spark, folder).withColumn("Date", snapshot_date(F.col("path")))
    if keep == "last":
        files = files.join(files.groupBy("Date").agg(F.max("name").alias("name")), ["Date", "name"])
    heads = heads.where(F.size("header") > 0).withColumn("layout", F.xxhash64("header"))
    known = heads.join(files, "uri")
    # one row per distinct header
    plans = {r["layout"]: column_plan(list(r["header"])) for r in known.select("layout", "header").distinct().collect()}
    if not plans:
        raise ValueError(f"no snapshot files in {folder}")
    splits = (rows.groupBy("uri", "block").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
              .join(known.select("uri", "path", "name", "Date", "layout"), "uri"))
    where = prefix.running_total(splits, [F.col("name"), F.col("path"), F.col("block")], F.col("n"), "upto")
    if since is not None:
        where = where.where(F.col("Date") >= F.lit(since))
    met = rows.join(where.select("uri", "block", "Date", "layout", "first", (F.col("upto") - F.col("n")).alias("base")), ["uri", "block"])
    own = {"date", "_row_seq"}                              # the loader's columns win over equally named ones of the files
    targets = list(dict.fromkeys([*RAW_TYPES, *sorted({t for p in plans.values() for t in p} - own)]))
    out = met.select("Date", (F.col("base") + F.col("pos") - F.col("first")).alias("_row_seq"), *[_pick(t, plans).alias(t) for t in targets])
    return to_target(out).select(*[F.col(f"`{t}`") for t in targets], "Date", "_row_seq")


def _pick(target: str, plans: dict[int, dict[str, list[int]]]) -> Column:
    """The target's cell of a row, by the row's layout (layouts that agree share a branch)."""
    by: dict[tuple, list[int]] = {}
    for layout, plan in plans.items():
        if target in plan:
            by.setdefault(tuple(plan[target]), []).append(layout)
    expr = None
    for at, of in sorted(by.items()):
        value = F.coalesce(*[F.get("cells", F.lit(i)) for i in at])
        cond = F.col("layout").isin(of)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return F.lit(None).cast("string") if expr is None else expr


def layout_frames(raw: DataFrame, split_date) -> tuple[DataFrame, DataFrame]:
    """Export the cleaning job's input in the two raw layouts (legacy before
    `split_date`, new from it), with the raw column names of each layout."""
    legacy = raw.where(F.col("Date") < F.lit(split_date)).select(
        F.col("_row_seq"), F.col("Date"),
        F.col("last_name").alias("Last Name"), F.col("first_name").alias("First Name"),
        F.col("date_of_hire").cast("string").alias("Date of Hire"),
        F.col("division").alias("Division"), F.col("department").alias("Department"),
        F.col("title").alias("Title"), F.col("jobcode").alias("Job Code"),
        F.col("employee_category").alias("Employee Category"),
        F.col("appt_type_length").alias("Appointment Type and Length"),
        F.col("full_time_equivalent").alias("Full-Time Equivalent"),
        F.col("current_annual_contracted_salary").alias("Annual Full Salary"),
        F.lit("Annual").alias("Pay Basis"))
    new = raw.where(F.col("Date") >= F.lit(split_date)).select(
        F.col("_row_seq"), F.col("Date"),
        F.col("last_name").alias("Last Name"), F.col("first_name").alias("First Name"),
        F.col("date_of_hire").cast("string").alias("Date of Hire"),
        F.col("division").alias("Division"), F.col("department").alias("Department"),
        F.col("title").alias("Title"), F.col("jobcode").alias("Job Code"),
        F.col("employee_category").alias("Employee Category"),
        F.col("appt_type_length").alias("Employee Contract Type"),
        F.col("full_time_equivalent").alias("FTE"),
        F.col("current_annual_contracted_salary").alias("Annualized Rate Amount"),
        F.lit("Salaried").alias("Pay Rate Type"))
    return legacy, new


# What a normalised column name must match to play a role.
ROLES = {
    "salary": "^(annual_full_salary|annualized_rate_amount)$",
    "fte": "full_time|^fte$",
    "first_name": "^(?=.*first)(?=.*name)",
    "last_name": "^(?=.*last)(?=.*name)",
    "division": "^division$",
    "department": "^department$",
    "title": "^title$",
}


def roles(columns: list[str]) -> dict[str, str]:
    """Role -> the first column whose normalised name plays it."""
    named = [(normalize_name(c, hyphens=True), c) for c in columns]
    return {role: hit for role, rule in ROLES.items()
            if (hit := next((c for n, c in named if re.search(rule, n)), None)) is not None}


def probe_columns(df: DataFrame, division_pattern: str | None = None) -> DataFrame:
    """The compact cohort layout (first_name, last_name, department,
    title, salary, fte, name_key), columns found by role.

    A salary and both names are required; without an FTE column it is 1.0.
    Amounts that are no numbers become null.  With `division_pattern`, rows are
    kept whose division matches it case-insensitively (null never matches).
    """
    found = roles(df.columns)
    lacking = {"salary", "first_name", "last_name"} - found.keys()
    if lacking:
        raise ValueError(f"no column for {', '.join(sorted(lacking))} among {df.columns}")
    col = {role: F.col(f"`{c}`") for role, c in found.items()}
    if division_pattern is not None:
        df = df.where(matches_ci(col["division"].cast("string"), division_pattern))
    upper = lambda role: F.upper(F.trim(F.coalesce(col[role].cast("string"), F.lit("NAN"))))
    number = lambda role: col[role].try_cast("double") if role in col else F.lit(1.0)
    return df.select(*[col[r].alias(r) for r in ("first_name", "last_name", "department", "title")],
                     number("salary").alias("salary"), number("fte").alias("fte"),
                     F.concat(upper("last_name"), F.lit("|"), upper("first_name")).alias("name_key"))
