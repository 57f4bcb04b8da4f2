"""Step 10 queries: raw layouts -> one frame, page fields and page records."""

from __future__ import annotations

import datetime as _dt
import os
import uuid

from pyspark.sql import functions as F

from ..sources import fixtures
from ..sources import pages as PG
from ..session import application_key, ensure_checkpoint_dir
from ..sources.snapshots import RAW_TYPES, layout_frames, normalize_columns, normalize_frame, read_snapshots, to_target
from ..sources.dimensions import JOB_COLUMNS, load_job_dimension, load_price_index
from ..sources.sinks import read_panel, write_csv
from ..sources.tables import read_table
from ..sources.workbooks import write_workbooks
from .common import raw_snapshots
from .registry import query

_RAW_COLS = ["_row_seq", "Date"] + list(RAW_TYPES)


@query("layout_union", f"""
with raw as ({fixtures.RAW_SNAPSHOTS_SQL})
select {", ".join('"' + c + '"' for c in _RAW_COLS)} from raw""")
def layout_union(spark, sf_dir):
    """Two raw layouts (legacy and new names, markers, text dates)
    detected, normalised, cast to the declared types and unioned by name."""
    raw = raw_snapshots(spark, sf_dir)
    legacy, new = layout_frames(raw, fixtures.NEW_LAYOUT_FROM)
    a = to_target(normalize_frame(legacy))
    b = to_target(normalize_frame(new))
    u = a.unionByName(b, allowMissingColumns=True)
    return u.select(*_RAW_COLS)


@query("snapshot_files", f"""
with raw as ({fixtures.RAW_SNAPSHOTS_SQL})
select {", ".join('"' + c + '"' for c in _RAW_COLS if c != "_row_seq")} from raw""")
def snapshot_files(spark, sf_dir):
    """A1-A3/G1: the raw rows exported as CSV in two layouts, three part-file folders per
    snapshot, listed and read back: every file of a date is kept."""
    raw = raw_snapshots(spark, sf_dir)
    folder = os.path.join(ensure_checkpoint_dir(spark), "exports", application_key(spark), uuid.uuid4().hex[:8])
    for frame in layout_frames(raw, fixtures.NEW_LAYOUT_FROM):
        name = F.concat(F.date_format("Date", "yyyy-MM"), F.lit(" part "), F.pmod("_row_seq", F.lit(3)).cast("string"))
        (frame.withColumn("Export", name).drop("Date", "_row_seq").write.mode("append").partitionBy("Export")
              .option("header", True).csv(folder))
    return read_snapshots(spark, folder).select(*[c for c in _RAW_COLS if c != "_row_seq"])


def _exports(frame, copies, date="Date"):
    """(named rows) an export name per date and copy."""
    return frame.withColumn("Export", F.concat(F.date_format(date, "yyyy-MM"), F.lit(" "), copies)).drop("Date", "_row_seq")


@query("workbook_files", f"""
with raw as ({fixtures.RAW_SNAPSHOTS_SQL})
select {", ".join('"' + c + '"' for c in _RAW_COLS if c != "_row_seq")} from raw""")
def workbook_files(spark, sf_dir):
    """The raw rows exported as workbooks in two layouts, three files or more per
    snapshot (dates as date cells), and read back by streaming their sheets."""
    raw = raw_snapshots(spark, sf_dir)
    folder = _scratch(spark, "workbooks")
    for frame in layout_frames(raw, fixtures.NEW_LAYOUT_FROM):
        frame = frame.withColumn("Date of Hire", F.col("Date of Hire").cast("date"))
        write_workbooks(_exports(frame, F.concat(F.lit("part "), F.pmod("_row_seq", F.lit(3)).cast("string"))), folder, file="Export")
    return read_snapshots(spark, folder, "xlsx").select(*[c for c in _RAW_COLS if c != "_row_seq"])


@query("snapshot_last", f"""
with raw as ({fixtures.RAW_SNAPSHOTS_SQL})
select {", ".join('"' + c + '"' for c in _RAW_COLS if c != "_row_seq")} from raw
where "Date" >= date '1997-01-01' and _row_seq % 4 = 3""")
def snapshot_last(spark, sf_dir):
    """Every date exported as releases 0 to 3; of each date from 1997-01 on, the last release by name is read."""
    raw = raw_snapshots(spark, sf_dir)
    folder = _scratch(spark, "releases")
    for frame in layout_frames(raw, fixtures.NEW_LAYOUT_FROM):
        (_exports(frame, F.concat(F.lit("release "), F.pmod("_row_seq", F.lit(4)).cast("string"))).write.mode("append")
         .partitionBy("Export").option("header", True).csv(folder))
    out = read_snapshots(spark, folder, since=_dt.date(1997, 1, 1), keep="last")
    return out.select(*[c for c in _RAW_COLS if c != "_row_seq"])


@query("page_fields", r"""
select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
       regexp_extract(html, '<html lang="([^"]*)"', 1) as lang,
       regexp_extract(url, '^https?://([^/?#]+)', 1) as host,
       len(string_split(html, '<p>')) - 1 as n_p_tags,
       len(string_split(html, '<a ')) - 1 as n_a_tags,
       length(html) as n_chars
from pages""")
def page_fields(spark, sf_dir):
    """A12 (native): per-field regex extraction from every page."""
    f = PG.page_fields(read_table(spark, sf_dir, "pages"))
    return f.select("page_id", "title", "lang", "host", F.col("n_p_tags").cast("bigint").alias("n_p_tags"),
                    F.col("n_a_tags").cast("bigint").alias("n_a_tags"), F.col("n_chars").cast("bigint").alias("n_chars"))


def _plain_sql(html: str) -> str:
    text = f"regexp_replace({html}, '<[^>]*>', ' ', 'gs')"
    for entity, char in PG.ENTITIES.items():
        text = f"replace({text}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def _inner_sql(name: str) -> str:
    return rf"regexp_extract(h, '<{name}\b[^>]*>(.*?)</{name}', 1, 'si')"


_ARTICLE_SQL = rf"regexp_replace({_inner_sql('article')}, '<h1\b[^>]*>.*?</h1\s*>', '', 'gsi')"
_ONE_SQL = "string_split_regex(x, '(?i)</p')[1]"


@query("pages_extract", rf"""
with clean as (select page_id, html, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'),
                 '<script\b[^>]*>.*?</script\s*>', '', 'gsi'), '<style\b[^>]*>.*?</style\s*>', '', 'gsi') as h from pages),
part as (select page_id, html, {_plain_sql(_inner_sql("title"))} as t, {_plain_sql(_inner_sql("h1"))} as heading,
                regexp_extract_all({_inner_sql("nav")}, '<a\b[^>]*>(.*?)</a', 1, 'si') as a,
                string_split_regex({_ARTICLE_SQL}, '(?i)<p\b[^>]*>')[2:] as p from clean),
texts as (select *, list_transform(a, lambda x: {_plain_sql("x")}) as l,
                 list_filter(list_transform(p, lambda x: {_plain_sql(_ONE_SQL)}), lambda x: x <> '') as ps from part)
select page_id, coalesce(nullif(t, ''), heading) as title, nullif(regexp_extract(html, '(?i)<html\b[^>]*\blang="([^"]*)"', 1), '') as lang, heading,
       array_to_string(l, '; ') as links, len(l)::int as n_links, len(ps)::int as n_paragraphs, array_to_string(ps, ' ') as text
from texts where coalesce(nullif(t, ''), heading) <> ''""")
def pages_extract(spark, sf_dir):
    """One record per titled page: title, heading, navigation links, paragraphs (native)."""
    return PG.page_records(read_table(spark, sf_dir, "pages"))


@query("alt_normalize", f"""
with raw as ({fixtures.RAW_SNAPSHOTS_SQL})
select last_name, first_name, jobcode as job_code, full_time_equivalent, current_annual_contracted_salary as annual_full_salary, 'Annual' as pay_basis
from raw where "Date" < date '{fixtures.NEW_LAYOUT_FROM}'""")
def alt_normalize(spark, sf_dir):
    """The older layout's column names stripped, lower-cased, blanks and hyphens to underscores."""
    legacy, _ = layout_frames(raw_snapshots(spark, sf_dir), fixtures.NEW_LAYOUT_FROM)
    return normalize_columns(legacy.withColumnRenamed("Last Name", " Last Name "), hyphens=True).select(
        "last_name", "first_name", "job_code", "full_time_equivalent", "annual_full_salary", "pay_basis")


def _job_html():
    return F.concat(
        F.lit('<details><summary><h3>'), F.col("p_name"), F.lit('</h3><div>Job Group: '), F.col("p_brand"),
        F.lit(' <b>Job Subgroup:</b> <span>'), F.lit("Sub "), F.col("p_brand"), F.lit('</span></div><div>Salary Range (Annual): $'),
        F.col("p_size").cast("string"), F.lit(',000 &amp; up Employee Category: '), F.col("p_type"),
        F.lit('</div><div>Job Code: P'), F.col("p_partkey").cast("string"),
        F.lit('</div></summary><div class="sjd-inner"><ul><li><strong>Job Summary:</strong> <p>Makes '), F.col("p_name"),
        F.lit('.</p></li><li><strong>Education</strong><ul><li>'), F.lit("Degree "), F.col("p_size").cast("string"),
        F.lit('</li><li>or more</li></ul></li></ul><h4>More</h4><ul><li><strong>Skills:</strong> '), F.col("p_type"),
        F.lit('</li></ul><div style="border-top: 1px"><a href="/job/'), F.col("p_partkey").cast("string"), F.lit('">Link</a></div></div></details>'))


@query("job_records", """
select p_name as title, 'P' || p_partkey as job_code, p_brand as job_group, 'Sub ' || p_brand as job_subgroup,
       '$' || p_size || ',000 & up' as salary_range_summary, p_type as employee_category,
       'Makes ' || p_name || '.' as job_summary, 'Degree ' || p_size || ' or more' as education, p_type as skills,
       cast(null as varchar) as knowledges, '/job/' || p_partkey as direct_link
from part""")
def job_records(spark, sf_dir):
    """Labelled job fields from pages with many records each (pages made of the part table's rows)."""
    part = read_table(spark, sf_dir, "part").withColumn("_html", _job_html())
    pages = (part.groupBy(F.floor(F.col("p_partkey") / 50).alias("page_id"))       # at most 50 blocks a page
                 .agg(F.concat(F.lit("<html><body>"), F.array_join(F.collect_list("_html"), "\n"), F.lit("</body></html>")).alias("html")))
    out = PG.job_records(pages)
    return out.select("title", "job_code", "job_group", "job_subgroup", "salary_range_summary", "employee_category",
                      "job_summary", "education", "skills", "knowledges", "direct_link")


def _scratch(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "exports", application_key(spark), f"{name}-{uuid.uuid4().hex[:8]}")


@query("price_csv", f"""
select d as "Date", 100 / idx as "CPI", 100 / 1.2 / (100 / idx) as "CPI_2021_Index" from ({fixtures.PRICE_INDEX_SQL})""")
def price_csv(spark, sf_dir):
    """The price series of the snapshots' years written as CSV, read back, index computed on a base month."""
    years = read_table(spark, sf_dir, "orders").select(F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("d")).distinct()
    price = fixtures.price_index(spark).join(years, "d", "left_semi")
    path = _scratch(spark, "cpi")
    write_csv(price.select(F.col("d").alias("Date"), (F.lit(100.0) / F.col("idx")).alias("CPI"), F.lit(None).cast("double").alias("CPI_2021_Index")), path)
    return load_price_index(spark, path, base_date=fixtures.PRICE_INDEX_FIRST)


@query("job_csv", f"""
select jobcode, job_group, job_subgroup, cast(null as varchar) as education from ({fixtures.JOB_DIMENSION_SQL})""")
def job_csv(spark, sf_dir):
    """The job dimension written with the 18 fixed columns, lower-case codes, read back by code."""
    jobs = fixtures.job_dimension(spark, sf_dir).withColumn("job_code", F.lower("jobcode")).drop("jobcode")
    path = _scratch(spark, "jobs")
    write_csv(jobs, path, columns=JOB_COLUMNS, fill="")
    out = load_job_dimension(spark, path)
    return out.select("jobcode", "job_group", "job_subgroup", F.nullif("education", F.lit("")).alias("education"))


@query("panel_store", f"""
with raw as ({fixtures.RAW_SNAPSHOTS_SQL})
select "Date", cast(count(*) as bigint) as n, cast(sum(_row_seq) as bigint) as seqs from raw group by "Date" """)
def panel_store(spark, sf_dir):
    """The panel written by date, built on first read, read back."""
    path = _scratch(spark, "panel")
    back = read_panel(spark, path, lambda: raw_snapshots(spark, sf_dir))
    return back.groupBy("Date").agg(F.count(F.lit(1)).alias("n"), F.sum("_row_seq").alias("seqs"))
