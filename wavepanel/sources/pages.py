"""Web pages -> records (A12, re-aimed to the `pages(page_id, url, html)` table).

Three forms:
* `job_records` -- many records per page: folding blocks with a title, a summary
  of labelled values and a list of labelled fields, by native expressions;
* `page_fields` -- per-field regex extraction (`regexp_extract`) for fields
  with a fixed pattern (title, language, counts);
* `page_records` -- one record per titled page: navigation links and the
  article's paragraphs as plain text, scripts, styles and comments left out.
All are native expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def page_fields(pages: DataFrame) -> DataFrame:
    """A12 (native): title, language, URL host and tag counts via regexes."""
    h = F.col("html")
    return pages.select(
        "page_id",
        F.regexp_extract(h, r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract(h, r"<html lang=\"([^\"]*)\"", 1).alias("lang"),
        F.regexp_extract(F.col("url"), r"^https?://([^/?#]+)", 1).alias("host"),
        (F.size(F.split(h, "<p>")) - 1).alias("n_p_tags"),
        (F.size(F.split(h, "<a ")) - 1).alias("n_a_tags"),
        F.length(h).alias("n_chars"))


# Labels of a job's folding block -> column.
SUMMARY_LABELS = {"Job Group": "job_group", "Job Subgroup": "job_subgroup", "Salary Range (Annual)": "salary_range_summary",
                  "Employee Category": "employee_category", "Job Code": "job_code"}
FIELD_LABELS = {"Job Summary": "job_summary", "Job Responsibilities": "job_responsibilities", "Education": "education",
                "FLSA Status": "flsa_status", "Institution Job": "institution_job",
                "Required Supervisory Duty of at Least 2.0 Full-Time Equivalent (FTE) Employees": "supervisory_required",
                "Scaled Job": "scaled_job", "Salary Range (Annual)": "salary_range_detail", "Job Code": "job_codes_detail",
                "Knowledges": "knowledges", "Skills": "skills"}
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": "\"", "&#39;": "'", "&amp;": "&"}


def plain_text(html: "F.Column") -> "F.Column":
    """Text of an HTML fragment: tags to spaces, common entities, white space squeezed."""
    text = F.regexp_replace(html, "(?s)<[^>]*>", " ")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, title, lang, heading, links, n_links, n_paragraphs, text) of
    every page with a title or a heading (whole pages, no caps).  A paragraph ends
    at its end tag or where the next one begins."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<!--.*?-->", ""),
                             r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    inner = lambda h, name: F.regexp_extract(h, f"(?is)<{name}\\b[^>]*>(.*?)</{name}\\s*>", 1)
    links = F.transform(F.regexp_extract_all(inner(clean, "nav"), F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1)), plain_text)
    article = F.regexp_replace(inner(clean, "article"), r"(?is)<h1\b[^>]*>.*?</h1\s*>", "")
    paragraphs = F.transform(F.slice(F.split(article, r"(?i)<p\b[^>]*>"), 2, 1 << 30), lambda p: plain_text(F.split(p, r"(?i)</p\s*>", 2)[0]))
    heading = plain_text(inner(clean, "h1"))
    rows = pages.select("page_id", F.coalesce(F.nullif(plain_text(inner(clean, "title")), F.lit("")), heading).alias("title"),
                        F.nullif(F.regexp_extract("html", r'(?i)<html\b[^>]*\blang="([^"]*)"', 1), F.lit("")).alias("lang"), heading.alias("heading"),
                        links.alias("_links"), F.filter(paragraphs, lambda p: p != "").alias("_text"))
    return rows.where(F.col("title") != "").select(
        "page_id", "title", "lang", "heading", F.array_join("_links", "; ").alias("links"), F.size("_links").alias("n_links"),
        F.size("_text").alias("n_paragraphs"), F.array_join("_text", " ").alias("text"))


def job_records(pages: DataFrame) -> DataFrame:
    """One row per titled folding block of every page: page_id, position,
    title, the summary's labelled values, the labelled fields and the direct link
    (null where absent).  A summary value ends where the next label begins.
    Native expressions; a page may hold any number of records.
    """
    tag = lambda block, name: F.regexp_extract(block, f"(?is)<{name}\\b[^>]*>(.*?)</{name}>", 1)
    blocks = F.slice(F.split(F.col("html"), r"(?i)<details\b[^>]*>"), 2, 1 << 30)
    rows = pages.select("page_id", F.posexplode(blocks).alias("position", "_block"))
    rows = rows.withColumn("_block", F.split("_block", "(?i)</details>", 2)[0])
    rows = rows.withColumn("title", plain_text(tag(F.col("_block"), "h3"))).where(F.col("title") != "")
    rows = rows.withColumn("_summary", plain_text(tag(F.col("_block"), "summary")))
    stop = "|".join(label.replace("(", "\\(").replace(")", "\\)") for label in SUMMARY_LABELS)
    value = lambda label: F.nullif(F.trim(F.regexp_extract(
        "_summary", f"(?:{label.replace('(', chr(92) + '(').replace(')', chr(92) + ')')}):(.*?)(?=(?:{stop}):|$)", 1)), F.lit(""))
    items = F.regexp_extract_all("_block", F.lit(r"(?is)<li\b[^>]*>\s*(<strong\b.*?</strong>.*?)(?=<li\b[^>]*>\s*<strong\b|</ul>\s*(?:<h|<div|<ul|$)|\z)"), 1)
    pairs = F.transform(items, lambda i: F.struct(
        F.regexp_replace(plain_text(tag(i, "strong")), r":\s*$", "").alias("k"),
        plain_text(F.regexp_replace(i, r"(?is)^.*?</strong>", "")).alias("v")))
    rows = rows.withColumn("_fields", pairs)
    field = lambda label: F.try_element_at(F.filter("_fields", lambda p: p["k"] == label), F.lit(-1))["v"]
    link = F.nullif(F.regexp_extract("_block", r'(?is)border-top.*?<a\b[^>]*href="([^"]*)"', 1), F.lit(""))
    return rows.select("page_id", "position", "title", *[value(k).alias(c) for k, c in SUMMARY_LABELS.items()],
                       *[field(k).alias(c) for k, c in FIELD_LABELS.items()], link.alias("direct_link"))
