"""Mixing sources to target weights along a time-varying curriculum (native).

Every source has a weight and a *schedule*: a piecewise-linear multiplier of
that weight over training time 0..1.  A source's target is its share of the
mix by weight, at most `max_epochs` times its size (the excess is reshared by
weight).  Its demand for words up to time t is target * I(t) / I(1), with I the
integral of its schedule (trapezoids, so a quadratic inside each segment).
A document that begins after c words of its source in epoch e is needed at the
time t at which the demand reaches e * source_size + c: the inverse of I,
a quadratic root inside one segment.  Documents are range-sorted by position.

Plan: one scan; word counts by a JVM regular expression; two grouped sums
(source; source and hash bucket), both combined map-side; a window over at
most 4096 bucket rows per source and one inside each (source, bucket), so a
hot source is split into 4096 window groups; a range sort.  The table of
sources is joined by AQE's size check; the ranking window over it holds one
row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import pick, stored

WORD = r"[^\x20\x09-\x0D]+"
# Production parameters of the query: weights by source rank, repeating; the
# schedule of each, as (time, multiplier) knots with integral 1 over 0..1.
WEIGHTS = (5, 2, 1)
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
SHARE, MAX_EPOCHS = 1.5, 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with weight, knots and target.

    Sources rank by code point (null last).  Water filling: with r = cap / weight
    ascending, a source is capped if r is at most the level that the words and
    the weights left over would give; the level of the uncapped ones follows
    from prefix sums.  One row per source; ties in r are of no effect.
    """
    n = len(weights)
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    at = F.col("_rank") % F.lit(n)
    lit_weights = F.array(*[F.lit(int(w)) for w in weights])
    lit_knots = F.array(*[F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in k])
                          for k in schedules])
    rows = (ranked.withColumn("weight", F.element_at(lit_weights, (at + 1).cast("int")))
            .withColumn("_knots", F.element_at(lit_knots, (F.col("_rank") % F.lit(len(schedules)) + 1).cast("int")))
            .withColumn("_cap", F.col("source_size") * F.lit(max_epochs)))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = (rows.withColumn("_capped_before", F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0)))
            .withColumn("_weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
            .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
            .withColumn("_level", (F.col("_total") - F.col("_capped_before")) / F.col("_weight_left")))
    # the level at the first source that is not capped holds for it and all after it
    fits = F.col("_cap") > F.col("_level") * F.col("weight")
    rows = rows.withColumn("_final", F.min(F.when(fits, F.struct(F.col("_cap") / F.col("weight"), F.col("_rank"), F.col("_level")
                                                                 .alias("l")))).over(everything)["l"])
    return (rows.withColumn("target", F.when(F.col("_final").isNull() | (F.col("_cap") <= F.col("_final") * F.col("weight")),
                                             F.col("_cap").cast("double")).otherwise(F.col("_final") * F.col("weight")))
            .select("source", "source_size", "weight", "target", "_knots"))


def demand_time(words: Column, target: Column, knots: Column) -> Column:
    """The time at which a source's demand reaches `words`: the inverse of the
    schedule's integral.  The knots are few (a schedule); null if target is 0."""
    area = lambda i: ((knots[i + 1]["t"] - knots[i]["t"]) * (knots[i + 1]["w"] + knots[i]["w"]) / F.lit(2.0))
    segments = F.sequence(F.lit(0), F.size(knots) - F.lit(2))
    total = F.aggregate(segments, F.lit(0.0), lambda acc, i: acc + area(i))
    need = F.try_divide(words * total, target)
    # walk the segments, keeping what is still needed and the time found
    zero = F.struct(need.alias("need"), F.lit(None).cast("double").alias("at"))

    def step(acc, i):
        t0, w0 = knots[i]["t"], knots[i]["w"]
        slope = (knots[i + 1]["w"] - w0) / (knots[i + 1]["t"] - t0)
        here = F.greatest(w0 * w0 + F.lit(2.0) * slope * acc["need"], F.lit(0.0))
        found = t0 + F.try_divide(F.lit(2.0) * acc["need"], w0 + F.sqrt(here))
        inside = acc["at"].isNull() & (acc["need"] < area(i))
        return F.struct((acc["need"] - area(i)).alias("need"), F.when(inside, found).otherwise(acc["at"]).alias("at"))

    return F.coalesce(F.aggregate(segments, zero, step, lambda acc: acc["at"]),
                      F.when(target > 0, F.element_at(knots, -1)["t"]))


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
        text: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target,
    taken (words the mix takes), copies (epochs that reach the document),
    positions (one training time per copy); range-sorted by the first position
    (documents not taken last).  With `carry` also row (all columns of `docs`),
    unsorted, for a caller that sorts the copies.

    Within a source documents follow in the order of md5(doc_id), ties by doc_id
    and size; the mix takes that sequence, repeated, up to the target, so the
    last document may be taken in part.  A null text has size 0 and a null
    source is a source of its own, last; a document of size 0 is taken with 0
    words (no copy).  Equal rows are separate documents.  An empty table gives
    no rows; other columns of any name are ignored.
    """
    base = docs.select("doc_id", "source", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    base = (base.withColumn("_order", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("g")))
            .withColumn("_bucket", F.substring("_order", 1, 3))
            # a key without nulls: window and join then share one exchange of the rows
            .withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))))
    if not carry:
        base = stored(base, "mix-sizes")       # a few dozen bytes a document: texts are counted once
    buckets = base.groupBy("source", "_key", "_bucket").agg(F.sum("size").alias("_words"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, schedules, share, max_epochs)
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (buckets.withColumn("_bucket_start", F.coalesce(F.sum("_words").over(before), F.lit(0)))
            .join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
            .select("_key", "_bucket", "_bucket_start", "source_size", "target", "_knots"))
    inside = (Window.partitionBy("_key", "_bucket").orderBy("_order", F.col("doc_id").asc_nulls_last(), "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = (base.withColumn("_in_bucket", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(plan, ["_key", "_bucket"])
            .withColumn("_start", F.col("_bucket_start") + F.col("_in_bucket")))
    epochs = F.sequence(F.lit(0), F.lit(max_epochs - 1))
    upto = F.floor("target")
    part = lambda e: F.greatest(F.lit(0), F.least(F.col("size"), upto - e * F.col("source_size") - F.col("_start")))
    rows = (rows.withColumn("taken", F.aggregate(epochs, F.lit(0).cast("long"), lambda acc, e: acc + part(e)))
            .withColumn("_epochs", F.filter(epochs, lambda e: part(e) > 0))
            .withColumn("copies", F.size("_epochs"))
            .withColumn("positions", F.transform("_epochs", lambda e: demand_time(
                (e * F.col("source_size") + F.col("_start")).cast("double"), F.col("target"), F.col("_knots")))))
    out = rows.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "positions", *(["row"] if carry else []))
    return out if carry else out.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix as rows, one per copy, range-sorted by training
    position; all columns of `docs`."""
    mixed = mix(docs, carry=True, **options).select("doc_id", "row", F.explode("positions").alias("position"))
    return mixed.orderBy("position", "doc_id").select("row.*")


# The same rows by one window per source (no buckets), for DuckDB.
OP1_SQL = r"""
with d as (select doc_id, source, case when text is null then 0
             else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end::bigint as size from documents),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source collate "binary" nulls last) - 1 as rk
       from d group by source),
s as (select *, [5, 2, 1][(rk % 3 + 1)::int] as weight, source_size * 2 as cap from s0),
p as (select *, coalesce(sum(cap) over w, 0)::bigint as capped,
             (sum(weight) over () - coalesce(sum(weight) over w, 0))::bigint as wleft,
             (sum(source_size) over ())::double * 1.5 as total
      from s window w as (order by cap::double / weight, rk rows between unbounded preceding and 1 preceding)),
l as (select *, (total - capped) / wleft as level from p),
f as (select arg_min(level, cap::double / weight + rk * 0.0) as lv from l where cap > level * weight),
t as (select source, source_size, case when (select lv from f) is null or cap <= (select lv from f) * weight then cap::double
             else (select lv from f) * weight end as target from l),
o as (select d.doc_id, d.size, t.source_size, t.target, coalesce(sum(d.size) over (partition by d.source
             order by coalesce(md5(d.doc_id::varchar), 'g'), d.doc_id nulls last, d.size
             rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target)::bigint - start))
        + greatest(0, least(size, floor(target)::bigint - source_size - start)))::bigint as taken
from o
"""


def op1_mixing(docs: DataFrame) -> DataFrame:
    return pick(mix(docs), "doc_id", "size", "source_size", "target", "taken")
