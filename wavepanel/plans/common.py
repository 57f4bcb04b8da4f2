"""Shared inputs of the registered queries (fixture panel + deflation)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import FIXTURE as FX
from ..functions.numeric import round_half_up, round_sql
from ..operators.cube import entity_cube
from ..operators.deflate import deflate
from ..session import application_key, input_version, store_table, stored_path
from ..sources import fixtures
from ..sources.sinks import read_entity_panel, write_entity_panel

R = round_half_up

# Derived inputs stored once per application and state of the input:
# (application id, sf_dir, input version, name) -> Parquet path.
_STORED: dict[tuple[str, str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Build a derived table once per application and store it as Parquet in
    the shared `spark.checkpoint.dir` (lineage cut, survives the loss of
    executors); later queries scan the stored copy with column pruning and
    filter pushdown.  This is the reference's own model: the panel is built
    once, then every view reads it.
    """
    key = (application_key(spark), sf_dir, input_version(spark, sf_dir), name)
    if key not in _STORED:
        _STORED[key] = store_table(build(), name)
    return spark.read.parquet(_STORED[key])          # read through the caller's session


def stored_by_entity(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """As `stored`, laid out by entity id: joins, windows and aggregates of an
    entity's rows need no exchange."""
    key = (application_key(spark), sf_dir, input_version(spark, sf_dir), name)
    if key not in _STORED:
        path = stored_path(spark, name)
        write_entity_panel(build(), path, FX.id, [FX.date])
        _STORED[key] = path
    return read_entity_panel(spark, _STORED[key])


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `panel` fixture view (FIXTURES.md 2.1), stored once per application."""
    return stored(spark, sf_dir, "panel", lambda: fixtures.panel(spark, sf_dir))


def deflated_panel(spark: SparkSession, sf_dir: str, mode: str = "latest") -> DataFrame:
    """Fixture panel with pay, index, real pay, real salary and the org key
    (C1 applied to the stored panel)."""
    p = deflate(panel(spark, sf_dir), fixtures.price_index(spark), FX,
                idx_date="d", idx_val="idx", mode=mode)
    return p.withColumn(FX.org, F.concat(F.col(FX.division), F.lit(" - "), F.col(FX.department)))


def panel_real(spark: SparkSession, sf_dir: str, mode: str = "latest") -> DataFrame:
    """The deflated panel every view reads: stored once per application, by
    entity, for the reference's fill rule; other modes are derived on the fly."""
    if mode != "latest":
        return deflated_panel(spark, sf_dir, mode)
    return stored_by_entity(spark, sf_dir, "panel_real", lambda: deflated_panel(spark, sf_dir, mode))


def trend_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity bitmaps and sums per (snapshot, division, type, job group) of the
    panel without zero-weight rows: every trend reads this table."""
    return stored(spark, sf_dir, "trend_cube", lambda: entity_cube(
        panel_real(spark, sf_dir).where(F.col(FX.weight) > 0), [FX.division, FX.div_type, FX.jobgroup], FX))


def raw_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw-layout rows of the cleaning job, stored once per application."""
    return stored(spark, sf_dir, "raw_snapshots", lambda: fixtures.raw_snapshots(spark, sf_dir))


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `appointments` fixture view (FIXTURES.md 2.2), stored once per application."""
    return stored(spark, sf_dir, "appointments", lambda: fixtures.appointments(spark, sf_dir))


def with_sql(body: str, ctes: str = "") -> str:
    """Prefix an oracle query with the fixture CTEs (panel, price_index, panel_real)
    and optional extra CTEs (`name as (...), ...`)."""
    extra = ",\n" + ctes.strip() if ctes.strip() else ""
    return "with " + fixtures.PANEL_REAL_SQL.strip() + extra + "\n" + body


def rs(expr: str, n: int = 2) -> str:
    return round_sql(expr, n)


def regression_ctes(src: str, keys: list[str], y: str, x: str, name: str = "reg") -> str:
    """CTEs ending in `<name>(keys, n, slope, intercept)`: the two-pass centred
    least-squares line of `operators.aggregate.linear_trend`, in SQL."""
    k = ", ".join(keys)
    on = " and ".join(f"t.{c} = m.{c}" for c in keys)
    tk = ", ".join(f"t.{c}" for c in keys)
    return f"""{name}_m as (select {k}, count(*) as n, avg({x}) as _mx, avg({y}) as _my,
                    min({x}) < max({x}) as _varies from {src} group by {k}),
{name}_s as (select {tk}, m.n, m._mx, m._my, m._varies,
                sum((t.{x} - m._mx) * (t.{y} - m._my)) as _sxy, sum((t.{x} - m._mx) * (t.{x} - m._mx)) as _sxx
         from {src} t join {name}_m m on {on} group by {tk}, m.n, m._mx, m._my, m._varies),
{name} as (select {k}, n, case when n > 2 and _varies and _sxx > 0 then _sxy / _sxx end as slope,
                 case when n > 2 and _varies and _sxx > 0 then _my - _sxy / _sxx * _mx end as intercept
           from {name}_s)"""
