"""Registered queries: each is a Spark plan over the driver's tables plus the
equivalent SQL the DuckDB oracle runs (see `registry.query`)."""

from . import basics, changes, cleaning, cohort, entities, extras, scenarios, sources, stats, transfers, trends  # noqa: F401  (registers queries)
from .registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
