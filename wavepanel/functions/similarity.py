"""Name similarity (J1): Ratcliff-Obershelp ratio of two normalised names.

A vectorised pandas UDF around the standard library's matcher.  It is only
ever applied to the *distinct pair* table (one row per from-unit/to-unit
pair), never to panel rows.  Argument order matters (the ratio is
asymmetric): (previous, current).
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def ratio(a, b) -> float:
    """Similarity of two already-normalised names; empty or missing -> 0.0."""
    if not isinstance(a, str) or not isinstance(b, str) or not a or not b:
        return 0.0
    return SequenceMatcher(None, a, b).ratio()


@pandas_udf(DoubleType())
def _ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def edit_similarity(prev_norm, cur_norm) -> Column:
    """1 - Levenshtein distance / longer length of two normalised names, native;
    empty or missing -> 0.0."""
    a = F.coalesce(F.col(prev_norm) if isinstance(prev_norm, str) else prev_norm, F.lit(""))
    b = F.coalesce(F.col(cur_norm) if isinstance(cur_norm, str) else cur_norm, F.lit(""))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longer)


def edit_similarity_sql(a: str, b: str) -> str:
    a, b = f"coalesce({a}, '')", f"coalesce({b}, '')"
    return (f"case when {a} = '' or {b} = '' then 0.0::double "
            f"else 1.0::double - levenshtein({a}, {b})::double / greatest(length({a}), length({b})) end")


def name_similarity(prev_norm, cur_norm) -> Column:
    """Column expression: similarity of two normalised-name columns."""
    a = F.col(prev_norm) if isinstance(prev_norm, str) else prev_norm
    b = F.col(cur_norm) if isinstance(cur_norm, str) else cur_norm
    return _ratio_udf(a, b)
