"""Rounding helpers for result columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(col, digits: int = 6) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits)


def round_columns(df: DataFrame, names, digits: int = 6) -> DataFrame:
    return df.withColumns({n: rounded(n, digits) for n in names})
