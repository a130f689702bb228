"""Ratio of two feature values, as used by every matching operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def feature_ratio(a: Column, b: Column) -> Column:
    """``a / b`` with an unknown or 0/0 ratio read as 1 and x/0 read as 0."""
    return (
        F.when(a.isNull() | b.isNull(), F.lit(1.0))
        .when((a == 0) & (b == 0), F.lit(1.0))
        .when(b == 0, F.lit(0.0))
        .otherwise(F.try_divide(a, b))
    )
