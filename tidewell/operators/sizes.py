"""Sides of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is sent to all tasks.
MOST = 20_000


def is_small(df: DataFrame, most: int = MOST) -> bool:
    return df.limit(most + 1).count() <= most


def held(df: DataFrame, most: int = MOST) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it is small, else as it is."""
    return F.broadcast(df) if is_small(df, most) else df
