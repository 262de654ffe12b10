"""The first rows of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_by(df: DataFrame, n: int | Column, *order: Column | str, by: str = "query_id") -> DataFrame:
    """Rows with rank (from 0) under ``n`` in each group; `WindowGroupLimit` keeps the shuffle small."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).filter(F.col("rank") < n)
