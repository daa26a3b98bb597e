"""Row helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed a single time per row.

    Filters and projections above a plain column are rewritten in terms of its
    expression, which would parse or search the same text again for every use.
    A one-row generator keeps the value.
    """
    return df.withColumn(name, F.explode(F.array(value)))
