"""Columns that are computed once a row, however often later expressions use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``. A plain column would be put in place of its name wherever it stands, also within lambdas,
    where it is computed for each element; rows that are generated are not."""
    return df.select("*", F.explode(F.array(value)).alias(name))
