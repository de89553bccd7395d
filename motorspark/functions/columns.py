"""Small helpers for columns and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Number the rows of each key from 0, as an int."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("int"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in all double and float columns."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def pearson(a: str | Column, b: str | Column) -> Column:
    """Pearson r as an aggregate; null where either side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
