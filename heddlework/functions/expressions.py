"""Columns from expression text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expression_column(action: str, code: str | None = None) -> Column:
    """A column from a Spark SQL expression; ``code`` goes before ``action``."""
    return F.expr(code or action)


def with_expression(df: DataFrame, out: str, action: str, code: str | None = None) -> DataFrame:
    return df.withColumn(out, expression_column(action, code))
