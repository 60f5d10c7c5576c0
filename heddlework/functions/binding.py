"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once per row.

    Spark works out whatever a lambda takes from outside anew for every element,
    and shares nothing inside a lambda. A lambda's own argument is only read.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are worked out once per row, however often they are used later.

    A plain column that several expressions or a filter use is copied into each of
    them. A generator of one row is not: filters on its columns stay above it.
    """
    made = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select(*[F.col(f"`{name}`") for name in df.columns if name not in columns], made)
