"""Named queries over the benchmark tables, each with SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Rows of a spread table that a task takes at most, about.
ROWS_A_TASK = 100_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; leave ``sql`` out where SQL cannot say the same."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A table with its timestamps read as UTC instants.

    ``spread`` is for work that is heavy per row: the rows are dealt out evenly. File splits say
    nothing of rows: a group of rows in a file is read by one task, and the splits beside it are empty.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if spread:
        # The count is read from the files' footers.
        df = df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK)))
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({name: F.col(name).cast("timestamp") for name in plain})


def micros(column: str | Column) -> Column:
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)


def joined(texts: Column | str) -> Column:
    return F.array_join(texts, ",")
