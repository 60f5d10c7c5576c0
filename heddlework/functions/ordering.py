"""Running totals, positions and carried values inside groups of any size.

A window over a group is one task's work, so a group that holds a large part of
the table would run on one executor. Here the rows are range partitioned by group and
order, which cuts a large group into slices of near-equal size and leaves many small groups
together in one. Each slice is scanned on its own and then shifted by the totals of
the slices before it. There is one plan for groups of every size, and no count before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heddlework.session import Staging

PAGE_ROWS = 1_000


def scan_within(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add running sums (``totals``) and last non-null values (``lasts``).

    ``order`` must be unique within a group. The current row is included.
    ``keep`` names the columns wanted beside ``keys`` and ``order``; all by default.
    """
    totals, lasts = totals or {}, lasts or {}
    placed = [*keys, *order]
    spare = [name for name in (df.columns if keep is None else keep) if name not in placed]
    values = {f"_v{i}": expr for i, expr in enumerate([*totals.values(), *lasts.values()])}
    # Slice numbers must not change between the two reads below, hence the written table.
    sliced = Staging(df.sparkSession, "slices").put(
        df.select(*placed, *spare, *[expr.alias(name) for name, expr in values.items()])
        .repartitionByRange(*placed)
        .withColumn("_slice", F.spark_partition_id()),
        "rows",
    )
    named = dict(zip([*totals, *lasts], map(F.col, values), strict=True))
    totals, lasts = {out: named[out] for out in totals}, {out: named[out] for out in lasts}
    frame = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = sliced.select(
        *placed, *spare, "_slice",
        *[F.sum(expr).over(frame).alias(f"_l_{out}") for out, expr in totals.items()],
        *[F.last(expr, ignorenulls=True).over(frame).alias(f"_l_{out}") for out, expr in lasts.items()],
    )
    rank = F.struct(*order)
    per_slice = sliced.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(expr).alias(out) for out, expr in totals.items()],
        *[F.max_by(expr, F.when(expr.isNotNull(), rank)).alias(out) for out, expr in lasts.items()],
    )
    # At most one row per slice and group: a group of any size has no more rows here than there are slices.
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = per_slice.select(
        *[F.col(key).alias(f"_k{i}") for i, key in enumerate(keys)],
        F.col("_slice").alias("_s"),
        F.count(F.lit(1)).over(before).alias("_before"),
        *[F.sum(out).over(before).alias(f"_c_{out}") for out in totals],
        *[F.last(out, ignorenulls=True).over(before).alias(f"_c_{out}") for out in lasts],
    )
    # Only groups that began in an earlier slice have anything to add.
    carried = carried.filter("_before > 0")
    same = [F.col(key).eqNullSafe(F.col(f"_k{i}")) for i, key in enumerate(keys)]
    joined = local.join(carried, reduce(lambda a, b: a & b, same, F.col("_slice") == F.col("_s")), "left")
    summed = {out: F.col(f"_l_{out}") + F.coalesce(F.col(f"_c_{out}"), F.lit(0)) for out in totals}
    kept = {out: F.coalesce(F.col(f"_l_{out}"), F.col(f"_c_{out}")) for out in lasts}
    return joined.select(*placed, *spare, *[expr.alias(out) for out, expr in {**summed, **kept}.items()])


def positions_within(df: DataFrame, keys: list[str], order: list[str], out: str, **kw) -> DataFrame:
    """Add the 1-based position of each row in its group as a long column."""
    return scan_within(df, keys, order, totals={out: F.lit(1).cast("long")}, **kw)


def paged(df: DataFrame, keys: list[str], order: list[str], page_rows: int = PAGE_ROWS, **kw) -> DataFrame:
    """Add ``position`` and ``page`` so that a group can be nested page by page."""
    numbered = positions_within(df, keys, order, "position", **kw)
    return numbered.withColumn("page", F.floor((F.col("position") - 1) / page_rows).cast("long"))


def ranked(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add numbers that follow ``order`` over the whole table, with gaps. Write the table before it is read twice."""
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut.withColumn(out, F.monotonically_increasing_id())
