"""What several operators share: settings, byte columns, staged tables, global row numbers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddlework.session import Staging, ship_package

#: Small Arrow batches: a batch of very long texts still fits a Python worker.
ARROW_ROWS = "512"

#: White space of the word rules, as a class of Java and RE2 patterns.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def prepare(spark: SparkSession) -> None:
    """Settings that the Python stages rely on, and the package on the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")
    ship_package(spark)


_HELD: dict = {}


def resident(owner: str, key, build: Callable):
    """What an operator keeps in a worker from batch to batch, built when first asked for.

    Workers outlive a stage, so that the models of a pipeline's stages would add up. A worker
    holds one owner's things, those of one ``key``; whatever else it held is let go before ``build``.
    """
    if (owner, key) not in _HELD:
        let_go()
        _HELD[owner, key] = build()
    return _HELD[owner, key]


def let_go() -> None:
    """A worker's models end; freed memory goes back to the system where the C library can do so."""
    if not _HELD:
        return
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def staging(spark: SparkSession, label: str) -> Staging:
    prepare(spark)
    return Staging(spark, label)


def per_row(fn: Callable[[list], Iterator], schema: str, deterministic: bool = False):
    """An Arrow UDF of one column; ``fn`` maps the values of a batch to tuples of ``schema``.

    It counts as not deterministic so that Spark evaluates it once even where a
    filter on its result could be pushed below the projection.
    """
    kind = T.StructType.fromDDL(schema)
    arrow = pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind.fields])

    def run(values: pa.Array) -> pa.Array:
        columns = list(zip(*fn(values.to_pylist()), strict=True)) or [()] * len(arrow)
        return pa.StructArray.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], fields=list(arrow)
        )

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    out = F.arrow_udf(run, kind)
    return out if deterministic else out.asNondeterministic()


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def text_bytes(text: str | Column = "text") -> Column:
    """UTF-8 of a text, empty for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit("")).cast("binary")


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """``fn`` turns the rows of a task (dicts) into tuples of ``schema``, in bounded batches."""
    kind = T.StructType.fromDDL(schema)
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in kind.fields])

    def run(batches):
        let_go()
        rows = (row for batch in batches for row in batch.to_pylist())
        block = []
        for out in fn(rows):
            block.append(out)
            if len(block) >= 4096:
                yield _batch(block, arrow)
                block = []
        if block:
            yield _batch(block, arrow)

    return df.mapInArrow(run, kind)


def _batch(block: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*block, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def numbered(df: DataFrame, stage: Staging, keys: list[str], name: str = "numbered") -> tuple[DataFrame, int]:
    """``df`` with ``row_number`` from 0 in the order of ``keys``, and the number of rows.

    A range sort deals the rows out; the position inside a slice plus the sizes of the
    slices before it is the global number. Rows equal in all keys are told apart by
    where the scan met them, so a key that repeats cannot fill one slice. The only
    table that meets in one task has one row for each slice.
    """
    met = df.withColumn("__met", F.monotonically_increasing_id())
    order = [F.col(k).asc_nulls_first() for k in keys] + [F.col("__met")]
    cut = met.repartitionByRange(*order).sortWithinPartitions(*order).drop("__met")
    rows = stage.put(cut.withColumn("__at", F.monotonically_increasing_id()), name)
    slice_id = F.shiftright("__at", 33)
    from pyspark.sql import Window

    sizes = rows.groupBy(slice_id.alias("__slice")).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage.put(
        sizes.select("__slice", "__rows", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset")),
        f"{name}-offsets",
    )
    total = offsets.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]
    out = (
        rows.withColumn("__slice", slice_id)
        .join(offsets.select("__slice", "__offset"), "__slice")
        .withColumn("row_number", F.col("__offset") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__slice", "__offset", "__at")
    )
    return out, int(total)
