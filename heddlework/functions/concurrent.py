"""Providers whose calls wait for something else, many at a time."""

from __future__ import annotations

import asyncio
import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def apply_async_provider(
    df: DataFrame,
    provider: Callable,
    outputs: T.StructType,
    concurrency: int = 32,
    timeout_seconds: float | None = None,
    error: str = "error",
) -> DataFrame:
    """Add columns that ``provider`` works out row by row, with calls under way together.

    ``provider`` takes a row as a dict and returns a dict of ``outputs``, or something to
    await for it; absent names are null. Each task keeps up to ``concurrency`` calls under
    way, so a service meets that many times the number of tasks. A row is called once per
    run of its task. A call that raises, takes longer than ``timeout_seconds`` or answers
    with values of another type leaves nulls and its error text; other rows go on. Order
    and all columns of the rows stay.
    """
    taken = sorted(set(df.columns) & {*outputs.fieldNames(), error})
    if taken:
        raise ValueError(f"columns already there: {', '.join(taken)}")
    schema = T.StructType([*df.schema.fields, *outputs.fields, T.StructField(error, T.StringType())])
    kinds = {field.name: to_arrow_type(field.dataType) for field in outputs.fields}

    async def answer(row: dict, gate: asyncio.Semaphore) -> tuple[dict, str | None]:
        async with gate:
            try:
                found = provider(row)
                if inspect.isawaitable(found):
                    found = await asyncio.wait_for(found, timeout_seconds)
                found = {name: found.get(name) for name in kinds}
                for name, kind in kinds.items():
                    pa.array([found[name]], type=kind)
                return found, None
            except Exception as problem:
                return {}, str(problem) or type(problem).__name__

    async def answers(rows: list[dict]) -> list[tuple[dict, str | None]]:
        gate = asyncio.Semaphore(concurrency)
        return await asyncio.gather(*(answer(row, gate) for row in rows))

    def batches(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One event loop per task, so that a provider may keep a connection.
        with asyncio.Runner() as runner:
            for piece in pieces:
                found = runner.run(answers(piece.to_pylist()))
                made = [pa.array([row.get(name) for row, _ in found], type=kind) for name, kind in kinds.items()]
                errors = pa.array([text for _, text in found], type=pa.string())
                yield pa.RecordBatch.from_arrays([*piece.columns, *made, errors], names=schema.names)

    return df.mapInArrow(batches, schema)
