"""Named vectorised functions, bound to columns by their signatures."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTEXT_COLUMNS = ("run_id", "workflow_id", "step_id")
ROW, CONTEXT = "the whole row", "the context of the row"
IN_PLACE = None


@dataclass(frozen=True)
class Binding:
    """A function and where each of its parameters gets its value.

    ``sources`` maps a parameter, or ``IN_PLACE`` for a value passed by position, to
    ``ROW``, ``CONTEXT`` or a set with the name of one column.
    """

    fn: Callable
    returns: T.DataType | str
    sources: dict

    @classmethod
    def of(cls, fn: Callable, returns: T.DataType | str) -> Binding:
        signature = inspect.signature(fn)
        named = signature.parameters.keys()
        special = {"inputs": ROW, "context": CONTEXT}
        if "inputs" in named:
            return cls(fn, returns, {p: source for p, source in special.items() if p in named})
        if len(named) == 1 and _takes_by_position(signature):
            return cls(fn, returns, {IN_PLACE: ROW})
        return cls(fn, returns, {p: {p} for p in named})

    def column(self, inputs: DataFrame) -> Column:
        """The function over the table; parameters without a column keep their defaults."""
        about = [c for c in inputs.columns if c in CONTEXT_COLUMNS]
        data = [c for c in inputs.columns if c not in about] or inputs.columns
        structs = {ROW: F.struct(*data), CONTEXT: F.struct(*about)}
        given = {}
        for parameter, source in self.sources.items():
            if isinstance(source, str):
                given[parameter] = structs[source]
            else:
                given |= {parameter: F.col(f"`{c}`") for c in source if c in inputs.columns}
        if not given:
            return _vectorised(_repeated(self.fn), self.returns)(F.struct(inputs.columns[0]))
        return _vectorised(_calling(self.fn, list(given)), self.returns)(*given.values())


class FunctionRegistry:
    """Functions over pandas Series that a session knows by name.

    A registered function is also a temporary SQL function where its parameters
    are plain columns.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._known: dict[str, Binding] = {}

    def register(self, name: str, fn: Callable, returns: T.DataType | str) -> None:
        """How the function is called is worked out here, once.

        No parameters: called bare. ``inputs`` (and ``context``), or one
        positional parameter: gets all columns as a pandas DataFrame. Otherwise
        parameters are matched with columns by name and other columns dropped.
        """
        self._known[name] = Binding.of(fn, returns)
        columns = list(inspect.signature(fn).parameters)
        if columns and "inputs" not in columns:
            self._spark.udf.register(name, _vectorised(_calling(fn, columns), returns))

    def unregister(self, name: str) -> None:
        if self._known.pop(name, None):
            self._spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS `{name}`")

    def names(self) -> list[str]:
        return sorted(self._known)

    def column(self, name: str, inputs: DataFrame) -> Column:
        """The named function applied to a table's columns."""
        return self._known[name].column(inputs)


def _takes_by_position(signature: inspect.Signature) -> bool:
    try:
        signature.bind(ROW)
    except TypeError:
        return False
    return True


def _calling(fn: Callable, parameters: list[str | None]) -> Callable:
    def call(*columns):
        given = dict(zip(parameters, columns, strict=True))
        in_place = [given.pop(IN_PLACE)] if IN_PLACE in given else []
        return fn(*in_place, **given)

    return call


def _repeated(fn: Callable) -> Callable:
    return lambda rows: pd.Series([fn()] * len(rows))


def _vectorised(fn: Callable, returns: T.DataType | str):
    def run(*columns: pd.Series) -> pd.Series:
        return fn(*columns)

    return F.pandas_udf(run, returnType=returns)


def apply_provider(df: DataFrame, provider: Callable, outputs: T.StructType, error: str = "error") -> DataFrame:
    """Add columns a caller's batch function works out.

    ``provider`` takes a pandas DataFrame and returns one with the ``outputs``
    columns in the same row order. A batch that fails is halved until the failing
    rows stand alone, so only they carry an error text and the job goes on. Good rows
    beside a failing one are thereby given to ``provider`` again, up to log2(batch)
    times; a provider whose calls cost something answers every row itself, with its
    own error column, and does not raise.
    """
    schema = T.StructType([*df.schema.fields, *outputs.fields, T.StructField(error, T.StringType())])
    names = outputs.fieldNames()

    def answers(rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list]]:
        try:
            yield provider(rows)[names], [None] * len(rows)
        except Exception as problem:
            if len(rows) == 1:
                yield pd.DataFrame([[None] * len(names)], columns=names), [str(problem)]
                return
            middle = len(rows) // 2
            yield from answers(rows.iloc[:middle])
            yield from answers(rows.iloc[middle:])

    def batches(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in pieces:
            found = list(answers(rows))
            made = {name: [v for part, _ in found for v in part[name].tolist()] for name in names}
            errors = [text for _, texts in found for text in texts]
            yield rows.reset_index(drop=True).assign(**made, **{error: errors})

    return df.mapInPandas(batches, schema)
