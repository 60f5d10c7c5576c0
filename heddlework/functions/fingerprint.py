"""Content keys: equal action and inputs give equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def input_key(action: Column, inputs: Column) -> Column:
    """SHA-256 over ``{"action", "inputs"}`` with object keys sorted at every level.

    ``inputs`` is VARIANT, whose objects hold their keys sorted, so the JSON text
    is canonical. Numbers are keyed by value: 1 and 1.0 share a key. Inputs that
    are no JSON give NULL instead of one shared key.
    """
    text = F.to_json(F.struct(action.alias("action"), inputs.alias("inputs")))
    return F.when(inputs.isNotNull(), F.sha2(text, 256))


def row_key(df: DataFrame, action: Column, columns: list[str]) -> Column:
    """The same for typed columns, in name order, with nulls written out."""
    inputs = F.struct(*[df[name] for name in sorted(columns)])
    text = F.to_json(
        F.struct(action.alias("action"), inputs.alias("inputs")), {"ignoreNullFields": "false"}
    )
    return F.sha2(text, 256)
