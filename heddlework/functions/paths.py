"""Deep paths into JSON values held as VARIANT.

A constant path is compiled on the driver into plain ``try_variant_get`` calls,
which stay inside whole-stage codegen. A path column is walked by a
higher-order function in the row. Neither starts Python workers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddlework.functions.binding import bind

# Fixed value: a bracketed segment, with or without quotes.
BRACKET_SEGMENT = r"\[['\"]?([^'\"\]]+)['\"]?\]"

_MAX_INDEX = 2**31 - 1
"""An array holds no more; larger digits name keys only."""

NULL_IN_PATH = "null_in_path"
KEY_MISSING = "key_missing"
INDEX_NOT_NUMERIC = "index_not_numeric"
INDEX_OUT_OF_RANGE = "index_out_of_range"
UNSUPPORTED_TYPE = "unsupported_type"
NO_SOURCE = "source_missing"


def segments(path: str | None) -> list[str]:
    """Segments of a constant path: ``a[0].b`` and ``a.0.b`` are the same."""
    dotted = re.sub(BRACKET_SEGMENT, r".\1", path or "")
    return [part for part in dotted.split(".") if part]


def segments_col(path: Column) -> Column:
    """``segments`` for a column of paths."""
    return F.filter(F.split(F.regexp_replace(path, BRACKET_SEGMENT, r".$1"), r"\."), lambda part: part != "")


def _as_key(segment: str) -> str:
    return f"['{segment}']" if '"' in segment else f'["{segment}"]'


def _both_quotes(segment: str) -> bool:
    return '"' in segment and "'" in segment


def _is_digits(segment: str) -> bool:
    return segment.isascii() and segment.isdigit()


def _walk(value: Column, parts: list[str], to: str) -> Column:
    """Names in a row are one path. Digits may name a key or an index: the value is an object
    or an array, so at most one of the two paths from there finds something."""
    runs: list[list[str]] = [[]]
    for part in parts:
        if _both_quotes(part) or (_is_digits(part) and any(map(_ambiguous, runs[-1]))) or _both_quotes((runs[-1] or [""])[0]):
            runs.append([])
        runs[-1].append(part)
    for run in runs[:-1]:
        value = _one_run(value, run, "variant")
    return _one_run(value, runs[-1], to)


def _ambiguous(segment: str) -> bool:
    return _is_digits(segment) and int(segment) <= _MAX_INDEX


def _one_run(value: Column, run: list[str], to: str) -> Column:
    if not run:
        return value if to == "variant" else F.try_variant_get(value, "$", to)
    if _both_quotes(run[0]):
        held = F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(run[0]))
        return held if to == "variant" else F.try_variant_get(held, "$", to)
    by_key = "$" + "".join(map(_as_key, run))
    if not any(map(_ambiguous, run)):
        return F.try_variant_get(value, by_key, to)
    by_index = "$" + "".join(f"[{int(p)}]" if _ambiguous(p) else _as_key(p) for p in run)
    return bind(value, lambda v: F.coalesce(F.try_variant_get(v, by_key, to), F.try_variant_get(v, by_index, to)))


def _walk_col(value: Column, parts: Column) -> Column:
    return F.aggregate(parts, value, _step)


def _step(held: Column, part: Column) -> Column:
    """One segment on; the same rules as for a constant path."""
    double, single = part.contains('"'), part.contains("'")
    path = F.when(double, F.concat(F.lit("$['"), part, F.lit("']"))).otherwise(F.concat(F.lit('$["'), part, F.lit('"]')))
    both = double & single
    by_key = F.when(both, F.try_element_at(F.try_variant_get(held, "$", "map<string,variant>"), part)).otherwise(
        F.try_variant_get(held, F.when(both, F.lit("$")).otherwise(path), "variant")
    )
    digits = F.when(part.rlike("^[0-9]+$"), part.try_cast("int"))
    index = F.concat(F.lit("$["), F.coalesce(digits, F.lit(0)).cast("string"), F.lit("]"))
    return F.coalesce(by_key, F.when(digits.isNotNull(), F.try_variant_get(held, index, "variant")))


def extract(value: Column, path: str | Column | None, to: str = "variant") -> Column:
    """The value at ``path``; SQL NULL where the path leads nowhere.

    A JSON null that is present comes back as a VARIANT null, so it can be told
    from a missing value. The empty path gives the whole value.
    """
    if isinstance(path, Column):
        found = _walk_col(value, segments_col(F.coalesce(path, F.lit(""))))
        return found if to == "variant" else F.try_variant_get(found, "$", to)
    return _walk(value, segments(path), to)


def path_error(value: Column, path: str | None) -> Column:
    """Why ``path`` cannot be followed, or NULL where it can."""
    parts = segments(path)
    reached = [_walk(value, parts[:i], "variant") for i in range(len(parts) + 1)]
    found = F.when(reached[0].isNull(), NO_SOURCE)
    for part, held, after in zip(parts, reached, reached[1:]):
        found = found.when(after.isNull(), _blocked(held, F.lit(part)))
    return F.when(reached[-1].isNull(), found)


def follow(value: Column, path: Column) -> Column:
    """Struct of ``value`` and ``error`` at a column of paths; exactly one of them is NULL."""
    start = F.struct(value.alias("value"), F.when(value.isNull(), NO_SOURCE).alias("error"))

    def on(held: Column, part: Column) -> Column:
        after = _step(held["value"], part)
        error = F.coalesce(held["error"], F.when(after.isNull(), _blocked(held["value"], part)))
        return F.struct(after.alias("value"), error.alias("error"))

    return F.aggregate(segments_col(F.coalesce(path, F.lit(""))), start, on)


def _blocked(held: Column, part: Column) -> Column:
    kind = F.schema_of_variant(held)
    numeric = part.rlike("^[0-9]+$")
    return (
        F.when(F.is_variant_null(held), NULL_IN_PATH)
        .when(kind.startswith("OBJECT"), KEY_MISSING)
        .when(kind.startswith("ARRAY"), F.when(numeric, INDEX_OUT_OF_RANGE).otherwise(INDEX_NOT_NUMERIC))
        .otherwise(UNSUPPORTED_TYPE)
    )


def text_of(value: Column) -> Column:
    """Text of a JSON value as a template prints it: ``None``, ``True``, bare strings.

    Objects and arrays print as JSON.
    """
    text = value.cast("string")
    return (
        F.when(F.is_variant_null(value), "None")
        .when(text.isin("true", "false") & (F.schema_of_variant(value) == "BOOLEAN"), F.initcap(text))
        .otherwise(text)
    )


