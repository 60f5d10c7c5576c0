"""Select, filter and merge over tables, maps, arrays and JSON values."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddlework.functions.binding import bind


# --- select -----------------------------------------------------------------


def select_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """The listed columns that exist, in list order, each once."""
    return df.select(*[name for name in dict.fromkeys(fields) if name in df.columns])


def select_keys(source: Column, fields: list[str]) -> Column:
    """The listed keys a map holds, in list order; a present null is kept."""
    names = F.array(*[F.lit(name) for name in dict.fromkeys(fields)])
    held = F.filter(names, lambda name: F.map_contains_key(source, name))
    return F.map_from_entries(F.transform(held, lambda name: F.struct(name, source[name])))


def select_json(source: Column, fields: list[str]) -> Column:
    """The same for a VARIANT object, as JSON text; any other value is unchanged."""
    pieces = []
    for name in dict.fromkeys(fields):
        value = F.to_json(_member(source, name))
        pieces.append(F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), value))
    kept = F.array_join(F.array_compact(F.array(*pieces)), ",") if pieces else F.lit("")
    picked = F.concat(F.lit("{"), kept, F.lit("}"))
    return F.when(_is_object(source), picked).otherwise(F.to_json(source))


# --- filter -----------------------------------------------------------------


def filter_rows(df: DataFrame, key: str, value) -> DataFrame:
    """Rows whose ``key`` equals ``value``; null equals null.

    Numbers and booleans compare by value, and a text never equals either: the
    types decide, so no value is cast to a text or from one. No key leaves the
    table as it is. A column the table lacks reads as null.
    """
    if not key:
        return df
    wanted = value if isinstance(value, Column) else F.lit(value)
    if key not in df.columns:
        return df.filter(wanted.isNull())
    given = F.col(f"`{key}`")
    kinds = [f.dataType for f in df.select(given, wanted).schema.fields]
    booleans = [isinstance(k, T.BooleanType) for k in kinds]
    numbers = [isinstance(k, T.NumericType) or b for k, b in zip(kinds, booleans, strict=True)]
    texts = [isinstance(k, (T.StringType, T.VarcharType, T.CharType)) for k in kinds]
    if any(isinstance(k, T.NullType) for k in kinds):
        return df.filter(given.isNull() & wanted.isNull())
    if numbers[0] != numbers[1] or texts[0] != texts[1]:
        return df.filter(given.isNull() & wanted.isNull())
    if booleans[0] != booleans[1]:
        given, wanted = (c.cast("int") if b else c for c, b in zip((given, wanted), booleans, strict=True))
    return df.filter(given.eqNullSafe(wanted))


def filter_structs(items: Column, key: str, value) -> Column:
    """The same over an array of structs; null items drop.

    Both sides are compared as JSON values, so a column of any type may meet a
    value of any other without a cast that fails.
    """
    if not key:
        return items
    value = value if isinstance(value, Column) else F.lit(value)

    def keep(given: Column) -> Column:
        seen = F.transform(
            given["items"], lambda item: F.struct(item.alias("item"), _printed(item[key]).alias("text"))
        )
        equal = F.filter(seen, lambda s: s["item"].isNotNull() & _same_value(s["text"], given["wanted"]))
        return F.transform(equal, lambda s: s["item"])

    return bind(F.struct(items.alias("items"), bind(_printed(value), _sought).alias("wanted")), keep)


def _printed(value: Column) -> Column:
    """A typed value as JSON text; ``null`` for a null."""
    text = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), "null").otherwise(F.substr(text, F.lit(6), F.length(text) - 6))


def filter_items(items: Column, key: str, value: Column) -> Column:
    """The same over a VARIANT array of anything.

    Items that are no objects drop, a missing key reads as null, numbers and
    booleans compare by value and a text never equals a number. What is not an
    array comes back unchanged.
    """
    if not key:
        return items
    listed = F.try_variant_get(items, "$", "array<variant>")

    def keep(given: Column) -> Column:
        seen = F.transform(
            given["listed"], lambda x: F.struct(x.alias("item"), F.to_json(_member(x, key)).alias("text"))
        )
        equal = F.filter(
            seen,
            lambda s: F.when(s["text"].isNotNull(), _same_value(s["text"], given["wanted"])).otherwise(
                (given["wanted"]["text"] == "null") & _is_object(s["item"])
            ),
        )
        return F.transform(equal, lambda s: s["item"])

    wanted = bind(F.coalesce(F.to_json(value), F.lit("null")), _sought)
    kept = bind(F.struct(listed.alias("listed"), wanted.alias("wanted")), keep)
    return F.coalesce(F.to_variant_object(kept), items)


def comparable(text: Column) -> Column:
    """A text that is equal for JSON texts whose values count as equal.

    Booleans are 1 and 0. A number becomes its significant digits and a power of
    ten, exactly and at any size. A text keeps its quotes, so it never meets a number.
    """
    whole = F.regexp_extract(text, r"^-?([0-9]+)", 1)
    part = F.regexp_extract(text, r"\.([0-9]+)", 1)
    power = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    sign = F.when(text.startswith("-"), "-").otherwise("")

    def written(number: Column) -> Column:
        short = F.rtrim(number["digits"], F.lit("0"))
        zeros = F.length(number["digits"]) - F.length(short)
        exponent = power - F.length(number["part"]) + zeros
        return F.when(short == "", "0").otherwise(F.concat(sign, short, F.lit("e"), exponent.cast("string")))

    number = bind(part, lambda p: F.struct(F.ltrim(F.concat(whole, p), F.lit("0")).alias("digits"), p.alias("part")))
    return (
        F.when(text.startswith('"'), text)
        .when(text == "true", "1e0")
        .when(text == "false", "0")
        .when(text.rlike("^-?[1-9](?:[0-9]*[1-9])?$"), F.concat(text, F.lit("e0")))
        .when(~text.rlike("^-?[0-9]"), text)
        .otherwise(bind(number, written))
    )


#: JSON texts that no other text of this form equals: texts, arrays, objects, null and whole numbers.
_SETTLED = r'^(?:["\[{n]|-?[1-9][0-9]*$|0$)'


def _sought(text: Column) -> Column:
    """What ``_same_value`` needs of the value that all items are compared with."""
    return F.struct(text.alias("text"), text.rlike(_SETTLED).alias("settled"), comparable(text).alias("comparable"))


def _same_value(text: Column, sought: Column) -> Column:
    """Equal by ``comparable``, which is worked out only where the texts leave it open."""
    return (
        F.when(text == sought["text"], True)
        .when(sought["settled"] & text.rlike(_SETTLED), False)
        .otherwise(bind(text, comparable) == sought["comparable"])
    )


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _member(value: Column, name: str) -> Column:
    if "'" in name and '"' in name:
        return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(name))
    quote = "'" if '"' in name else '"'
    return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")


# --- merge ------------------------------------------------------------------


def _later_wins(earlier: Column, later: Column) -> Column:
    kept = F.map_filter(earlier, lambda key, _: ~F.map_contains_key(later, key))
    return F.map_concat(kept, later)


def merge_maps(*maps: Column) -> Column:
    """One map from several; a later map's value wins for an equal key."""
    return reduce(_later_wins, maps)


def merge_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """One flat table from columns: struct columns are spread, others keep their name.

    A later column wins for an equal name.
    """
    merged: dict[str, Column] = {}
    for name in names:
        kind = df.schema[name].dataType
        if isinstance(kind, T.StructType):
            merged.update({field: F.col(f"`{name}`.`{field}`") for field in kind.fieldNames()})
        else:
            merged[name] = F.col(f"`{name}`")
    return df.select(*[value.alias(name) for name, value in merged.items()])


def merge_document(document: Column) -> Column:
    """Merge the values of a JSON object text, in the order its keys are written.

    Object values are spread one level, other values stay under their own key,
    later ones win. The result is VARIANT; NULL where the text is no JSON object.
    """
    whole = F.try_variant_get(F.try_parse_json(document), "$", "map<string,variant>")
    nothing = F.create_map().cast("map<string,variant>")

    def spread(value: Column, key: Column) -> Column:
        return F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.create_map(key, value))

    def add(held: Column, key: Column) -> Column:
        part = bind(held["whole"][key], lambda value: spread(value, key))
        merged = bind(part, lambda later: _later_wins(held["merged"], later))
        return F.struct(merged.alias("merged"), held["whole"].alias("whole"))

    start = F.struct(nothing.alias("merged"), whole.alias("whole"))
    merged = F.aggregate(F.json_object_keys(document), start, add, lambda held: held["merged"])
    return F.to_variant_object(merged)


def merge_rows(df: DataFrame, group: list[str], position: str, key: str, value: str) -> DataFrame:
    """Merge key/value rows: per group and key, the value with the largest position.

    ``max_by`` combines on the map side, so a large group costs no large shuffle.
    """
    return df.groupBy(*group, key).agg(F.max_by(F.struct(value), F.col(position)).alias("_last")).select(
        *group, key, F.col(f"_last.{value}").alias(value)
    )


# --- passthrough ------------------------------------------------------------


def passthrough(df: DataFrame) -> DataFrame:
    """Any other transform leaves its input as it is."""
    return df
