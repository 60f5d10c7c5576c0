"""``${source.kind.path}`` references inside texts and documents."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddlework.functions.binding import bind
from heddlework.functions.paths import extract, follow, path_error, text_of

# Fixed value: source, kind and optional path of a reference.
REFERENCE = r"\$\{([a-zA-Z0-9_]+)\.(input|output)(?:\.([a-zA-Z0-9_\[\].\-]+))?\}"
_REFERENCE = re.compile(REFERENCE)

WORKFLOW = "workflow"
WORKFLOW_OUTPUT = "workflow_output"
STEP_INPUT = "step_input"
STEP_NOT_COMPLETE = "step_not_complete"
STEP_UNKNOWN = "step_unknown"
NOT_JSON = "not_json"


@dataclass(frozen=True)
class Scope:
    """What references may point at, one value per row.

    ``inputs`` is a VARIANT column. ``outputs`` is either one VARIANT column per
    step id or a single ``map<string, variant>`` column; a step without output
    in a row holds SQL NULL there. ``known`` lists declared step ids.
    """

    inputs: Column
    outputs: Mapping[str, Column] | Column = field(default_factory=dict)
    known: frozenset[str] = frozenset()

    def output(self, step_id: str) -> Column | None:
        if isinstance(self.outputs, Column):
            return F.try_element_at(self.outputs, F.lit(step_id))
        return self.outputs.get(step_id)

    def resolve(self, source: str, kind: str, path: str | None) -> tuple[Column, Column]:
        """Value and error code of one reference; exactly one of them is NULL."""
        nothing = F.lit(None).cast("variant")
        if source == WORKFLOW:
            if kind != "input":
                return nothing, F.lit(WORKFLOW_OUTPUT)
            return extract(self.inputs, path), path_error(self.inputs, path)
        held = self.output(source)
        absent = F.lit(STEP_NOT_COMPLETE if source in self.known else STEP_UNKNOWN)
        if held is None:
            return nothing, absent
        if kind != "output":
            return nothing, F.when(held.isNull(), absent).otherwise(STEP_INPUT)
        return extract(held, path), F.when(held.isNull(), absent).otherwise(path_error(held, path))


def _parts(text: str) -> list[str | tuple[str, str, str | None]]:
    """Literal pieces and references of a constant template, in order."""
    pieces, at = [], 0
    for match in _REFERENCE.finditer(text):
        pieces += [text[at : match.start()], match.groups()]
        at = match.end()
    return [piece for piece in [*pieces, text[at:]] if piece != ""]


def _single(text: str):
    match = _REFERENCE.fullmatch(text.strip())
    return match.groups() if match else None


def _strict(value: Column, error: Column, strict: bool, shown: str) -> Column:
    if not strict:
        return value
    complaint = F.raise_error(F.concat(F.lit(f"cannot resolve {shown}: "), error))
    return F.when(error.isNotNull(), complaint.cast("variant")).otherwise(value)


def render(template: str, scope: Scope, strict: bool = False) -> Column:
    """Fill a constant template.

    A text that is one reference and nothing else keeps the value's type and
    comes back as VARIANT. Anything else is a STRING. What cannot be resolved
    gives NULL, or fails the job when ``strict`` is set.
    """
    single = _single(template)
    if single:
        return _strict(*scope.resolve(*single), strict, template.strip())
    pieces = []
    for part in _parts(template):
        if isinstance(part, str):
            pieces.append(F.lit(part))
        else:
            pieces.append(text_of(_strict(*scope.resolve(*part), strict, template)))
    return F.concat(F.lit(""), *pieces)


def render_document(document, scope: Scope, strict: bool = False) -> Column:
    """Fill every text value of a constant document; keys stay as they are."""
    if not _REFERENCE.search(json.dumps(document)):
        return F.parse_json(F.lit(json.dumps(document)))
    if isinstance(document, str):
        filled = render(document, scope, strict)
        return filled if _single(document) else filled.cast("variant")
    if isinstance(document, Mapping):
        filled = [render_document(value, scope, strict).alias(key) for key, value in document.items()]
        return F.to_variant_object(F.struct(*filled))
    return F.to_variant_object(F.array(*[render_document(item, scope, strict) for item in document]))


def template_errors(document, scope: Scope) -> Column:
    """Error codes of all references in a constant text or document, in order."""
    found = [ref for text in _texts(document) for ref in _REFERENCE.findall(text)]
    codes = [scope.resolve(source, kind, path or None)[1] for source, kind, path in found]
    return F.array_compact(F.array(*codes)) if codes else F.array().cast("array<string>")


def _texts(document) -> list[str]:
    if isinstance(document, str):
        return [document]
    inner = document.values() if isinstance(document, Mapping) else document
    return [t for item in inner for t in _texts(item)] if isinstance(document, (Mapping, list)) else []


def split_resolved(df: DataFrame, document, scope: Scope, out: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose document can be filled, and rows set aside with error codes."""
    checked = df.withColumn("error_codes", template_errors(document, scope))
    good = checked.filter(F.size("error_codes") == 0).drop("error_codes")
    return good.withColumn(out, render_document(document, scope)), checked.filter(F.size("error_codes") > 0)


def references(text: Column) -> Column:
    """All references of a text column as ``array<struct<source, kind, path>>``."""
    groups = [F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(i)) for i in (1, 2, 3)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("source", "kind", "path"))])
    return F.transform(
        zipped,
        lambda r: F.struct(
            r["source"].alias("source"),
            r["kind"].alias("kind"),
            F.when(r["path"] != "", r["path"]).alias("path"),
        ),
    )


def explode_references(df: DataFrame, text: str) -> DataFrame:
    """One row per reference, with its position in the text."""
    exploded = df.select("*", F.posexplode(references(F.col(text))).alias("ref_pos", "_ref"))
    return exploded.select(*df.columns, "ref_pos", "_ref.source", "_ref.kind", "_ref.path")


def render_column(template: Column, inputs: Column, outputs: Column) -> Column:
    """Fill a column of templates, each row with its own text.

    ``outputs`` is a ``map<string, variant>``. All work happens in the row, so
    there is no explode and no shuffle. NULL where a reference cannot be resolved.
    """

    def fill(ref: Column) -> Column:
        ours = ref["source"] == WORKFLOW
        held = F.when(ours & (ref["kind"] == "input"), inputs).when(
            ~ours & (ref["kind"] == "output"), F.try_element_at(outputs, ref["source"])
        )
        return text_of(extract(held, ref["path"]))

    filled = F.transform(references(template), fill)
    literal = F.split(template, REFERENCE, -1)
    tail = F.slice(literal, F.lit(2), F.greatest(F.size(literal) - 1, F.lit(0)))
    joined = F.array_join(F.zip_with(filled, tail, lambda a, b: F.concat(a, b)), "")
    return F.when(~F.exists(filled, lambda x: x.isNull()), F.concat(F.get(literal, F.lit(0)), joined))


_BLANK = r"(?:\s|\\[nrtf])*"
_REST_OF_KEY = r'[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:'
#: In JSON text: a text value that is one reference (groups 1-3), or a reference inside one (4-6).
_IN_JSON = rf'(?<!\\)"{_BLANK}{REFERENCE}{_BLANK}"(?!\s*:)|{REFERENCE}(?!{_REST_OF_KEY})'


def _json_references(document: Column) -> Column:
    groups = [F.regexp_extract_all(document, F.lit(_IN_JSON), F.lit(i)) for i in range(1, 7)]
    zipped = F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups, 1)])
    return F.transform(
        zipped,
        lambda r: F.struct(
            (r["g1"] != "").alias("whole"),
            F.concat(r["g1"], r["g4"]).alias("source"),
            F.concat(r["g2"], r["g5"]).alias("kind"),
            F.concat(r["g3"], r["g6"]).alias("path"),
        ),
    )


def render_documents(document: Column, inputs: Column, outputs: Column, known: frozenset[str] = frozenset()) -> Column:
    """Fill a column of JSON documents, each row with its own text.

    A struct of ``resolved`` (JSON text in the order of the document) and ``error_codes``
    (one for each reference that cannot be resolved, in order; ``not_json`` for a text
    that does not parse). ``resolved`` is NULL where there is an error or no document.
    A text value that is one reference takes the value's type; keys stay as they are.
    ``outputs`` is a ``map<string, variant>``. All work happens in the row.
    """

    row = F.struct(document.alias("document"), inputs.alias("inputs"), outputs.alias("outputs"))
    return bind(row, lambda r: _filled(r["document"], r["inputs"], r["outputs"], known))


def _filled(document: Column, inputs: Column, outputs: Column, known: frozenset[str]) -> Column:
    def value_of(ref: Column) -> Column:
        ours, kind = ref["source"] == WORKFLOW, ref["kind"]
        held = F.when(ours, inputs).otherwise(F.try_element_at(outputs, ref["source"]))
        declared = F.array_contains(F.array(*map(F.lit, sorted(known))), ref["source"]) if known else F.lit(False)
        early = F.when(ours & (kind != "input"), WORKFLOW_OUTPUT).when(
            ~ours & held.isNull(), F.when(declared, STEP_NOT_COMPLETE).otherwise(STEP_UNKNOWN)
        ).when(~ours & (kind != "output"), STEP_INPUT)
        return F.struct(follow(held, ref["path"]).alias("at"), early.alias("early"), ref["whole"].alias("whole"))

    def shown(got: Column) -> Column:
        value = got["at"]["value"]
        inside = bind(F.to_json(text_of(value).cast("variant")), lambda t: F.substr(t, F.lit(2), F.length(t) - 2))
        text = F.when(got["whole"], F.to_json(value)).otherwise(inside)
        return F.struct(text.alias("text"), F.coalesce(got["early"], got["at"]["error"]).alias("code"))

    filled = F.transform(_json_references(document), lambda ref: bind(value_of(ref), shown))
    literal = F.split(document, _IN_JSON, -1)

    def result(parts: Column) -> Column:
        tail = F.slice(literal, F.lit(2), F.greatest(F.size(literal) - 1, F.lit(0)))
        joined = F.array_join(F.zip_with(parts, tail, lambda a, b: F.concat(a["text"], b)), "")
        codes = F.array_compact(F.transform(parts, lambda p: p["code"]))
        codes = F.when(F.try_parse_json(document).isNull(), F.array(F.lit(NOT_JSON))).otherwise(codes)
        codes = F.when(document.isNull(), F.array().cast("array<string>")).otherwise(codes)
        whole = F.concat(F.get(literal, F.lit(0)), joined)
        return bind(codes, lambda c: F.struct(F.when(F.size(c) == 0, whole).alias("resolved"), c.alias("error_codes")))

    return bind(filled, result)
