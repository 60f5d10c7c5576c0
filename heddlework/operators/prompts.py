"""Prompts and model answers as columns; the model call is the caller's business."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DEFAULT_SYSTEM = "You are an expert AI orchestrator."
DEFAULT_MODEL = "gpt-4o"
DEFAULT_TEMPERATURE = 0.7
SCHEMA_SUFFIX = "\n\nFormat your response strictly as valid JSON matching schema: "
FENCED_JSON = r"(?sU)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```"


def assemble_prompt(
    prompt: Column,
    system: Column | None = None,
    model: Column | None = None,
    temperature: Column | None = None,
    output_schema: Column | None = None,
) -> Column:
    """Messages, one full text and settings of a model call, defaults filled in.

    ``output_schema`` is JSON text; an object is passed on as the response
    format, anything else asks for a JSON object.
    """
    nothing = F.lit(None).cast("string")
    system = F.coalesce(nothing if system is None else system, F.lit(DEFAULT_SYSTEM))
    prompt = F.coalesce(prompt, F.lit(""))
    schema = nothing if output_schema is None else output_schema
    lead = F.when(system != "", F.concat(system, F.lit("\n\n"))).otherwise("")
    suffix = F.when(schema.isNotNull(), F.concat(F.lit(SCHEMA_SUFFIX), schema)).otherwise("")
    is_object = F.schema_of_variant(F.try_parse_json(schema)).startswith("OBJECT")
    wanted = F.when(is_object, schema).when(schema.isNotNull(), json.dumps({"type": "json_object"}))

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    chosen = F.lit(None).cast("double") if temperature is None else temperature.cast("double")
    return F.struct(
        F.coalesce(F.when(model != "", model) if model is not None else nothing, F.lit(DEFAULT_MODEL)).alias("model"),
        F.array(message("system", system), message("user", prompt)).alias("messages"),
        F.concat(lead, prompt, suffix).alias("full_prompt"),
        F.coalesce(chosen, F.lit(DEFAULT_TEMPERATURE)).alias("temperature"),
        wanted.alias("response_format"),
    )


def json_from_text(text: Column) -> Column:
    """The whole text as JSON, else its first fenced object or array, else NULL; VARIANT."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, FENCED_JSON, 1)))


def wrap_answer(text: Column, model: Column, wants_json: Column | None = None) -> Column:
    """JSON of an answer where it was asked for and is there, else content and model."""
    parsed = json_from_text(text)
    if wants_json is not None:
        parsed = F.when(wants_json, parsed)
    return F.coalesce(parsed, F.to_variant_object(F.struct(text.alias("content"), model.alias("model"))))


def wrap_tool_answer(text: Column, tool: Column) -> Column:
    """The same for a command-line tool's output."""
    plain = F.struct(text.alias("content"), tool.alias("harness"), F.lit("success").alias("status"))
    return F.coalesce(json_from_text(text), F.to_variant_object(plain))


def first_answer(candidates: dict[str, Column], fallback: Column, warning: Column) -> Column:
    """The first candidate present in a row, else the fallback with a warning.

    A struct of ``answer``, ``source`` and ``warning``. Candidates are VARIANT;
    a JSON null is an answer, SQL NULL is none.
    """
    answer = F.coalesce(*candidates.values(), fallback)
    source = F.lit("fallback")
    for name, column in reversed(candidates.items()):
        source = F.when(column.isNotNull(), name).otherwise(source)
    return F.struct(
        answer.alias("answer"),
        source.alias("source"),
        F.when(source == "fallback", warning).alias("warning"),
    )
