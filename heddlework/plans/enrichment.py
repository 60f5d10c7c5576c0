"""Queries on expressions, user functions, requests, responses and prompts."""

from __future__ import annotations

import asyncio
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddlework.functions.expressions import with_expression
from heddlework.functions.concurrent import apply_async_provider
from heddlework.functions.registry import FunctionRegistry, apply_provider
from heddlework.operators import prompts as L
from heddlework.operators import requests as N
from heddlework.plans.catalog import query, table


@query(
    "expression_column",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) * 3 AS tripled,
           len(l_returnflag || l_linestatus) AS n_flags, CAST(greatest(l_quantity, 10) AS BIGINT) AS at_least_ten
    FROM lineitem
    """,
)
def expression_column(spark, folder):
    rows = table(spark, folder, "lineitem", spread=True)
    rows = with_expression(rows, "tripled", "ignored", code="cast(l_quantity as bigint) * 3")
    rows = with_expression(rows, "n_flags", "cast(length(concat(l_returnflag, l_linestatus)) as bigint)")
    rows = with_expression(rows, "at_least_ten", "cast(array_max(array(l_quantity, 10D)) as bigint)")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "tripled", "n_flags", "at_least_ten")


def _discounted(l_extendedprice, l_discount):
    return (l_extendedprice * 100).round().astype("int64") * (100 - (l_discount * 100).round().astype("int64"))


def _whole_row(rows: pd.DataFrame):
    return rows["l_linenumber"].astype("int64") + rows["l_suppkey"]


def _with_inputs(inputs: pd.DataFrame):
    return inputs["l_partkey"] * 2


def _with_context(inputs: pd.DataFrame, context: pd.DataFrame):
    return context["run_id"] + "/" + inputs["l_returnflag"]


def _bare():
    return 7


@query(
    "bound_functions",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS discounted,
           l_linenumber + l_suppkey AS row_sum, l_partkey * 2 AS doubled,
           'run_' || l_orderkey || '/' || l_returnflag AS tagged, CAST(7 AS BIGINT) AS seven
    FROM lineitem
    """,
)
def bound_functions(spark, folder):
    """One function per way of binding: by name, whole row, inputs, inputs and context, bare."""
    rows = table(spark, folder, "lineitem", spread=True).withColumn("run_id", F.concat(F.lit("run_"), F.col("l_orderkey").cast("string")))
    known = FunctionRegistry(spark)
    made = {
        "discounted": (_discounted, "long", ["l_extendedprice", "l_discount", "l_tax"]),
        "row_sum": (_whole_row, "long", ["l_linenumber", "l_suppkey"]),
        "doubled": (_with_inputs, "long", ["l_partkey", "l_tax"]),
        "tagged": (_with_context, "string", ["run_id", "l_returnflag"]),
        "seven": (_bare, "long", ["l_orderkey"]),
    }
    columns = []
    for name, (fn, returns, inputs) in made.items():
        known.register(name, fn, returns)
        columns.append(known.column(name, rows.select(*inputs)).alias(name))
        known.unregister(name)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *columns)


def _score(rows: pd.DataFrame) -> pd.DataFrame:
    if (rows["p_size"] == 13).any():
        raise ValueError("no thirteen")
    return pd.DataFrame({"score": rows["p_size"].astype("int64") * 10})


@query(
    "provider_rows",
    """
    SELECT p_partkey, p_size, CASE WHEN p_size <> 13 THEN CAST(p_size AS DOUBLE) * 10 END AS score,
           CASE WHEN p_size = 13 THEN 'no thirteen' END AS error FROM part
    """,
)
def provider_rows(spark, folder):
    rows = table(spark, folder, "part", spread=True).select("p_partkey", "p_size")
    return apply_provider(rows, _score, T.StructType([T.StructField("score", T.DoubleType())]))


async def _score_later(row):
    await asyncio.sleep(0)
    if row["p_size"] == 13:
        raise ValueError("no thirteen")
    return {"score": row["p_size"] * 10.0}


@query(
    "provider_async",
    """
    SELECT p_partkey, p_size, CASE WHEN p_size <> 13 THEN CAST(p_size AS DOUBLE) * 10 END AS score,
           CASE WHEN p_size = 13 THEN 'no thirteen' END AS error FROM part
    """,
)
def provider_async(spark, folder):
    rows = table(spark, folder, "part", spread=True).select("p_partkey", "p_size")
    return apply_async_provider(rows, _score_later, T.StructType([T.StructField("score", T.DoubleType())]))


# --- requests and responses --------------------------------------------------------


@query(
    "parse_actions",
    r"""
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'DELETE' ELSE 'GET' END AS method,
           CASE page_id % 4 WHEN 3 THEN 'fetch ' || url ELSE url END AS url FROM pages
    """,
)
def parse_actions(spark, folder):
    kind = F.col("page_id") % 4
    action = (
        F.when(kind == 0, F.concat(F.lit("post  "), "url")).when(kind == 1, F.concat(F.lit(" DELETE\t"), "url", F.lit(" ")))
        .when(kind == 2, F.concat(F.lit("\n"), "url")).otherwise(F.concat(F.lit("fetch "), "url"))
    )
    return table(spark, folder, "pages", spread=True).select("page_id", N.parse_action(action).alias("a")).select("page_id", "a.*")


@query(
    "build_requests",
    """
    WITH p AS (SELECT page_id, url, page_id % 6 AS c FROM pages)
    SELECT page_id,
           CASE c WHEN 0 THEN 'POST' WHEN 1 THEN 'GET' WHEN 2 THEN 'PUT' WHEN 3 THEN 'PATCH' WHEN 4 THEN 'DELETE' ELSE 'GET' END AS method,
           CASE c WHEN 2 THEN 'http://other/' || page_id ELSE url END AS url,
           CASE c WHEN 3 THEN '{"h":"1"}' ELSE '{}' END AS headers,
           CASE c WHEN 1 THEN '{"id":' || page_id || ',"q":"x"}' WHEN 5 THEN '{"page":2}' END AS params,
           CASE c WHEN 0 THEN '{"a":{"z":1},"id":' || page_id || '}' WHEN 2 THEN '[1,2]' END AS json_body,
           CASE c WHEN 3 THEN '"raw"' END AS data_body,
           CASE c WHEN 0 THEN 12.5 ELSE 300.0 END::DOUBLE AS timeout
    FROM p
    """,
)
def build_requests(spark, folder):
    key = F.col("page_id").cast("string")
    kind = F.col("page_id") % 6

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    inputs = (
        F.when(kind == 0, text('{"method":"post","id":', key, ',"a":{"z":1},"timeout":12.5}'))
        .when(kind == 1, text('{"q":"x","id":', key, ',"headers":{},"params":null}'))
        .when(kind == 2, text('{"json":[1,2],"data":"no","other":1,"url":"http://other/', key, '"}'))
        .when(kind == 3, text('{"data":"raw","left":1,"headers":{"h":"1"}}'))
        .when(kind == 4, text('{"left":1}'))
        .otherwise(text('{"params":{"page":2},"left":1}'))
    )
    verb = F.when(kind == 2, "PUT ").when(kind == 3, "PATCH ").when(kind == 4, "DELETE ").otherwise("GET ")
    rows = table(spark, folder, "pages", spread=True).select(
        "page_id", F.concat(verb, "url").alias("action"), inputs.alias("inputs"), F.lit(300).alias("timeout_seconds")
    )
    return N.build_requests(rows, "action", "inputs").drop("action", "inputs", "timeout_seconds")


_RESPONSES_SQL = """
WITH e AS (SELECT event_id, props, props->>'$.k' AS k, event_type, 'http://s/' || event_id AS url,
           CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 302 ELSE 200 END AS status,
           CASE event_type WHEN 'click' THEN 'plain ' || (props->>'$.k') WHEN 'view' THEN '{broken' ELSE props END AS body FROM events)
"""


def _responses(spark, folder):
    e = table(spark, folder, "events", spread=True)
    kind = F.col("event_type")
    return e.select(
        "event_id",
        F.concat(F.lit("http://s/"), F.col("event_id").cast("string")).alias("url"),
        F.when(kind == "error", 503).when(kind == "signup", 302).otherwise(200).alias("status"),
        F.when(kind == "purchase", "application/json; charset=utf-8").otherwise("text/plain").alias("content_type"),
        F.when(kind == "click", F.concat(F.lit("plain "), F.get_json_object("props", "$.k")))
        .when(kind == "view", "{broken").otherwise(F.col("props")).alias("body"),
    )


@query(
    "shape_responses",
    _RESPONSES_SQL + """
    SELECT event_id, CASE WHEN event_type IN ('click', 'view')
           THEN '{"headers":{"h":"v"},"status_code":200,"text":"' || body || '"}' ELSE '{"k":' || k || '}' END AS output FROM e
    """,
)
def shape_responses(spark, folder):
    headers = F.create_map(F.lit("h"), F.lit("v"))
    shaped = N.shape_response(F.col("status"), F.col("content_type"), F.col("body"), headers)
    return _responses(spark, folder).select("event_id", F.to_json(shaped).alias("output"))


@query(
    "split_responses",
    _RESPONSES_SQL + """
    SELECT event_id, status = 200 AS good, CASE WHEN status <> 200 THEN
      'HTTP request to ''' || url || ''' failed with status ' || status || ': ' || body END AS error FROM e
    """,
)
def split_responses(spark, folder):
    good, bad = N.split_responses(_responses(spark, folder), "url", "status", "body")
    left = good.select("event_id", F.lit(True).alias("good"), F.lit(None).cast("string").alias("error"))
    return left.unionByName(bad.select("event_id", F.lit(False).alias("good"), "error"))


# --- prompts and answers -------------------------------------------------------------


@query(
    "assemble_prompts",
    """
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'gpt-4o' ELSE 'm-' || role END AS model,
           CASE WHEN role = 'user' THEN 'You are an expert AI orchestrator.' ELSE 'Be ' || role END AS system_text,
           text AS user_text, 2 AS n_messages,
           CASE WHEN role = 'user' THEN 'You are an expert AI orchestrator.' ELSE 'Be ' || role END || chr(10) || chr(10) || text ||
             CASE WHEN turn = 0 THEN chr(10) || chr(10) || 'Format your response strictly as valid JSON matching schema: {"type":"object"}'
                  WHEN turn = 1 THEN chr(10) || chr(10) || 'Format your response strictly as valid JSON matching schema: true' ELSE '' END AS full_prompt,
           CASE WHEN turn = 2 THEN 0.1 ELSE 0.7 END::DOUBLE AS temperature,
           CASE WHEN turn = 0 THEN '{"type":"object"}' WHEN turn = 1 THEN '{"type": "json_object"}' END AS response_format
    FROM conversations
    """,
)
def assemble_prompts(spark, folder):
    other = F.when(F.col("role") != "user", F.col("role"))
    turn = F.col("turn")
    made = L.assemble_prompt(
        F.col("text"),
        system=F.concat(F.lit("Be "), other),
        model=F.concat(F.lit("m-"), other),
        temperature=F.when(turn == 2, 0.1),
        output_schema=F.when(turn == 0, '{"type":"object"}').when(turn == 1, "true"),
    )
    rows = table(spark, folder, "conversations", spread=True).select("conv_id", "turn", made.alias("p"))
    return rows.select(
        "conv_id", "turn", "p.model", F.col("p.messages")[0]["content"].alias("system_text"),
        F.col("p.messages")[1]["content"].alias("user_text"), F.size("p.messages").alias("n_messages"),
        "p.full_prompt", "p.temperature", "p.response_format",
    )


_ANSWER_SQL = """
WITH e AS (SELECT event_id, event_type, props, props->>'$.k' AS k,
  CASE event_type WHEN 'click' THEN props
    WHEN 'view' THEN 'Sure:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'and ``` [1] ```'
    WHEN 'purchase' THEN 'List ``` [' || (props->>'$.k') || ', {"a": 1}] ``` done'
    WHEN 'signup' THEN 'broken ```json {"k": } ``` end' ELSE 'no json ' || event_id END AS text FROM events),
a AS (SELECT event_id, text, CASE event_type WHEN 'click' THEN '{"k":' || k || '}' WHEN 'view' THEN '{"k":' || k || '}'
      WHEN 'purchase' THEN '[' || k || ',{"a":1}]' END AS parsed FROM e)
"""


def _answers(spark, folder):
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    text = (
        F.when(kind == "click", F.col("props"))
        .when(kind == "view", F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nand ``` [1] ```")))
        .when(kind == "purchase", F.concat(F.lit("List ``` ["), k, F.lit(', {"a": 1}] ``` done')))
        .when(kind == "signup", 'broken ```json {"k": } ``` end')
        .otherwise(F.concat(F.lit("no json "), F.col("event_id").cast("string")))
    )
    return table(spark, folder, "events", spread=True).select("event_id", "event_type", text.alias("text"))


@query("json_from_text", _ANSWER_SQL + "SELECT event_id, parsed FROM a")
def json_from_text(spark, folder):
    return _answers(spark, folder).select("event_id", F.to_json(L.json_from_text(F.col("text"))).alias("parsed"))


@query(
    "wrap_answers",
    _ANSWER_SQL + """SELECT event_id, coalesce(parsed, '{"content":' || to_json(text) || ',"model":"m"}') AS answer,
    coalesce(parsed, '{"content":' || to_json(text) || ',"harness":"tool","status":"success"}') AS tool_answer,
    '{"content":' || to_json(text) || ',"model":"m"}' AS plain_answer FROM a""",
)
def wrap_answers(spark, folder):
    text = F.col("text")
    return _answers(spark, folder).select(
        "event_id",
        F.to_json(L.wrap_answer(text, F.lit("m"))).alias("answer"),
        F.to_json(L.wrap_tool_answer(text, F.lit("tool"))).alias("tool_answer"),
        F.to_json(L.wrap_answer(text, F.lit("m"), F.lit(False))).alias("plain_answer"),
    )


@query(
    "first_answer",
    """
    SELECT event_id, CASE event_type WHEN 'click' THEN 'given' WHEN 'view' THEN 'given' WHEN 'purchase' THEN 'provider' ELSE 'fallback' END AS source,
           CASE event_type WHEN 'click' THEN '{"k":' || (props->>'$.k') || '}' WHEN 'view' THEN 'null' WHEN 'purchase' THEN '1' ELSE '"none"' END AS answer,
           CASE WHEN event_type IN ('signup', 'error') THEN 'nobody answered' END AS warning
    FROM events
    """,
)
def first_answer(spark, folder):
    kind = F.col("event_type")
    given = F.try_parse_json(F.when(kind == "click", F.col("props")).when(kind == "view", "null"))
    provider = F.try_parse_json(F.when(kind.isin("click", "purchase"), "1"))
    fallback = F.parse_json(F.lit('"none"'))
    best = L.first_answer({"given": given, "provider": provider}, fallback, F.lit("nobody answered"))
    rows = table(spark, folder, "events", spread=True).select("event_id", best.alias("a"))
    return rows.select("event_id", "a.source", F.to_json("a.answer").alias("answer"), "a.warning")
