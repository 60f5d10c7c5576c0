"""Expressions, user functions, requests, responses and prompts."""

import asyncio
import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddlework.functions.concurrent import apply_async_provider
from heddlework.functions.expressions import expression_column
from heddlework.functions.registry import FunctionRegistry, apply_provider
from heddlework.operators import prompts as L
from heddlework.operators import requests as N


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_expression_column(spark):
    df = spark.createDataFrame([(7, [3, 1, 2])], "val int, xs array<int>")
    got = df.select(expression_column("val * 2", code="val * 3").alias("a"), expression_column("array_sort(xs)").alias("b"), expression_column("sqrt(val + 2)").alias("c")).first()
    assert (got.a, got.b, got.c) == (21, [1, 2, 3], 3.0)


def test_registered_name_in_sql(spark):
    known = FunctionRegistry(spark)
    known.register("add_up", lambda a, b: a + b, "long")
    assert spark.sql("select add_up(2L, 3L)").first()[0] == 5 and known.names() == ["add_up"]
    known.unregister("add_up")
    assert known.names() == []
    with pytest.raises(Exception, match="UNRESOLVED_ROUTINE"):
        spark.sql("select add_up(2L, 3L)")


def test_binding_by_signature(spark):
    df = spark.createDataFrame([("r1", 2, 3, "z")], "run_id string, a long, b long, extra string")
    known = FunctionRegistry(spark)

    def both(inputs, context):
        return context["run_id"] + inputs["extra"]

    def positional(rows):
        return rows["a"] * 10 + rows["b"]

    forms = {"named": (lambda b, a: a - b, "long"), "whole": (positional, "long"), "both": (both, "string"), "bare": (lambda: 9, "long"), "inputs": (lambda inputs: inputs["b"], "long")}
    for name, (fn, kind) in forms.items():
        known.register(name, fn, kind)
    got = df.select(*[known.column(n, df).alias(n) for n in forms]).first()
    assert tuple(got) == (-1, 23, "r1z", 9, 3)
    for name in forms:
        known.unregister(name)


def test_provider_keeps_bad_rows(spark):
    def provider(rows: pd.DataFrame) -> pd.DataFrame:
        if (rows["id"] % 40 == 7).any():
            raise ValueError("bad row")
        return pd.DataFrame({"twice": rows["id"].values * 2})

    fields = T.StructType([T.StructField("twice", T.LongType())])
    got = {r.id: r for r in apply_provider(spark.range(100), provider, fields).collect()}
    assert len(got) == 100 and {i for i, r in got.items() if r.error} == {7, 47, 87}
    assert all(r.twice == i * 2 for i, r in got.items() if not r.error) and got[7].twice is None


def test_parse_action(spark):
    texts = [" post  https://a/x ", "GET http://b", "http://c", "run it", "FETCH http://d", "GET ftp://e"]
    got = one(spark, *[N.parse_action(F.lit(t)) for t in texts])
    assert [tuple(g) for g in got] == [("POST", "https://a/x"), ("GET", "http://b"), ("GET", "http://c"), ("GET", "run it"), ("GET", "FETCH http://d"), ("GET", "GET ftp://e")]


def test_build_requests(spark):
    cases = [
        ("POST http://u", {"a": 1, "headers": {"h": "x"}}), ("GET http://u", {"q": 1}), ("GET http://u", {"q": 1, "params": {}}),
        ("GET http://u", {"q": 1, "params": None}), ("PUT http://u", {"json": None, "data": "d", "z": 1}), ("PATCH http://u", {"data": {"f": 1}, "z": 1}),
        ("DELETE http://u", {"z": 1}), ("GET http://u", {"method": "post", "url": "http://v", "timeout": 5}),
    ]
    df = spark.createDataFrame([(i, a, json.dumps(v), 300) for i, (a, v) in enumerate(cases)], "id int, a string, j string, timeout_seconds int")
    got = [tuple(r)[4:] for r in N.build_requests(df, "a", "j").orderBy("id").collect()]
    assert got == [
        ("POST", "http://u", '{"h":"x"}', None, '{"a":1}', None, 300.0),
        ("GET", "http://u", "{}", '{"q":1}', None, None, 300.0),
        ("GET", "http://u", "{}", "{}", None, None, 300.0),
        ("GET", "http://u", "{}", '{"q":1}', None, None, 300.0),
        ("PUT", "http://u", "{}", None, "null", None, 300.0),
        ("PATCH", "http://u", "{}", None, None, '{"f":1}', 300.0),
        ("DELETE", "http://u", "{}", None, None, None, 300.0),
        ("POST", "http://v", "{}", None, None, None, 5.0),
    ]


def test_responses(spark):
    headers = F.create_map(F.lit("a"), F.lit("b"))

    def shaped(kind, text):
        return F.to_json(N.shape_response(F.lit(200), F.lit(kind).cast("string"), F.lit(text), headers))

    got = [json.loads(g) for g in one(spark, shaped("application/json", "5"), shaped("text/html", "5"), shaped(None, "[1]"), shaped(None, "{bad"))]
    plain = {"status_code": 200, "headers": {"a": "b"}}
    assert got == [5, {**plain, "text": "5"}, [1], {**plain, "text": "{bad"}]
    errors = one(spark, *[N.response_error(F.lit("http://u"), F.lit(s), F.lit("body")) for s in (200, 204, 302, 404)])
    assert list(errors) == [None, None, "HTTP request to 'http://u' failed with status 302: body", "HTTP request to 'http://u' failed with status 404: body"]


def test_json_from_text(spark):
    texts = ['{"a": 1}', 'x ```json\n{"a": {"b": 2}}\n``` y ``` [1] ```', "``` [1, 2] ```", "```json {bad} ```", "none", "``` 5 ```", ""]
    got = one(spark, *[F.to_json(L.json_from_text(F.lit(t))) for t in texts])
    assert list(got) == ['{"a":1}', '{"a":{"b":2}}', "[1,2]", None, None, None, None]


def test_prompts(spark):
    plain = one(spark, L.assemble_prompt(F.lit("Do it")))[0]
    assert (plain.model, plain.temperature, plain.response_format) == ("gpt-4o", 0.7, None)
    assert [(m.role, m.content) for m in plain.messages] == [("system", L.DEFAULT_SYSTEM), ("user", "Do it")]
    bare = one(spark, L.assemble_prompt(F.lit("Do"), system=F.lit(""), model=F.lit(""), output_schema=F.lit("[1]")))[0]
    assert bare.full_prompt == "Do" + L.SCHEMA_SUFFIX + "[1]" and bare.model == "gpt-4o" and json.loads(bare.response_format) == {"type": "json_object"}


def test_first_answer(spark):
    nothing, null = F.lit(None).cast("variant"), F.parse_json(F.lit("null"))
    back = F.parse_json(F.lit("1"))
    first, last = one(spark, L.first_answer({"a": nothing, "b": null}, back, F.lit("w")), L.first_answer({"a": nothing}, back, F.lit("w")))
    assert (first.source, first.warning) == ("b", None) and (last.source, last.warning) == ("fallback", "w")


def test_async_provider_overlaps_calls_and_calls_each_row_once(spark, tmp_path):
    folder = str(tmp_path)

    async def provider(row):
        with open(f"{folder}/{row['id']}", "a") as seen:
            seen.write("x")
        if row["id"] == 7:
            await asyncio.sleep(60)
        await asyncio.sleep(0.2)
        if row["id"] % 10 == 3:
            raise ValueError(f"bad {row['id']}")
        return {"answer": "text"} if row["id"] == 5 else {"answer": row["id"] * 2} if row["id"] else {}

    fields = T.StructType([T.StructField("answer", T.LongType())])
    began = time.monotonic()
    rows = apply_async_provider(spark.range(0, 200, 1, 2), provider, fields, concurrency=50, timeout_seconds=2).collect()
    # 200 calls of 0.2 s one by one in two tasks would take 20 s.
    assert time.monotonic() - began < 15
    got = {r.id: (r.answer, r.error) for r in rows}
    assert [r.id for r in rows] == list(range(200)) and got[0] == (None, None) and got[4] == (8, None)
    assert got[13] == (None, "bad 13") and got[7] == (None, "TimeoutError") and got[5][0] is None and got[5][1]
    assert sum(error is not None for _, error in got.values()) == 22
    assert all((tmp_path / str(i)).read_text() == "x" for i in range(200))
    with pytest.raises(ValueError):
        apply_async_provider(spark.range(1), provider, T.StructType([T.StructField("id", T.LongType())]))
    assert apply_async_provider(spark.range(0), provider, fields).collect() == []
