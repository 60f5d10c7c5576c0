"""Paths, templates, transforms and content keys on small hand-made rows."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddlework.functions.binding import bind
from heddlework.functions.fingerprint import input_key
from heddlework.functions.paths import extract, path_error, segments, segments_col, text_of
from heddlework.functions.templates import (
    Scope,
    explode_references,
    render,
    render_column,
    render_document,
    split_resolved,
    template_errors,
)
from heddlework.operators import transforms as P


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def doc(value):
    return F.parse_json(F.lit(json.dumps(value)))


@pytest.mark.parametrize(
    "path, parts",
    [("a[0].b", ["a", "0", "b"]), ("a['k']", ["a", "k"]), ("a.0.b", ["a", "0", "b"]), ("..a..", ["a"]), (None, []), ('x["y"][2]', ["x", "y", "2"])],
)
def test_segments(spark, path, parts):
    assert segments(path) == parts
    if path:
        assert one(spark, segments_col(F.lit(path)))[0] == parts


def test_extract_deep_paths(spark):
    data = doc({"items": [{"title": "One", "score": 9.5}, {"title": "Two"}], "metadata": {"tags": ["ai", "dag"]}, "0": {"1": "key"}, "n": None})
    got = one(
        spark,
        extract(data, "items[0].title", "string"),
        extract(data, "items.1.title", "string"),
        extract(data, "metadata.tags[1]", "string"),
        extract(data, "0.1", "string"),
        extract(data, "0.1.2.3.4.5.6", "string"),
        F.is_variant_null(extract(data, "n")),
        extract(data, "absent").isNull(),
        extract(data, "items[0].score", "double"),
        F.to_json(extract(data, "")),
    )
    assert list(got[:8]) == ["One", "Two", "dag", "key", None, True, True, 9.5]
    assert json.loads(got[8])["0"] == {"1": "key"}


def test_path_errors(spark):
    data = doc({"user": {"name": "Alice"}, "list": [1], "none": None})
    asked = ["user.name", "user.age", "list[5]", "list.first", "none.x", "user.name.x", "list[-1]"]
    got = one(spark, *[path_error(data, p) for p in asked])
    assert list(got) == [None, "key_missing", "index_out_of_range", "index_not_numeric", "null_in_path", "unsupported_type", "index_not_numeric"]


def test_random_paths_match_a_plain_walk(spark):
    rng = random.Random(3)

    def value(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.2:
            return rng.choice([1, "t", True, None, 2])
        if kind < 0.6:
            return {rng.choice("ab01"): value(depth - 1) for _ in range(3)}
        return [value(depth - 1) for _ in range(2)]

    def walk(held, parts):
        for part in parts:
            if isinstance(held, dict) and part in held:
                held = held[part]
            elif isinstance(held, list) and part.isdigit() and int(part) < len(held):
                held = held[int(part)]
            else:
                return "absent"
        return held

    docs = [value(4) for _ in range(200)]
    paths = ["a", "0", "a.0", "0.1.a", "b.a.0", "1.1.1", "a.b", "0.0.0.0"]
    rows = spark.createDataFrame([(json.dumps(d),) for d in docs], "j string").withColumn("v", F.parse_json("j"))
    constant = rows.select(*[F.to_json(extract(F.col("v"), p)).alias(f"p{i}") for i, p in enumerate(paths)]).collect()
    dynamic = rows.select(*[F.to_json(extract(F.col("v"), F.lit(p))).alias(f"p{i}") for i, p in enumerate(paths)]).collect()
    for d, left, right in zip(docs, constant, dynamic):
        for i, p in enumerate(paths):
            want = walk(d, p.split("."))
            for got in (left[i], right[i]):
                assert (got is None) if want == "absent" else json.loads(got) == want


def test_whole_references_keep_their_type(spark):
    out = doc({"dict_val": {"data": [1, 2], "status": "ok"}, "list_val": ["a"], "int_val": 42, "bool_val": True})
    scope = Scope(inputs=doc({"topic": "AI"}), outputs={"step_1": out})
    got = one(
        spark,
        *[F.to_json(render(f" ${{step_1.output.{k}}} ", scope)) for k in ("dict_val", "list_val", "int_val", "bool_val")],
        F.schema_of_variant(render("${step_1.output.int_val}", scope)),
        F.to_json(render("${workflow.input}", scope)),
    )
    assert [json.loads(x) for x in got[:4]] == [{"data": [1, 2], "status": "ok"}, ["a"], 42, True]
    assert got[4] == "BIGINT" and json.loads(got[5]) == {"topic": "AI"}


def test_composite_text(spark):
    scope = Scope(inputs=doc({"topic": "Autonomous Agents"}), outputs={"trends": doc({"count": 15, "volume": 1420, "ok": True, "none": None, "l": [1]})})
    text = "Report for ${workflow.input.topic}: count=${trends.output.count}, vol=${trends.output.volume}."
    odd = "${trends.output.ok} ${trends.output.none} ${trends.output.l} ${x.z} ${trends.output[0]} $ {a}"
    got = one(spark, render(text, scope), render(odd, scope), render("plain", scope), render("a ${workflow.input.no}", scope))
    assert got[0] == "Report for Autonomous Agents: count=15, vol=1420."
    assert got[1] == "True None [1] ${x.z} ${trends.output[0]} $ {a}"
    assert got[2] == "plain" and got[3] is None
    column = one(spark, render_column(F.lit(text), scope.inputs, F.create_map(F.lit("trends"), scope.outputs["trends"])))
    assert column[0] == got[0]


def test_nested_document(spark):
    scope = Scope(inputs=doc({"id": 7, "name": "N"}), outputs={"s": doc({"v": ["x", "y"]})})
    template = {
        "static_str": "unchanged", "header": "Hi ${workflow.input.name}", "n": 1.5, "none": None, "${workflow.input.id}": 1,
        "nested_dict": {"target_id": "${workflow.input.id}", "inner_list": ["${s.output.v[0]}", "${s.output.v[1]}!", 3]},
    }
    got = json.loads(one(spark, F.to_json(render_document(template, scope)))[0])
    assert got == {
        "static_str": "unchanged", "header": "Hi N", "n": 1.5, "none": None, "${workflow.input.id}": 1,
        "nested_dict": {"target_id": 7, "inner_list": ["x", "y!", 3]},
    }


def test_reference_errors_and_strict_mode(spark):
    scope = Scope(inputs=doc({"a": 1}), outputs={"late": F.lit(None).cast("variant")}, known=frozenset({"late", "other"}))
    texts = ["${late.output.x}", "${other.output}", "${nobody.output}", "${workflow.output.a}", "${workflow.input.a}"]
    got = one(spark, *[template_errors(t, scope) for t in texts], template_errors({"k": ["${workflow.input.b}"], "${bad.output}": 1}, scope))
    assert list(got) == [["step_not_complete"], ["step_not_complete"], ["step_unknown"], ["workflow_output"], [], ["key_missing"]]
    done = Scope(inputs=doc({}), outputs={"s": doc({"a": 1})})
    assert one(spark, template_errors("${s.input.a}", done))[0] == ["step_input"]
    with pytest.raises(Exception, match="key_missing"):
        one(spark, render("x ${workflow.input.b}", scope, strict=True))


def test_split_resolved(spark):
    rows = spark.createDataFrame([(1, '{"a": 5}'), (2, "{}"), (3, "broken")], "id int, j string")
    good, bad = split_resolved(rows, {"v": "${workflow.input.a}"}, Scope(inputs=F.try_parse_json("j")), "out")
    assert [(r.id, json.loads(r.o)) for r in good.select("id", F.to_json("out").alias("o")).collect()] == [(1, {"v": 5})]
    assert {r.id: r.error_codes for r in bad.collect()} == {2: ["key_missing"], 3: ["source_missing"]}


def test_text_of(spark):
    got = one(spark, *[text_of(doc(v)) for v in (True, False, None, "true", "None", 5, 1.25, [1], {"a": None})])
    assert list(got) == ["True", "False", "None", "true", "None", "5", "1.25", "[1]", '{"a":null}']


def test_references(spark):
    rows = spark.createDataFrame([("a ${s1.output.x[0].y} ${workflow.input} ${s.output['k']} ${-.output}",)], "t string")
    got = [(r.ref_pos, r.source, r.kind, r.path) for r in explode_references(rows, "t").collect()]
    assert got == [(0, "s1", "output", "x[0].y"), (1, "workflow", "input", None)]


# --- transforms -------------------------------------------------------------------


def test_select_forms(spark):
    source = doc({"a": 1, "b": None, 'q"x': 2})
    got = one(spark, P.select_json(source, ["b", "zz", "a", "b", 'q"x']), P.select_json(doc([1]), ["a"]), P.select_json(source, []))
    assert list(json.loads(got[0]).items()) == [("b", None), ("a", 1), ('q"x', 2)]
    assert got[1] == "[1]" and got[2] == "{}"
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert P.select_fields(df, ["b", "x", "b"]).columns == ["b"]


def test_filter_items_follow_value_equality(spark):
    items = doc([{"k": 1}, {"k": 1.0}, {"k": "1"}, {"k": True}, {"k": None}, {}, 5, "k", None, {"k": [1]}, {"k": False}, {"k": 10000000}])

    def kept(key, value):
        return F.to_json(P.filter_items(items, key, value))

    got = one(spark, kept("k", doc(1)), kept("k", doc("1")), kept("k", doc(None)), kept("k", doc([1])), kept("", doc(1)),
              kept("k", F.parse_json(F.lit("1e0"))), kept("k", F.parse_json(F.lit("1.0E7"))), kept("k", doc(0)),
              F.to_json(P.filter_items(doc({"a": 1}), "a", doc(1))))
    got = [json.loads(g) for g in got]
    assert got[0] == got[5] == [{"k": 1}, {"k": 1}, {"k": True}]
    assert got[1] == [{"k": "1"}] and got[2] == [{"k": None}, {}] and got[3] == [{"k": [1]}]
    assert len(got[4]) == 12 and got[6] == [{"k": 10000000}] and got[7] == [{"k": False}] and got[8] == {"a": 1}


def test_filter_rows_null_and_missing_column(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    assert [r.id for r in P.filter_rows(df, "v", None).collect()] == [2]
    assert P.filter_rows(df, "w", None).count() == 2 and P.filter_rows(df, "w", 1).count() == 0
    assert P.filter_rows(df, "", 1).count() == 2


def test_merge_document(spark):
    def merged(text):
        return json.loads(one(spark, F.to_json(P.merge_document(F.lit(text))))[0] or "null")

    assert merged('{"squares": [1, 4], "metadata": {"processed": true}}') == {"squares": [1, 4], "processed": True}
    assert merged('{"z": {"a": 1, "b": {"x": 1}}, "a": 2, "c": {"b": {"y": 2}}}') == {"a": 2, "b": {"y": 2}}
    assert merged('{"a": 5, "b": {"a": null}}') == {"a": None}
    assert merged("[1]") is None and merged("{}") == {}


def test_merge_maps_columns_rows(spark):
    a, b = F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2)), F.create_map(F.lit("y"), F.lit(3))
    assert one(spark, P.merge_maps(a, b))[0] == {"x": 1, "y": 3}
    df = spark.createDataFrame([((1, 2), 9, (3,))], "s struct<a:int,b:int>, b int, t struct<a:int>")
    assert P.merge_columns(df, ["s", "b", "t"]).first().asDict() == {"a": 3, "b": 9}
    rows = spark.createDataFrame([("g", 1, "k", "old"), ("g", 2, "k", None), ("g", 1, "j", "v")], "g string, pos int, key string, value string")
    assert {(r.key, r.value) for r in P.merge_rows(rows, ["g"], "pos", "key", "value").collect()} == {("k", None), ("j", "v")}


def test_content_key(spark):
    def key(action, text):
        return input_key(F.lit(action), F.try_parse_json(F.lit(text)))

    a, b, c, d, e, f = one(spark, key("x", '{"a":1,"b":{"d":1,"c":[2]}}'), key("x", ' {"b":{"c":[2],"d":1.0}, "a":1}'),
                           key("y", '{"a":1,"b":{"d":1,"c":[2]}}'), key("x", '{"a":1,"b":{"d":1,"c":["2"]}}'), key("x", "broken"),
                           key("x", '{"a":1,"a":2}'))
    assert a == b and len({a, c, d}) == 3 and len(a) == 64 and e is None and f is None


def test_bind_gives_the_value_once(spark):
    got = spark.range(50).select(bind(F.rand(), lambda x: F.struct(x.alias("a"), x.alias("b"))).alias("p")).filter("p.a <> p.b")
    assert got.count() == 0


def test_plans_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("{}",)], T.StructType([T.StructField("j", T.StringType())]))
    v = F.try_parse_json("j")
    scope = Scope(inputs=v, outputs={"s": v})
    made = df.select(
        extract(v, "a[0].b", "int").alias("a"), render("x ${s.output.y}", scope).alias("b"), input_key(F.lit("x"), v).alias("c"),
        P.select_json(v, ["a"]).alias("d"), F.to_json(P.filter_items(v, "k", doc(1))).alias("e"), F.to_json(P.merge_document(F.col("j"))).alias("f"),
    )
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan
