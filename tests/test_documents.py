"""Rendering a column of JSON documents, and paths with digits and quotes."""

import json

import pytest
from pyspark.sql import functions as F

from heddlework.functions.paths import extract
from heddlework.functions.templates import render_documents

INPUTS = {"n": 5, "t": 'say "hi"\n', "l": [10, {"0": "key"}], "null": None, "o": {"b": True}}
CASES = [
    ('{"b":"${workflow.input.n}","a":"${workflow.input.l[0]}"}', '{"b":5,"a":10}', []),
    ('{"x":"is ${workflow.input.t}"}', r'{"x":"is say \"hi\"\n"}', []),
    (r'{"x":"q \"${workflow.input.n}\" ${workflow.input.null}"}', r'{"x":"q \"5\" None"}', []),
    (r'{"x":"\n${workflow.input.o}\t"}', '{"x":{"b":true}}', []),
    ('{"${workflow.input.n}" : "k", "pre ${workflow.input.n} post": ["${a.output}"]}', '{"${workflow.input.n}" : "k", "pre ${workflow.input.n} post": [[1]]}', []),
    ('["${workflow.input.l.1.0}", 3, null]', '["key", 3, null]', []),
    ('"${workflow.input.null}"', "null", []),
    ("{}", "{}", []),
    ('{"x":"${b.output} ${c.output.y} ${a.input} ${workflow.output}"}', None, ["step_not_complete", "step_unknown", "step_input", "workflow_output"]),
    ('{"x":"${workflow.input.l[9]} ${workflow.input.l.k} ${workflow.input.null.k} ${workflow.input.n.k}"}', None,
     ["index_out_of_range", "index_not_numeric", "null_in_path", "unsupported_type"]),
    ("{bad ${workflow.input.n}", None, ["not_json"]),
    ("", None, ["not_json"]),
    (None, None, []),
]


def test_documents(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _, _) in enumerate(CASES)], "i int, d string")
    inputs = F.parse_json(F.lit(json.dumps(INPUTS)))
    outputs = F.create_map(F.lit("a"), F.parse_json(F.lit("[1]")))
    got = df.select("i", render_documents(F.col("d"), inputs, outputs, frozenset({"a", "b"})).alias("r")).collect()
    assert {r.i: (r.r.resolved, r.r.error_codes) for r in got} == {i: (text, codes) for i, (_, text, codes) in enumerate(CASES)}


VALUE = {"a": [[{"0": {"1": "x"}}], ["y", "z"]], "1": {"2": {"3": {"4": {"5": "deep"}}}}, "it's \"q\"": {"k": 7}, "4000000000": "big"}
PATHS = {
    "a.0.0.0.1": "x", "a[1][0]": "y", "a.1.01": "z", "1.2.3.4.5": "deep", "it's \"q\".k": "7", "4000000000": "big",
    "a.4000000000": None, "a.5": None, "1.2.x.4.5": None, "": json.dumps(VALUE),
}


@pytest.mark.parametrize("path", PATHS)
def test_constant_and_column_paths_agree(spark, path):
    df = spark.createDataFrame([(json.dumps(VALUE), path)], "v string, p string")
    value = F.parse_json("v")
    row = df.select(extract(value, path, "string").alias("a"), extract(value, F.col("p"), "string").alias("b")).first()
    if path:
        assert (row.a, row.b) == (PATHS[path], PATHS[path])
    else:
        assert json.loads(row.a) == json.loads(row.b) == VALUE
