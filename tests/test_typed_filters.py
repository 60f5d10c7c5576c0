"""Equality of typed values, and outcomes by step id."""

import pytest
from pyspark.sql import functions as F

from heddlework.operators.runlog import run_outcome
from heddlework.operators.transforms import filter_items, filter_rows, filter_structs


@pytest.mark.parametrize(
    ("items", "value", "kept"),
    [
        ('[{"a":1e-12},{"a":2e-12},{"a":0}]', "0", ['{"a":0}']),
        ('[{"a":1e-12},{"a":2e-12},{"a":0.000000000001}]', "1e-12", [1e-12, 1e-12]),
        ('[{"a":1},{"a":1.0},{"a":10e-1},{"a":true},{"a":"1"}]', "1", [1, 1, 1, True]),
        ('[{"a":-0.0},{"a":false},{"a":0}]', "0", [0, False, 0]),
        ('[{"a":1e30},{"a":1e31}]', "1000000000000000000000000000000", [1e30]),
    ],
)
def test_items_compare_exactly(spark, items, value, kept):
    df = spark.createDataFrame([(items, value)], "items string, v string")
    out = df.select(F.to_json(filter_items(F.parse_json("items"), "a", F.parse_json("v"))).alias("o")).first().o
    assert out.count('"a"') == len(kept)


@pytest.mark.parametrize(("value", "n"), [("5", 0), ("abc", 0), (5, 1), (5.0, 1), (True, 1), (False, 0), (None, 1)])
def test_rows_of_a_number_column(spark, value, n):
    df = spark.createDataFrame([(5,), (1,), (None,)], "k int")
    assert filter_rows(df, "k", value).count() == n


@pytest.mark.parametrize(("value", "n"), [(5, 0), ("5", 1), (True, 0), (None, 1)])
def test_rows_of_a_text_column(spark, value, n):
    df = spark.createDataFrame([("5",), ("true",), (None,)], "k string")
    assert filter_rows(df, "k", value).count() == n


def test_an_undeclared_step_completes_no_run(spark):
    runs = spark.createDataFrame([("r1", "w", None), ("r2", "w", None)], "run_id string, workflow_id string, error_message string")
    steps = spark.createDataFrame([("w", "a"), ("w", "b")], "workflow_id string, step_id string")
    seen = [("r1", "a"), ("r1", "zzz"), ("r2", "a"), ("r2", "b")]
    log = spark.createDataFrame([(r, s, "COMPLETED", 1, None) for r, s in seen], "run_id string, step_id string, status string, completed_at int, error_trace string")
    out = {r.run_id: r.outcome for r in run_outcome(runs, steps, log).collect()}
    assert out == {"r1": "RUNNING", "r2": "COMPLETED"}


@pytest.mark.parametrize(
    ("kind", "value", "n"),
    [("int", "5", 0), ("int", "abc", 0), ("int", 5, 1), ("int", 5.0, 1), ("string", 5, 0), ("string", "5", 1),
     ("decimal(20,12)", 5, 1), ("double", 5, 1), ("int", None, 1), ("boolean", 1, 1)],
)
def test_structs_compare_by_type(spark, kind, value, n):
    df = spark.createDataFrame([(["5", "7", None],)], "k array<string>")
    made = F.transform("k", lambda k: F.struct(F.when(k != "7", k).cast(kind).alias("a")) if kind != "boolean" else F.struct((k == "5").alias("a")))
    items = F.filter(F.array_append(made, F.lit(None)), lambda x: x.isNull() | x["a"].isNotNull() | F.lit(value is None))
    kept = df.select(filter_structs(items, "a", value).alias("o")).first().o
    assert len(kept) == (2 if value is None else n) and all(x is not None for x in kept)
