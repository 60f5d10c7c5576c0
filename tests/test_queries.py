"""Every named query against its SQL on the smallest tables, and the plans that matter."""

import pytest
from compare import connect, spark_rows, sql_rows

from heddlework.plans import all_queries, all_sql

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = spark_rows(QUERIES[name](spark, FOLDER))
    assert got == sql_rows(con, SQL[name])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["typed_event_flow"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in text or "EqualNullSafe(event_type,purchase)" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,props:string>" in text


def test_newest_per_key_combines_before_the_shuffle(spark):
    text = plan(QUERIES["cache_newest"](spark, FOLDER))
    assert "partial_max_by" in text and "Window" not in text


@pytest.mark.parametrize("name", ["path_extract", "render_template", "extract_references", "fingerprint", "filter_items", "merge_document", "build_requests", "json_from_text"])
def test_row_work_stays_in_the_jvm(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "Python" not in text and "Pandas" not in text


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
