"""The closure of dependencies: what its rounds shuffle, and arrays that take several rows."""

import random

import pytest

from heddlework.operators import graph as Gr


def model(edges):
    """As the SQL: pairs by equal ids; a null id is an ancestor, but nobody's dependent."""
    reach = set(edges)
    while True:
        more = {(g, a, z) for g, a, m in reach for h, s, z in edges if g is not None and m is not None and (g, m) == (h, s)} - reach
        if not more:
            return reach
        reach |= more


def closure(spark, edges):
    got = [tuple(r) for r in Gr.transitive_dependencies(spark.createDataFrame(edges, "workflow_id string, src string, dst string")).collect()]
    assert len(got) == len(set(got))
    return set(got)


ODD = [("g", None, "a"), ("g", "a", "b"), ("g", "b", None), ("g", "b", "b"), (None, "x", "y"), (None, "y", "z"), ("g", "b", "c"), ("h", "c", "d")]


def test_missing_ids(spark):
    assert closure(spark, ODD) == model(ODD)


@pytest.mark.parametrize("met", [3, 40, 1_000_000])
def test_arrays_in_several_rows(spark, monkeypatch, met):
    monkeypatch.setattr(Gr, "MET", met)
    rng = random.Random(met)
    edges = [("wide", f"r{i}", "sink") for i in range(40)] + [("wide", "sink", "last"), ("wide", "last", "r3")]
    edges += [("dag", f"n{rng.randrange(i)}", f"n{i}") for i in range(1, 40) for _ in range(2)] + [("dag", "n30", "n2")]
    assert closure(spark, sorted(set(edges))) == model(set(edges))


def test_a_round_shuffles_steps_not_pairs(spark, monkeypatch):
    """No shuffle of a round deals pairs out by both of their ends."""
    plans, put = [], Gr.Staging.put

    def seen(stage, df, name, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(stage, df, name, *args)

    monkeypatch.setattr(Gr.Staging, "put", seen)
    closure(spark, [("g", f"n{i // 2}", f"n{i}") for i in range(1, 60)])
    assert plans and not any("ancestor" in text and "Exchange hashpartitioning" in text for text in plans)
