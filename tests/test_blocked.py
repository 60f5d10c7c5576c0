"""What failed steps block: marks that go down a graph, and what a round shuffles."""

import random

import pytest

from heddlework.operators import graph as Gr


def model(failed, edges):
    """Pairs by equal ids; a null id is blocked like others, but blocks nobody."""
    out = set()
    for run, g, s in failed:
        fresh = {(g, s)} if None not in (g, s) else set()
        seen = set()
        while fresh:
            fresh = {(h, z) for h, a, z in edges if (h, a) in fresh and None not in (h, a)} - seen
            seen |= fresh
        out |= {(run, g, z) for g, z in seen}
    return out


def blocked(spark, failed, edges):
    failed = spark.createDataFrame(failed, "run_id string, workflow_id string, step_id string")
    edges = spark.createDataFrame(edges, "workflow_id string, src string, dst string")
    got = [tuple(r) for r in Gr.blocked_steps(failed, edges).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_missing_ids(spark):
    edges = [("g", None, "a"), ("g", "a", "b"), ("g", "b", None), ("g", "b", "b"), (None, "x", "y"), ("g", "b", "c"), ("h", "a", "d")]
    failed = [("r", "g", "a"), (None, "g", "b"), ("r", "g", None), ("r", None, "x"), ("q", "h", "nobody")]
    assert blocked(spark, failed, edges) == model(failed, edges)


@pytest.mark.parametrize("n_runs", [2, 200])
def test_few_or_many_runs_of_graphs_with_rings_and_chains(spark, n_runs):
    rng = random.Random(n_runs)
    edges = [("dag", f"n{rng.randrange(i)}", f"n{i}") for i in range(1, 90) for _ in range(2)] + [("dag", "n50", "n2")]
    edges += [("ring", f"s{i}", f"s{(i + 1) % 9}") for i in range(9)] + [("ring", "s4", "t0")] + [("ring", f"t{i}", f"t{i + 1}") for i in range(20)]
    edges += [("ladder", f"{a}{i}", f"{b}{i + 1}") for i in range(9) for a in "xy" for b in "xy"] + [("ladder", "x5", "x2"), ("ladder", "z", "z")]
    steps = sorted({(g, s) for g, a, z in edges for s in (a, z)})
    failed = [(f"r{rng.randrange(n_runs)}", *rng.choice(steps)) for _ in range(150)]
    # One graph whose failed steps are fewer than its runs, and some rows twice.
    failed += [(f"q{i}", "ring", s) for i in range(30) for s in ("s3", "t4")] + failed[:5]
    assert blocked(spark, failed, sorted(set(edges))) == model(set(failed), set(edges))


def test_more_failed_steps_of_a_run_send_no_more_rows(spark, monkeypatch):
    """A round holds a row for each step, not one for each failed step above it."""
    rows, put = [], Gr.Staging.put

    def counted(self, df, name, *args):
        out = put(self, df, name, *args)
        rows.append((out.count(), name))
        return out

    monkeypatch.setattr(Gr.Staging, "put", counted)
    edges = [("g", f"n{p}", f"n{i}") for i in range(1, 300) for p in {i // 2, i // 3}]
    failed = [(f"r{i % 3}", "g", f"n{i}") for i in range(0, 300)]
    assert blocked(spark, failed, edges) == model(failed, edges)
    assert max(rows)[0] <= len(edges)
