"""Graph operators against fixtures and plain models."""

import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from heddlework.operators import graph as Gr


def steps(spark, **graphs):
    rows = [(g, s, list(deps)) for g, defs in graphs.items() for s, deps in defs]
    return spark.createDataFrame(rows, "workflow_id string, step_id string, depends_on array<string>")


def parts(df):
    return Gr.graph_nodes(df), Gr.graph_edges(df)


def ordered(df):
    out = {}
    for r in sorted(Gr.execution_order(*parts(df)).collect(), key=lambda r: r.position):
        waves, order = out.setdefault(r.workflow_id, ({}, []))
        waves.setdefault(r.wave, []).append(r.step_id)
        order.append(r.step_id)
    return {g: ([sorted(waves[w]) for w in sorted(waves)], order) for g, (waves, order) in out.items()}


FIXTURES = {
    "linear": [("step_1", []), ("step_2", ["step_1"]), ("step_3", ["step_2"])],
    "diamond": [("start", []), ("branch_b", ["start"]), ("branch_a", ["start", "start"]), ("join", ["branch_a", "branch_b"])],
    "two_roots": [("root_2", []), ("root_1", []), ("join", ["root_1", "root_2"])],
    "self_loop": [("step_1", ["step_1"])],
    "two_cycle": [("step_a", ["step_b"]), ("step_b", ["step_a"])],
    "tail": [("a", ["c"]), ("b", ["a"]), ("c", ["b"]), ("d", ["c"])],
    "undefined": [("step_1", ["non_existent_step"]), ("after", ["step_1"]), ("free", [])],
    "twice": [("step_1", []), ("step_1", [])],
}


def test_rounds_leave_unchanged_rows_where_they_are(spark, monkeypatch):
    """No round deals all rows out by both ends; steps that come to wait twice for one other are right."""
    plans, put = [], Gr.Staging.put

    def seen(stage, df, name, *args):
        if name.startswith("rows-") and name != "rows-0":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(stage, df, name, *args)

    monkeypatch.setattr(Gr.Staging, "put", seen)
    df = steps(spark, g=[("r", []), ("t", []), ("a", ["r", "t"]), ("b", ["a"]), ("c", ["a"]), ("d", ["b", "c"]), ("e", ["d", "a"]), ("f", ["e", "d"])])
    waves = {r.step_id: r.wave for r in Gr.execution_waves(*parts(df)).collect()}
    assert waves == {"r": 0, "t": 0, "a": 1, "b": 2, "c": 2, "d": 3, "e": 4, "f": 5}
    assert plans and not any(re.search(r"hashpartitioning\(workflow_id#\d+, src#\d+, dst#\d+", text) for text in plans)


def test_fixture_orders(spark):
    got = ordered(steps(spark, **FIXTURES))
    assert got["linear"] == ([["step_1"], ["step_2"], ["step_3"]], ["step_1", "step_2", "step_3"])
    assert got["diamond"] == ([["start"], ["branch_a", "branch_b"], ["join"]], ["start", "branch_a", "branch_b", "join"])
    assert got["two_roots"][0] == [["root_1", "root_2"], ["join"]]
    assert got["undefined"] == ([["free"]], ["free"])
    assert not {"self_loop", "two_cycle", "tail"} & set(got)


def test_report(spark):
    got = {r.workflow_id: r for r in Gr.validation_report(steps(spark, **FIXTURES)).collect()}
    kinds = {g: r.error_type for g, r in got.items()}
    assert kinds == {
        "linear": None, "diamond": None, "two_roots": None, "self_loop": "CycleDetectedError", "two_cycle": "CycleDetectedError",
        "tail": "CycleDetectedError", "undefined": "InvalidGraphError", "twice": "DuplicateStepIds",
    }
    assert got["diamond"].valid and got["diamond"].step_count == 4 and got["diamond"].n_waves == 3
    assert got["tail"].n_cyclic == 3 and got["tail"].n_ordered == 0 and got["self_loop"].n_self == 1


def test_lookups(spark):
    nodes, edges = parts(steps(spark, diamond=FIXTURES["diamond"], undefined=FIXTURES["undefined"]))
    assert {r.step_id for r in Gr.dependencies_of(edges, "join").collect()} == {"branch_a", "branch_b"}
    assert {r.step_id for r in Gr.dependents_of(edges, "start").collect()} == {"branch_a", "branch_b"}
    assert {r.step_id for r in Gr.root_steps(nodes, edges).collect()} == {"start", "free"}
    assert [(r.src, r.dst) for r in Gr.undefined_dependencies(nodes, edges).collect()] == [("non_existent_step", "step_1")]
    done = spark.createDataFrame([("diamond", "start"), ("diamond", "branch_a")], "workflow_id string, step_id string")
    assert {r.step_id for r in Gr.ready_steps(nodes, edges, done).collect()} == {"branch_b", "free"}


def test_ready_steps_of_each_run(spark):
    nodes, edges = parts(steps(spark, diamond=FIXTURES["diamond"], undefined=FIXTURES["undefined"]))
    runs = spark.createDataFrame([("r1", "diamond"), ("r1", "diamond"), ("r2", "diamond"), ("r3", "undefined")], "run_id string, workflow_id string")
    rows = [("r1", "start"), ("r1", "start"), ("r1", "branch_a"), ("r9", "start"), ("r9", "branch_a"), ("r9", "branch_b")]
    done = spark.createDataFrame([(r, "diamond", s) for r, s in rows], "run_id string, workflow_id string, step_id string")
    want = [("r1", "branch_b"), ("r2", "start"), ("r3", "free")]
    ready = lambda met=None: sorted((r.run_id, r.step_id) for r in Gr.ready_by_run(runs, nodes, edges, done, met).collect())
    assert ready() == want
    first, second = (Gr.met_dependencies(done.where(f"step_id {sign} 'start'"), edges) for sign in ("=", "<>"))
    assert ready(Gr.add_met(first, second)) == want
    assert Gr.ready_by_run(runs.limit(0), nodes, edges, done).count() == 0


def test_faults_name_their_steps(spark):
    def found(page_rows):
        return sorted((r.workflow_id, r.error_rank, r.error_type, r.page, r.message) for r in Gr.graph_faults(steps(spark, **FIXTURES), page_rows).collect())

    got = found(1000)
    assert [g[4].count("directly depends on itself (cycle: ") for g in got if g[0] == "self_loop"] == [1]
    assert [g[1:4] for g in got if g[0] == "twice"] == [(0, "DuplicateStepIds", 0)]
    assert ("undefined", 1, "InvalidGraphError", 0, "Step 'step_1' depends on undefined step 'non_existent_step'.") in got
    cycles = {g[0]: g[4] for g in got if g[1] == 2}
    assert set(cycles) == {"two_cycle", "tail"} and all(c.startswith(Gr.CYCLE_TEXT) for c in cycles.values())
    paged = [g[4] for g in found(2) if g[0] == "two_cycle"]
    assert len(paged) == 2 and "".join(paged) == cycles["two_cycle"]


def fifo(defs):
    """First-in-first-out order with sorted ties; None where there is a cycle."""
    deps = {s: set(d) for s, d in defs}
    need = {s: len(d) for s, d in deps.items()}
    queue, out = deque(sorted(s for s in deps if not need[s])), []
    while queue:
        at = queue.popleft()
        out.append(at)
        for s in sorted(s for s in deps if at in deps[s]):
            need[s] -= 1
            if not need[s]:
                queue.append(s)
    return out


def depth_first_cycle(defs):
    onward = {s: sorted(t for t, d in defs if s in d) for s, _ in defs}
    done, found = set(), []

    def visit(s, path):
        if s in path:
            found.append([*path[path.index(s):], s])
        elif s not in done:
            for t in onward[s]:
                if found:
                    return
                visit(t, [*path, s])
            done.add(s)

    for s in sorted(onward):
        if not found:
            visit(s, [])
    return found[0] if found else None


def random_graphs(rng, n, cyclic):
    graphs = {}
    for g in range(n):
        names = [f"n{i}" for i in range(rng.randrange(1, 13))]
        rng.shuffle(names)
        defs = []
        for i, name in enumerate(names):
            pool = names if cyclic else names[:i]
            pool = [p for p in pool if p != name]
            defs.append((name, rng.sample(pool, min(len(pool), rng.choice([0, 0, 1, 1, 2, 3] if not cyclic else [0, 1, 1, 2])))))
        rng.shuffle(defs)
        graphs[f"g{g}"] = defs
    return graphs


def test_random_orders(spark):
    graphs = random_graphs(random.Random(5), 400, cyclic=False)
    got = ordered(steps(spark, **graphs))
    assert {g: order for g, (_, order) in got.items()} == {g: fifo(defs) for g, defs in graphs.items()}


def test_first_cycle_is_the_depth_first_one(spark):
    graphs = random_graphs(random.Random(6), 200, cyclic=True)
    got = {}
    for r in sorted(Gr.first_cycle(*parts(steps(spark, **graphs))).collect(), key=lambda r: r.seq):
        got.setdefault(r.workflow_id, []).append(r.step_id)
    want = {g: depth_first_cycle(defs) for g, defs in graphs.items()}
    assert got == {g: c for g, c in want.items() if c}


def closure(defs):
    deps = dict(defs)
    out = set()
    for s in deps:
        todo, seen = list(deps[s]), set()
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += deps.get(at, [])
        out |= {(a, s) for a in seen}
    return out


def test_random_closures_and_core(spark):
    graphs = random_graphs(random.Random(7), 120, cyclic=True)
    nodes, edges = parts(steps(spark, **graphs))
    got = {}
    for r in Gr.transitive_dependencies(edges).collect():
        got.setdefault(r.workflow_id, set()).add((r.ancestor, r.step_id))
    want = {g: closure(defs) for g, defs in graphs.items()}
    assert got == {g: c for g, c in want.items() if c}
    core = {(r.workflow_id, r.step_id) for r in Gr.cycle_core(nodes, edges).collect()}
    expect = set()
    for g, pairs in want.items():
        loops = {a for a, z in pairs if a == z}
        after, before = {z for a, z in pairs if a in loops}, {a for a, z in pairs if z in loops}
        expect |= {(g, s) for s in after & before}
    assert core == expect


def test_components_are_those_of_the_closure(spark):
    graphs = random_graphs(random.Random(9), 80, cyclic=True)
    # Two rings joined by a way, a ring of 100 steps, and a ring with a chord.
    graphs["joined"] = [("a", ["b"]), ("b", ["a"]), ("m", ["a"]), ("n", ["m"]), ("x", ["n", "z"]), ("y", ["x"]), ("z", ["y"]), ("tail", ["z"])]
    graphs["ring"] = [(f"s{i:03d}", [f"s{(i - 1) % 100:03d}"]) for i in range(100)]
    graphs["chord"] = [(f"s{i:02d}", [f"s{(i - 1) % 30:02d}", *(["s04"] if i == 20 else [])]) for i in range(30)]
    got = {(r.workflow_id, r.step_id): r.component for r in Gr.cycle_components(*parts(steps(spark, **graphs))).collect()}
    want = {}
    for g, defs in graphs.items():
        pairs = closure(defs)
        for a, z in pairs:
            if a != z and (z, a) in pairs:
                want[g, a] = min(want.get((g, a), a), z)
    assert got == want and len({c for (g, _), c in got.items() if g == "joined"}) == 2


def counted_puts(monkeypatch):
    """Names of the tables staged from here on."""
    names, put = [], Gr.Staging.put

    def counted(self, df, name, *rest):
        names.append(name)
        return put(self, df, name, *rest)

    monkeypatch.setattr(Gr.Staging, "put", counted)
    return names


def test_long_chain_takes_logarithmic_rounds(spark, monkeypatch):
    names = counted_puts(monkeypatch)
    chain = [("c00000", [])] + [(f"c{i:05d}", [f"c{i - 1:05d}", "c00000"]) for i in range(1, 5000)]
    waves, order = ordered(steps(spark, chain=chain))["chain"]
    assert order == sorted(order) and len(waves) == 5000
    assert sum(n.startswith("round=") for n in names) <= 15 and sum(n.startswith("moving-") for n in names) <= 15


def test_wide_and_deep_graph_in_one_stretch_or_many(spark):
    rng = random.Random(11)
    defs = [("r0", []), ("r1", [])]
    for i in range(2, 120):
        names = [d for d, _ in defs]
        defs.append((f"v{rng.randrange(10**6):06d}", sorted({rng.choice(names[-3:]), rng.choice(names[-6:])})))
    assert ordered(steps(spark, deep=defs))["deep"][1] == fifo(defs)


def test_pages(spark):
    df = steps(spark, wide=[("root", [])] + [(f"s{i:03d}", ["root"]) for i in range(25)])
    order = Gr.execution_order(*parts(df))
    pages = {(r.wave, r.page): r.steps for r in Gr.wave_pages(order, page_rows=10).collect()}
    assert [len(pages[k]) for k in sorted(pages)] == [1, 10, 10, 5] and pages[(1, 2)] == [f"s{i:03d}" for i in range(20, 25)]
    listed = {r.page: r.steps for r in Gr.order_pages(order, page_rows=10).collect()}
    assert [s for p in sorted(listed) for s in listed[p]] == ["root"] + [f"s{i:03d}" for i in range(25)]


def test_blocked_and_undeclared(spark):
    df = steps(spark, wf=[("a", []), ("b", ["a"]), ("c", ["b"]), ("d", [])])
    links = Gr.graph_edges(df)
    failed = spark.createDataFrame([("r1", "wf", "a"), ("r2", "wf", "b"), ("r3", "wf", "d")], "run_id string, workflow_id string, step_id string")
    assert {(r.run_id, r.step_id) for r in Gr.blocked_steps(failed, links).collect()} == {("r1", "b"), ("r1", "c"), ("r2", "c")}
    texts = df.withColumn("inputs", F.when(F.col("step_id") == "c", '{"x":"${a.output.v} ${d.output} ${workflow.input.q} ${c.output}"}').otherwise("{}"))
    assert {(r.step_id, r.ancestor) for r in Gr.undeclared_references(texts, links).collect()} == {("c", "d"), ("c", "c")}


def test_edges_to_unknown_steps_and_missing_ids(spark):
    nodes = spark.createDataFrame([("g", "a"), ("g", "b"), (None, "x"), ("g", None)], "workflow_id string, step_id string")
    edges = spark.createDataFrame(
        [("g", "a", "b"), ("g", "a", "nowhere"), (None, "x", "y"), ("g", None, "b")], "workflow_id string, src string, dst string"
    )
    got = [(r.workflow_id, r.step_id, r.wave, r.position) for r in Gr.execution_order(nodes, edges).collect()]
    assert sorted(got) == [("g", "a", 0, 1), ("g", "b", 1, 2)]


def test_short_cycles_do_not_double_with_a_long_one(spark, monkeypatch):
    graphs = {f"g{i}": [("a", ["b"]), ("b", ["a"])] for i in range(20)}
    graphs["long"] = [(f"s{i:02d}", [f"s{(i - 1) % 40:02d}"]) for i in range(40)]
    rows, put = [], Gr.Staging.put

    def counted(self, df, name, *rest):
        out = put(self, df, name, *rest)
        if name.startswith("walk-"):
            rows.append(out.filter("workflow_id <> 'long'").count())
        return out

    monkeypatch.setattr(Gr.Staging, "put", counted)
    found = Gr.first_cycle(*parts(steps(spark, **graphs))).groupBy("workflow_id").count().collect()
    assert {r.workflow_id: r["count"] for r in found} == {g: len(d) + 1 for g, d in graphs.items()}
    assert max(rows) <= 20 * 4 and rows[-1] == 0


def test_seeded_reach_is_the_closure_of_the_seeds(spark):
    graphs = random_graphs(random.Random(8), 40, cyclic=True)
    nodes, edges = parts(steps(spark, **graphs))
    seeds = nodes.filter("step_id in ('n0', 'n3')")
    got = {(r.workflow_id, r.step_id, r.at) for r in Gr.reached_from(seeds, edges).collect()}
    want = {(g, a, z) for g, defs in graphs.items() for a, z in closure(defs) if a in ("n0", "n3")}
    assert got == want


def test_asked_pairs_are_those_of_the_closure(spark):
    graphs = random_graphs(random.Random(10), 60, cyclic=False) | {f"c{g}": d for g, d in random_graphs(random.Random(12), 20, cyclic=True).items()}
    nodes, edges = parts(steps(spark, **graphs))
    every = [(g, a, z) for g, defs in graphs.items() for a, _ in defs for z, _ in defs] + [("g0", "nobody", "n0"), ("g0", "n0", "nobody")]
    asked = spark.createDataFrame(every, "workflow_id string, ancestor string, step_id string")
    got = {(r.workflow_id, r.ancestor, r.step_id) for r in Gr.reaching_pairs(asked, nodes, edges).collect()}
    assert got == {(g, a, z) for g, defs in graphs.items() for a, z in closure(defs)}


def test_reach_in_long_chains_takes_logarithmic_rounds(spark, monkeypatch):
    chain = [("c0000", [])] + [(f"c{i:04d}", [f"c{i - 1:04d}"]) for i in range(1, 2000)]
    nodes, edges = parts(steps(spark, chain=chain, other=[("x", [])]))
    pairs = [("chain", "c0000", "c1999"), ("chain", "c0700", "c0701"), ("chain", "c0701", "c0700"), ("chain", "x", "c0005")]
    asked = spark.createDataFrame(pairs, "workflow_id string, ancestor string, step_id string")
    names = counted_puts(monkeypatch)
    assert {(r.ancestor, r.step_id) for r in Gr.reaching_pairs(asked, nodes, edges).collect()} == {("c0000", "c1999"), ("c0700", "c0701")}
    assert Gr.reached_from(nodes.filter("step_id = 'c0010'"), edges).count() == 1989
    assert len(names) < 120
