"""Dependency graphs as edge tables, many graphs at once.

Nodes are rows (workflow_id, step_id). An edge (workflow_id, src, dst) says that
step ``dst`` depends on step ``src``.

Waves, cycles and reachability run as rounds of joins over all graphs together; one graph may
hold all rows, and no group holds a graph. A step with a single open dependency passes what it needs
on to that one's own, so the way a round covers doubles along unbranched stretches, and a
chain takes as many rounds as the logarithm of its length. Rounds write what has changed
to the shared folder; the driver sees counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddlework.functions.ordering import PAGE_ROWS, paged, positions_within, ranked, scan_within
from heddlework.functions.templates import explode_references
from heddlework.session import Staging

G = "workflow_id"


# --- tables and lookups ------------------------------------------------------


def graph_edges(steps: DataFrame) -> DataFrame:
    """Edges from ``depends_on``; repeated names count once.

    Repeats are removed inside the list first, so the shuffle that is left only
    has to catch steps defined twice.
    """
    listed = steps.select(G, F.explode(F.array_distinct("depends_on")).alias("src"), F.col("step_id").alias("dst"))
    return listed.distinct()


def graph_nodes(steps: DataFrame) -> DataFrame:
    return steps.select(G, "step_id").distinct()


def undefined_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(nodes.withColumnRenamed("step_id", "src"), [G, "src"], "left_anti").select(G, "src", "dst")


def self_dependencies(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") == F.col("dst"))


def duplicate_steps(steps: DataFrame) -> DataFrame:
    """Step ids defined more than once, with the number of definitions."""
    return steps.groupBy(G, "step_id").agg(F.count(F.lit(1)).alias("n_defined")).filter("n_defined > 1")


def dependencies_of(edges: DataFrame, step_id: str) -> DataFrame:
    return edges.filter(F.col("dst") == step_id).select(G, F.col("src").alias("step_id"))


def dependents_of(edges: DataFrame, step_id: str) -> DataFrame:
    return edges.filter(F.col("src") == step_id).select(G, F.col("dst").alias("step_id"))


def root_steps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(G, F.col("dst").alias("step_id")), [G, "step_id"], "left_anti")


def ready_steps(nodes: DataFrame, edges: DataFrame, completed: DataFrame) -> DataFrame:
    """Steps not completed whose dependencies all are; ``completed``: workflow_id, step_id."""
    done = completed.select(G, "step_id").distinct()
    open_deps = edges.join(done.withColumnRenamed("step_id", "src"), [G, "src"], "left_anti")
    waiting = open_deps.select(G, F.col("dst").alias("step_id"))
    return nodes.join(done, [G, "step_id"], "left_anti").join(waiting, [G, "step_id"], "left_anti")


def met_dependencies(completed: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, workflow_id, step_id, n_met: how many dependencies of a step a run has completed.

    Counts of batches of different completions add up, so a stored table of them is brought up
    to date by the completions that are new: ``add_met(stored, met_dependencies(new, edges))``.
    """
    done = completed.select("run_id", G, F.col("step_id").alias("src")).distinct()
    return done.join(edges, [G, "src"]).groupBy("run_id", G, F.col("dst").alias("step_id")).agg(F.count(F.lit(1)).alias("n_met"))


def add_met(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.unionByName(new).groupBy("run_id", G, "step_id").agg(F.sum("n_met").alias("n_met"))


def ready_by_run(runs: DataFrame, nodes: DataFrame, edges: DataFrame, completed: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """run_id, workflow_id and step_id of what each run can start: not completed, all dependencies completed.

    ``runs``: run_id, workflow_id. ``completed``: run_id, workflow_id, step_id; rows may repeat, and those
    of other runs count for nothing. ``met`` holds counts kept by ``add_met``; without it all
    completions are counted. Only roots and steps with a completed dependency are looked at. A
    dependency that nobody defines is never completed.
    """
    runs = runs.select("run_id", G).distinct()
    met = met_dependencies(completed, edges) if met is None else met
    needs = edges.groupBy(G, F.col("dst").alias("step_id")).agg(F.count(F.lit(1)).alias("n_deps"))
    full = met.join(needs, [G, "step_id"]).where("n_met = n_deps").join(runs, ["run_id", G], "left_semi")
    starts = runs.join(root_steps(nodes, edges), G).select("run_id", G, "step_id")
    done = completed.select("run_id", G, "step_id")
    return starts.unionByName(full.select("run_id", G, "step_id")).join(done, ["run_id", G, "step_id"], "left_anti")


# --- waves and order ---------------------------------------------------------


def _known(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with both ids, and the different edges into them."""
    nodes = nodes.filter(f"{G} is not null and step_id is not null").select(G, "step_id").distinct()
    links = edges.filter("src is not null").select(G, "src", "dst").distinct()
    return nodes, links.join(nodes.withColumnRenamed("step_id", "dst"), [G, "dst"], "left_semi").select(G, "src", "dst")


def execution_waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """workflow_id, step_id and wave of every step that can run.

    ``wave`` counts from 0 and is the longest way from a root. Steps on or behind a cycle or an
    undefined dependency have no row. An edge to an undefined step counts for nothing; rows
    without a graph or step id take no part.

    A row (src, dst, n) says that dst comes at least n waves after src, without src that its wave is n
    at least. Each round settles the steps without open dependencies. A row from a settled
    step becomes a number; a row from a step with one open dependency goes over to that
    dependency. Every round settles some step as long as any can run. All other rows stay as they
    are and are not shuffled by src. A row that comes to equal another in src and dst stays beside it.
    """
    stage = Staging(nodes.sparkSession, "waves")
    nodes, links = _known(nodes, edges)
    none, zero, one = F.lit(None).cast("string"), F.lit(0).cast("long"), F.lit(1).cast("long")
    start = nodes.select(G, none.alias("src"), F.col("step_id").alias("dst"), zero.alias("n")).unionByName(
        links.select(G, "src", "dst", one.alias("n"))
    )
    rows, seen = stage.put_measured(start, "rows-0", n=F.count(F.lit(1)))
    most = F.lit(seen["n"]).cast("long")  # a longer way runs round a cycle
    open_ = F.col("src").isNotNull()
    fields, rounds = None, []
    while True:
        state = rows.groupBy(G, F.col("dst").alias("step_id")).agg(
            F.min("src").alias("low"), F.max("src").alias("via"), F.max(F.when(open_, F.col("n"))).alias("more"),
            F.max(F.when(~open_, F.col("n"))).alias("least"),
        )
        # None, one or several: how many rows there are does not matter.
        n_open = F.when(F.col("via").isNull(), 0).when(F.col("low") == F.col("via"), 1).otherwise(2)
        state = state.withColumn("n_open", n_open).drop("low")
        name = f"round={len(rounds)}"
        state, seen = stage.put_measured(
            state.withColumn("settled", F.col("n_open") == 0), name, ("settled",),
            n_settled=F.count_if(F.col("n_open") == 0), n_rest=F.count_if(F.col("n_open") > 0),
        )
        fields = fields or T.StructType([f for f in state.schema.fields if f.name != "settled"] + [T.StructField("settled", T.BooleanType())])
        rounds.append(name)
        if not seen["n_settled"] or not seen["n_rest"]:
            break
        # A row must not go over to a step that is settled just now: that one is never met again.
        settled = state.filter("settled").select(G, F.col("step_id").alias("via"), F.col("least").alias("via_wave"))
        source = state.filter("n_open < 2").drop("settled").withColumnRenamed("step_id", "src").join(settled, [G, "via"], "left")
        far, sum_ = lambda a: F.least(a, most), F.col("n") + F.col("least")
        row = lambda src, n: F.struct(src.alias("src"), n.alias("n"))
        passed = F.when(F.col("n_open") == 0, F.array(row(none, sum_))).when(
            F.col("via_wave").isNotNull() & (F.col("n_open") == 1), F.array(row(none, F.greatest(sum_, F.col("n") + F.col("more") + F.col("via_wave"))))
        ).when(
            F.col("n_open") == 1, F.array(row(F.col("via"), far(F.col("n") + F.col("more"))), row(none, far(sum_)))
        ).otherwise(F.array(row(F.col("src"), F.col("n"))))
        moved = rows.filter(open_).join(source, [G, "src"], "left").select(G, "dst", F.explode(passed).alias("r"))
        held = state.filter("not settled").select(G, none.alias("src"), F.col("step_id").alias("dst"), F.col("least").alias("n"))
        both = moved.select(G, "r.src", "dst", "r.n").unionByName(held)
        rows = stage.put(both, f"rows-{len(rounds)}")
    done = stage.scan(fields, *rounds).filter("settled")
    return done.select(G, "step_id", F.col("least").cast("int").alias("wave"))


def execution_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As ``execution_waves``, with the position of each step.

    ``position`` is the place, from 1, in a first-in-first-out topological order whose ties go
    by id: inside a wave, steps follow the last of their dependencies, then id. Only dependencies
    of the wave before matter. Waves in which a step has several of these begin a stretch:
    its first wave is ranked by the ranks before it. In the rest of a stretch each step has one
    such dependency, and ranks come by doubling: the order by the last 2k ids on the way is
    the order by the rank k steps up and the own rank.
    """
    stage = Staging(nodes.sparkSession, "order")
    nodes, links = _known(nodes, edges)
    waves = stage.put(execution_waves(nodes, links), "waves")
    above = waves.select(G, F.col("step_id").alias("src"), (F.col("wave") + 1).alias("wave"))
    tight = links.join(waves.withColumnRenamed("step_id", "dst"), [G, "dst"]).join(above, [G, "src", "wave"])
    tight = stage.put(tight.select(G, "src", "dst", "wave"), "tight-edges")
    several = tight.groupBy(G, F.col("dst").alias("step_id")).agg(F.count(F.lit(1)).alias("n_up"), F.max("src").alias("up"))
    placed = waves.join(several, [G, "step_id"], "left")
    first = ((F.col("wave") == 0) | F.max(F.coalesce("n_up", F.lit(0)) > 1)).alias("first")
    starts = stage.put(placed.groupBy("wave").agg(first), "starts").withColumn("all", F.lit(0))
    stretch = scan_within(starts, ["all"], ["wave"], totals={"stretch": F.col("first").cast("long")}).drop("all")
    stretch = stage.put(stretch, "stretches")
    placed = stage.put(placed.join(stretch, "wave"), "placed", ("stretch",))
    tight = stage.put(tight.join(stretch.filter("first"), "wave"), "tight", ("stretch",))

    parts, before = [], None
    for r in stretch.groupBy("stretch").agg(F.count_if(~F.col("first")).alias("n_more")).orderBy("stretch").collect():
        here = placed.filter(F.col("stretch") == r.stretch)
        heads = here.filter("first").select(G, "step_id", "wave")
        if before is None:
            heads = ranked(heads, ["step_id"], "rank")
        else:
            last = tight.filter(F.col("stretch") == r.stretch).join(before, [G, "src"]).groupBy(G, F.col("dst").alias("step_id"))
            heads = ranked(heads.join(last.agg(F.max("rank").alias("at")), [G, "step_id"]), ["at", "step_id"], "rank")
        heads = stage.put(heads.select(G, "step_id", "wave", "rank"), f"heads-{r.stretch}")
        done = heads
        if r.n_more:
            rest = here.filter("not first").select(G, "step_id", "wave", "up")
            done = _rank_stretch(heads, rest, stage, str(r.stretch))
        parts.append(done)
        before = done.select(G, F.col("step_id").alias("src"), "rank")
    out = reduce(DataFrame.unionByName, parts or [waves.withColumn("rank", F.lit(0).cast("long"))])
    return positions_within(out, [G], ["wave", "rank"], "position").select(G, "step_id", "wave", "position")


def _rank_stretch(heads: DataFrame, rest: DataFrame, stage: Staging, name: str) -> DataFrame:
    """Ranks of steps that follow one dependency each (``up``), down from ranked ones."""
    settled = [heads]
    moving, k = stage.put(ranked(rest, ["step_id"], "rank"), f"moving-{name}-0"), 0
    while True:
        known = reduce(DataFrame.unionByName, [s.withColumn("up", F.lit(None).cast("string")) for s in settled], moving)
        known = known.select(G, F.col("step_id").alias("up"), F.col("rank").alias("above"), F.col("up").alias("next"))
        joined = ranked(moving.join(known, [G, "up"]), ["above", "rank"], "new_rank")
        k += 1
        moved, seen = stage.put_measured(
            joined.select(G, "step_id", "wave", F.col("next").alias("up"), F.col("new_rank").alias("rank")), f"moving-{name}-{k}",
            n_moving=F.count("up"),
        )
        settled.append(moved.filter("up is null").drop("up"))
        moving = moved.filter("up is not null")
        if not seen["n_moving"]:
            return reduce(DataFrame.unionByName, settled)


def wave_pages(order: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Sorted step ids per wave as arrays; a wide wave takes several pages."""
    pages = paged(order.select(G, "wave", "step_id"), [G, "wave"], ["step_id"], page_rows)
    return pages.groupBy(G, "wave", "page").agg(F.sort_array(F.collect_list("step_id")).alias("steps"))


def order_pages(order: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The topological order as arrays, page by page."""
    page = F.floor((F.col("position") - 1) / page_rows).cast("long").alias("page")
    listed = F.sort_array(F.collect_list(F.struct("position", "step_id")))
    grouped = order.groupBy(G, page).agg(listed.alias("_l"))
    return grouped.select(G, "page", F.col("_l.step_id").alias("steps"))


def unordered_steps(nodes: DataFrame, order: DataFrame) -> DataFrame:
    """Steps that can never run."""
    return nodes.join(order.select(G, "step_id"), [G, "step_id"], "left_anti")


# --- cycles --------------------------------------------------------------------


def proper_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between two different defined steps."""
    known = nodes.select(G, F.col("step_id").alias("src"))
    return edges.filter(F.col("src") != F.col("dst")).join(known, [G, "src"], "left_semi").select(G, "src", "dst")


def reaching_cycle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps from which some cycle can be reached (the cycle's own steps included)."""
    backwards = edges.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return unordered_steps(nodes, execution_waves(nodes, backwards))


def _between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    src, dst = nodes.select(G, F.col("step_id").alias("src")), nodes.select(G, F.col("step_id").alias("dst"))
    return edges.join(src, [G, "src"], "left_semi").join(dst, [G, "dst"], "left_semi").select(G, "src", "dst")


def cycle_core(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps on a cycle or on a way from one cycle to another."""
    stage = Staging(nodes.sparkSession, "core")
    proper = stage.put(proper_edges(nodes, edges), "edges")
    rest = stage.put(reaching_cycle(nodes, proper), "rest")
    return unordered_steps(rest, execution_waves(rest, _between(proper, rest)))


def cycle_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """workflow_id, step_id and component of every step on a cycle; steps on one cycle share it.

    A component is named by its smallest step. Steps that no cycle reaches, or that reach none,
    are trimmed away first. Then each step is coloured by the smallest step that reaches it; the
    steps of a colour that reach the step it is named by are its component. They are set
    aside, and the rest is coloured anew. Steps between two cycles end up alone and have no row;
    a dependency on itself is no cycle here (``self_dependencies``).
    """
    stage = Staging(nodes.sparkSession, "components")
    core = stage.put(cycle_core(nodes, edges), "core")
    links = stage.put(_between(proper_edges(core, edges), core).distinct(), "links")
    parts, k = [], 0
    while not core.isEmpty():
        coloured = _least_reaching(core.select(G, "step_id", F.col("step_id").alias("own")), links, stage, f"colour-{k}")
        colour = coloured.select(G, "step_id", F.col("least").alias("component"))
        src, dst = colour.withColumnsRenamed({"step_id": "src", "component": "c"}), colour.withColumnsRenamed({"step_id": "dst", "component": "d"})
        inside = links.join(src, [G, "src"]).join(dst, [G, "dst"]).filter("c = d")
        backwards = stage.put(inside.select(G, F.col("dst").alias("src"), F.col("src").alias("dst")), f"backwards-{k}")
        named = colour.select(G, "step_id", F.when(F.col("step_id") == F.col("component"), 0).otherwise(1).alias("own"))
        back = _least_reaching(named, backwards, stage, f"back-{k}").filter("least = 0").select(G, "step_id")
        parts.append(stage.put(colour.join(back, [G, "step_id"]), f"found-{k}"))
        core = stage.put(core.join(back, [G, "step_id"], "left_anti"), f"core-{k}")
        links = stage.put(_between(links, core), f"links-{k}")
        k += 1
    if not parts:
        return core.withColumn("component", F.col("step_id"))
    found = reduce(DataFrame.unionByName, parts)
    several = found.groupBy(G, "component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.join(several, [G, "component"]).select(G, "step_id", "component")


def _least_reaching(nodes: DataFrame, links: DataFrame, stage: Staging, name: str) -> DataFrame:
    """workflow_id, step_id, least: the smallest ``own`` of the steps that reach a step, itself included.

    Values are pulled over the links. A link from a step with one link of its own goes over to
    that one's source and carries the least value on the way, so unbranched stretches and plain
    rings take as many rounds as the logarithm of their length. Ends when no value changes.
    """
    kind = nodes.schema["own"].dataType
    none, blank = F.lit(None).cast("string"), F.lit(None).cast(kind)
    open_ = F.col("src").isNotNull()
    start = nodes.select(G, none.alias("src"), F.col("step_id").alias("dst"), F.col("own").alias("m"), F.lit(True).alias("old"))
    rows = start.unionByName(links.select(G, "src", "dst", blank.alias("m"), F.lit(False).alias("old")))
    rows, k = stage.put(rows, f"{name}-rows-0"), 0
    while True:
        state = rows.groupBy(G, F.col("dst").alias("step_id")).agg(
            F.count("src").alias("n_open"), F.max("src").alias("via"), F.min(F.when(open_, F.col("m"))).alias("passed"),
            F.min(F.when(~open_, F.col("m"))).alias("least"), F.min(F.when(F.col("old"), F.col("m"))).alias("before"),
        )
        state, seen = stage.put_measured(
            state, f"{name}-state-{k}", n_changed=F.count_if(F.col("least") < F.col("before")), n_linked=F.count_if(F.col("n_open") > 0)
        )
        if not seen["n_linked"] or (k and not seen["n_changed"]):
            return state.select(G, "step_id", "least")
        source = state.select(G, F.col("step_id").alias("src"), "n_open", "via", "passed", "least")
        row = lambda src, m, old: F.struct(src.alias("src"), m.alias("m"), F.lit(old).alias("old"))
        pulled = row(none, F.least("m", "least"), False)
        onward = F.when(F.col("n_open") == 0, F.array(pulled)).when(
            F.col("n_open") == 1, F.array(pulled, row(F.col("via"), F.least("m", "least", "passed"), False))
        ).otherwise(F.array(pulled, row(F.col("src"), F.col("m"), False)))
        moved = rows.filter(open_).join(source, [G, "src"]).select(G, "dst", F.explode(onward).alias("r"))
        held = state.select(G, none.alias("src"), F.col("step_id").alias("dst"), F.col("least").alias("m"), F.lit(True).alias("old"))
        # A link of a step to itself has told all it knows.
        both = moved.select(G, "r.src", "dst", "r.m", "r.old").filter("src is null or src <> dst").unionByName(held)
        k += 1
        rows = stage.put(both.groupBy(G, "src", "dst", "old").agg(F.min("m").alias("m")), f"{name}-rows-{k}")


def first_cycle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The cycle a sorted depth-first search meets first, one per cyclic graph.

    Such a search only ever comes back from steps that reach no cycle. So it goes
    from the smallest step that reaches one, always on to the smallest dependent
    that does, until a step comes up again. That walk is found by doubling: a
    table of 2^k-step jumps extends a walk of 2^k steps to twice its length.

    Rows (workflow_id, seq, step_id), seq from 0; the first step is named again
    at the end.
    """
    stage = Staging(nodes.sparkSession, "cycle")
    proper = stage.put(proper_edges(nodes, edges), "edges")
    rest = stage.put(reaching_cycle(nodes, proper), "rest")
    jump = stage.put(
        _between(proper, rest).groupBy(G, F.col("src").alias("step_id")).agg(F.min("dst").alias("next")), "jump-0"
    )
    walk = rest.groupBy(G).agg(F.min("step_id").alias("step_id")).withColumn("at", F.lit(0).cast("long"))
    walk, length, k, closed = stage.put(walk, "walk-0"), 1, 0, []
    while True:
        k += 1
        onward = walk.join(jump, [G, "step_id"]).select(
            G, F.col("next").alias("step_id"), (F.col("at") + F.lit(length)).alias("at")
        )
        grown = stage.put(walk.select(G, "step_id", "at").unionByName(onward), f"walk-{k}")
        length *= 2
        met = grown.groupBy(G, "step_id").agg(F.count(F.lit(1)).alias("n"))
        open_graphs = stage.put(met.groupBy(G).agg(F.max("n").alias("n")).filter("n = 1").select(G), f"open-{k}")
        # Graphs whose walk has met itself are set aside and double no further.
        closed.append(grown.join(open_graphs, G, "left_anti"))
        walk = grown.join(open_graphs, G, "left_semi")
        if open_graphs.isEmpty():
            break
        jump = jump.join(open_graphs, G, "left_semi")
        twice = jump.select(G, F.col("step_id").alias("next"), F.col("next").alias("after"))
        jump = stage.put(jump.join(twice, [G, "next"]).select(G, "step_id", F.col("after").alias("next")), f"jump-{k}")
    walk = reduce(DataFrame.unionByName, closed)
    # The walk enters the cycle at the earliest step met twice.
    visits = walk.groupBy(G, "step_id").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n")
    )
    entry = visits.filter("n > 1").groupBy(G).agg(
        F.min(F.struct("first_at", ((F.col("last_at") - F.col("first_at")) / (F.col("n") - 1)).cast("long").alias("size"))).alias("e")
    )
    on_cycle = walk.join(entry, G).filter("at between e.first_at and e.first_at + e.size")
    return on_cycle.select(G, (F.col("at") - F.col("e.first_at")).alias("seq"), "step_id")


# --- reachability ----------------------------------------------------------------


#: Numbers that meet in one row of the closure, about; more take several rows, at most so many a step.
MET, ROWS_A_STEP = 1_000_000, 10_000


def transitive_dependencies(edges: DataFrame) -> DataFrame:
    """All pairs (workflow_id, ancestor, step_id) where the step depends on the ancestor.

    Steps go by numbers, and the ancestors of a step are two arrays: ``near`` holds those less than ``reach`` steps
    away, ``far`` those at that distance exactly. Each round doubles ``reach``: a shortest way of up to twice
    as many steps passes a step of ``far``, which hands its own ancestors on. Arrays that might outgrow a row
    are dealt over several by hash. Ends on cyclic graphs too. A dependency without an id is
    an ancestor like others; nothing depends on a step without an id or graph.
    """
    stage = Staging(edges.sparkSession, "reach")
    links = stage.put(edges.select(G, "src", "dst").distinct(), "links")
    ends = [links.select(G, F.col(end).alias("step_id"), F.lit(0).alias("all")) for end in ("src", "dst")]
    names = positions_within(ends[0].unionByName(ends[1]).distinct(), ["all"], [G, "step_id"], "id").drop("all")
    names, seen = stage.put_measured(names, "names", n=F.count(F.lit(1)))
    kind = "int" if seen["n"] < 2**31 else "long"
    names = names.withColumn("id", F.col("id").cast(kind))
    none = F.array().cast(f"array<{kind}>")

    def numbered(df: DataFrame, end: str, to: str) -> DataFrame:
        named = names.select(F.col(G).alias("g"), F.col("step_id").alias("s"), F.col("id").alias(to))
        return df.join(named, F.col(G).eqNullSafe(F.col("g")) & F.col(end).eqNullSafe(F.col("s"))).drop("g", "s")

    sound = F.col(G).isNotNull() & F.col("dst").isNotNull()
    pairs = stage.put(numbered(numbered(links, "src", "a"), "dst", "id").select("a", "id", sound.alias("sound")), "pairs")
    fed = pairs.select(F.col("a").alias("id"), F.lit(True).alias("fed")).distinct()
    direct = pairs.groupBy("id").agg(F.collect_list("a").alias("far"), F.every("sound").alias("sound")).join(fed, ["id"], "left")
    gives = F.col("sound") & F.coalesce("fed", F.lit(False))
    state = direct.select("id", F.lit(0).alias("page"), F.lit(1).alias("pages"), gives.alias("gives"), none.alias("near"), "far")

    k = 0
    while True:
        held = (F.col("pages") * (F.size("near") + F.size("far"))).cast("long")
        state, seen = stage.put_measured(
            state, f"round-{k}", n_far=F.sum(F.size("far")), far=F.max(F.size("far")), pages=F.max("pages"), held=F.max(F.when(F.col("gives"), held)),
        )
        if not seen["n_far"]:
            break
        # What may meet for a step; the same for all of its rows.
        n_far = F.when(F.col("pages") > 1, F.col("pages") * F.lit(float(seen["far"]))).otherwise(F.size("far"))
        wanted = F.least(F.ceil(n_far * F.lit(seen["held"] / MET)), F.lit(ROWS_A_STEP)).cast("int")
        step = ["id", "pages", "gives"]
        asking = state.withColumn("pages", F.greatest("pages", wanted))
        given = state.filter("gives").select(F.col("id").alias("at"), "near", "far")
        met = asking.select(*step, F.explode("far").alias("at")).join(given, "at").select(*step, "near", "far")
        met = met.unionByName(asking.select(*step, F.concat("near", "far").alias("near"), none.alias("far")))
        if seen["pages"] > 1 or seen["far"] * seen["held"] > MET:
            page = lambda x: F.pmod(F.xxhash64(x), F.col("pages")).cast("int").alias("page")
            one = lambda x: F.array(x)
            apart = F.concat(
                F.transform("near", lambda x: F.struct(page(x), one(x).alias("near"), none.alias("far"))),
                F.transform("far", lambda x: F.struct(page(x), none.alias("near"), one(x).alias("far"))),
            )
            whole = F.array(F.struct(F.lit(0).alias("page"), "near", "far"))
            met = met.select(*step, F.inline(F.when(F.col("pages") == 1, whole).otherwise(apart)))
        else:
            met = met.withColumn("page", F.lit(0))
        union = lambda x: F.array_distinct(F.flatten(F.collect_list(x))).alias(x)
        grown = met.groupBy("id", "page").agg(F.max("pages").alias("pages"), F.every("gives").alias("gives"), union("near"), union("far"))
        state = grown.withColumn("far", F.array_except("far", "near"))
        k += 1
    steps = names.select("id", "step_id")
    above = names.select(F.col("id").alias("a"), G, F.col("step_id").alias("ancestor"))
    # Pairs need no sort for this: what a task holds is its share of the names.
    named = state.join(steps, "id").select("step_id", F.explode("near").alias("a")).join(above.hint("shuffle_hash"), "a")
    return named.select(G, "ancestor", "step_id")


def _doubled(hops: DataFrame, stage: Staging, name: str) -> list[DataFrame]:
    """Tables (workflow_id, step_id, up) of 1, 2, 4, ... steps along ``hops``, which leads from a step to one other.

    Ends where no way is that long, or where it must have gone round a ring.
    """
    table, seen = stage.put_measured(hops, f"{name}-0", n=F.count(F.lit(1)))
    tables, most, n = [], seen["n"], seen["n"]
    while n and 2 ** len(tables) <= most:
        tables.append(table)
        above = table.select(G, F.col("step_id").alias("up"), F.col("up").alias("top"))
        longer = table.join(above, [G, "up"]).select(G, "step_id", F.col("top").alias("up"))
        table, seen = stage.put_measured(longer, f"{name}-{len(tables)}", n=F.count(F.lit(1)))
        n = seen["n"]
    return tables


#: Marks that travel together, as the bits of one number.
MARKS = 64


def carried(marks: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow_id, step_id, mark): the marks of all steps that a step depends on at any distance.

    ``marks``: workflow_id, step_id, mark, a number from 0 on. Steps go by numbers, and the marks of a step by the bits
    of one number for each page of ``MARKS``, so what travels grows with steps rather than pairs where marks are few.
    Steps with one dependency are passed over: by doubling, each gets the marks up to the first step above
    that has several or none. Rounds only lead between steps with several dependencies and send what is new
    there. Ends on cyclic graphs too; a mark on a cycle comes back to its own step.
    """
    stage = Staging(edges.sparkSession, "carried")
    links = stage.put(edges.filter(f"{G} is not null and src is not null").select(G, "src", "dst").distinct(), "links")
    ends = links.select(G, F.col("src").alias("step_id")).unionByName(links.select(G, F.col("dst").alias("step_id")))
    names = positions_within(ends.distinct().withColumn("all", F.lit(0)), ["all"], [G, "step_id"], "id").drop("all")
    names = stage.put(names, "names")
    source = names.select(G, F.col("step_id").alias("src"), F.col("id").alias("a"))
    target = names.select(F.col(G).alias("g"), F.col("step_id").alias("s"), "id")
    # A dependent without an id is a step like others, on which nothing depends.
    pairs = links.join(source, [G, "src"]).join(target, (F.col(G) == F.col("g")) & F.col("dst").eqNullSafe(F.col("s")))
    pairs = stage.put(pairs.select("a", "id"), "pairs")

    page, bit = F.floor(F.col("mark") / MARKS).cast("long"), F.expr(f"shiftleft(1L, cast(mark % {MARKS} as int))")
    met = lambda df: df.groupBy("id", "page").agg(F.bit_or("bits").alias("bits"))
    own = marks.join(names, [G, "step_id"]).select("id", page.alias("page"), bit.alias("bits"))
    own = stage.put(met(own), "own")
    handed = lambda to, of: to.join(of.withColumnRenamed("id", "a"), "a").select("id", "page", "bits")

    degree = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("a").alias("a"))
    degree = stage.put(degree, "degree")
    up, seen = stage.put_measured(degree.filter("n = 1").select("id", "a"), "up-0", n=F.count(F.lit(1)))
    above, k = stage.put(met(handed(up, own)), "above-0"), 0
    # Past so many steps as there are, a way has gone round a ring, and all of its marks are met.
    while 2**k <= 2 * seen["n"]:
        k += 1
        further = up.join(up.select(F.col("id").alias("a"), F.col("a").alias("top")), "a", "left")
        longer, moved = stage.put_measured(further, f"longer-{k}", n=F.count("top"))
        if not moved["n"]:
            break
        above = stage.put(met(above.unionByName(handed(longer.filter("top is not null").select("id", "a"), above))), f"above-{k}")
        up = longer.select("id", F.coalesce("top", "a").alias("a"))

    several = degree.filter("n > 1").select("id")
    branches = stage.put(pairs.join(several, "id", "left_semi"), "branches")
    top = up.select(F.col("id").alias("a"), F.col("a").alias("top"))
    between = branches.join(top, "a", "left").select(F.coalesce("top", "a").alias("a"), "id").distinct()
    between = stage.put(between.join(several.withColumnRenamed("id", "a"), "a", "left_semi"), "between")
    start = met(handed(branches, own.unionByName(above)))
    state, seen = stage.put_measured(start.withColumn("fresh", F.col("bits")), "round-0", n=F.count(F.lit(1)))
    k, none = 0, F.lit(0).cast("long")
    while seen["n"]:
        k += 1
        sent = handed(between, state.filter("fresh <> 0").select("id", "page", F.col("fresh").alias("bits")))
        both = state.select("id", "page", "bits", none.alias("got")).unionByName(sent.select("id", "page", none.alias("bits"), F.col("bits").alias("got")))
        both = both.groupBy("id", "page").agg(F.bit_or("bits").alias("bits"), F.bit_or("got").alias("got"))
        fresh = F.col("got").bitwiseAND(F.bitwise_not("bits"))
        both = both.select("id", "page", F.col("bits").bitwiseOR(F.col("got")).alias("bits"), fresh.alias("fresh"))
        state, seen = stage.put_measured(both, f"round-{k}", n=F.count_if(F.col("fresh") != 0))
    state = state.select("id", "page", "bits")
    found = state.unionByName(met(above.unionByName(handed(up, state)))).join(names, "id")
    each = F.expr(f"filter(sequence(0, {MARKS - 1}), b -> getbit(bits, b) = 1)")
    return found.select(G, "step_id", "page", F.explode(each).alias("b")).select(G, "step_id", (F.col("page") * MARKS + F.col("b")).alias("mark"))


def reached_from(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow_id, step_id, at): all steps ``at`` that can be reached from a seed step.

    ``seeds``: workflow_id, step_id. Each seed is a mark of its own (``carried``); one on a cycle reaches itself.
    """
    stage = Staging(edges.sparkSession, "seeded")
    known = seeds.filter(f"{G} is not null and step_id is not null").select(G, "step_id").distinct()
    marked = stage.put(positions_within(known, [G], ["step_id"], "mark"), "marks")
    down = carried(marked, edges).withColumnRenamed("step_id", "at")
    return down.join(marked, [G, "mark"]).select(G, "step_id", "at")


def blocked_steps(failed: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps that cannot start because a step they depend on failed.

    ``failed``: run_id, workflow_id, step_id. What goes down a definition are its runs or its failed steps, whichever
    are fewer: many runs of a few failed steps cost no more than these steps, many failed steps of a few runs no more than these runs.
    """
    stage = Staging(edges.sparkSession, "blocked")
    failed = failed.filter(f"{G} is not null and step_id is not null").select("run_id", G, "step_id").distinct()
    failed = stage.put(failed, "failed")
    fewer = failed.groupBy(G).agg((F.count_distinct("run_id") <= F.count_distinct("step_id")).alias("by_run"))
    mine = [F.when(F.col("by_run"), F.col("run_id")).alias("run"), F.when(~F.col("by_run"), F.col("step_id")).alias("step")]
    kept, seen = stage.put_measured(failed.join(fewer, G).select("*", *mine), "kept", n_by_step=F.count_if(~F.col("by_run")))
    marks = positions_within(kept.select(G, "run", "step").distinct(), [G], ["run", "step"], "mark")
    marks = marks.select(F.col(G).alias("g"), F.col("run").alias("r"), F.col("step").alias("s"), "mark")
    same = (F.col(G) == F.col("g")) & F.col("run").eqNullSafe(F.col("r")) & F.col("step").eqNullSafe(F.col("s"))
    marked = stage.put(kept.join(marks, same).select("run_id", G, "step_id", "by_run", "mark"), "marked")
    runs = stage.put(marked.select("run_id", G, "by_run", "mark").distinct(), "runs")
    down = carried(marked.select(G, "step_id", "mark"), edges)
    row = ["run_id", G, "step_id"]
    found = down.join(runs.filter("by_run").drop("by_run"), [G, "mark"]).select(*row)
    if not seen["n_by_step"]:
        return found
    # Several failed steps of a run may block the same step.
    return found.unionByName(down.join(runs.filter("not by_run").drop("by_run"), [G, "mark"]).select(*row).distinct())


def reaching_pairs(asked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of the asked pairs (workflow_id, ancestor, step_id) whose step depends on the ancestor at any distance.

    Every step that can run has two labels: its wave, and a place in a forest in which it hangs below
    one of its dependencies of the wave before. An ancestor of no earlier wave is none. One that is met by going up
    in the forest by the difference of the waves is one, which takes as many joins as that difference has binary
    digits. Pairs that this leaves open are searched upwards, past steps with one dependency at once, and only
    as far as the ancestor's wave. Steps on or behind a cycle have no labels; their pairs are followed back.
    """
    stage = Staging(nodes.sparkSession, "reaching")
    nodes, links = _known(nodes, edges)
    links = stage.put(links, "links")
    waves = stage.put(execution_waves(nodes, links), "waves")
    asked = asked.select(G, "ancestor", "step_id").distinct()
    labelled = asked.join(waves, [G, "step_id"], "left")
    earlier = waves.select(G, F.col("step_id").alias("ancestor"), F.col("wave").alias("a_wave"))
    open_ = labelled.filter("wave is not null").join(earlier, [G, "ancestor"]).filter("a_wave < wave")
    open_ = stage.put(open_.select(G, "ancestor", "step_id", "a_wave", F.col("step_id").alias("at"), "wave"), "asked")
    unlabelled = stage.put(labelled.filter("wave is null").select(G, "ancestor", "step_id"), "unlabelled")

    into = links.join(waves.withColumnRenamed("step_id", "dst"), [G, "dst"])
    above = waves.select(G, F.col("step_id").alias("src"), F.col("wave").alias("src_wave"))
    into = stage.put(into.join(above, [G, "src"]), "into")
    by_step = into.groupBy(G, F.col("dst").alias("step_id")).agg(
        F.max(F.when(F.col("src_wave") == F.col("wave") - 1, F.col("src"))).alias("up"), F.count(F.lit(1)).alias("n")
    )
    by_step = stage.put(by_step, "by-step")
    forest = _doubled(by_step.select(G, "step_id", "up"), stage, "forest")
    single = _doubled(by_step.filter("n = 1").select(G, "step_id", "up"), stage, "single")

    def climbed(df: DataFrame) -> DataFrame:
        """With ``top``, where the forest leads from ``at`` to in the ancestor's wave."""
        df = df.withColumns({"top": F.col("at"), "more": F.col("wave") - F.col("a_wave")})
        for k, table in enumerate(forest):
            up = table.select(G, F.col("step_id").alias("top"), F.col("up").alias("next"))
            df = df.join(up, [G, "top"], "left")
            digit = F.col("more").bitwiseAND(F.lit(1 << k)) > 0
            df = df.withColumn("top", F.when(digit, F.col("next")).otherwise(F.col("top"))).drop("next")
        return df.drop("more")

    def unbranched(df: DataFrame) -> DataFrame:
        """With ``at`` moved up to the first step with several dependencies, or none."""
        for table in reversed(single):
            up = table.select(G, F.col("step_id").alias("at"), F.col("up").alias("next"))
            df = df.join(up, [G, "at"], "left").withColumn("at", F.coalesce("next", "at")).drop("next")
        return df

    pair, found, k = [G, "ancestor", "step_id"], [], 0
    while True:
        tested, seen = stage.put_measured(
            climbed(open_).withColumn("met", F.col("top") == F.col("ancestor")), f"tested-{k}", n=F.count(F.lit(1)), n_met=F.count_if("met")
        )
        if not seen["n"]:
            break
        met = tested.filter("met").select(*pair).distinct()
        found.append(met)
        left = tested.filter("not met").join(met, pair, "left_anti").select(*pair, "a_wave", "at")
        higher = unbranched(left).distinct().join(into.select(G, F.col("dst").alias("at"), "src", "src_wave"), [G, "at"])
        k += 1
        open_ = higher.filter("src_wave >= a_wave").select(*pair, "a_wave", F.col("src").alias("at"), F.col("src_wave").alias("wave")).distinct()
    if not unlabelled.isEmpty():
        backwards = links.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"))
        up = reached_from(unlabelled, backwards).withColumnRenamed("at", "ancestor")
        found.append(unlabelled.join(up, pair, "left_semi"))
    return reduce(DataFrame.unionByName, found, unlabelled.limit(0)).distinct()


def undeclared_references(steps: DataFrame, edges: DataFrame, text: str = "inputs") -> DataFrame:
    """References to steps that are no (transitive) dependency, so may not be done yet.

    Only steps that name something beyond their direct dependencies are looked into.
    """
    refs = explode_references(steps.select(G, "step_id", text), text).filter(
        (F.col("source") != "workflow") & (F.col("kind") == "output")
    )
    asked = refs.select(G, "step_id", F.col("source").alias("ancestor")).distinct()
    direct = edges.select(G, F.col("src").alias("ancestor"), F.col("dst").alias("step_id"))
    asked = asked.join(direct, [G, "ancestor", "step_id"], "left_anti")
    asked = Staging(steps.sparkSession, "asked").put(asked, "references")
    met = reaching_pairs(asked, graph_nodes(steps), edges)
    return asked.join(met, [G, "ancestor", "step_id"], "left_anti").select(G, "step_id", "ancestor")


# --- report ----------------------------------------------------------------------


# Kinds and texts of faults.
DUPLICATE, UNDEFINED, CYCLE = "DuplicateStepIds", "InvalidGraphError", "CycleDetectedError"
DUPLICATE_TEXT = "Duplicate step IDs found in workflow: ['%s']"
UNDEFINED_TEXT = "Step '%s' depends on undefined step '%s'."
SELF_TEXT = "Step '%s' directly depends on itself (cycle: %s -> %s)."
CYCLE_TEXT = "Cycle detected in workflow graph: "


def graph_faults(steps: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """All faults of all graphs: workflow_id, error_rank, error_type, step_id, page, message.

    Rank 0 are steps defined twice, 1 undefined and self dependencies, 2 the cycle that a search
    meets first, with its path; a path of more than ``page_rows`` steps goes on in further
    pages. Everything else has the one page 0.
    """
    stage = Staging(steps.sparkSession, "faults")
    nodes, edges = stage.put(graph_nodes(steps), "nodes"), stage.put(graph_edges(steps), "edges")
    step, other = F.col("dst"), F.col("src")

    def rows(df: DataFrame, rank: int, kind: str, step_id, message, page=None) -> DataFrame:
        page = F.lit(0).cast("bigint") if page is None else page
        return df.select(
            G, F.lit(rank).alias("error_rank"), F.lit(kind).alias("error_type"), step_id.alias("step_id"),
            page.alias("page"), message.alias("message"),
        )

    path = first_cycle(nodes, edges).withColumn("page", F.expr(f"seq DIV {page_rows}"))
    pages = path.groupBy(G, "page").agg(F.array_sort(F.collect_list(F.struct("seq", "step_id"))).alias("path"))
    text = F.concat(F.when(F.col("page") == 0, CYCLE_TEXT).otherwise(" -> "), F.array_join("path.step_id", " -> "))
    found = [
        rows(duplicate_steps(steps), 0, DUPLICATE, F.col("step_id"), F.format_string(DUPLICATE_TEXT, "step_id")),
        rows(undefined_dependencies(nodes, edges), 1, UNDEFINED, step, F.format_string(UNDEFINED_TEXT, step, other)),
        rows(self_dependencies(edges), 1, CYCLE, step, F.format_string(SELF_TEXT, step, step, step)),
        rows(pages, 2, CYCLE, F.col("path")[0]["step_id"], text, F.col("page")),
    ]
    return reduce(DataFrame.unionByName, found)


def validation_report(steps: DataFrame) -> DataFrame:
    """One row per graph: counts, whether it is valid and the first kind of error.

    Order and waves of valid graphs come from ``execution_order`` and its pages.
    """
    stage = Staging(steps.sparkSession, "report")
    defined = stage.put(steps.groupBy(G, "step_id").agg(F.count(F.lit(1)).alias("n_defined")), "defined")
    nodes, edges = defined.select(G, "step_id"), stage.put(graph_edges(steps), "edges")
    order = stage.put(execution_waves(nodes, edges), "waves")

    def per_graph(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(G).agg(F.count(F.lit(1)).alias(name))

    counts = [
        order.groupBy(G).agg(F.count(F.lit(1)).alias("n_ordered"), (F.max("wave") + 1).cast("long").alias("n_waves")),
        per_graph(undefined_dependencies(nodes, edges), "n_undefined"),
        per_graph(self_dependencies(edges), "n_self"),
        per_graph(_cyclic(nodes, edges, order), "n_cyclic"),
    ]
    report = defined.groupBy(G).agg(
        F.sum("n_defined").alias("step_count"), F.count_if(F.col("n_defined") > 1).alias("n_duplicate")
    )
    for count in counts:
        report = report.join(count, G, "left")
    report = report.na.fill(0)
    kind = (
        F.when(F.col("n_duplicate") > 0, "DuplicateStepIds")
        .when(F.col("n_undefined") > 0, "InvalidGraphError")
        .when((F.col("n_self") > 0) | (F.col("n_cyclic") > 0), "CycleDetectedError")
    )
    return report.withColumn("error_type", kind).withColumn("valid", F.col("error_type").isNull())


def _cyclic(nodes, edges, order):
    """Steps that reach a cycle, looked for only in graphs that could not be ordered."""
    stuck = unordered_steps(nodes, order).select(G).distinct()
    some, links = nodes.join(stuck, G, "left_semi"), edges.join(stuck, G, "left_semi")
    return reaching_cycle(some, proper_edges(some, links))
