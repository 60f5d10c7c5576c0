"""Queries on dependency graphs.

``part`` gives one large graph: part k depends on k/2 and k/3, rounded down. Each
brand gives a small one with the same rule on its own numbering; some brands have
faults put in.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from heddlework.functions.ordering import positions_within
from heddlework.operators import graph as Gr
from heddlework.plans.catalog import joined, query, table

G = Gr.G


def _halves_and_thirds(k):
    parents = F.array_distinct(F.array((k / 2).cast("long"), (k / 3).cast("long")))
    return F.filter(parents, lambda x: x > 0)


def part_steps(spark, folder):
    """One graph; the list of dependencies holds a repeat, which counts once."""
    k = F.col("p_partkey")
    parents = F.transform(_halves_and_thirds(k), lambda x: x.cast("string"))
    return table(spark, folder, "part").select(
        F.lit("parts").alias(G), k.cast("string").alias("step_id"), F.concat(parents, parents).alias("depends_on")
    )


PART_SQL = """
WITH RECURSIVE node AS (SELECT 'parts' AS workflow_id, CAST(p_partkey AS VARCHAR) AS step_id FROM part),
edge AS (
  SELECT DISTINCT 'parts' AS workflow_id, CAST(src AS VARCHAR) AS src, CAST(p_partkey AS VARCHAR) AS dst
  FROM (SELECT p_partkey, unnest([p_partkey // 2, p_partkey // 3]) AS src FROM part) WHERE src > 0)
"""

# Brands with an odd number get the cycle s2 -> s4 -> s2; every fifth s3 -> .. -> s27 -> s3
# as well; every seventh a dependency nobody defines; brand 11 a step on itself;
# brand 13 defines one step twice.
BRAND_SQL = """
WITH RECURSIVE raw AS (
  SELECT p_brand AS workflow_id, CAST(substr(p_brand, 7) AS INTEGER) AS b,
         row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part),
step AS (
  SELECT workflow_id, 's' || CASE WHEN b = 13 AND r = 8 THEN 7 ELSE r END AS step_id,
         list_filter(['s' || nullif(r // 2, 0), 's' || nullif(r // 3, 0),
          CASE WHEN b % 2 = 1 AND r = 2 THEN 's4' END, CASE WHEN b % 5 = 0 AND r = 3 THEN 's27' END,
          CASE WHEN b % 7 = 0 AND r = 5 THEN 'absent' END, CASE WHEN b = 11 AND r = 6 THEN 's6' END],
          lambda x: x IS NOT NULL) AS depends_on
  FROM raw),
node AS (SELECT DISTINCT workflow_id, step_id FROM step),
edge AS (SELECT DISTINCT workflow_id, src, dst FROM (SELECT workflow_id, step_id AS dst, unnest(depends_on) AS src FROM step)),
proper AS (SELECT e.* FROM edge e SEMI JOIN node n ON e.workflow_id = n.workflow_id AND e.src = n.step_id WHERE src <> dst),
reach AS (
  SELECT workflow_id, src AS a, dst AS z FROM proper
  UNION SELECT r.workflow_id, r.a, p.dst FROM reach r JOIN proper p ON r.workflow_id = p.workflow_id AND r.z = p.src),
looped AS (SELECT workflow_id, a AS step_id FROM reach WHERE a = z)
"""


def brand_steps(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_brand").alias(G), "p_partkey")
    numbered = positions_within(p, [G], ["p_partkey"], "r")
    b, r = F.substring(F.col(G), 7, 10).cast("int"), F.col("r")
    faults = F.array(
        F.when((b % 2 == 1) & (r == 2), "s4"),
        F.when((b % 5 == 0) & (r == 3), "s27"),
        F.when((b % 7 == 0) & (r == 5), "absent"),
        F.when((b == 11) & (r == 6), "s6"),
    )
    parents = F.transform(_halves_and_thirds(r), lambda x: F.concat(F.lit("s"), x.cast("string")))
    name = F.when((b == 13) & (r == 8), F.lit(7).cast("long")).otherwise(r).cast("string")
    return numbered.select(
        G, F.concat(F.lit("s"), name).alias("step_id"), F.concat(parents, F.array_compact(faults)).alias("depends_on")
    )


def _part_graph(spark, folder):
    steps = part_steps(spark, folder)
    return Gr.graph_nodes(steps), Gr.graph_edges(steps)


def _brand_graphs(spark, folder):
    steps = brand_steps(spark, folder)
    return Gr.graph_nodes(steps), Gr.graph_edges(steps)


@query("graph_edges", PART_SQL + "SELECT * FROM edge")
def graph_edges(spark, folder):
    return _part_graph(spark, folder)[1]


@query(
    "graph_undefined",
    BRAND_SQL + "SELECT e.workflow_id, e.src, e.dst FROM edge e ANTI JOIN node n ON e.workflow_id = n.workflow_id AND e.src = n.step_id",
)
def graph_undefined(spark, folder):
    return Gr.undefined_dependencies(*_brand_graphs(spark, folder))


@query("graph_self", BRAND_SQL + "SELECT workflow_id, src, dst FROM edge WHERE src = dst")
def graph_self(spark, folder):
    return Gr.self_dependencies(_brand_graphs(spark, folder)[1])


@query(
    "graph_duplicates",
    BRAND_SQL + "SELECT workflow_id, step_id, count(*) AS n_defined FROM step GROUP BY workflow_id, step_id HAVING count(*) > 1",
)
def graph_duplicates(spark, folder):
    return Gr.duplicate_steps(brand_steps(spark, folder))


@query("graph_dependencies", BRAND_SQL + "SELECT workflow_id, src AS step_id FROM edge WHERE dst = 's9'")
def graph_dependencies(spark, folder):
    return Gr.dependencies_of(_brand_graphs(spark, folder)[1], "s9")


@query("graph_dependents", BRAND_SQL + "SELECT workflow_id, dst AS step_id FROM edge WHERE src = 's3'")
def graph_dependents(spark, folder):
    return Gr.dependents_of(_brand_graphs(spark, folder)[1], "s3")


@query("graph_roots", PART_SQL + "SELECT n.* FROM node n ANTI JOIN edge e ON n.workflow_id = e.workflow_id AND n.step_id = e.dst")
def graph_roots(spark, folder):
    return Gr.root_steps(*_part_graph(spark, folder))


_READY_SQL = """, done AS (SELECT 'parts' AS workflow_id, CAST(p_partkey AS VARCHAR) AS step_id FROM part WHERE p_size <= 40)
SELECT n.* FROM node n ANTI JOIN done d ON n.step_id = d.step_id
ANTI JOIN (SELECT e.dst FROM edge e ANTI JOIN done d ON e.src = d.step_id) w ON n.step_id = w.dst
"""


@query("graph_ready", PART_SQL + _READY_SQL)
def graph_ready(spark, folder):
    done = table(spark, folder, "part").filter("p_size <= 40")
    completed = done.select(F.lit("parts").alias(G), F.col("p_partkey").cast("string").alias("step_id"))
    return Gr.ready_steps(*_part_graph(spark, folder), completed)


@query(
    "graph_ready_by_run",
    PART_SQL + """, run AS (SELECT 'run_' || k AS run_id, 12 * k AS upto FROM (VALUES (0), (1), (2), (3)) v(k)),
    done AS (SELECT run_id, CAST(p_partkey AS VARCHAR) AS step_id FROM part JOIN run ON p_size <= upto)
    SELECT r.run_id, n.workflow_id, n.step_id FROM run r CROSS JOIN node n
    ANTI JOIN done d ON r.run_id = d.run_id AND n.step_id = d.step_id
    ANTI JOIN (SELECT q.run_id, e.dst FROM run q CROSS JOIN edge e ANTI JOIN done d ON q.run_id = d.run_id AND e.src = d.step_id) w
      ON r.run_id = w.run_id AND n.step_id = w.dst
    """,
)
def graph_ready_by_run(spark, folder):
    """Four runs of one graph; the second half of what they complete is added to kept counts."""
    nodes, edges = _part_graph(spark, folder)
    sizes = table(spark, folder, "part").select("p_size", F.col("p_partkey").cast("string").alias("step_id"))
    runs = F.filter(F.sequence(F.lit(1), F.lit(3)), lambda k: F.col("p_size") <= 12 * k)
    done = sizes.select(F.explode(runs).alias("k"), "p_size", "step_id")
    done = done.select(F.concat(F.lit("run_"), F.col("k").cast("string")).alias("run_id"), F.lit("parts").alias(G), "step_id", "p_size")
    met = [Gr.met_dependencies(done.where(f"p_size % 2 = {k}"), edges) for k in (0, 1)]
    all_runs = spark.range(4).select(F.concat(F.lit("run_"), F.col("id").cast("string")).alias("run_id"), F.lit("parts").alias(G))
    return Gr.ready_by_run(all_runs, nodes, edges, done, Gr.add_met(*met))


# A step's key is the list of ids along its latest dependencies, one per wave;
# comparing such lists compares the steps' places in a first-in-first-out order.
_ORDER_SQL = """,
depth AS (
  SELECT step_id, 0 AS d FROM node ANTI JOIN edge ON step_id = dst
  UNION SELECT e.dst, d + 1 FROM depth JOIN edge e ON step_id = e.src),
waved AS (SELECT step_id, max(d) AS wave FROM depth GROUP BY step_id),
walk AS (
  SELECT step_id, wave, [step_id] AS path FROM waved WHERE wave = 0
  UNION ALL
  SELECT n.step_id, n.wave, list_append(w.path, n.step_id) FROM walk w JOIN edge e ON e.src = w.step_id
  JOIN waved n ON n.step_id = e.dst AND n.wave = w.wave + 1),
placed AS (SELECT step_id, wave, max(path) AS path FROM walk GROUP BY step_id, wave)
"""


@query(
    "graph_order",
    PART_SQL + _ORDER_SQL + """SELECT 'parts' AS workflow_id, step_id, wave, row_number() OVER (ORDER BY wave, path) AS position FROM placed""",
)
def graph_order(spark, folder):
    return Gr.execution_order(*_part_graph(spark, folder))


@query(
    "graph_wave_pages",
    PART_SQL + _ORDER_SQL + """, paged AS (
      SELECT wave, step_id, (row_number() OVER (PARTITION BY wave ORDER BY step_id) - 1) // 100 AS page FROM waved)
    SELECT 'parts' AS workflow_id, wave, page, string_agg(step_id, ',' ORDER BY step_id) AS steps FROM paged GROUP BY wave, page
    """,
)
def graph_wave_pages(spark, folder):
    order = Gr.execution_waves(*_part_graph(spark, folder))
    return Gr.wave_pages(order, page_rows=100).withColumn("steps", joined("steps"))


@query(
    "graph_order_pages",
    PART_SQL + _ORDER_SQL + """, numbered AS (SELECT step_id, row_number() OVER (ORDER BY wave, path) AS position FROM placed)
    SELECT 'parts' AS workflow_id, (position - 1) // 100 AS page, string_agg(step_id, ',' ORDER BY position) AS steps
    FROM numbered GROUP BY page
    """,
)
def graph_order_pages(spark, folder):
    order = Gr.execution_order(*_part_graph(spark, folder))
    return Gr.order_pages(order, page_rows=100).withColumn("steps", joined("steps"))


@query(
    "graph_chains",
    """
    SELECT 'conv_' || conv_id AS workflow_id, 't' || turn AS step_id,
           CAST(rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS wave,
           rank() OVER (PARTITION BY conv_id ORDER BY turn) AS position
    FROM (SELECT DISTINCT conv_id, turn FROM conversations)
    """,
)
def graph_chains(spark, folder):
    c = table(spark, folder, "conversations")
    before = F.when(F.col("turn") > 0, F.array(F.concat(F.lit("t"), (F.col("turn") - 1).cast("string"))))
    steps = c.select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias(G),
        F.concat(F.lit("t"), F.col("turn").cast("string")).alias("step_id"),
        F.coalesce(before, F.array().cast("array<string>")).alias("depends_on"),
    )
    return Gr.execution_order(Gr.graph_nodes(steps), Gr.graph_edges(steps))


_CLOSURE_SQL = """, reach AS (
  SELECT src AS a, dst AS z FROM edge UNION SELECT r.a, e.dst FROM reach r JOIN edge e ON r.z = e.src)
"""


@query(
    "graph_closure",
    PART_SQL + _CLOSURE_SQL + "SELECT 'parts' AS workflow_id, a AS ancestor, z AS step_id FROM reach",
)
def graph_closure(spark, folder):
    return Gr.transitive_dependencies(_part_graph(spark, folder)[1])


@query("graph_closure_cyclic", BRAND_SQL + "SELECT workflow_id, a AS ancestor, z AS step_id FROM reach")
def graph_closure_cyclic(spark, folder):
    nodes, edges = _brand_graphs(spark, folder)
    return Gr.transitive_dependencies(Gr.proper_edges(nodes, edges))


@query(
    "graph_cycle_core",
    BRAND_SQL + """, onto AS (SELECT DISTINCT r.workflow_id, r.z AS step_id FROM reach r JOIN looped l ON r.workflow_id = l.workflow_id AND r.a = l.step_id),
    back AS (SELECT DISTINCT r.workflow_id, r.a AS step_id FROM reach r JOIN looped l ON r.workflow_id = l.workflow_id AND r.z = l.step_id)
    SELECT workflow_id, step_id FROM onto INTERSECT SELECT workflow_id, step_id FROM back
    """,
)
def graph_cycle_core(spark, folder):
    return Gr.cycle_core(*_brand_graphs(spark, folder))


@query(
    "graph_components",
    BRAND_SQL + """SELECT r.workflow_id, r.a AS step_id, min(least(r.a, r.z)) AS component FROM reach r
    SEMI JOIN reach b ON r.workflow_id = b.workflow_id AND r.a = b.z AND r.z = b.a
    WHERE r.a IN (SELECT step_id FROM looped l WHERE l.workflow_id = r.workflow_id) GROUP BY r.workflow_id, r.a
    """,
)
def graph_components(spark, folder):
    return Gr.cycle_components(*_brand_graphs(spark, folder))


_RING_SQL = """, live AS (
      SELECT workflow_id, step_id FROM looped
      UNION SELECT r.workflow_id, r.a FROM reach r JOIN looped l ON r.workflow_id = l.workflow_id AND r.z = l.step_id),
    hop AS (
      SELECT p.workflow_id, p.src, min(p.dst) AS dst FROM proper p
      SEMI JOIN live a ON p.workflow_id = a.workflow_id AND p.src = a.step_id
      SEMI JOIN live b ON p.workflow_id = b.workflow_id AND p.dst = b.step_id GROUP BY p.workflow_id, p.src),
    walk AS (
      SELECT workflow_id, [min(step_id)] AS path, FALSE AS met FROM live GROUP BY workflow_id
      UNION ALL
      SELECT w.workflow_id, list_append(w.path, h.dst), list_contains(w.path, h.dst) FROM walk w
      JOIN hop h ON w.workflow_id = h.workflow_id AND w.path[-1] = h.src WHERE NOT w.met),
    ring AS (SELECT workflow_id, path[list_position(path, path[-1]):] AS path FROM walk WHERE met)
"""


@query(
    "graph_first_cycle",
    BRAND_SQL + _RING_SQL + """SELECT workflow_id, unnest(range(len(path))) AS seq, unnest(path) AS step_id FROM ring
    """,
)
def graph_first_cycle(spark, folder):
    return Gr.first_cycle(*_brand_graphs(spark, folder))


@query(
    "graph_faults",
    BRAND_SQL + _RING_SQL + """
    SELECT workflow_id, 0 AS error_rank, 'DuplicateStepIds' AS error_type, step_id, CAST(0 AS BIGINT) AS page,
      'Duplicate step IDs found in workflow: [''' || step_id || ''']' AS message
    FROM step GROUP BY workflow_id, step_id HAVING count(*) > 1
    UNION ALL SELECT e.workflow_id, 1, 'InvalidGraphError', dst, 0, 'Step ''' || dst || ''' depends on undefined step ''' || src || '''.'
    FROM edge e ANTI JOIN node n ON e.workflow_id = n.workflow_id AND e.src = n.step_id
    UNION ALL SELECT workflow_id, 1, 'CycleDetectedError', dst, 0,
      'Step ''' || dst || ''' directly depends on itself (cycle: ' || dst || ' -> ' || dst || ').' FROM edge WHERE src = dst
    UNION ALL SELECT workflow_id, 2, 'CycleDetectedError', path[1], 0,
      'Cycle detected in workflow graph: ' || array_to_string(path, ' -> ') FROM ring
    """,
)
def graph_faults(spark, folder):
    return Gr.graph_faults(brand_steps(spark, folder))


@query(
    "graph_validation_report",
    BRAND_SQL + """, bad AS (
      SELECT workflow_id, step_id FROM looped UNION SELECT workflow_id, dst FROM edge WHERE src = dst
      UNION SELECT e.workflow_id, e.dst FROM edge e ANTI JOIN node n ON e.workflow_id = n.workflow_id AND e.src = n.step_id),
    stuck AS (
      SELECT workflow_id, step_id FROM bad
      UNION SELECT r.workflow_id, r.z FROM reach r JOIN bad b ON r.workflow_id = b.workflow_id AND r.a = b.step_id),
    free AS (SELECT n.* FROM node n ANTI JOIN stuck s ON n.workflow_id = s.workflow_id AND n.step_id = s.step_id),
    depth AS (
      SELECT workflow_id, step_id, 0 AS d FROM free
      UNION SELECT p.workflow_id, p.dst, d + 1 FROM depth JOIN proper p ON depth.workflow_id = p.workflow_id AND depth.step_id = p.src
      SEMI JOIN free f ON p.workflow_id = f.workflow_id AND p.dst = f.step_id),
    cyclic AS (
      SELECT workflow_id, step_id FROM looped
      UNION SELECT r.workflow_id, r.a FROM reach r JOIN looped l ON r.workflow_id = l.workflow_id AND r.z = l.step_id),
    report AS (
      SELECT s.workflow_id, count(*) AS step_count,
        (SELECT count(*) FROM free f WHERE f.workflow_id = s.workflow_id) AS n_ordered,
        (SELECT CAST(coalesce(max(d) + 1, 0) AS BIGINT) FROM depth d WHERE d.workflow_id = s.workflow_id) AS n_waves,
        count(*) - count(DISTINCT step_id) AS n_duplicate,
        (SELECT count(*) FROM edge e ANTI JOIN node n ON e.workflow_id = n.workflow_id AND e.src = n.step_id WHERE e.workflow_id = s.workflow_id) AS n_undefined,
        (SELECT count(*) FROM edge e WHERE e.workflow_id = s.workflow_id AND src = dst) AS n_self,
        (SELECT count(*) FROM cyclic c WHERE c.workflow_id = s.workflow_id) AS n_cyclic
      FROM step s GROUP BY s.workflow_id)
    SELECT *, CASE WHEN n_duplicate > 0 THEN 'DuplicateStepIds' WHEN n_undefined > 0 THEN 'InvalidGraphError'
                   WHEN n_self + n_cyclic > 0 THEN 'CycleDetectedError' END AS error_type,
           n_duplicate + n_undefined + n_self + n_cyclic = 0 AS valid FROM report
    """,
)
def graph_validation_report(spark, folder):
    return Gr.validation_report(brand_steps(spark, folder))


@query(
    "graph_blocked",
    PART_SQL + _CLOSURE_SQL + """SELECT DISTINCT 'run_' || p_size AS run_id, 'parts' AS workflow_id, z AS step_id
    FROM reach JOIN part ON a = CAST(p_partkey AS VARCHAR) WHERE p_type = 'ECONOMY'
    """,
)
def graph_blocked(spark, folder):
    failed = table(spark, folder, "part").filter("p_type = 'ECONOMY'").select(
        F.concat(F.lit("run_"), F.col("p_size").cast("string")).alias("run_id"), F.lit("parts").alias(G),
        F.col("p_partkey").cast("string").alias("step_id"),
    )
    return Gr.blocked_steps(failed, _part_graph(spark, folder)[1])


@query(
    "graph_undeclared_references",
    PART_SQL + _CLOSURE_SQL + """, asked AS (
      SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS step_id, unnest([CAST(p_partkey // 4 AS VARCHAR), CAST(p_size AS VARCHAR)]) AS ancestor FROM part)
    SELECT 'parts' AS workflow_id, q.step_id, q.ancestor FROM asked q ANTI JOIN reach r ON r.a = q.ancestor AND r.z = q.step_id
    """,
)
def graph_undeclared_references(spark, folder):
    k = F.col("p_partkey")
    texts = table(spark, folder, "part").select(
        k.cast("string").alias("step_id"),
        F.concat(
            F.lit('{"a":"${'), (k / 4).cast("long").cast("string"), F.lit('.output.x}","b":"${'),
            F.col("p_size").cast("string"), F.lit('.output} ${workflow.input.y} ${unit.input}"}'),
        ).alias("inputs"),
    )
    steps = part_steps(spark, folder)
    return Gr.undeclared_references(steps.join(texts, "step_id"), Gr.graph_edges(steps))
