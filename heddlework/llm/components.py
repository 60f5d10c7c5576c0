"""Connected components of a table of links, by contraction.

Each round points every node at its smallest neighbour or itself, follows the pointers to
their roots by doubling, and replaces the ends of the links by roots until no link is left
between different ones. The number of rounds grows with the logarithm of the longest chain.
Minima are taken on the map side, so a node with a third of all links is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, stage, a: str = "a", b: str = "b", name: str = "") -> DataFrame:
    """(node, root): the smallest node that each linked node reaches."""
    links = stage.put(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), f"links-0{name}")
    both = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    roots = stage.put(both.withColumn("root", F.col("node")), f"roots-0{name}")
    k = 0
    while not links.isEmpty():
        k += 1
        ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        parents = _to_roots(stage.put(parents, f"parents-{k}{name}"), stage, f"{k}{name}")
        roots = roots.join(parents, roots.root == parents.a, "left")
        roots = stage.put(roots.select("node", F.coalesce("p", "root").alias("root")), f"roots-{k}{name}")
        left = links.join(parents.withColumnRenamed("a", "from"), F.col("a") == F.col("from")).select(F.col("p").alias("x"), "b")
        both = left.join(parents.withColumnRenamed("a", "from"), F.col("b") == F.col("from")).select("x", F.col("p").alias("y"))
        links = stage.put(both.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"links-{k}{name}")
    return roots


def _to_roots(parents: DataFrame, stage, name: str) -> DataFrame:
    step = 0
    while True:
        above = parents.select(F.col("a").alias("up"), F.col("p").alias("top"))
        jumped = parents.join(above, parents.p == above.up, "left")
        jumped = jumped.select("a", F.coalesce("top", "p").alias("p"), (F.coalesce("top", "p") != F.col("p")).cast("int").alias("moved"))
        step += 1
        jumped, seen = stage.put_measured(jumped, f"parents-{name}-{step}", moved=F.sum("moved"))
        parents = jumped.select("a", "p")
        if not seen["moved"]:
            return parents
