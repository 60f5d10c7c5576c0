"""A Merkle manifest of a document table: content-addressed records and proofs by descent.

Each document is a leaf, the digest of its fields. Per source the leaves, in order of doc_id,
are hashed in runs of ``FAN`` until one node is left, the subroot; the subroots, in order of
source, are hashed likewise into the root. Every inner node is a record, digest to the digests
of its children.

A proof is found by descent. A request for leaf r starts at the root and takes, level by level,
the record of the digest it stands on; a digit of r in base ``FAN`` selects the child to go on
with, the children that are not selected are collected. Requests with equal leading digits go
the same way, so they travel as one row until they part, and the root's record is read once
and not once per document. At the end the collected segments are reversed: a proof runs from the
leaf up.

Ranks come from a range sort of all leaves, so a source of any size is dealt over all tasks. A
group holds one run. The driver sees counts only.

Null fields count as ``-``. Null doc_ids and null sources come first. Rows of one source and
doc_id follow by digest; equal rows are leaves of their own with equal digests. An empty table
gives no rows. Columns beside the five of ``FIELDS`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddlework.llm.common import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16


def written(value: Column) -> Column:
    """A field as ``byte count:value``, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """The digest of a document row; ``changed`` puts other values in place of fields."""
    return F.sha2(F.concat(*[written(changed.get(name, F.col(name))) for name in FIELDS]), 256)


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


@dataclass
class Manifest:
    """Staged tables of one manifest.

    ``trees``: source, tree, n, height, subroot, one row for each source; ``runs``: the lowest inner nodes
    with their documents; ``lone``: documents that are a whole tree; ``levels`` and ``top_levels``:
    nodes by height; ``root``: one row.
    """

    trees: DataFrame
    runs: DataFrame
    lone: DataFrame
    levels: list[DataFrame]
    top_levels: list[DataFrame]
    root: DataFrame

    def records(self) -> DataFrame:
        """digest, children: each inner node once."""
        parts = [_records(nodes) for nodes in [*self.levels, *self.top_levels]]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.dropDuplicates(["digest"])


def build(docs: DataFrame, stage, presented: Column | None = None) -> Manifest:
    """Hash all documents into a manifest.

    ``presented``: for each row the leaf digest that a holder of the document shows, null where
    it is the row's own; ``prove`` checks it.
    """
    shown = F.lit(None).cast("string") if presented is None else presented
    leaves = stage.put(docs.select("doc_id", "source", leaf_digest().alias("leaf"), shown.alias("presented")), "leaves")
    ranked, _ = numbered(leaves, stage, ["source", "doc_id", "leaf"], "ranked")
    sizes = ranked.groupBy("source").agg(F.min("row_number").alias("first"), F.count(F.lit(1)).alias("n"))
    sources, n_sources = numbered(stage.put(sizes, "sizes"), stage, ["source"], "sources")
    sources = stage.put(sources.withColumnRenamed("row_number", "tree"), "trees")
    most = sources.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]

    of = sources.select(F.col("source").alias("of"), "tree", "first", "n")
    placed = ranked.join(of, F.col("source").eqNullSafe(F.col("of"))).select(
        "tree", "n", (F.col("row_number") - F.col("first")).alias("at"), F.col("leaf").alias("digest"), "doc_id", "presented"
    )
    lone = stage.put(placed.where("n = 1"), "lone")
    levels, tops = _grow(placed, most, stage, "level", carry=["doc_id", "presented"])
    tops.append(lone.select("tree", "digest", F.lit(0).alias("height")))
    subroots = tops[0]
    for top in tops[1:]:
        subroots = subroots.unionByName(top)
    subroots = subroots.withColumnRenamed("digest", "subroot")
    trees = stage.put(sources.join(subroots, "tree").select("source", "tree", "n", "height", "subroot"), "subroots")

    nodes = trees.select(
        F.lit(0).cast("long").alias("tree"), F.lit(n_sources).cast("long").alias("n"), F.col("tree").alias("at"), F.col("subroot").alias("digest")
    )
    top_levels, roots = _grow(nodes, n_sources, stage, "top")
    root = (roots[-1] if roots else nodes).select(F.col("digest").alias("root"))
    return Manifest(trees, levels[0] if levels else None, lone, levels, top_levels, stage.put(root, "root"))


def _grow(nodes: DataFrame, most: int, stage, label: str, carry: list[str] = ()) -> tuple[list[DataFrame], list[DataFrame]]:
    """Inner nodes by height, and the topmost ones (tree, digest, height) of trees that end there.

    ``nodes``: tree, n (nodes of that tree), at, digest. The lowest inner nodes keep the ``carry``
    columns of their members.
    """
    levels, tops = [], []
    while most > 1:
        members = F.sort_array(F.collect_list(F.struct("at", "digest", *([] if levels else carry))))
        run = F.floor(F.col("at") / FAN).cast("long")
        grouped = nodes.where("n > 1").groupBy("tree", "n", run.alias("run")).agg(members.alias("members"))
        parents = grouped.select(
            "tree", F.ceil(F.col("n") / FAN).cast("long").alias("n"), F.col("run").alias("at"),
            F.sha2(joined(F.col("members.digest")), 256).alias("digest"), "members",
        )
        parents = stage.put(parents, f"{label}-{len(levels) + 1}")
        levels.append(parents)
        tops.append(parents.where("n = 1").select("tree", "digest", F.lit(len(levels)).alias("height")))
        nodes = parents.select("tree", "n", "at", "digest")
        most = -(-most // FAN)
    return levels, tops


def _records(nodes: DataFrame) -> DataFrame:
    return nodes.select("digest", F.col("members.digest").alias("children")).dropDuplicates(["digest"])


def _segment(children: Column, digit: Column) -> Column:
    """The children on both sides of the selected one."""
    left = F.slice(children, F.lit(1), digit)
    right = F.slice(children, digit + 2, F.lit(FAN))
    return F.struct(joined(left).alias("left"), joined(right).alias("right"))


def _down(front: DataFrame, records: DataFrame) -> DataFrame:
    """One level: each standing place becomes the places of its children."""
    opened = front.join(records, "digest")
    kept = [c for c in front.columns if c not in ("digest", "at", "path")]
    placed = opened.select(*kept, "at", "path", "children", F.posexplode("children").alias("digit", "digest"))
    return placed.select(
        *kept, "digest", (F.col("at") * FAN + F.col("digit")).alias("at"),
        F.array_append("path", _segment(F.col("children"), F.col("digit"))).alias("path"),
    )


def prove(manifest: Manifest, stage) -> DataFrame:
    """doc_id, source, leaf, presented, subroot, root and proof of every document.

    ``proof``: from the leaf up, the digests ``left`` and ``right`` of the node at each level.
    """
    segments = F.array().cast("array<struct<left:string,right:string>>")
    zero = F.lit(0).cast("long")
    front = manifest.root.select("root", F.col("root").alias("digest"), zero.alias("at"), segments.alias("path"))
    for k, nodes in enumerate(reversed(manifest.top_levels)):
        front = stage.put(_down(front, _records(nodes)), f"front-top-{k}")
    # Standing on the subroots; ``at`` is the number of the source's tree.
    front = front.withColumnRenamed("at", "tree").join(manifest.trees.select("tree", "source", "height", "subroot"), "tree")
    entries = stage.put(front.withColumn("at", zero), "front-trees")

    lone = manifest.lone.select("tree", "doc_id", F.col("digest").alias("leaf"), "presented")
    alone = entries.where("height = 0").join(lone, "tree").select(
        "doc_id", "source", "leaf", "presented", "subroot", "root", F.reverse("path").alias("proof")
    )
    if not manifest.levels:
        return alone
    front = None
    for height in range(len(manifest.levels), 0, -1):
        here = entries.where(F.col("height") == height)
        front = here if front is None else here.unionByName(front)
        if height > 1:
            front = stage.put(_down(front, _records(manifest.levels[height - 1])), f"front-{height - 1}")
    # Standing on the runs: the requests of a run take the last step side by side.
    asked = manifest.runs.select("tree", "at", "members")
    opened = front.join(_records(manifest.runs), "digest").join(asked, ["tree", "at"])
    each = opened.select("source", "subroot", "root", "path", "children", F.explode("members").alias("m"))
    digit = F.pmod(F.col("m.at"), F.lit(FAN)).cast("int")
    path = F.array_append("path", _segment(F.col("children"), digit))
    return each.select(
        "m.doc_id", "source", F.col("m.digest").alias("leaf"), "m.presented", "subroot", "root", F.reverse(path).alias("proof")
    ).unionByName(alone)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def siblings_digest(proof: Column) -> Column:
    return F.sha2(joined(F.transform(proof, lambda s: F.concat(s["left"], s["right"]))), 256)


def verified(proofs: DataFrame) -> DataFrame:
    """The proofs' digests: the root recomputed from what is presented and whether it is the root."""
    again = folded(F.coalesce("presented", "leaf"), F.col("proof"))
    out = proofs.select(
        "doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), again.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
