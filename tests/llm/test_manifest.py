"""The Merkle manifest against a plain tree, on odd rows and table sizes around the powers of the fan."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from heddlework.llm import manifest
from heddlework.llm.common import prepare, staging
from heddlework.llm.queries import QUERIES

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, root bigint"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [row[0], row[1], row[2], row[3], text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """The root of a list of digests and, for each leaf, its siblings level by level as (left, right)."""
    at, ways, level = list(range(len(nodes))), [[] for _ in nodes], nodes
    while len(level) > 1:
        for k in range(len(nodes)):
            run = at[k] // 16 * 16
            ways[k].append(("".join(level[run : at[k]]), "".join(level[at[k] + 1 : run + 16])))
            at[k] //= 16
        level = [sha(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], ways


def plain(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r, leaf(r, r[4])))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = climb([d for _, d in by_source[s]])
    root, tops = climb([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for k, s in enumerate(order):
        for (r, own), way in zip(by_source[s], trees[s][1]):
            way = way + tops[k]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            again = leaf(r, lower(r[4])) if tampered else own
            for left, right in way:
                again = sha(left, again, right)
            out.append((r[0], own, trees[s][0], root, sha(*[a + b for a, b in way]), again, again == root))
    return sorted(out, key=repr)


def run(spark, tmp_path, rows):
    prepare(spark)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()
    fields = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    return sorted([tuple(r[f] for f in fields) for r in got], key=repr)


def rows_of(sizes):
    return [
        (k, s, None if k % 3 else "en", k % 7 or None, None if k % 11 == 5 else f"Text {k % 4} é漢\U0001f600", "t", k)
        for s, n in sizes.items() for k in range(n)
    ]


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1}, {"a": 16}, {"a": 17, None: 1}, {"": 257, "é": 16, "z": 1, None: 33},
        {f"s{k}": 1 + k % 3 for k in range(20)} | {"hot": 300},
    ],
)
def test_by_brute_force(spark, tmp_path, sizes):
    rows = rows_of(sizes)
    assert run(spark, tmp_path, rows) == plain(rows)


def test_repeated_rows_null_ids_and_long_texts(spark, tmp_path):
    rows = [(5, "a", "en", 1, "Same", None, None)] * 40 + [(None, "a", None, None, None, None, 1), (None, None, None, None, "", "x", 2)]
    rows += [(5, "a", "en", 1, "Other", None, None), (6, "b", "en", 3, "Long " * 200_000, None, None)]
    got = run(spark, tmp_path, rows)
    assert got == plain(rows) and len(got) == len(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_records_are_content_addressed(spark):
    prepare(spark)
    docs = spark.createDataFrame(rows_of({"a": 40, "b": 40, "c": 2}), DOCS)
    built = manifest.build(docs, staging(spark, "records"))
    records = {r.digest: r.children for r in built.records().collect()}
    assert all(sha(*children) == digest for digest, children in records.items())
    seen, todo = set(), [built.root.first().root]
    while todo:  # every leaf can be reached from the root
        digest = todo.pop()
        seen.add(digest)
        todo += [c for c in records.get(digest, []) if c not in seen]
    leaves = {r.leaf for r in docs.select(manifest.leaf_digest().alias("leaf")).collect()}
    assert leaves <= seen and not leaves & set(records)


def test_a_changed_leaf_or_sibling_does_not_verify(spark):
    prepare(spark)
    stage = staging(spark, "changed")
    proofs = manifest.prove(manifest.build(spark.createDataFrame(rows_of({"a": 40, "b": 5}), DOCS), stage), stage)
    assert manifest.verified(proofs).where("not verified").count() == 0
    changed = F.transform("proof", lambda s: F.struct(F.translate(s["left"], "a", "b").alias("left"), s["right"].alias("right")))
    touched = proofs.where("exists(proof, s -> s.left like '%a%')")
    assert touched.count() > 0 and manifest.verified(touched.withColumn("proof", changed)).where("verified").count() == 0
