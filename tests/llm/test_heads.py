"""The n-gram join: how heads travel, and rounds that would drop little."""

import random

import numpy as np
import pyarrow as pa

from heddlework.llm import ngram_join
from heddlework.session import Staging


def texts(seed, n):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(n)]
    return base + [t.replace(t.split()[7], "other", 1) for t in base[: n // 2]]


def test_a_task_packs_each_class_once_in_ten_bytes_an_ngram(spark, monkeypatch):
    df = spark.createDataFrame([(t.encode(),) for t in texts(1, 40)], "bytes binary")
    taken, kept = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, *args: taken.append(fn) or kept(self, fn, *args))
    none = np.array([], dtype=np.uint64), np.array([], dtype=np.int64)
    got = ngram_join.shared_heads(df, *none, 3, 4, 85).collect()
    sets = [ngram_join.shingles(t.encode()) for t in texts(1, 40)]
    heads = [ngram_join.first_of(s, *none) for s in sets]
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts(1, 40)] * 5)], names=["bytes"])
    size = sum(len(x) for out in taken[0]([batch]) for name in ("tokens", "nodes") for x in out.column(name).to_pylist())
    assert size <= 10 * sum(len(h) for h in heads)
    # Classes that share an n-gram of their heads, and no others, meet in one.
    names = [ngram_join.node_of(ngram_join.set_digest(s)) for s in sets]
    want = {tuple(sorted((names[i], names[j]))) for i in range(len(sets)) for j in range(i) if names[i] != names[j] and np.intersect1d(heads[i], heads[j]).size}
    groups = {}
    for row in got:
        groups.setdefault(row.token, set()).add(row.node)
    assert {tuple(sorted((a, b))) for g in groups.values() for a in g for b in g if a != b} == want and want


def test_a_round_that_would_drop_little_is_not_run(spark, monkeypatch):
    names, put = [], Staging.put
    monkeypatch.setattr(Staging, "put", lambda self, df, name, *rest: names.append(name) or put(self, df, name, *rest))
    docs = spark.createDataFrame(list(enumerate(texts(2, 60))), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_join(docs, Staging(spark, "t")).collect()}
    assert got == {k: k - 60 if k >= 60 else k for k in range(90)}
    assert sum(name.startswith("members-") for name in names) == 1


def test_ngrams_of_equal_bits_lose_no_link(spark, monkeypatch):
    """All n-grams share the 32 bits by which a head names them."""
    whole = ngram_join.shingles
    monkeypatch.setattr(ngram_join, "shingles", lambda text, n=4: np.unique(whole(text, n) & np.uint64(0xFFFFFFFF)))
    docs = spark.createDataFrame(list(enumerate(texts(3, 40))), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_join(docs, Staging(spark, "t")).collect()}
    assert got == {k: k - 40 if k >= 40 else k for k in range(60)}
