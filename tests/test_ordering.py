"""Scans inside groups: sliced and plain scans agree."""

import random

import pytest
from pyspark.sql import functions as F

from heddlework.functions.ordering import paged, positions_within, ranked, scan_within


def rows(spark):
    rng = random.Random(1)
    data = []
    for i in range(3000):
        group = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None, "c"])
        data.append((i, group, rng.randrange(200), rng.randrange(-5, 6), rng.choice([None, None, f"v{i}"])))
    return data, spark.createDataFrame(data, "id int, g string, at int, n int, mark string").repartition(5)


@pytest.mark.parametrize("slices", [1, 8, 40])
def test_scan_matches_brute_force(spark, slices):
    data, df = rows(spark)
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scan_within(df, ["g"], ["at", "id"], {"total": F.col("n")}, {"held": F.col("mark")}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, state = {}, {}
    for i, g, _, n, mark in sorted(data, key=lambda r: (r[2], r[0])):
        total, held = state.get(g, (0, None))
        state[g] = (total + n, mark or held)
        want[i] = state[g]
    assert {r.id: (r.total, r.held) for r in got} == want and len(got) == len(data)


def test_positions_and_pages(spark):
    data, df = rows(spark)
    got = {(r.g, r.p): r.id for r in positions_within(df, ["g"], ["at", "id"], "p").collect()}
    for g in {r[1] for r in data}:
        mine = [r[0] for r in sorted(data, key=lambda r: (r[2], r[0])) if r[1] == g]
        assert [got[g, k + 1] for k in range(len(mine))] == mine
    pages = paged(df, ["g"], ["at", "id"], 100).groupBy("g", "page").count()
    assert pages.agg(F.max("count")).first()[0] == 100


def test_ranks_follow_the_order(spark):
    data, df = rows(spark)
    got = [r.id for r in sorted(ranked(df, ["at", "id"], "rank").collect(), key=lambda r: r["rank"])]
    assert got == [r[0] for r in sorted(data, key=lambda r: (r[2], r[0]))]
