"""Searches by blocks of queries."""

import numpy as np
import pytest

from heddlework.llm import topk
from heddlework.llm.common import staging


@pytest.mark.parametrize("largest", [3, 200, 2**30])
def test_blocks_of_queries_score_exactly(largest):
    """Sparse and full terms, rows of several widths, products past 2^53."""
    rng = np.random.default_rng(largest)
    rows = rng.integers(-largest, largest + 1, (50, 12)) * (rng.random((50, 12)) < np.linspace(0, 1, 12))
    widths = [7] * 10 + [12] * 40
    flat = [int(x) for row, n in zip(rows, widths, strict=True) for x in row[:n]]
    postings = topk.Postings(range(50), flat, widths)
    for n in (5, 12, 15):
        queries = rng.integers(-largest, largest + 1, (9, n))
        queries[:, 3] = 0
        full = topk.dense(flat, widths)
        want = [[sum(int(a) * int(b) for a, b in zip(q, c)) for c in full] for q in queries]
        assert postings.scores(queries).tolist() == want


@pytest.mark.parametrize("k", [1, 4, 30])
def test_selected_rows_are_the_sorted_ones(k):
    rng = np.random.default_rng(k)
    ids, scores = rng.permutation(30), rng.integers(-3, 3, (8, 30))
    for row, got in zip(scores, topk.select_rows(ids, scores, k), strict=True):
        assert got.tolist() == sorted(range(30), key=lambda i: (-row[i], ids[i]))[:k]


def test_no_repeated_block_is_broadcast(spark):
    """Spark sizes repeated blocks as one of each, so that a small table's would reach the driver whole."""
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(200)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), staging(spark, "t"))
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    assert any("explode(" in x for x in lines)
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
            assert not any("explode(" in x for x in lines[k:below])
    assert found.count() == 10 * topk.K
