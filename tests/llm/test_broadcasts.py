"""What Spark would size too low is not broadcast, and texts go to few searches."""

import random

from heddlework.llm import mixing, ngram_join
from heddlework.session import Staging


def below_broadcasts(df):
    """The lines of a plan that stand below a broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for j in range(k + 1, len(lines)):
                if depth[j] <= depth[k]:
                    break
                yield lines[j]


def chained(n):
    """Texts that share a passage with the one before and the one after, each with a near copy."""
    rng = random.Random(n)
    words = lambda: [f"w{rng.randrange(10**6)}" for _ in range(20)]
    passages = [words() for _ in range(n + 1)]
    own = [words() for _ in range(n)]
    texts = [passages[k] + own[k] + passages[k + 1] for k in range(n)]
    near = [passages[k] + own[k][:10] + ["other"] + own[k][11:] + passages[k + 1] for k in range(n)]
    return [" ".join(t) for t in texts + near]


def test_a_text_goes_to_few_searches(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "AT_LEAST", 100)
    monkeypatch.setattr(ngram_join, "PART_TOKENS", 300)
    sent, places = [], ngram_join.places

    def counted(*args):
        out = places(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "places", counted)
    docs = spark.createDataFrame(list(enumerate(chained(30))), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_join(docs, Staging(spark, "t")).collect()}
    assert got == {k: k % 30 for k in range(60)}
    assert sent[0] <= 4 * 60


def test_places_and_salted_families_are_not_broadcast(spark, monkeypatch):
    below, put = {}, Staging.put
    monkeypatch.setattr(Staging, "put", lambda self, df, name, *rest: below.update({name: [*below_broadcasts(df)]}) or put(self, df, name, *rest))
    docs = spark.createDataFrame(list(enumerate(chained(20))), "doc_id bigint, text string")
    ngram_join.jaccard_join(docs, Staging(spark, "t")).count()
    assert not any("places#" in x for x in below["links-0-link"])
    assert not any("explode(" in x for x in below["placed"])


def test_decided_copies_are_not_broadcast(spark):
    rows = [(k, "ab"[k % 2], "x " * (k % 9)) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    mixed = mixing.mixed_documents(docs, Staging(spark, "t"))
    assert not any("copies#" in x for x in below_broadcasts(mixed)) and mixed.count()
