"""Exact top-k search: term-at-a-time accumulation over blocks of postings.

A vector becomes whole weights, floor(64 x). The candidates of a block are held as postings,
for each component (term) the positions and weights of the candidates that have it. A query
is a sparse row of terms; each of its terms scatters weight times posting into a dense row of
scores, for a block of queries at once; long posting lists are taken several terms together.
The k best of a row are selected by partition, and the selections of blocks merge.

All queries meet all candidates, in blocks dealt over the cluster; nothing is skipped. A block of candidates is laid
out once, and blocks of queries, of which there are fewer rows, travel to each. Every row is
a candidate of every query but its own row, whatever its vec_id; rows of one vec_id that are queries are
queries of their own, each with its ranks. Vectors that are null or empty or hold a null or
non-finite component, and null ids, take no part. A component that one vector lacks counts as
0. Weights must stay below 2^31 in size. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddlework.llm.common import let_go, map_rows

SCALE = 64
QUERY_EVERY = 20
K = 20
QUERY_BLOCK = 256
CANDIDATE_BLOCK = 4096
FULL = 8
"""A posting list of this share of the candidates, one in so many, is laid out in full."""
EXACT = 1 << 53


def weights(df: DataFrame) -> DataFrame:
    """row, vec_id and its whole weights; ``row`` tells rows of one vec_id apart once it is written."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = df.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).where(sound)
    whole = F.transform(x, lambda v: F.floor(v * SCALE)).alias("weights")
    return usable.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole)


def _blocks(df: DataFrame, size: int) -> DataFrame:
    """Rows packed into blocks of at most ``size``: rows, ids and weights as plain arrays."""

    def pack(rows):
        places, ids, flat, widths = [], [], [], []
        for row in rows:
            places.append(row["row"])
            ids.append(row["vec_id"])
            flat += row["weights"]
            widths.append(len(row["weights"]))
            if len(ids) == size:
                yield places, ids, flat, widths
                places, ids, flat, widths = [], [], [], []
        if ids:
            yield places, ids, flat, widths

    return map_rows(df, pack, "rows array<bigint>, ids array<bigint>, flat array<bigint>, widths array<int>")


def dense(flat, widths) -> np.ndarray:
    widths = np.asarray(widths)
    out = np.zeros((len(widths), int(widths.max())), dtype=np.int64)
    out[np.arange(out.shape[1]) < widths[:, None]] = flat
    return out


class Postings:
    """For each term the candidates that have it, and their weights."""

    def __init__(self, ids, flat, widths):
        self.ids = np.asarray(ids, dtype=np.int64)
        rows = dense(flat, widths)
        term, at = np.nonzero(rows.T)
        cuts = np.searchsorted(term, np.arange(rows.shape[1] + 1))
        self.n_terms, self.largest = rows.shape[1], int(np.abs(rows).max(initial=0))
        # Postings of many candidates are laid out in full, so that several terms are taken at once.
        full = np.diff(cuts) * FULL >= len(self.ids)
        self.full = np.flatnonzero(full)
        self.laid_out = rows.T[self.full].astype(np.float64)
        self.terms = {int(t): (at[cuts[t] : cuts[t + 1]], rows[at[cuts[t] : cuts[t + 1]], t]) for t in np.flatnonzero(~full)}

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """A row of scores for each query: term after term, or block of terms, adds to all rows."""
        queries = queries[:, : self.n_terms]
        known = self.full[self.full < queries.shape[1]]
        largest = int(np.abs(queries).max(initial=0))
        if self.largest * largest * max(len(known), 1) < EXACT:  # whole numbers below 2^53 are exact
            out = (queries[:, known].astype(np.float64) @ self.laid_out[: len(known)]).astype(np.int64)
        else:
            out = queries[:, known] @ self.laid_out[: len(known)].astype(np.int64)
        for term, (at, weight) in self.terms.items():
            having = np.flatnonzero(queries[:, term]) if term < queries.shape[1] else ()
            if len(having) and len(at):
                out[np.ix_(having, at)] += np.outer(queries[having, term], weight)
        return out


def select_rows(ids: np.ndarray, scores: np.ndarray, k: int):
    """For each row of scores the places of its k largest, ties to the smaller id."""
    n = len(ids)
    cuts = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else scores.min(axis=1)
    for row, cut in zip(scores, cuts, strict=True):
        keep = np.flatnonzero(row >= cut)
        yield keep[np.lexsort((ids[keep], -row[keep]))[:k]]


def top_k(df: DataFrame, stage, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all other vectors."""
    vectors = stage.put(weights(df), "weights")
    queries = stage.put(_blocks(vectors.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0), QUERY_BLOCK), "queries")
    candidates = stage.put(_blocks(vectors, CANDIDATE_BLOCK).withColumn("block", F.monotonically_increasing_id()), "candidates")
    numbers = Window.orderBy("block")
    names = stage.put(candidates.select("block", (F.row_number().over(numbers) - 1).alias("no")), "names")
    n_blocks = names.count()
    if not n_blocks:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    columns = [F.col(c) for c in ("no", "asks", "rows", "ids", "flat", "widths")]
    asked = candidates.join(names, "block").withColumn("asks", F.lit(False)).select(columns)
    # The smaller side is repeated, and no join meets it: Spark sizes repeated rows as if there were one of each, and would broadcast them.
    asking = queries.withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("asks", F.lit(True))
    met = asked.unionByName(asking.select(columns)).repartition("no").sortWithinPartitions("no", "asks")

    def search(batches):
        let_go()
        postings = None
        for batch in batches:
            for row in range(batch.num_rows):
                asks = batch.column(1)[row].as_py()
                places, ids, flat, widths = (column[row].values.to_numpy() for column in batch.columns[2:])
                if not asks:
                    postings, at = Postings(ids, flat, widths), places
                    continue
                scores = postings.scores(dense(flat, widths))
                # One more than wanted, as the query itself may be among the best.
                best = [chosen[at[chosen] != place][:k] for place, chosen in zip(places, select_rows(postings.ids, scores, k + 1), strict=True)]
                sizes, chosen = [len(x) for x in best], np.concatenate(best)
                of = np.repeat(np.arange(len(best)), sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (places[of], ids[of], postings.ids[chosen], scores[of, chosen])],
                    names=["query_row", "query_id", "vec_id", "score"],
                )

    found = met.mapInArrow(search, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
