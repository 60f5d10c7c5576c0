"""Quality by regularised quadratic discriminant analysis.

A document is a vector of transformed statistics of its text. Each class has a mean and a
covariance from the labelled training rows; the covariance is shrunk towards the pooled
within-class one and that towards a multiple of the identity. A score is the posterior of class 1: the
logistic of the difference of two Gaussian log densities, each a Mahalanobis distance by a
cached Cholesky factor, plus the log prior odds.

Moments are sums that Spark adds up over all labelled rows; the driver gets two means and
two small matrices. Labels, language, source and id are never inputs. Null texts are empty
and get the score of an empty text. A document with several labels counts once for each
different one; null labels count for nothing. With fewer than two rows of a class all scores
are the prior of class 1 (0.5 without any label).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddlework.llm.common import per_row, text_bytes
from heddlework.llm.quality_rules import STARTS, SYMBOLS

TRAIN_MOD, HELD_OUT = 5, 0
SHRINK_TO_POOLED, SHRINK_TO_ROUND = 0.1, 0.02
PREDICT_FROM = 0.3

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(0xC0, 0x100))
DIGITS = b"0123456789"

STATISTICS = (
    "words", "word_length", "symbols", "upper", "shouts", "digits", "dup_lines", "repeats", "distinct", "line_words",
    "common_word", "other_marks",
)


def statistics(text: bytes) -> list[float]:
    """Counts and shares of a text, on scales on which ordinary texts look normal."""
    words = text.split()
    n = len(words)
    chars = len(text) - len(text.translate(None, STARTS))
    of = lambda chosen: len(text) - len(text.translate(None, chosen))
    lines = [line for line in text.split(b"\n") if line.strip()]
    triples = set(zip(words, words[1:], words[2:], strict=False))
    kinds = set(words)
    letters = of(LETTERS)
    share = lambda part, whole: part / whole if whole else 0.0
    longest = max((len(w) for w in words), default=0)
    return [
        math.log1p(n), math.log1p(share(chars, n)), math.log1p(1000 * share(of(SYMBOLS), chars)),
        math.sqrt(share(of(UPPER), letters)), math.log1p(1000 * share(text.count(b"!"), n)),
        math.sqrt(share(of(DIGITS), chars)), math.sqrt(share(len(lines) - len(set(lines)), len(lines))),
        math.sqrt(share(max(n - 2, 0) - len(triples), n)), share(len(kinds), n), math.log1p(share(n, len(lines))),
        math.log1p(longest), math.sqrt(share(chars - letters - of(b" \n\t.,") - of(SYMBOLS), chars) if chars else 0.0),
    ]


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    column = per_row(lambda texts: ((statistics(t),) for t in texts), "x array<double>")(text_bytes(F.col(text)))
    return df.withColumn("x", column["x"])


class Discriminant:
    """Two Gaussian classes with shrunk covariances."""

    def __init__(self, counts, sums, products):
        self.prior = (counts[1] + 0.5) / (counts[0] + counts[1] + 1) if sum(counts) else 0.5
        self.classes = None
        if min(counts) < 2:
            return
        means = [s / c for s, c in zip(sums, counts, strict=True)]
        scatter = [p - c * np.outer(m, m) for p, c, m in zip(products, counts, means, strict=True)]
        pooled = (scatter[0] + scatter[1]) / (counts[0] + counts[1])
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        unit = np.outer(scale, scale)
        pooled, d = pooled / unit, len(scale)
        self.classes = []
        for c, m, s in zip(counts, means, scatter, strict=True):
            own = (1 - SHRINK_TO_POOLED) * s / c / unit + SHRINK_TO_POOLED * pooled
            round_ = np.trace(own) / d * np.eye(d)
            factor = np.linalg.cholesky((1 - SHRINK_TO_ROUND) * own + SHRINK_TO_ROUND * round_ + 1e-9 * np.eye(d))
            self.classes.append((m / scale, np.linalg.inv(factor), np.log(np.diag(factor)).sum()))
        self.scale = scale

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.prior)
        logs = []
        for mean, inverse, half_log_det in self.classes:
            distance = (((x / self.scale - mean) @ inverse.T) ** 2).sum(axis=1)
            logs.append(-0.5 * distance - half_log_det)
        margin = np.clip(logs[1] - logs[0] + math.log(self.prior / (1 - self.prior)), -500, 500)
        return np.round(1 / (1 + np.exp(-margin)), 9)


def fit(labelled: DataFrame) -> Discriminant:
    """From rows of (x, label), by sums that are added up on the map side."""
    d = len(STATISTICS)
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = {r["label"]: r for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}
    counts, means, matrices = [], [], []
    for label in (0, 1):
        row, matrix = rows.get(label), np.zeros((d, d))
        counts.append(row["n"] if row else 0)
        means.append(np.array([row[f"s{i}"] if row else 0.0 for i in range(d)]))
        for i in range(d):
            for j in range(i, d):
                matrix[i, j] = matrix[j, i] = row[f"p{i}_{j}"] if row else 0.0
        matrices.append(matrix)
    return Discriminant(counts, means, matrices)


def held_out(doc_id, mod: int, remainder: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == remainder, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, stage) -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each document."""
    stats = stage.put(with_statistics(docs.select("doc_id", "text")).select("doc_id", "x"), "statistics")
    out = held_out(F.col("doc_id"), TRAIN_MOD, HELD_OUT)
    train = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~out)
    train = train.select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    model = fit(stats.join(train, "doc_id").select("x", "label"))

    def score(values: pa.Array) -> pa.Array:
        rows = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
        return pa.array(model.scores(rows)) if len(values) else pa.array([], pa.float64())

    score.__annotations__ = {"values": pa.Array, "return": pa.Array}
    scored = stats.select("doc_id", out.alias("held_out"), F.arrow_udf(score, "double").asNondeterministic()("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))
