"""A training-data pipeline over ``documents``: five stages, each an operator of the llm package.

A stage takes all documents that its predecessor kept. All but the last give the columns of
documents; the last gives the piece ids of the texts that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heddlework.llm import mixing, ngram_join, pieces, quality_rules, toxicity
from heddlework.llm.common import staging
from heddlework.llm.queries import tokenizer

#: Near copies of the pipeline: sets of five words, similar to 80 percent. The defaults of
#: ``ngram_join`` are those of query 10 alone.
COPY_WORDS, COPY_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject_toxic(docs, labels, staging(spark, "pipeline-toxicity"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_filter(docs, staging(spark, "pipeline-quality"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, staging(spark, "pipeline-ngrams"), n=COPY_WORDS, percent=COPY_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, staging(spark, "pipeline-mixing"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    staging(spark, "pipeline-pieces")
    return pieces.tokenized(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("n-gram Jaccard join", drop_copies),
    ("mixing", mix_sources),
    ("SentencePiece", encode),
]

#: Trained models, the trie join and the encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written as Parquet and read again as the next one's documents."""
    stage = staging(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, fn) in enumerate(STAGES):
        docs = stage.put(fn(spark, docs, sf_dir), f"stage-{k}")
    return docs
