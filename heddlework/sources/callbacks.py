"""Callbacks and waits as they arrive in JSON files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddlework import schemas as S

#: Files are written with microseconds, as callbacks are ordered by them.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
_UNREAD = "_unread"
_LINES = T.StructType([*S.CALLBACKS.fields, T.StructField(_UNREAD, T.StringType())])
_NEEDED = ("callback_id", "run_id", "step_id", "ts")


def read_callbacks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.CALLBACKS).json(path)


def stream_callbacks(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """Callbacks as a stream; the file limit bounds one micro-batch, not the result."""
    return spark.readStream.schema(S.CALLBACKS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def stream_waits(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    return spark.readStream.schema(S.WAITS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def write_callbacks(callbacks: DataFrame, path: str) -> None:
    """Append callbacks as JSON lines; readers see whole files only."""
    callbacks.select(*S.CALLBACKS.fieldNames()).write.mode("append").option("timestampFormat", TIME_FORMAT).json(path)


@dataclass(frozen=True)
class Ingested:
    """``accepted``: callbacks with all they need. ``rejects``: the others with a ``reason``
    and, where the line is no callback at all, the line itself."""

    accepted: DataFrame
    rejects: DataFrame


def ingest_callbacks(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int = 1_000) -> Ingested:
    """Callback files, as a table or as a stream, with what cannot be used set aside.

    A payload of any JSON kind is kept as its JSON text (a text as itself). Lines that are
    no JSON object or hold a time that is none are ``unreadable``; those without an id,
    run, step or time are ``missing_<name>``. Nothing stops the reader and no line is lost.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    lines = reader.schema(_LINES).option("columnNameOfCorruptRecord", _UNREAD).json(path)
    reason = F.when(F.col(_UNREAD).isNotNull(), "unreadable")
    for name in _NEEDED:
        reason = reason.when(F.col(name).isNull(), f"missing_{name}")
    judged = lines.withColumn("reason", reason)
    accepted = judged.filter(F.col("reason").isNull()).select(*S.CALLBACKS.fieldNames())
    rejects = judged.filter(F.col("reason").isNotNull()).select(
        *S.CALLBACKS.fieldNames(), "reason", F.col(_UNREAD).alias("line")
    )
    return Ingested(accepted, rejects)
