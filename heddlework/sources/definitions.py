"""Workflow definitions: reading JSON documents, keeping and looking them up."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddlework import schemas as S

_BAD = "_malformed"
_PARSED = T.StructType([*S.DEFINITION.fields, T.StructField(_BAD, T.StringType())])


def read_definitions(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Definitions from JSON files, with a ``malformed`` flag for unreadable ones."""
    read = spark.read.schema(_PARSED).option("columnNameOfCorruptRecord", _BAD)
    rows = read.option("multiLine", multiline).json(path)
    return rows.withColumn("malformed", F.col(_BAD).isNotNull()).drop(_BAD)


def parse_definitions(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """The same from a column of JSON texts."""
    parsed = F.from_json(F.col(text), _PARSED, {"columnNameOfCorruptRecord": _BAD})
    rows = df.select(*(keep or []), parsed.alias("_d"))
    bad = F.col("_d").isNull() | F.col(f"_d.{_BAD}").isNotNull()
    return rows.select(
        *(keep or []), *[F.col(f"_d.{name}") for name in S.DEFINITION.fieldNames()], bad.alias("malformed")
    )


def explode_steps(definitions: DataFrame) -> DataFrame:
    """One row per step with its place in the list."""
    rows = definitions.select("workflow_id", F.posexplode("steps").alias("step_pos", "_s"))
    return rows.select("workflow_id", "step_pos", "_s.*")


def definition_step(steps: DataFrame, step_id: str) -> DataFrame:
    """Per workflow the first step with this id."""
    found = steps.filter(F.col("id") == step_id)
    first = found.groupBy("workflow_id").agg(F.min_by(F.struct(*found.columns), "step_pos").alias("_s"))
    return first.select("_s.*")


def upsert_definitions(kept: DataFrame, incoming: DataFrame) -> DataFrame:
    """The row updated last per workflow, with the earliest creation time.

    At equal times an incoming row wins over a kept one, then the larger version and
    text, so that a rerun gives the same rows.
    """
    sides = kept.withColumn("_new", F.lit(False)).unionByName(incoming.withColumn("_new", F.lit(True)))
    rank = F.struct("updated_at", "_new", "version", "definition_json")
    merged = sides.groupBy("workflow_id").agg(F.max(rank).alias("_d"), F.min("created_at").alias("created_at"))
    return merged.select("workflow_id", "_d.version", "_d.definition_json", "created_at", "_d.updated_at")


def save_definitions(df: DataFrame, root: str) -> str:
    """Write a whole new snapshot; readers keep the one they opened."""
    path = f"{root.rstrip('/')}/snapshot={time.time_ns():020d}"
    df.write.parquet(path)
    return path


def load_definitions(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete snapshot; no rows where there is none.

    The folder is listed through the file system that Spark itself would use. A
    snapshot counts once its ``_SUCCESS`` file is there, so one that is still being
    written, or whose writer failed, is passed over; no data file is opened.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(root)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    listed = [status.getPath() for status in files.listStatus(folder)] if files.exists(folder) else []
    snapshots = sorted((p for p in listed if p.getName().startswith("snapshot=")), key=lambda p: p.getName())
    for snapshot in reversed(snapshots):
        if files.exists(path(snapshot, "_SUCCESS")):
            return spark.read.schema(S.WORKFLOW_DEFINITIONS).parquet(snapshot.toString())
    return spark.createDataFrame([], S.WORKFLOW_DEFINITIONS)


def find_definition(definitions: DataFrame, workflow_id: str) -> DataFrame:
    """One definition by id; an equality filter that reaches the file scan."""
    return definitions.filter(F.col("workflow_id") == workflow_id)


def find_definitions(wanted: DataFrame, definitions: DataFrame) -> DataFrame:
    """Many ids at once, each with a ``found`` flag."""
    marked = definitions.withColumn("found", F.lit(True))
    return wanted.join(marked, "workflow_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
