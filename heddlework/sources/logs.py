"""Run and step-run logs as append-only parquet, partitioned by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddlework import schemas as S

DAY = "log_date"


def _when_status(statuses: tuple[str, ...], value: Column) -> Column:
    return F.when(F.col("status").isin(*statuses), value)


def _shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the table in order; absent ones become null."""
    columns = []
    for field in schema.fields:
        held = F.col(field.name) if field.name in df.columns else F.lit(None)
        columns.append(held.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def new_runs(df: DataFrame) -> DataFrame:
    """Run rows as first written: started only when already RUNNING."""
    started = _when_status(("RUNNING",), F.col("created_at"))
    return _shaped(df.withColumn("started_at", started), S.WORKFLOW_RUNS)


def new_step_runs(df: DataFrame) -> DataFrame:
    """Step-run rows as first written: cached ones start and end at once."""
    stamped = df.withColumns(
        {
            "started_at": _when_status(("RUNNING", "COMPLETED"), F.col("created_at")),
            "completed_at": _when_status(("COMPLETED",), F.col("created_at")),
        }
    )
    if "cached" in df.columns:
        stamped = stamped.withColumn("cached", F.coalesce("cached", F.lit(False)))
    else:
        stamped = stamped.withColumn("cached", F.lit(False))
    return _shaped(stamped, S.STEP_RUNS)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows under the day they were created."""
    dated = df.withColumn(DAY, F.to_date("created_at"))
    dated.write.mode("append").partitionBy(DAY).parquet(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType, since: str | None = None) -> DataFrame:
    """Read a log; ``since`` (a date) prunes whole day folders."""
    fields = [*schema.fields, T.StructField(DAY, T.DateType())]
    rows = spark.read.schema(T.StructType(fields)).parquet(path)
    if since:
        rows = rows.filter(F.col(DAY) >= F.lit(since).cast("date"))
    return rows.drop(DAY)


def read_runs(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    return read_log(spark, path, S.WORKFLOW_RUNS, since)


def read_step_runs(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    return read_log(spark, path, S.STEP_RUNS, since)


def find_step_run(step_runs: DataFrame, run_id: str, step_id: str) -> DataFrame:
    """The newest row of one step of one run, or no row."""
    rows = step_runs.filter((F.col("run_id") == run_id) & (F.col("step_id") == step_id))
    return newest_step_runs(rows)


def newest_step_runs(step_runs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The newest row per run and step; a resumed step has an older failed row.

    Only ``columns`` (all by default) are read beside the key and the ranking.
    """
    kept = [name for name in columns or step_runs.columns if name not in ("run_id", "step_id")]
    newest = F.max_by(F.struct(*kept), F.struct("created_at", "id"))
    return step_runs.groupBy("run_id", "step_id").agg(newest.alias("_s")).select("run_id", "step_id", "_s.*")


def repeated_step_runs(step_runs: DataFrame) -> DataFrame:
    """Keys that hold more than one row."""
    return step_runs.groupBy("run_id", "step_id").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
