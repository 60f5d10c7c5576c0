"""Session settings and the shared folder that long jobs stage their work in."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Skewed join sides are split even where a later stage has to shuffle again.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app: str = "heddlework", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def apply_settings(spark: SparkSession) -> None:
    """Set the same options on a session somebody else has built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = f"{tempfile.mkdtemp(prefix='heddlework-')}/{package.name}"
    context.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local master may fall back to a temporary folder: executors on other
    machines could not read it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="heddlework-"))
    return context.getCheckpointDir().rstrip("/")


class Staging:
    """Tables written to the shared folder to cut lineage.

    A staged table is plain parquet on shared storage, so it outlives lost
    executors, and its file sizes let Catalyst choose broadcast joins by size.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put_measured(
        self, df: DataFrame, name: str, partition_by: tuple[str, ...] = (), **metrics
    ) -> tuple[DataFrame, dict]:
        """As ``put``; the named aggregates come from the same job that writes."""
        seen = Observation()
        observed = df.observe(seen, *[expr.alias(key) for key, expr in metrics.items()])
        table = self.put(observed, name, partition_by)
        return table, {key: value or 0 for key, value in seen.get.items()}

    def scan(self, schema, *names: str) -> DataFrame:
        """Read several staged tables as one; ``key=value`` names become columns."""
        paths = [f"{self.root}/{name}" for name in names]
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*paths)


