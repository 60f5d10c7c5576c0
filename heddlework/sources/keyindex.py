"""The newest completed row per content key, kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddlework.operators.cache import newest_completed

_BUCKET = "bucket"
_KEPT = ["id", "outputs", "completed_at"]
_SCHEMA = f"input_hash string, id string, outputs string, completed_at timestamp, version int, kind string, {_BUCKET} string"


class KeyIndex:
    """Folders by version, kind (``delta`` or ``base``) and hash prefix of the key.

    ``add`` writes a version's own newest rows. Every ``compact_every`` versions what came
    before is folded into a new base, so a reader meets one base and fewer deltas than
    that. ``lookup`` reads only the prefixes that its keys have: 16 ** ``digits`` at most.
    Versions count up from 0. Writing one again replaces it by the same rows, and older
    bases stay until the folder is cleaned, so a reader never meets half of a change.
    """

    def __init__(self, root: str, digits: int = 2, compact_every: int = 64):
        self.root = root.rstrip("/")
        self.digits = digits
        self.every = compact_every

    def add(self, step_runs: DataFrame, version: int) -> None:
        if version and version % self.every == 0:
            self._write(_newest(self._rows(step_runs.sparkSession, version)), f"version={version}/kind=base")
        self._write(newest_completed(step_runs, columns=_KEPT), f"version={version}/kind=delta")

    def lookup(self, keys: DataFrame, before: int) -> DataFrame:
        """Newest rows before a version in the prefixes of ``keys`` (input_hash), in the
        shape of a step-run log. The prefixes, not the keys, pass through the driver."""
        spark = keys.sparkSession
        asked = keys.filter(F.col("input_hash").isNotNull()).select(self._prefix()).distinct()
        buckets = sorted(row[0] for row in asked.collect())
        rows = self._rows(spark, before).filter(F.col(_BUCKET).isin(buckets))
        return _newest(rows).withColumn("status", F.lit("COMPLETED"))

    def _prefix(self):
        return F.substring("input_hash", 1, self.digits).alias(_BUCKET)

    def _rows(self, spark: SparkSession, before: int) -> DataFrame:
        base = max(before - 1, 0) // self.every * self.every
        paths = [f"{self.root}/version={base}/kind=base"] if base else []
        paths += [f"{self.root}/version={version}/kind=delta" for version in range(base, before)]
        if not paths:
            return spark.createDataFrame([], _SCHEMA)
        return spark.read.schema(_SCHEMA).option("basePath", self.root).parquet(*paths)

    def _write(self, rows: DataFrame, name: str) -> None:
        placed = rows.select("input_hash", *_KEPT, self._prefix()).repartition(_BUCKET)
        placed.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.root}/{name}")


def _newest(rows: DataFrame) -> DataFrame:
    last = F.max_by(F.struct(*_KEPT), F.struct("completed_at", "id")).alias("_s")
    return rows.groupBy("input_hash").agg(last).select("input_hash", "_s.*")
