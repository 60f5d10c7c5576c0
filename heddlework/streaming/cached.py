"""The cached step over arriving requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from heddlework import schemas as S
from heddlework.operators.cache import cached_step, with_input_key
from heddlework.sources.keyindex import KeyIndex


class CachedBatches:
    """A ``foreachBatch`` sink that answers each batch from the log so far.

    The log is a folder per batch id. Beside it, in ``<root>-index``, lies the newest row per
    content key by hash prefix (``KeyIndex``): a batch reads the prefixes of its own keys
    there and never the log. A repeated batch reads only the batches before it and replaces
    its own folders, so it writes the same rows again. Requests without a content key go
    to the folder ``<root>-rejects``. Requests need ``id``, ``run_id``, ``step_id`` and
    ``created_at`` beside action and inputs.
    """

    def __init__(
        self, root: str, compute: Callable[[DataFrame], DataFrame], use_cache: str | None = None, **index_options
    ):
        self.root = root.rstrip("/")
        self.compute = compute
        self.use_cache = use_cache
        self.index = KeyIndex(f"{self.root}-index", **index_options)

    def log(self, spark, before: int | None = None) -> DataFrame:
        rows = spark.read.schema(f"{_ddl()}, batch int").parquet(self.root)
        return (rows if before is None else rows.filter(rows["batch"] < before)).drop("batch")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = self.index.lookup(with_input_key(batch), batch_id) if batch_id else spark.createDataFrame([], S.STEP_RUNS)
        step = cached_step(batch, known, self.compute, self.use_cache)
        own = f"{self.root}/batch={batch_id}"
        step.log_rows().write.mode("overwrite").parquet(own)
        step.rejects.write.mode("overwrite").parquet(f"{self.root}-rejects/batch={batch_id}")
        self.index.add(spark.read.schema(_ddl()).parquet(own), batch_id)


def _ddl() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.STEP_RUNS.fields)
