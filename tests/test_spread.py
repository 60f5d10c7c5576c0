"""Tables that are dealt out for work that is heavy per row."""

import pytest
from pyspark.sql import functions as F

from heddlework.plans import catalog
from heddlework.plans.catalog import table


@pytest.fixture
def one_group(spark, tmp_path):
    """A file of one row group that is cut into more splits than there are cores."""
    rows = spark.range(300_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    keys = {"spark.sql.files.maxPartitionBytes": str(1 << 19), "spark.sql.files.openCostInBytes": "1024"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield str(tmp_path)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_of_one_row_group_reach_all_tasks(spark, one_group):
    assert table(spark, one_group, "t").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    sizes = [r["count"] for r in table(spark, one_group, "t", spread=True).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 300_000 and max(sizes) <= 300_000 / spark.sparkContext.defaultParallelism * 1.1


def test_a_task_does_not_grow_with_the_table(spark, one_group, monkeypatch):
    monkeypatch.setattr(catalog, "ROWS_A_TASK", 10_000)
    assert table(spark, one_group, "t", spread=True).rdd.getNumPartitions() == 30
