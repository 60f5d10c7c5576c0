"""The shared folder and staged tables."""

import pytest
from pyspark.sql import functions as F

from heddlework.session import Staging, shared_folder


class Fake:
    """A session that knows its master and two places for the folder."""

    def __init__(self, master, setting=None, held=None):
        self.master, self.setting, self.held = master, setting, held
        self.conf = self.sparkContext = self

    def get(self, key, default):
        return self.setting or default

    def getCheckpointDir(self):
        return self.held

    def setCheckpointDir(self, folder):
        self.held = f"file:{folder}"


def test_shared_folder(spark):
    assert shared_folder(Fake("yarn", "/shared/place/")) == "/shared/place"
    assert shared_folder(Fake("yarn", held="hdfs:/held/x")) == "hdfs:/held/x"
    fallback = Fake("local[2]")
    assert shared_folder(fallback) == shared_folder(fallback) and "heddlework-" in fallback.held
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Fake("yarn"))
    assert shared_folder(spark)


def test_staged_tables(spark):
    stage = Staging(spark, "test")
    table, seen = stage.put_measured(spark.range(10).withColumn("even", F.col("id") % 2 == 0), "part=0", ("even",), n=F.count(F.lit(1)), top=F.max("id"))
    assert seen == {"n": 10, "top": 9} and table.filter("even").count() == 5
    empty, seen = stage.put_measured(spark.range(0), "none", n=F.count(F.lit(1)), top=F.max("id"))
    assert seen == {"n": 0, "top": 0} and empty.count() == 0
