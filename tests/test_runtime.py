"""Lineage cuts, the shared folder, and joins of checked size."""

import pytest
from pyspark.sql import functions as F

from sievewright import runtime


def test_small_and_large_sides_join_alike(spark):
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(40).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    for how in ("left", "inner"):
        small = sorted(map(tuple, runtime.join_small(left, right, ["k"], how).select("id", "v").collect()), key=str)
        large = sorted(map(tuple, runtime.join_small(left, right, ["k"], how, max_rows=10, salts=4).select("id", "v").collect()), key=str)
        assert small == large and len(small) == (2000 if how == "left" else len([1 for s in small if s[1]]))
    assert runtime.join_small(left, right.limit(0), ["k"]).filter("v is not null").count() == 0


def test_written_tables_are_released(spark):
    frame = runtime.materialize(spark.range(5), "probe")
    assert frame.count() == 5
    path = frame.inputFiles()[0]
    runtime.release(spark)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://h:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(ValueError):
        runtime.shared_dir(Session())
