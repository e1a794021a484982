"""Stream and batch give the same windows."""

from pyspark.sql import functions as F

from sievewright.streaming.outcomes import outcome_windows


def test_stream_equals_batch(spark, data, tmp_path):
    calls = spark.read.parquet(f"{data}/engine_perf.parquet")
    calls.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = outcome_windows(stream, lateness="60 days").writeStream.format("memory").queryName("outcomes").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda f: sorted(map(tuple, f.collect()), key=str)
    assert key(spark.table("outcomes")) == key(outcome_windows(calls))
    assert spark.table("outcomes").agg(F.sum("n_calls")).first()[0] == calls.count()
