"""Result sinks: an archive of runs, and plain-text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_archive(results: DataFrame, path: str, run_id: str, day: str) -> None:
    """Add a run to the archive: JSON lines, partitioned by day and run, so
    that a run is read without the others. Writing a run again replaces it."""
    results.withColumns({"day": F.lit(day), "run_id": F.lit(run_id)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run_id").json(path)


def load_run(spark: SparkSession, path: str, run_id: str, schema: str | None = None) -> DataFrame:
    """The rows of a run; only its folders are read. None for unknown runs."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path).filter(F.col("run_id") == run_id)


def list_runs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The runs of an archive with their rows, the latest day first."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path).groupBy("day", "run_id").agg(F.count("*").alias("n_rows")).orderBy(F.desc("day"), "run_id")


def text_report(results: DataFrame, by: str = "query_id", most: int = 10) -> DataFrame:
    """One text for each query: its first results by score, numbered, with
    URL and a short snippet. ``most`` results a query make the report."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc_nulls_last(), "result_id")
    few = results.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    line = F.concat_ws("\n", F.concat(F.col("n"), F.lit(". "), F.coalesce("title", F.lit("(no title)"))), F.concat(F.lit("   "), F.when(F.col("url") != "", F.col("url"))), F.concat(F.lit("   "), F.when(F.col("snippet") != "", F.substring("snippet", 1, 160))))
    lines = few.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))
    return lines.select(by, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("report"))
