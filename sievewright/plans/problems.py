"""Queries of the training-data problems that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators.timestamps import normalize_timestamps
from sievewright.runtime import table


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "search_results").select("result_id", "engine", "published_at", "fetched_at")
    out = normalize_timestamps(rows, table(spark, root, "engines"))
    return out.filter(F.col("published_us").isNotNull()).select("result_id", "published_us")


def p4_notations(spark: SparkSession, root: str) -> DataFrame:
    """Values, readable values and unresolved ambiguity by engine and notation."""
    rows = table(spark, root, "search_results").select("result_id", "engine", "published_at", "fetched_at")
    out = normalize_timestamps(rows, table(spark, root, "engines"))
    return out.groupBy("engine", "notation").agg(F.count("*").alias("n_values"), F.count("published_us").alias("n_readable"), F.count_if("ambiguous").alias("n_ambiguous"))


QUERIES = {"p4_found": p4_found, "p4_notations": p4_notations}
SQL: dict[str, str] = {}
