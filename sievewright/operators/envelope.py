"""Candidates handed on: one a page, with coverage by engine and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import text, urls


def candidates(rows: DataFrame) -> DataFrame:
    """One candidate for each page of a query, by canonical URL, the first by
    score: ``query_id, result_id, candidate_id, platform, canonical_url, rank,
    backend``. Rows without a URL are candidates of their own."""
    canonical = urls.canonical_envelope(F.col("url"))
    told = rows.withColumn("canonical_url", canonical).withColumn("platform", urls.platform(F.col("url")))
    told = told.withColumn("candidate_id", F.concat("platform", F.lit(":"), F.substring(F.sha2("canonical_url", 256), 1, 16)))
    key = F.when(F.col("canonical_url") != "", F.col("canonical_url")).otherwise(F.concat(F.lit("\x1f"), F.col("result_id").cast("string")))
    # The order keeps all but the key and the score out of the aggregate.
    best = told.withColumn("key", key).groupBy("query_id", "key").agg(F.min(F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), "result_id")).alias("b"))
    first = best.select("query_id", F.col("b.result_id").alias("result_id"), F.col("b.s").alias("s"))
    line = Window.partitionBy("query_id").orderBy("s", "result_id")
    ranked = first.withColumn("rank", F.row_number().over(line)).drop("s")
    kept = told.select("query_id", "result_id", "candidate_id", "platform", "canonical_url", F.coalesce(F.when(F.col("source") != "", F.col("source")), F.col("engine"), F.lit("unknown")).alias("backend"))
    return kept.join(ranked, ["query_id", "result_id"])


def coverage(rows: DataFrame, most: int = 10) -> DataFrame:
    """What each engine gave a query: ``query_id, engine, returned, usable,
    status, truncated``: truncated where it returned ``most`` or more."""
    usable = (F.coalesce("title", F.lit("")) != "") | (F.coalesce("url", F.lit("")) != "")
    by = rows.groupBy("query_id", "engine").agg(F.count("*").alias("returned"), F.count_if(usable).alias("usable"))
    status = F.when(F.col("usable") == 0, "no-results").when(F.col("usable") < F.col("returned"), "partial").otherwise("ok")
    return by.withColumn("status", status).withColumn("truncated", F.col("returned") >= most)


def merge_partitions(rows: DataFrame, partition: str = "partition") -> DataFrame:
    """Pages of a query over partitions of its results (public and behind a
    login, for instance): ``query_id, canonical_url, partitions, n_rows,
    dual_sourced, conflict``. A page of several partitions whose titles differ
    is in conflict. Rows without a URL are left out."""
    told = rows.select("query_id", urls.canonical_envelope(F.col("url")).alias("canonical_url"), F.col(partition).alias("p"), F.trim(F.coalesce("title", F.lit(""))).alias("t")).filter("canonical_url <> ''")
    by = told.groupBy("query_id", "canonical_url").agg(F.array_sort(F.collect_set("p")).alias("ps"), F.count("*").alias("n_rows"), F.min("t").alias("a"), F.max("t").alias("b"))
    dual = F.size("ps") > 1
    return by.select("query_id", "canonical_url", F.array_join("ps", ",").alias("partitions"), "n_rows", dual.alias("dual_sourced"), (dual & (F.col("a") != F.col("b"))).alias("conflict"))


# Seconds that an answer stays valid, for queries of the present
# and others.
FRESH_TTL, TTL = 900, 3600


def cache_hits(requests: DataFrame, fresh_ttl: int = FRESH_TTL, ttl: int = TTL) -> DataFrame:
    """Which requests an earlier answer could serve: ``query_id, engine, age_s,
    hit``.

    ``requests`` has ``query_id, text, engine, at, n``. A request is served by
    the answer to the one before it of the same normalised text and engine, if
    that is younger than its time to live and had as many results. Ties in time
    are settled by ``query_id``.
    """
    told = requests.select("query_id", "engine", F.unix_micros("at").alias("at"), "n", text.normalized_query(F.col("text")).alias("q"), text.is_fresh_query(F.col("text")).alias("f")).filter("q <> ''")
    line = Window.partitionBy("q", "engine").orderBy("at", "query_id")
    seen = told.withColumn("last", F.lag("at").over(line)).withColumn("had", F.lag("n").over(line))
    age = F.floor((F.col("at") - F.col("last")) / 1_000_000)
    young = age < F.when(F.col("f"), fresh_ttl).otherwise(ttl)
    return seen.select("query_id", "engine", age.cast("long").alias("age_s"), F.coalesce(young & (F.col("had") >= F.col("n")), F.lit(False)).alias("hit"))
