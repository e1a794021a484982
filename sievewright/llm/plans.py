"""Queries of the training-data problems on text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm.encoding import garbled_fields, prose_model
from sievewright.llm.languages import document_languages, fit_languages, segments
from sievewright.llm.mixing import draw_mixture, mixture_report
from sievewright.llm.packing import pack_documents, packing_report
from sievewright.llm.percentiles import digest, left_out, merge_digests, quantiles, valid_calls
from sievewright.llm.records import collapse_records, record_counts
from sievewright.llm.residue import residue_fields
from sievewright.llm.tokens import with_tokens
from sievewright.llm.truncation import cut_rates, cut_texts
from sievewright.llm.visual import disguised_fields, normalized
from sievewright.runtime import materialize, table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    members = collapse_records(table(spark, root, "search_results").select("result_id", "title", "url"))
    return members.filter("first_id <> copy_id")


def p1_records(spark: SparkSession, root: str) -> DataFrame:
    return record_counts(table(spark, root, "search_results").select("result_id", "title", "url"))


def _garbled(spark: SparkSession, root: str) -> DataFrame:
    model = prose_model(table(spark, root, "documents"))
    return garbled_fields(table(spark, root, "search_results").select("result_id", "engine", "title", "snippet"), model)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _garbled(spark, root).select("result_id", "field")


def p3_restored(spark: SparkSession, root: str) -> DataFrame:
    return _garbled(spark, root)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "search_results").select("result_id", "title", "snippet")
    return disguised_fields(rows, _garbled(spark, root))


def p6_normalized(spark: SparkSession, root: str) -> DataFrame:
    return normalized(table(spark, root, "search_results").select("result_id", "title", "snippet"))


def p2_fields(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "search_results").select("result_id", "title", "snippet")
    return residue_fields(rows, table(spark, root, "documents"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return p2_fields(spark, root).select("result_id", "field")


def p5_latency_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles per engine and day, and per engine by merging its days."""
    calls = valid_calls(table(spark, root, "engine_perf"))
    days = materialize(digest(calls, "latency_ms", ["engine", "day"]), "latency-digests")
    by_day = quantiles(days, ["engine", "day"]).withColumn("scope", F.lit("engine_day"))
    whole = quantiles(merge_digests(days, ["engine"]), ["engine"]).withColumns({"day": F.lit(None).cast("date"), "scope": F.lit("engine")})
    return by_day.unionByName(whole)


def p5_calls(spark: SparkSession, root: str) -> DataFrame:
    """What the percentiles rest on: calls counted once, by engine and day."""
    calls = valid_calls(table(spark, root, "engine_perf"))
    return calls.groupBy("engine", "day").agg(F.count("*").alias("n_calls"), F.min("latency_ms").alias("least_ms"), F.max("latency_ms").alias("most_ms"))


def p5_left_out(spark: SparkSession, root: str) -> DataFrame:
    """Calls without a usable latency, by engine and reason."""
    return left_out(table(spark, root, "engine_perf"))


def _cut(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "search_results").select("result_id", "engine", "source", "snippet")
    documents = table(spark, root, "documents")
    garbled = garbled_fields(rows, prose_model(documents), fields=("snippet",))
    residue = residue_fields(rows, documents, fields=("snippet",))
    return cut_texts(rows, garbled, residue)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return _cut(spark, root).filter("cut").select("result_id")


def p7_rates(spark: SparkSession, root: str) -> DataFrame:
    return cut_rates(_cut(spark, root))


def _sized(spark: SparkSession, root: str) -> DataFrame:
    return with_tokens(table(spark, root, "documents").select("doc_id", "source", "text")).drop("text")


def p8_placement(spark: SparkSession, root: str) -> DataFrame:
    return pack_documents(_sized(spark, root), table(spark, root, "pack_capacities"))


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    return packing_report(p8_placement(spark, root), table(spark, root, "pack_capacities"))


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    """The largest mixture in which all sources reach their shares."""
    return draw_mixture(_sized(spark, root), table(spark, root, "mix_targets"))


# The size of the mixture at a requested size.
REQUESTED_TOKENS = 10_000_000


def p9_requested(spark: SparkSession, root: str) -> DataFrame:
    """A mixture of a requested size, in which scarce sources fall short."""
    return draw_mixture(_sized(spark, root), table(spark, root, "mix_targets"), REQUESTED_TOKENS)


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """Shares, and shortfalls in tokens, of both mixtures."""
    targets = table(spark, root, "mix_targets")
    balanced = mixture_report(p9_mixture(spark, root), targets).withColumn("mixture", F.lit("balanced"))
    return balanced.unionByName(mixture_report(p9_requested(spark, root), targets, REQUESTED_TOKENS).withColumn("mixture", F.lit("requested")))


def p10_segments(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents").select("doc_id", "text", "lang")
    return segments(documents, fit_languages(documents))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return p10_segments(spark, root).filter("n_segments > 1 or not label_ok").select("doc_id", "seg_no", "lang")


def p10_documents(spark: SparkSession, root: str) -> DataFrame:
    return document_languages(p10_segments(spark, root))


QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p2_found": p2_found, "p2_fields": p2_fields, "p3_found": p3_found, "p3_restored": p3_restored, "p5_latency_percentiles": p5_latency_percentiles, "p5_calls": p5_calls, "p5_left_out": p5_left_out, "p6_found": p6_found, "p6_normalized": p6_normalized, "p7_found": p7_found, "p7_rates": p7_rates, "p8_placement": p8_placement, "p8_report": p8_report, "p9_mixture": p9_mixture, "p9_requested": p9_requested, "p9_shares": p9_shares, "p10_found": p10_found, "p10_segments": p10_segments, "p10_documents": p10_documents}
SQL: dict[str, str] = {
    "p5_left_out": """
        WITH once AS (SELECT DISTINCT call_id, engine, latency_ms FROM engine_perf)
        SELECT engine, count(*) AS n_calls, count(*) FILTER (latency_ms IS NULL) AS n_null, count(*) FILTER (latency_ms < 0) AS n_negative, count(*) FILTER (latency_ms > 3600000) AS n_implausible FROM once GROUP BY engine""",
    "p5_calls": """
        WITH calls AS (SELECT DISTINCT ON (call_id) call_id, engine, latency_ms, CAST(DATE '1970-01-01' + CAST(floor(created_at / 86400) AS INTEGER) AS DATE) AS day
                       FROM engine_perf WHERE latency_ms BETWEEN 0 AND 3600000)
        SELECT engine, day, count(*) AS n_calls, min(latency_ms) AS least_ms, max(latency_ms) AS most_ms FROM calls GROUP BY engine, day""",
}
