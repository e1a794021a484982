"""Recovery, envelopes, caching and policy on small cases."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from sievewright.operators import envelope, governance, recovery

ROWS = "query_id string, result_id long, engine string, title string, snippet string, url string, source string, score double, rank int"


def one(spark, expression, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expression(*map(F.col, names)).alias("x")).first()["x"]


def test_relaxed_queries(spark):
    cases = {"请问 “苹果” 最新 营收": "苹果 营收", "How to please the cat": "cat", "the of": "the of", "": "", None: ""}
    assert {q: one(spark, recovery.relaxed, q) for q in cases} == cases


def test_answers(spark):
    told = lambda q, t: one(spark, recovery.answers, q, t, None, None)
    assert told("WHO founding year", "The who page") and not told("Kego forecast", "An unrelated page") and told("的 a", "anything") and not told("Kego", None)


def test_alternatives(spark):
    engines = spark.createDataFrame([("w1", "web", True, 5), ("w2", "web", True, 9), ("r", "reference", False, 9), ("s1", "sport", True, 50), ("s2", "sport", True, 40), ("c", "code", True, 99)], "engine string, family string, enabled boolean, priority int")
    tried = spark.createDataFrame([("a", "w2"), ("b", "s1"), ("c", "gone")], "query_id string, engine string")
    got = sorted((r["query_id"], r["position"], r["engine"]) for r in recovery.alternatives(tried, engines, most=3).collect())
    assert got == [("a", 1, "w1"), ("b", 1, "w2"), ("b", 2, "w1"), ("b", 3, "s2"), ("c", 1, "w2"), ("c", 2, "w1")]
    assert recovery.alternatives(tried.limit(0), engines).count() == 0


def test_plan(spark):
    queries = spark.createDataFrame([("a", "the cat"), ("b", "天气"), ("c", None), ("d", " ")], "query_id string, text string")
    assert sorted(map(tuple, recovery.recovery_plan(queries).collect())) == [("a", "L1", "relax", "cat"), ("a", "L3", "switch_engine", "cat"), ("b", "L3", "switch_engine", "天气"), ("b", "L4", "cross_lang", "天气")]


def test_candidates_and_coverage(spark):
    rows = spark.createDataFrame(
        [("q", 1, "e", "t", None, "https://a.example/x?utm_source=1", None, 0.5, 1), ("q", 2, "f", "u", None, "https://a.example/x", "s", 0.9, 1), ("q", 3, "e", None, None, None, None, None, 2), ("q", 4, "e", None, "", "", "", 0.1, 3)], ROWS
    )
    got = {r["result_id"]: r for r in envelope.candidates(rows).collect()}
    assert set(got) == {2, 3, 4} and got[2]["rank"] == 1 and got[2]["backend"] == "s" and got[4]["backend"] == "e"
    told = {(r["engine"]): (r["returned"], r["usable"], r["status"], r["truncated"]) for r in envelope.coverage(rows, 3).collect()}
    assert told == {"e": (3, 1, "partial", True), "f": (1, 1, "ok", False)}
    assert envelope.candidates(rows.limit(0)).count() == 0
    parts = rows.withColumn("partition", F.when(F.col("engine") == "e", "public").otherwise("login"))
    merged = envelope.merge_partitions(parts).collect()
    assert [(r["partitions"], r["n_rows"], r["dual_sourced"], r["conflict"]) for r in merged] == [("login,public", 2, True, True)]


def test_cache_hits(spark):
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    asked = [("a", "Kego", 0, 5), ("b", " kego ", 600, 5), ("c", "KEGO", 700, 9), ("d", "kego", 9000, 1), ("e", "今日 Kego", 0, 1), ("f", "今日 kego", 1000, 1), ("g", None, 0, 1)]
    rows = spark.createDataFrame([(q, "e", t, start + timedelta(seconds=s), n) for q, t, s, n in asked], "query_id string, engine string, text string, at timestamp, n long")
    assert {r["query_id"]: r["hit"] for r in envelope.cache_hits(rows).collect()} == {"a": False, "b": True, "c": False, "d": False, "e": False, "f": False}


def test_policy_and_rates(spark):
    engines = spark.createDataFrame([("a", "paid"), ("b", None), ("c", "free"), ("d", "paid")], "engine string, cost_tier string")
    combos = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("p", "a", 1), ("p", "d", 2)], "query_id string, engine string, best_rank int")
    assert sorted(map(tuple, governance.policy_filter(combos, engines, 1).collect())) == [("p", "a", 1), ("q", "b", 1)]
    assert sorted(map(tuple, governance.policy_filter(combos, engines, None).collect())) == [("p", "a", 1), ("p", "d", 2), ("q", "b", 1), ("q", "c", 2)]
    calls = spark.createDataFrame([("a", float(t)) for t in (0, 10, 59, 60, 3590, 3605, 3640, 7300)] + [("b", None)], "engine string, created_at double")
    assert [tuple(r) for r in governance.peak_rate(calls).collect()] == [("a", 3)]
    assert governance.peak_rate(calls.limit(0)).count() == 0
