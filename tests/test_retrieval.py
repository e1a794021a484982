"""Near-duplicates, rerank and relevance on small cases and against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.operators import relevance, rerank, similarity

ROWS = "query_id string, result_id long, title string, snippet string, url string, source string, score double, selection double, sig string"


def brute_signature(text):
    flat = "".join(text.split())
    grams = {flat[i : i + 3] for i in range(max(len(flat) - 2, 1))}
    out = []
    for seed in range(8):
        values = []
        for gram in grams:
            h = seed * 1315423911
            for c in gram:
                h = (h ^ ord(c)) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
            values.append(h)
        out.append(min(values))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab c天\U0001f600", max_size=8), max_size=5))
def test_signatures(texts):
    assert similarity.signatures(texts).tolist() == [brute_signature(t) for t in texts]


def test_bands_leave_no_pair_out():
    for least in range(4, 9):
        bands = similarity._bands(least)
        assert sum(n for _, n in bands) == 8 and len(bands) == 9 - least and all(n for _, n in bands)


def test_dedupe_against_brute_force(spark):
    rng = random.Random(5)
    words = "the index of kego grew last spring and most comments praise it while others call the forecast stable".split()
    base = [" ".join(rng.choices(words, k=14)) for _ in range(6)]
    texts = [t[: len(t) - rng.randrange(6)] + rng.choice(["", " x", "!", " and more"]) for t in base for _ in range(12)] + [None, "", None]
    rows = [(rng.choice("ab"), i, t, None, None, None, rng.choice([0.5, 0.7, None]), rng.choice([0.1, None]), "clash") for i, t in enumerate(texts)]
    want = set()
    for q in "ab":
        kept = []
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-(r[6] or 0), -(r[7] or 0), r[1])):
            body = f"{r[2] or ''} ".strip()
            sig = brute_signature(body)
            if not body or all(sum(x == y for x, y in zip(sig, k)) < 7 for k in kept):
                want.add((q, r[1]))
                if body:
                    kept.append(sig)
    frame = spark.createDataFrame(rows, ROWS)
    got = similarity.minhash_dedupe(frame)
    assert got.count() == len(rows) and {(r["query_id"], r["result_id"]) for r in got.filter("kept").collect()} == want
    assert similarity.minhash_dedupe(frame.limit(0)).count() == 0


def test_hot_text_is_one_class(spark):
    rows = [("q", i, "one page that comes back very often", None, None, None, 0.5, None, "") for i in range(1500)]
    assert [r["result_id"] for r in similarity.minhash_dedupe(spark.createDataFrame(rows, ROWS)).filter("kept").collect()] == [0]


def test_query_links(spark):
    queries = spark.createDataFrame([("a", "苹果 2025 营收 是多少"), ("b", "苹果 2025 年营收 是多少"), ("c", "Weather in Kego"), ("d", " weather  in kego "), ("e", None), ("f", "")], "query_id string, text string")
    assert {(r["first_id"], r["second_id"]) for r in similarity.query_links(queries, 0.4).collect()} >= {("a", "b")}
    assert {(r["query_id"], r["first_id"]) for r in similarity.query_classes(queries).collect()} == {("a", "a"), ("b", "b"), ("c", "c"), ("d", "c")}
    assert similarity.query_links(queries.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 4, 10])
def test_bound_of_the_greedy_pass(spark, n):
    """Cutting by the bound gives what the greedy pass over all rows gives."""
    rng = random.Random(n)
    rows = [("q", i, [f"w{rng.randrange(6)}_{rng.randrange(6)}" for _ in range(rng.randrange(5))], rng.choice([500_000, 520_000, 545_000, 550_000, 600_000])) for i in range(120)]
    frame = spark.createDataFrame(rows, "query_id string, result_id long, pairs array<string>, static_e6 long")
    want = rerank.greedy([r[1] for r in rows], [r[3] for r in rows], [set(r[2]) for r in rows], n, 5)
    got = rerank.five_dimensions(frame, n).orderBy("position").collect()
    assert [(r["result_id"], r["score_e6"], r["novelty_e4"]) for r in got] == want
    assert rerank.five_dimensions(frame.limit(0), n).count() == 0


def test_near_duplicate_titles_lose_novelty(spark):
    rows = [("q", 1, "Python asyncio guide for beginners", "1 " * 100, "https://docs.python.org/3", None, 0.5, 0.5, ""), ("q", 2, "Python asyncio guide for beginners", "1 " * 100, "https://docs.python.org/4", None, 0.5, 0.5, ""), ("q", 3, None, None, None, None, None, None, "")]
    queries = spark.createDataFrame([("q", "python asyncio")], "query_id string, text string")
    got = rerank.five_dimensions(rerank.static_scores(spark.createDataFrame(rows, ROWS), queries, 2026)).orderBy("position").collect()
    assert [r["result_id"] for r in got] == [1, 2, 3] and got[1]["novelty_e4"] == 0
    assert [r["score_e6"] for r in got] == sorted((r["score_e6"] for r in got), reverse=True)


def test_focus_blocks(spark):
    noise = "\n\n".join(f"Paragraph {i} is about nothing of note and has many words in it to be long enough here" for i in range(30))
    page = f"# Intro\n\n{noise}\n\n## Asyncio\n\nThe asyncio event loop runs asyncio tasks.\r\n\r\n{noise}"
    rows = [(1, page, "asyncio loop"), (2, "short", "x"), (3, None, "x"), (4, page, None), (5, page, "zzz")]
    got = {r["doc_id"]: r for r in relevance.focus_blocks(spark.createDataFrame(rows, "doc_id int, text string, query string")).collect()}
    assert got[1]["keep"] == [31, 32] and got[1]["n_blocks"] == 63
    assert got[2]["keep"] == [0] and got[3]["keep"] == [] and len(got[4]["keep"]) == 63 and got[5]["keep"] == [0, 1, 2, 3, 4]


def test_profiles(spark):
    profiles = spark.createDataFrame([("weather", "weather forecast rain tomorrow 天气 预报"), ("code", "python code function library")], "profile string, document string")
    queries = spark.createDataFrame([("a", "weather tomorrow"), ("b", "python library 对比"), ("c", "zzz"), ("d", None)], "query_id string, text string")
    routed = relevance.route_by_profile(queries, profiles)
    assert {(r["query_id"], r["profile"]) for r in routed.filter("position = 1").collect()} == {("a", "weather"), ("b", "code")}
    assert {r["query_id"]: r["parallel"] for r in relevance.needs_parallel(queries, routed).collect()} == {"a": False, "b": True, "c": True, "d": True}
    assert relevance.route_by_profile(queries.limit(0), profiles).count() == 0
