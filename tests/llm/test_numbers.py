"""Digests, packing and mixing against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.llm.mixing import draw_mixture, mixture_report, play_epoch
from sievewright.llm.packing import _reduce, _Sizes, pack_documents, pack_sizes, packing_report
from sievewright.llm.percentiles import LEVELS, bucket_bounds, compress, digest, merge_digests, quantiles, valid_calls
from sievewright.llm.tokens import VOCABULARY, _encoding, count_tokens


def rank_of(values, x):
    return np.searchsorted(np.sort(values), x, "left"), np.searchsorted(np.sort(values), x, "right")


def test_rank_error_of_merged_digests(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(5, 2, 40_000), np.full(15_000, 70.0)])
    rows = spark.createDataFrame([(float(v), i % 7) for i, v in enumerate(values)], "v double, day int").withColumn("g", F.lit("x"))
    k = 400
    merged = merge_digests(digest(rows, "v", ["g", "day"], k), ["g"], k)
    assert merged.count() <= 3 * k
    got = quantiles(merged, ["g"], k=k).first()
    assert got["n"] == len(values)
    allowed = 2 * got["rank_error"] + 1
    for name, share in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)):
        low, _ = rank_of(values, got[name] * (1 - 2**-10))
        _, high = rank_of(values, got[name] * (1 + 2**-10))
        assert low - allowed <= share * len(values) <= high + allowed


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**LEVELS - 1), min_size=1, max_size=300), st.integers(1, 50))
def test_compress_keeps_counts(values, k):
    ids, counts = np.unique(np.array(values), return_counts=True)
    level, node, n = compress(np.full(len(ids), LEVELS), ids, counts, k)
    assert n.sum() == len(values) and (n > 0).all()
    assert (node < (1 << level)).all()


def test_bucket_width():
    low, high = bucket_bounds(np.arange(1 << LEVELS))
    assert (np.diff(low) > 0).all() and ((high - low) <= low / 2**11 + 0.001).all()


def test_digest_edges(spark):
    rows = spark.createDataFrame([(None, "a"), (-1.0, "a"), (float("nan"), "a"), (3.0, None), (3.0, None)], "v double, g string")
    got = quantiles(digest(rows, "v", ["g"]), ["g"]).collect()
    assert [(r["g"], r["n"]) for r in got] == [(None, 2)] and abs(got[0]["p50"] - 3.0) < 0.002
    assert digest(rows.limit(0), "v", ["g"]).count() == 0
    calls = spark.createDataFrame([(1, "a", 5.0, 86400.0), (1, "a", 5.0, 86400.0), (2, "a", None, 0.0), (3, "a", 9e9, 0.0)], "call_id long, engine string, latency_ms double, created_at double")
    assert [str(r["day"]) for r in valid_calls(calls).collect()] == ["1970-01-02"]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 20), min_size=1, max_size=20))
def test_packing_is_whole(histogram):
    used, containers = dict.fromkeys(histogram, 0), 0
    for times, items in pack_sizes(histogram, 60):
        assert times >= 1 and sum(s * m for s, m in items.items()) <= 60
        containers += times
        for s, m in items.items():
            used[s] += times * m
    assert used == histogram
    total = sum(s * n for s, n in histogram.items())
    assert containers <= max(2 * -(-total // 60), 1)


def test_dominance_and_exact_pairs():
    """A partner as large as the best pair is fixed, and an exact pair is found
    however far down it is."""
    sizes = _Sizes({70: 1, 29: 1, 10: 2}, 100)
    assert _reduce(sizes, 100)[0] == (1, {70: 1, 29: 1})
    crowd = {2000: 1} | {s: 1 for s in range(900, 1000)} | {1500: 1, 500: 1}
    assert _Sizes(crowd, 4000).exact_pair(2000, {2000: 1}) == (1500, 500)
    far = _Sizes({4000: 1, 1400: 1, 600: 1} | {s: 1 for s in range(1401, 1599) if s % 2}, 6000)
    assert far.exact_pair(2000, {4000: 1}) == (1400, 600)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(5, 40), min_size=1, max_size=9))
def test_reduction_loses_nothing(items):
    """The fixed sets are part of a best packing, by brute force."""

    def least(left, bins, best):
        if not left:
            return min(best, len(bins))
        if len(bins) >= best:
            return best
        for i in range(len(bins)):
            if bins[i] + left[0] <= 40 and bins[i] not in bins[:i]:
                best = least(left[1:], bins[:i] + [bins[i] + left[0]] + bins[i + 1 :], best)
        return least(left[1:], [*bins, left[0]], best)

    optimum = least(sorted(items, reverse=True), [], len(items) + 1)
    sizes = _Sizes({s: items.count(s) for s in items}, 40)
    fixed = sum(n for n, _ in _reduce(sizes, 40))
    rest = [s for s in range(41) for _ in range(int(sizes.count[s]))]
    assert fixed + least(sorted(rest, reverse=True), [], len(rest) + 1) == optimum


@pytest.fixture(scope="module")
def sized(spark):
    rows = [(i, ["a", "b", "c", None][i % 4], (i * 37) % 90) for i in range(400)] + [(1000, "a", 250), (1001, None, None)] + [(2000 + i, "b", 30) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")


def test_placement(spark, sized):
    caps = spark.createDataFrame([("small", 60), ("big", 100), ("none", 0), (None, None)], "capacity_name string, capacity_tokens int")
    placed = pack_documents(sized, caps, buckets=8)
    filled = placed.groupBy("capacity_name", "container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()
    assert all(r["t"] <= {"small": 60, "big": 100}[r["capacity_name"]] for r in filled)
    whole = placed.groupBy("capacity_name", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    joined = whole.join(sized.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("want")), "doc_id").collect()
    assert len(joined) == 2 * sized.count()
    assert all(r["t"] == r["want"] for r in joined)
    assert all(r["n"] == 1 for r in joined if r["want"] <= 60)
    report = packing_report(placed, caps).collect()
    assert all(r["n_containers"] <= r["least_containers"] + 12 for r in report)
    assert pack_documents(sized.limit(0), caps).count() == 0
    assert pack_documents(sized, caps.limit(0)).count() == 0


def test_mixture(spark, sized):
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, 5), ("missing", 0.1, 3)], "source string, target_share double, max_repeats int")
    drawn = draw_mixture(sized, targets, buckets=8)
    rows = drawn.orderBy("epoch", "slot").collect()
    total = sum(r["n_tokens"] for r in rows)
    shares = {"a": 0.5 / 0.9, "b": 0.3 / 0.9, "c": 0.1 / 0.9}
    most = {"a": 2, "b": 1, "c": 5}
    at = dict.fromkeys(shares, 0)
    for r in rows:  # at any moment each source is within a block of its share
        at[r["source"]] += r["n_tokens"]
        now = sum(at.values())
        assert all(abs(at[s] - shares[s] * now) <= 2 * 250 for s in shares)
    for s, share in shares.items():
        assert abs(at[s] / total - share) < 0.05
    uses = drawn.groupBy("source", "doc_id").count().collect()
    assert all(r["count"] <= most[r["source"]] for r in uses)
    report = {r["source"]: r for r in mixture_report(drawn, targets).collect()}
    assert report["missing"]["n_tokens"] == 0 and report["a"]["most_uses"] <= 2
    assert draw_mixture(sized.limit(0), targets).count() == 0
    # At a requested size the scarce sources fall short, and say so.
    size = 60_000
    report = {r["source"]: r for r in mixture_report(draw_mixture(sized, targets, size, buckets=8, epoch_blocks=50), targets, size).collect()}
    assert all(r["asked_tokens"] == size and r["reached_tokens"] < size for r in report.values())
    assert report["b"]["shortfall_tokens"] == 60_000 * 0.3 - report["b"]["n_tokens"] > 0 and report["missing"]["shortfall_tokens"] == 6000


def test_released_blocks_come_first():
    """A block waits for its release though its deadline is earlier."""
    release, deadline, tokens = [0.0, 0.0, 10.0, 20.0], [40.0, 10.0, 20.0, 30.0], [20, 5, 5, 5]
    assert play_epoch(release, deadline, tokens, 0.0) == [1, 0, 2, 3]
    assert play_epoch([], [], [], 0.0) == []


def test_tokens():
    assert count_tokens(None) == count_tokens("") == 0
    assert count_tokens("hello world") == 2
    # Long texts are counted as a whole, also where no space parts them.
    for long in ("word " * 100_000, "天気予報" * 80_000, "ab1-" * 75_000):
        assert count_tokens(long) == len(_encoding(VOCABULARY).encode_ordinary(long))
