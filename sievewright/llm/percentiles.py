"""Percentiles of very large columns from mergeable digests.

Values are quantised to an ordered universe of ``2**LEVELS`` buckets (a
relative width of 2**-11 each), counted map-side, and compressed into the
nodes of a dyadic tree: siblings whose counts and their parent's stay within
``n / k`` together move up to the parent. Two digests merge by adding nodes.
The rank of an answer is off by at most ``LEVELS * floor(n / k)``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 16
_SUB = 11


def bucket_of(value: Column, unit: float = 1000.0) -> Column:
    """Bucket of a non-negative value; ``unit`` steps make one."""
    x = F.least(F.floor(value * unit), F.lit((1 << 42) - 1)).cast("long")
    shift = F.greatest(F.length(F.bin(x)) - (_SUB + 1), F.lit(0))
    return (shift * (1 << _SUB) + F.call_function("shiftright", x, shift.cast("int"))).cast("int")


def bucket_bounds(bucket: np.ndarray, unit: float = 1000.0) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each bucket."""
    bucket = np.asarray(bucket, dtype=np.int64)
    shift = np.maximum((bucket >> _SUB) - 1, 0)
    low = (bucket - (shift << _SUB)) << shift
    return low / unit, (low + (np.int64(1) << shift) - 1) / unit


def compress(level: np.ndarray, node: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digest of the given tree nodes; level ``LEVELS`` holds the buckets."""
    limit = int(count.sum()) // k
    by = {}
    for d in range(LEVELS + 1):
        here = level == d
        ids, at = np.unique(node[here], return_inverse=True)
        by[d] = (ids, np.bincount(at, weights=count[here], minlength=len(ids)).astype(np.int64))
    for d in range(LEVELS, 0, -1) if limit else ():
        ids, counts = by[d]
        if not len(ids):
            continue
        up, up_counts = by[d - 1]
        parents, at = np.unique(ids >> 1, return_inverse=True)
        pair = np.bincount(at, weights=counts, minlength=len(parents)).astype(np.int64)
        spot = np.searchsorted(up, parents)
        have = np.zeros(len(parents), dtype=np.int64)
        inside = spot < len(up)
        inside[inside] &= up[spot[inside]] == parents[inside]
        have[inside] = up_counts[spot[inside]]
        move = pair + have <= limit
        stay = ~move[at]
        by[d] = (ids[stay], counts[stay])
        merged = np.concatenate([up, parents[move]])
        merged_counts = np.concatenate([up_counts, pair[move]])
        ids, at = np.unique(merged, return_inverse=True)
        by[d - 1] = (ids, np.bincount(at, weights=merged_counts, minlength=len(ids)).astype(np.int64))
    levels = np.concatenate([np.full(len(by[d][0]), d) for d in by])
    return levels, np.concatenate([by[d][0] for d in by]), np.concatenate([by[d][1] for d in by])


def _compressed(nodes: DataFrame, keys: list[str], k: int) -> DataFrame:
    schema = ", ".join([*(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in keys), "level int", "node int", "n long"])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        level, node, n = compress(group["level"].to_numpy(), group["node"].to_numpy(), group["n"].to_numpy(), k)
        out = pd.DataFrame({"level": level, "node": node, "n": n})
        for i, c in enumerate(keys):
            out.insert(i, c, group[c].iloc[0])
        return out

    return nodes.groupBy(*keys).applyInPandas(pack, schema)


def digest(rows: DataFrame, value: str, keys: list[str], k: int = 3200, unit: float = 1000.0) -> DataFrame:
    """Digest of a column per group: ``keys, level, node, n``.

    Null, NaN and negative values are left out. A group reaches the Python
    stage as at most ``2**LEVELS`` pre-aggregated rows, however hot its key.
    Null keys are a group of their own; an empty table has no digests.
    """
    v = F.col(value).cast("double")
    counted = rows.filter(v.isNotNull() & ~F.isnan(v) & (v >= 0)).groupBy(*keys, bucket_of(v, unit).alias("node")).agg(F.count("*").alias("n"))
    return _compressed(counted.withColumn("level", F.lit(LEVELS)), keys, k)


def merge_digests(digests: DataFrame, keys: list[str], k: int = 3200) -> DataFrame:
    """One digest per group of ``keys``, from the digests of finer groups."""
    return _compressed(digests.groupBy(*keys, "level", "node").agg(F.sum("n").alias("n")), keys, k)


def quantiles(digests: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), k: int = 3200, unit: float = 1000.0) -> DataFrame:
    """One row per group: ``keys, n, p50, ..., rank_error``."""
    names = [f"p{round(s * 100, 4):g}".replace(".", "_") for s in shares]
    schema = ", ".join([*(f"{c} {digests.schema[c].dataType.simpleString()}" for c in keys), "n long", *(f"{x} double" for x in names), "rank_error long"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        level, node, n = (group[c].to_numpy(dtype=np.int64) for c in ("level", "node", "n"))
        width = LEVELS - level
        last = ((node + 1) << width) - 1
        order = np.lexsort((width, last))
        total, reached = int(n.sum()), np.cumsum(n[order])
        out = {c: [group[c].iloc[0]] for c in keys} | {"n": [total]}
        for name, share in zip(names, shares):
            at = order[min(int(np.searchsorted(reached, max(1, np.ceil(share * total)))), len(order) - 1)]
            low, high = bucket_bounds(last[at], unit)
            out[name] = [float((low + high) / 2)]
        return pd.DataFrame(out | {"rank_error": [LEVELS * (total // k)]})

    return digests.groupBy(*keys).applyInPandas(answer, schema)


def valid_calls(calls: DataFrame, max_latency_ms: float = 3_600_000.0) -> DataFrame:
    """Calls counted once each, with their UTC day; latencies that are null,
    negative or beyond ``max_latency_ms`` are left out."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("created_at") / 86400).cast("int"))
    kept = calls.filter(F.col("latency_ms").between(0, max_latency_ms))
    return kept.select("call_id", "engine", "latency_ms", day.alias("day")).dropDuplicates(["call_id"])


def left_out(calls: DataFrame, max_latency_ms: float = 3_600_000.0) -> DataFrame:
    """How many calls of each engine the percentiles leave out, and why; calls
    delivered again count once."""
    once = calls.select("call_id", "engine", "latency_ms").dropDuplicates(["call_id"])
    v = F.col("latency_ms")
    return once.groupBy("engine").agg(F.count("*").alias("n_calls"), F.count_if(v.isNull()).alias("n_null"), F.count_if(v < 0).alias("n_negative"), F.count_if(v > max_latency_ms).alias("n_implausible"))
