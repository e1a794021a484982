"""Rerank by five dimensions, the last of them what a title adds.

Four dimensions are static: relevance, authority, freshness, completeness. The
fifth is one minus the overlap of a title's word pairs with those of the
results ranked before it, which only a greedy pass can tell. As it weighs
little, a bound keeps that pass small: what falls behind the n-th static score
by more than the whole weight of novelty can't be among the first n.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import text
from sievewright.operators import evidence

# Weights of relevance, authority, freshness, completeness and
# novelty in hundredths, in general and for technical domains.
WEIGHTS = {"general": (30, 30, 20, 15, 5), "technical": (40, 20, 20, 15, 5)}


def word_pairs(title: Column) -> Column:
    """The distinct pairs of neighbouring tokens of a title."""
    t = text.tokens(title)
    return F.array_distinct(F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>")))


def static_scores(rows: DataFrame, queries: DataFrame, as_of_year: int, kind: str = "general") -> DataFrame:
    """``query_id, result_id, pairs, static_e6``: the weighed sum of the four
    static dimensions in millionths."""
    w = WEIGHTS[kind]
    dims = evidence.static_dimensions(rows, queries)
    scored = rows.join(dims, "result_id")
    fixed = w[1] * 100 * evidence.authority(F.col("url"), F.col("source")) + w[2] * 100 * evidence.freshness(F.col("title"), F.col("snippet"), as_of_year, F.col("url"))
    return scored.select("query_id", "result_id", word_pairs(F.col("title")).alias("pairs"), (w[0] * F.col("relevance_e4") + fixed + w[3] * F.col("completeness_e4")).cast("long").alias("static_e6"))


def greedy(ids: list[int], static: list[int], pairs: list[set[str]], n: int, weight: int) -> list[tuple[int, int, int]]:
    """(id, score, novelty) of the first ``n``; ties by the order given."""
    seen: set[str] = set()
    left = list(range(len(ids)))
    out = []
    while left and len(out) < n:
        best = None
        for i in left:
            either = len(pairs[i] | seen)
            novelty = 10_000 if not pairs[i] or not seen else (either - len(pairs[i] & seen)) * 10_000 // either
            score = static[i] + weight * novelty
            if best is None or score > best[1]:
                best = (i, score, novelty)
        left.remove(best[0])
        seen |= pairs[best[0]]
        out.append((ids[best[0]], best[1], best[2]))
    return out


def five_dimensions(scored: DataFrame, n: int = 10, kind: str = "general") -> DataFrame:
    """The first ``n`` results of each query: ``query_id, result_id, position,
    score_e6, novelty_e4``, ties by ``result_id``.

    ``scored`` is of ``static_scores``. Rows that share their word pairs and
    static score can stand for each other, so ``n`` of them are enough.
    """
    weight = WEIGHTS[kind][4]
    line = Window.partitionBy("query_id").orderBy(F.desc("static_e6"), "result_id")
    alike = Window.partitionBy("query_id", "pairs", "static_e6").orderBy("result_id")
    bound = F.coalesce(F.max(F.when(F.col("r") == n, F.col("static_e6"))).over(Window.partitionBy("query_id")), F.lit(-1))
    near = scored.withColumn("r", F.row_number().over(line)).withColumn("bound", bound).filter(F.col("static_e6") >= F.col("bound") - weight * 10_000)
    few = near.withColumn("k", F.row_number().over(alike)).filter(F.col("k") <= n).select("query_id", "result_id", "pairs", "static_e6")

    def ranked(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("result_id")
        found = greedy(group["result_id"].tolist(), group["static_e6"].tolist(), [set(p) for p in group["pairs"]], n, weight)
        return pd.DataFrame([(group["query_id"].iloc[0], i, k + 1, s, v) for k, (i, s, v) in enumerate(found)], columns=["query_id", "result_id", "position", "score_e6", "novelty_e4"])

    return few.groupBy("query_id").applyInPandas(ranked, "query_id string, result_id long, position int, score_e6 long, novelty_e4 long")
