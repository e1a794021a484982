"""Near-duplicate texts by MinHash over character trigrams.

Eight hashes a text; two texts are as similar as the share of hashes they
agree in. A threshold leaves room for a number of disagreements, so cutting
the eight hashes into one band more than that finds every pair: some band
agrees wholly. Texts of equal signature are one class from the start, and only
classes are joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import text
from sievewright.runtime import materialize

# Fixed values of the hash family: hashes, length of the grams, seed and multiplier.
HASHES, GRAM, SEED, MULTIPLIER = 8, 3, 1315423911, 1099511628211


def signatures(texts: list[str]) -> np.ndarray:
    """The least hash of the trigrams of each text, for each of the hashes;
    white space is left out, a shorter text is one gram."""
    flat = ["".join(t.split()) for t in texts]
    out = np.empty((len(flat), HASHES), dtype=np.uint64)
    long = [i for i, t in enumerate(flat) if len(t) >= GRAM]
    codes = np.frombuffer("".join(flat[i] for i in long).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(flat[i]) for i in long), dtype=np.int64, count=len(long))
    ends = np.cumsum(sizes)
    for seed in range(HASHES):
        if long:
            h = np.full(len(codes) - GRAM + 1, seed * SEED, dtype=np.uint64)
            for k in range(GRAM):
                h = (h ^ codes[k : len(codes) - GRAM + 1 + k]) * np.uint64(MULTIPLIER)
            # Grams that reach into the next text lose against any other.
            row = np.repeat(np.arange(len(long)), sizes)[: len(h)]
            h[np.arange(len(h)) + GRAM > ends[row]] = np.uint64(0xFFFFFFFFFFFFFFFF)
            out[long, seed] = np.minimum.reduceat(h, ends - sizes)
        for i, t in enumerate(flat):
            if len(t) < GRAM:
                value = seed * SEED
                for c in t:
                    value = (value ^ ord(c)) * MULTIPLIER & 0xFFFFFFFFFFFFFFFF
                out[i, seed] = value
    return out


def signature(value: Column) -> Column:
    """MinHash signature of a text; null counts as empty."""

    @F.pandas_udf("array<bigint>")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series(list(signatures(values.fillna("").tolist()).view(np.int64)), dtype=object)

    return of(value)


def agreement(a: Column, b: Column) -> Column:
    """In how many hashes two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _bands(least: int) -> list[tuple[int, int]]:
    """Cut of the hashes into one band more than may disagree."""
    edges = np.linspace(0, HASHES, HASHES - least + 2).astype(int)
    return list(zip(edges[:-1].tolist(), np.diff(edges).tolist()))


def _links(classes: DataFrame, by: list[str], first: Column, least: int) -> DataFrame:
    """Pairs of classes (``a`` before ``b`` by ``first``) that agree in at
    least that many hashes, each once: ``by, a, b, n_equal``."""
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(*[F.get("sig", F.lit(at + k)) for k in range(n)]).alias("h")) for i, (at, n) in enumerate(_bands(least))])
    banded = classes.withColumn("band", F.explode(bands)).select(*by, "band", first.alias("key"), "sig")
    pairs = banded.alias("a").join(banded.alias("b"), [*[F.col(f"a.{c}") == F.col(f"b.{c}") for c in by], F.col("a.band") == F.col("b.band"), F.col("a.key") < F.col("b.key")])
    pairs = pairs.select(*[F.col(f"a.{c}").alias(c) for c in by], F.col("a.key").alias("a"), F.col("b.key").alias("b"), agreement(F.col("a.sig"), F.col("b.sig")).alias("n_equal"))
    return pairs.filter(F.col("n_equal") >= least).distinct()


def query_links(queries: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Links between different query texts: ``first_id, second_id, n_equal``.

    A class is the queries of equal normalised text, named by its smallest
    ``query_id``; ``query_classes`` gives the membership. Texts whose lengths
    differ by more than half of the longer are not linked. Null and blank
    texts are left out.
    """
    least = int(np.ceil(threshold * HASHES - 1e-9))
    named = queries.select("query_id", text.normalized_query(F.col("text")).alias("t")).filter("t <> ''")
    classes = materialize(named.groupBy("t").agg(F.min("query_id").alias("query_id")).withColumn("sig", signature(F.col("t"))).withColumn("size", F.length("t")), "query-classes")
    found = _links(classes, [], F.struct("query_id", "size"), least)
    near = F.abs(F.col("a.size") - F.col("b.size")) * 2 <= F.greatest("a.size", "b.size")
    return found.filter(near).select(F.col("a.query_id").alias("first_id"), F.col("b.query_id").alias("second_id"), "n_equal")


def query_classes(queries: DataFrame) -> DataFrame:
    """The class of each query: ``query_id, first_id``, by normalised text."""
    from pyspark.sql import Window

    named = queries.select("query_id", text.normalized_query(F.col("text")).alias("t")).filter("t <> ''")
    return named.join(named.groupBy("t").agg(F.min("query_id").alias("first_id")), "t").select("query_id", "first_id")


def minhash_dedupe(rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Near-duplicates within each query: ``query_id, result_id, kept``.

    Results are taken by score, then selection, then ``result_id``; one is
    dropped if it is as similar as ``threshold`` to one that was kept. Rows
    without title and snippet are always kept. Results of equal signature are
    settled without a join. The rest is decided in rounds: who has no better
    neighbour left is kept, who has a kept neighbour is dropped; each round
    runs a job, and links shrink with each.
    """
    least = int(np.ceil(threshold * HASHES - 1e-9))
    body = F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit(""))))
    order = F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), (-F.coalesce("selection", F.lit(0.0))).alias("l"), F.col("result_id").alias("i"))
    told = materialize(rows.select("query_id", "result_id", order.alias("key"), F.when(body != "", signature(body)).alias("sig")), "result-signatures")
    classes = told.filter("sig is not null").groupBy("query_id", "sig").agg(F.min("key").alias("key"))
    links = materialize(_links(classes, ["query_id"], F.col("key"), least).select("query_id", "a", "b"), "result-links")
    dropped = None
    while not links.isEmpty():
        later = links.select("query_id", F.col("b").alias("a")).distinct()
        kept = links.select("query_id", "a").distinct().join(later, ["query_id", "a"], "left_anti")
        out = links.join(kept, ["query_id", "a"], "left_semi").select("query_id", F.col("b").alias("a")).distinct()
        out = materialize(out, "result-dropped")
        dropped = out if dropped is None else dropped.unionByName(out)
        rest = links.join(out, ["query_id", "a"], "left_anti").join(out.withColumnRenamed("a", "b"), ["query_id", "b"], "left_anti").join(kept, ["query_id", "a"], "left_anti")
        links = materialize(rest.select("query_id", "a", "b"), "result-links")
    best = classes.withColumnRenamed("key", "a")
    if dropped is not None:
        best = best.join(dropped, ["query_id", "a"], "left_anti")
    survivors = best.select("query_id", F.col("a.i").alias("result_id"), F.lit(True).alias("kept"))
    return told.join(survivors, ["query_id", "result_id"], "left").select("query_id", "result_id", F.coalesce("kept", F.col("sig").isNull()).alias("kept"))
