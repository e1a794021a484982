"""Fusion of ranked lists: weighted reciprocal ranks, consensus, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import urls

# Fusion weight of an engine in hundredths; others count 100.
ENGINE_WEIGHTS = {
    "wikipedia": 140, "wikidata": 140, "zh_wikipedia": 140, "baidu_baike": 130, "arxiv": 130, "openalex": 130, "crossref": 130, "semantic_scholar": 130, "dblp": 130, "europepmc": 130, "pubmed": 130, "google_scholar": 130,
    "pubchem": 130, "uniprot": 130, "rcsb_pdb": 130, "github": 120, "pypi": 120, "npm": 120, "crates": 120, "mdn": 120, "stackoverflow": 110, "imdb": 120, "thesportsdb": 120, "itunes": 120, "finviz": 120, "sina_quote": 120,
    "tencent_quote": 120, "eastmoney": 120, "fred": 130, "worldbank": 130, "nbs_stats": 130, "eurostat": 130, "bocha_ai": 130, "opencorporates": 120, "google_patents": 120,
    "twitter": 70, "reddit": 70, "xiaohongshu": 70, "bilibili": 70, "weibo": 70, "v2ex": 80, "zhihu": 80, "hackernews": 80, "zhihu_hot": 80, "baidu_hot": 80, "toutiao_hot": 80, "bilibili_hot": 80,
}


def engine_weight(source: Column) -> Column:
    """Weight of an engine in hundredths; of several joined by ``/``, the
    greatest."""
    known = F.create_map(*[F.lit(x) for kv in ENGINE_WEIGHTS.items() for x in kv])
    names = F.filter(F.transform(F.split(F.coalesce(source, F.lit("")), "/"), F.trim), lambda x: x != "")
    return F.coalesce(F.array_max(F.transform(names, lambda x: F.coalesce(F.try_element_at(known, x), F.lit(100)))), F.lit(100))


def fusion_key() -> F.Column:
    """Canonical URL, else the title, else the card, else the position."""
    url = urls.canonical_fusion(F.col("url"))
    return F.when(url != "", url).when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("__title__:"), "title")).when(F.coalesce("card_type", F.lit("")) != "", F.concat(F.lit("__card__:"), "card_type")).otherwise(F.concat(F.lit("__idx__:"), F.coalesce(F.col("rank") - 1, F.lit(0)).cast("string")))


def with_weights(rows: DataFrame) -> DataFrame:
    """``weight`` in hundredths, by the row's engine, else by its source."""
    return rows.withColumn("weight", engine_weight(F.when(F.coalesce("engine", F.lit("")) != "", F.col("engine")).otherwise(F.col("source"))))


def fuse(rows: DataFrame, k: int = 60) -> DataFrame:
    """One row per query and key: score in billionths, consensus, best text.

    ``rows`` has a ``weight`` in hundredths. The text kept is the longest of
    title and snippet together, ties by the smallest ``result_id``. Null
    ranks count as rank 1. Partial sums are made map-side, so a key that
    comes back very often is no hot spot.
    """
    # The order keeps text out of the shuffle's comparisons but for the best.
    text = F.struct(F.length(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit("")))).alias("n"), (-F.col("result_id")).alias("i"))
    part = F.floor(F.col("weight").cast("long") * 10_000_000 / (k + F.coalesce("rank", F.lit(1)))).cast("long")
    return rows.withColumn("key", fusion_key()).groupBy("query_id", "key").agg(
        F.sum(part).alias("score_e9"), F.count_distinct("engine").alias("consensus"), F.count("*").alias("n_rows"), (-F.max(text)["i"]).alias("best_id")
    )


def consensus_boost(fused: DataFrame) -> DataFrame:
    """Score raised by 5 % for each further engine, three at most."""
    return fused.withColumn("boosted_e9", F.floor(F.col("score_e9") * (100 + 5 * F.least(F.col("consensus") - 1, F.lit(3))) / 100).cast("long"))


def top_ranked(fused: DataFrame, n: int, score: str = "score_e9") -> DataFrame:
    """The first ``n`` of each query by score, ties by key; with ``position``."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "key")
    return fused.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def family_cap(rows: DataFrame, engines: DataFrame, most: int = 2, limited: tuple[str, ...] | None = None) -> DataFrame:
    """At most ``most`` engines a family in each query, by best rank; with
    ``limited`` only those families are cut."""
    best = rows.groupBy("query_id", "engine").agg(F.min("rank").alias("best_rank"))
    known = best.join(engines.select("engine", "family"), "engine")
    order = Window.partitionBy("query_id", "family").orderBy("best_rank", "engine")
    kept = F.col("n") <= most if limited is None else (F.col("n") <= most) | ~F.col("family").isin(*limited)
    return known.withColumn("n", F.row_number().over(order)).filter(kept).select("query_id", "family", "engine", "best_rank")


def url_dedupe(rows: DataFrame) -> DataFrame:
    """The first row of each query and canonical URL, by smallest key."""
    kept = rows.withColumn("key", urls.canonical_fusion(F.col("url"))).filter("key <> ''")
    return kept.groupBy("query_id", "key").agg(F.min("result_id").alias("result_id"), F.count("*").alias("n_rows"))
