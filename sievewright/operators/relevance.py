"""Lexical relevance: BM25 over the blocks of a page, TF-IDF over profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import text

# Fixed values of the BM25 score: saturation, length weight, least score kept,
# blocks kept where none reaches it, and the length from which pages are cut.
K1, B, LEAST, FALLBACK, LONG = 1.5, 0.75, 1.0, 5, 2000
BLOCK_TOKEN = r"[a-z0-9\x{4e00}-\x{9fff}]+"


def block_tokens(value: Column) -> Column:
    """Runs of Latin letters, digits and Han characters of two or more."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit(BLOCK_TOKEN), F.lit(0)), lambda t: F.length(t) >= 2)


def focus_blocks(pages: DataFrame, page: str = "text", query: str = "query") -> DataFrame:
    """The blocks of each page that a query asks for: ``keep`` (indices from 0,
    ascending), ``n_blocks`` and ``scores_e4``.

    Blocks are parted by blank lines. All blocks of a page that is short, has
    one block, or whose query has no tokens, are kept. Else blocks of a BM25
    score of one or more are kept, or the five best; a heading before a kept
    block is kept with it. One row stays one row: everything is computed over
    arrays within it.
    """
    body = F.coalesce(F.col(page), F.lit(""))
    blocks = F.filter(F.split(F.regexp_replace(body, r"\r\n?", "\n"), r"\n(?:[ \t]*\n)+"), lambda b: F.trim(F.regexp_replace(b, r"\s+", " ")) != "")
    told = pages.withColumn("_blocks", blocks).withColumn("_terms", F.array_distinct(block_tokens(F.col(query))))
    told = told.withColumn("_t", F.transform("_blocks", block_tokens)).withColumn("n_blocks", F.size("_blocks"))
    sizes = F.transform("_t", F.size)
    mean = F.aggregate(sizes, F.lit(0), lambda a, x: a + x) / F.greatest(F.col("n_blocks"), F.lit(1))
    told = told.withColumn("_mean", F.when(mean > 0, mean).otherwise(F.lit(1.0)))
    has = lambda q: F.size(F.filter("_t", lambda t: F.array_contains(t, q)))
    told = told.withColumn("_idf", F.transform("_terms", lambda q: F.struct(q.alias("q"), F.log((F.col("n_blocks") - has(q) + 0.5) / (has(q) + 0.5) + 1).alias("w"))))

    def score(tokens: Column) -> Column:
        weight = lambda x: F.size(F.filter(tokens, lambda t: t == x["q"]))
        part = lambda x: x["w"] * weight(x) * (K1 + 1) / (weight(x) + K1 * (1 - B + B * F.size(tokens) / F.col("_mean")))
        return F.aggregate("_idf", F.lit(0.0), lambda a, x: a + part(x))

    told = told.withColumn("_s", F.transform("_t", score)).withColumn("scores_e4", F.transform("_s", lambda s: F.round(s * 10_000).cast("long")))
    every = F.sequence(F.lit(0), F.greatest(F.col("n_blocks") - 1, F.lit(0)))
    good = F.filter(every, lambda i: F.get("scores_e4", i) >= int(LEAST * 10_000))
    best = F.transform(F.slice(F.array_sort(F.transform(every, lambda i: F.struct((-F.get("scores_e4", i)).alias("s"), i.alias("i")))), 1, FALLBACK), lambda x: x["i"])
    told = told.withColumn("_kept", F.when(F.size(good) > 0, good).otherwise(best))
    heading = lambda i: F.ltrim(F.get("_blocks", i)).startswith("#")
    more = F.filter(F.transform("_kept", lambda i: i - 1), lambda i: (i >= 0) & heading(i) & ~heading(i + 1))
    whole = (F.length(body) < LONG) | (F.col("n_blocks") <= 1) | (F.size("_terms") == 0)
    none = F.array().cast("array<int>")
    keep = F.when(F.col("n_blocks") == 0, none).when(whole, every).otherwise(F.array_sort(F.array_distinct(F.concat("_kept", more))))
    return told.withColumn("keep", keep).drop("_blocks", "_terms", "_t", "_mean", "_idf", "_s", "_kept")


def profile_tokens(value: Column) -> Column:
    """Han characters and words of two or more, and their neighbouring pairs."""
    t = F.filter(text.tokens(value), lambda x: (F.length(x) > 1) | (x >= "一"))
    pairs = F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(t, pairs)


def tfidf_vectors(documents: DataFrame, key: str, value: str, idf: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vectors ``key, token, weight`` of texts, and the ``token, idf`` used:
    those given, or those of the documents themselves."""
    counts = documents.select(key, F.explode(profile_tokens(F.col(value))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    if idf is None:
        total = documents.agg(F.count("*").alias("total"))
        df = counts.groupBy("token").agg(F.count("*").alias("df"))
        idf = df.crossJoin(F.broadcast(total)).select("token", (F.log((F.col("total") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    sizes = counts.groupBy(key).agg(F.sum("n").alias("size"))
    return counts.join(idf, "token").join(sizes, key).select(key, "token", (F.col("n") / F.col("size") * F.col("idf")).alias("weight")), idf


def route_by_profile(queries: DataFrame, profiles: DataFrame, top: int = 3) -> DataFrame:
    """The profiles nearest to each query by the cosine of their TF-IDF
    vectors: ``query_id, profile, score_e4, position``.

    ``profiles`` has ``profile, document``; their number is that of domains,
    their vocabulary is the only one that counts. Queries that share no token
    with any profile get none.
    """
    vectors, idf = tfidf_vectors(profiles, "profile", "document")
    asked, _ = tfidf_vectors(queries.select("query_id", "text"), "query_id", "text", idf)
    norm = lambda v, k: v.groupBy(k).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dot = asked.join(vectors.withColumnRenamed("weight", "other"), "token").groupBy("query_id", "profile").agg(F.sum(F.col("weight") * F.col("other")).alias("dot"))
    scored = dot.join(norm(asked, "query_id"), "query_id").join(norm(vectors, "profile").withColumnRenamed("norm", "own"), "profile")
    scored = scored.select("query_id", "profile", F.round(F.col("dot") / (F.col("norm") * F.col("own")) * 10_000).cast("long").alias("score_e4"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score_e4"), "profile")
    return scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top)


# Words that ask for research.
RESEARCH = ["分析", "研究", "格局", "趋势", "深度", "全面", "详细", "research", "analysis", "comprehensive", "deep", "对比", "评测", "推荐", "review", "comparison"]


def needs_parallel(queries: DataFrame, routed: DataFrame) -> DataFrame:
    """Whether a query should go to several profiles: it asks for research,
    its best score is under 0.15, or the second is within a fifth of it."""
    best = routed.groupBy("query_id").agg(F.max(F.when(F.col("position") == 1, F.col("score_e4"))).alias("a"), F.max(F.when(F.col("position") == 2, F.col("score_e4"))).alias("b"))
    low = F.lower(F.coalesce("text", F.lit("")))
    asks = F.lit(False)
    for word in RESEARCH:
        asks = asks | low.contains(word)
    a, b = F.coalesce("a", F.lit(0)), F.col("b")
    close = F.coalesce((a > 0) & ((a - b) * 5 < a), F.lit(False))
    return queries.join(best, "query_id", "left").select("query_id", (asks | (a < 1500) | close).alias("parallel"))
