"""Research packs: tiers of evidence, gates, gaps, topics, work packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import urls
from sievewright.operators import evidence
from sievewright.runtime import materialize

# Parts of source names by tier of evidence.
TIERS = {
    "primary": ["arxiv", "openalex", "crossref", "semantic_scholar", "pubmed", "europepmc", "github", "cninfo", "fred", "worldbank", "nbs_stats", "sina_quote", "tencent_quote"],
    "secondary": ["zhihu", "eastmoney", "byted", "bocha", "octen", "cls_telegraph", "em_global_news", "jin10"],
    "tertiary": ["twitter", "reddit", "weibo", "bilibili", "xiaohongshu", "douban", "v2ex", "hackernews", "local_sogou", "local_baidu"],
}
# Han characters that begin or end no topic.
STOP_HAN = (
    "的了是在和我你她他它这就也不很但而或如果因为所以而且或者虽然但是可以应该需要已经正在之前之后时候地方问题工作生活东西事情时间今天昨天明天今年去年明年个些吗呢啊吧哦嗯哈呀嘛哪谁什么怎么多少几样种类下上里中后前时来回过开给让把被对从向比跟和与及当比"
    "如例包括相关关于根据通过进行使用作为成为具有属于位于来自获得达到实现完成产生形成存在发生发展提供包含涉及适用于"
)


def evidence_tier(source: Column, grades: dict[str, list[str]] | None = None) -> Column:
    """Tier of a source: by the given grades where one of their names is in
    it, else by its name; ``unknown`` where neither tells."""
    low = F.lower(F.coalesce(source, F.lit("")))
    out = F.when(low == "", "unknown")
    for tier in TIERS:
        for name in (grades or {}).get(tier, []):
            out = out.when(source.contains(name), tier)
    for tier, names in TIERS.items():
        hit = F.lit(False)
        for name in names:
            hit = hit | low.contains(name)
        out = out.when(hit, tier)
    return out.otherwise("unknown")


def dossier_gates(queries: DataFrame, rows: DataFrame, graded: bool = False) -> DataFrame:
    """Whether a query's results allow a conclusion: ``n_urls, coverage,
    n_conflicts, has_primary, failures, warnings, passed, conclusion_cap``.

    No URL, or no result at all, is a failure; facts of several values, and
    (where sources are ``graded``) no primary source, are warnings. A
    conclusion is capped at low, medium or high.
    """
    by = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("url", F.lit("")) != "").alias("u"), F.max(evidence_tier(F.col("source")) == "primary").alias("p"))
    conflicts = evidence.value_divergence(evidence.facts_by_domain(rows)).groupBy("query_id").agg(F.count("*").alias("c"))
    told = queries.select("query_id").join(by, "query_id", "left").join(conflicts, "query_id", "left")
    n, u = F.coalesce("n", F.lit(0)), F.coalesce("u", F.lit(0))
    told = told.select(
        "query_id", u.alias("n_urls"), F.when(n >= 3, "COVERED").when(n >= 1, "PARTIAL").otherwise("NOT_COVERED").alias("coverage"),
        F.coalesce("c", F.lit(0)).alias("n_conflicts"), F.coalesce("p", F.lit(False)).alias("has_primary"),
    )
    failures = F.concat_ws(",", F.when(F.col("n_urls") == 0, F.lit("no_sources")), F.when(F.col("coverage") == "NOT_COVERED", F.lit("uncovered_dimensions")))
    warnings = F.concat_ws(",", F.when(F.col("n_conflicts") > 0, F.lit("fact_conflicts")), F.when(F.lit(graded) & ~F.col("has_primary"), F.lit("no_primary_sources")))
    told = told.withColumn("failures", failures).withColumn("warnings", warnings)
    return told.withColumn("passed", F.col("failures") == "").withColumn("conclusion_cap", F.when(F.col("failures") != "", "low").when(F.col("warnings") != "", "medium").otherwise("high"))


def knowledge_gaps(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """What a query's results lack: ``query_id, gap``: ``no_results``,
    ``few_results`` (one), ``few_sources`` (under three), ``year_missing``
    (the year it names is in none)."""
    year = F.regexp_extract(F.coalesce("text", F.lit("")), "20[0-9]{2}", 0)
    asked = queries.select("query_id", year.alias("year"))
    body = F.concat(F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    by = rows.join(asked, "query_id").groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("source") != "", F.col("source"))).alias("s"), F.max(F.contains(body, F.col("year"))).alias("y"))
    told = asked.join(by, "query_id", "left").select("query_id", "year", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("y", F.lit(False)).alias("y"))
    gaps = F.array(F.when(F.col("n") == 0, F.lit("no_results")), F.when(F.col("n") == 1, F.lit("few_results")), F.when(F.col("s") < 3, F.lit("few_sources")), F.when((F.col("year") != "") & ~F.col("y"), F.lit("year_missing")))
    return told.select("query_id", F.explode(F.array_compact(gaps)).alias("gap"))


def topics(rows: DataFrame, by: str = "query_id", title: str = "title", most: int = 10) -> DataFrame:
    """The topics that titles name most often: ``by, topic, mentions,
    position``. Topics are Latin words of three letters or more, and pairs of
    Han characters that no stop character begins or ends; ties by topic."""
    t = F.coalesce(F.col(title), F.lit(""))
    words = F.filter(F.regexp_extract_all(F.lower(t), F.lit("[a-z]{2,}"), F.lit(0)), lambda w: F.length(w) >= 3)
    han = F.regexp_extract_all(t, F.lit(r"[\x{4e00}-\x{9fff}]"), F.lit(0))
    pairs = F.when(F.size(han) > 1, F.zip_with(F.slice(han, 1, F.size(han) - 1), F.slice(han, 2, F.size(han) - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    kept = F.filter(pairs, lambda p: ~F.lit(STOP_HAN).contains(F.substring(p, 1, 1)) & ~F.lit(STOP_HAN).contains(F.substring(p, 2, 1)))
    counts = rows.select(by, F.explode(F.concat(words, kept)).alias("topic")).groupBy(by, "topic").agg(F.count("*").alias("mentions"))
    order = Window.partitionBy(by).orderBy(F.desc("mentions"), "topic")
    return counts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most)


def stage_packages(packages: DataFrame, key: str = "id", needs: str = "depends_on") -> DataFrame:
    """``stage`` of each work package (from 1) and whether it is ``cyclic``:
    a package comes after all that it depends on; packages that depend on each
    other in a circle share the last stage. Dependencies that don't exist,
    and null ones, count for nothing. One job a stage.
    """
    known = packages.select(key).distinct()
    left = packages.select(key, F.explode_outer(needs).alias("need")).join(known.withColumnRenamed(key, "need"), "need", "left_semi").select(key, "need").distinct()
    left, open_ = materialize(left, "package-needs"), known
    staged, stage = None, 0
    while not open_.isEmpty():
        stage += 1
        ready = open_.join(left.select(key).distinct(), key, "left_anti")
        cyclic = ready.isEmpty()
        done = materialize((open_ if cyclic else ready).select(key, F.lit(stage).alias("stage"), F.lit(cyclic).alias("cyclic")), "package-stage")
        staged = done if staged is None else staged.unionByName(done)
        open_ = open_.join(done.select(key), key, "left_anti")
        left = left.join(done.select(F.col(key).alias("need")), "need", "left_anti").join(done.select(key), key, "left_anti")
    return staged if staged is not None else known.select(key, F.lit(1).alias("stage"), F.lit(False).alias("cyclic"))


def source_leads(rows: DataFrame) -> DataFrame:
    """One lead a canonical URL of each query: ``query_id, canonical,
    result_id`` (the smallest), ``n_rows, tier`` (the best)."""
    rank = F.coalesce(*[F.when(evidence_tier(F.col("source")) == t, F.lit(i)) for i, t in enumerate(TIERS)], F.lit(len(TIERS)))
    by = rows.withColumn("canonical", urls.canonical_dossier(F.col("url"))).filter("canonical <> ''").groupBy("query_id", "canonical").agg(F.min("result_id").alias("result_id"), F.count("*").alias("n_rows"), F.min(rank).alias("r"))
    return by.select("query_id", "canonical", "result_id", "n_rows", F.get(F.array(*[F.lit(t) for t in [*TIERS, "unknown"]]), F.col("r")).alias("tier"))
