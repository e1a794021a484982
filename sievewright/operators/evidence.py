"""Credibility of results: authority, freshness, density, corroboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import text, urls

# Authority of hosts in hundredths; the longest suffix counts.
AUTHORITY = {
    "gov.cn": 100, "gov": 95, "edu.cn": 95, "edu": 90, "ac.cn": 95,
    "nature.com": 95, "science.org": 95, "ieee.org": 90, "acm.org": 90, "springer.com": 90, "elsevier.com": 90, "arxiv.org": 90, "pubmed.ncbi.nlm.nih.gov": 95, "scholar.google.com": 85, "ncbi.nlm.nih.gov": 95,
    "nvd.nist.gov": 95, "cve.mitre.org": 95, "xinhuanet.com": 95, "people.com.cn": 95, "zhihu.com": 90, "github.com": 85, "stackoverflow.com": 85, "medium.com": 75, "dev.to": 75, "reuters.com": 90, "bloomberg.com": 90,
    "wsj.com": 90, "caixin.com": 90, "yicai.com": 86, "wallstreetcn.com": 86, "cls.cn": 88, "api3.cls.cn": 85, "cs.com.cn": 92, "stcn.com": 88, "cnr.cn": 90, "finance.cnr.cn": 90, "thepaper.cn": 82, "jiemian.com": 80, "36kr.com": 80,
    "infoq.cn": 80, "juejin.cn": 75, "eastmoney.com": 85, "xueqiu.com": 80, "10jqka.com.cn": 78, "docs.python.org": 90, "react.dev": 90, "nextjs.org": 90, "wikipedia.org": 75, "baike.baidu.com": 70, "linkedin.com": 65,
    "twitter.com": 45, "x.com": 45, "reddit.com": 55, "sohu.com": 40, "163.com": 45, "sina.com.cn": 55, "k.sina.com.cn": 55, "baijiahao.baidu.com": 35, "zhuanlan.zhihu.com": 85, "toutiao.com": 40, "weixin.qq.com": 50,
    "guba.eastmoney.com": 35, "maigoo.com": 28, "chinapp.com": 28, "cnpp.cn": 28, "hexun.com": 70, "nbd.com.cn": 80, "eeo.com.cn": 80, "ssap.com.cn": 75, "finviz.com": 82, "seekingalpha.com": 80, "qweather.com": 90,
    "wenshu.court.gov.cn": 96, "court.gov.cn": 96, "jin10.com": 78,
}
# Hosts that are put down to a value, and hosts of opinions that
# get no more than a value.
DEMOTED = {"maigoo.com": 28, "chinapp.com": 28, "cnpp.cn": 28, "canyin88.com": 35, "xiuxianshipin.com": 30}
NARRATIVE = {"x.com": 45, "twitter.com": 45, "weibo.com": 40, "xiaohongshu.com": 40, "bilibili.com": 45, "guba.eastmoney.com": 35}
# The least authority of results of a source in hundredths; for
# sources that are pages of a local search it is the most.
SOURCE_FLOOR = {
    "eastmoney": 90, "zhihu": 80, "arxiv": 85, "semantic_scholar": 90, "openalex": 85, "crossref": 90, "europepmc": 88, "dblp": 85, "github": 85, "byted": 70, "bocha": 70, "tavily": 75, "felo": 70, "duckduckgo": 65, "wikipedia": 75,
    "baidu_baike": 72, "mdn": 90, "pypi": 88, "npm": 88, "huggingface": 85, "docker_hub": 80, "juejin": 65, "devto": 65, "clinicaltrials": 90, "openfda": 88, "archive_org": 75, "steam": 70, "polymarket": 35, "anysearch": 75,
    "local_search": 70, "metaso": 75, "finviz": 75, "seeking_alpha": 70, "jin10": 65, "models_dev": 85, "octen": 70, "qweather": 90, "wenshu": 75, "zhihu_global": 80, "zhihu_hot": 55,
}
SOURCE_CEILING = {"local_baidu": 35, "local_sogou": 35, "local_bing": 40}
_LABELS = 5


def _by_suffix(host: Column, table: dict[str, int]) -> Column:
    """Value of the longest suffix of a host that a table has, or null."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(*[F.try_element_at(known, F.substring_index(host, ".", -n)) for n in range(_LABELS, 0, -1)])


def authority(url: Column, source: Column | None = None) -> Column:
    """Authority in hundredths: 12 for search pages, 30 without a URL, else
    that of the longest known host suffix, else 50; demoted hosts and hosts of
    opinions are put down, documents get 5 more, and the result's source sets
    a floor (or a ceiling)."""

    def of_host(h: Column) -> Column:
        base = F.coalesce(_by_suffix(h, DEMOTED), _by_suffix(h, AUTHORITY), F.lit(50))
        return F.least(base, F.coalesce(_by_suffix(h, NARRATIVE), F.lit(100)))

    # The host stands in a list of one, so that it is worked out once a row.
    base = F.get(F.transform(F.array(urls.host(url)), of_host), F.lit(0))
    path = F.lower(urls.pieces(url)["path"])
    for marks in (("/docs/", "/documentation/"), ("/paper/", "/arxiv/", "/abs/")):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | path.contains(mark)
        base = F.when(hit, F.least(base + 5, F.lit(100))).otherwise(base)
    if source is not None:
        lookup = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), source)
        base = F.least(F.greatest(base, F.coalesce(lookup(SOURCE_FLOOR), F.lit(0))), F.coalesce(lookup(SOURCE_CEILING), F.lit(100)))
    return F.when(F.coalesce(url, F.lit("")) == "", 30).when(urls.is_search_page(url), 12).otherwise(base)


# A year since which something holds, a year of publication, and
# words of the present.
SINCE = r"(?:自|从)?(?:19|20)[0-9]{2}\s*年?\s*(?:以来|起|至今|至|到现在|之前|以前水平|以前)"
PUBLISHED = [r"(?:发布|披露|刊登|更新|Published|发表)[^\n]{0,12}(20[0-9]{2})", r"(20[0-9]{2})\s*年\s*(?:[0-1]?[0-9]\s*月)?\s*(?:[0-3]?[0-9]\s*日)?\s*(?:电|讯|报道)"]
FULL_DATE = r"(20[0-9]{2})[年/-][0-9]{1,2}[月/-][0-9]{1,2}"
PRESENT = r"(?i)最新|latest|recent|breaking|just|刚刚|今日|today|本周|本月"


def freshness(title: Column, snippet: Column, as_of_year: int, url: Column | None = None) -> Column:
    """Freshness in hundredths: by the latest full date, else by the latest
    year that the text or the URL's path names, years since which something
    holds aside; years beyond the next don't count in the text."""
    body = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(snippet, F.lit("")))
    full = F.array_max(F.regexp_extract_all(body, F.lit(FULL_DATE), F.lit(1)))
    loose = F.filter(F.regexp_extract_all(F.regexp_replace(body, SINCE, " "), F.lit("[0-9]+"), F.lit(0)), lambda y: (F.length(y) == 4) & y.startswith("20"))
    hints = F.concat(*[F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in PUBLISHED])
    named = F.filter(F.concat(loose, hints), lambda y: y.cast("int") <= as_of_year + 1)
    if url is not None:
        in_path = F.regexp_extract(F.coalesce(url, F.lit("")), r"/(20[0-9]{2})(?:/|-)", 1)
        named = F.concat(named, F.when(in_path != "", F.array(in_path)).otherwise(F.array().cast("array<string>")))
    age = lambda y: F.lit(as_of_year) - y.cast("int")
    by_age = lambda y, now: F.when(age(y) < 0, 40).when(age(y) == 0, now).when(age(y) == 1, 80).when(age(y) <= 2, 65).when(age(y) <= 5, 45).otherwise(25)
    base = F.when(full.isNotNull(), by_age(full, 90)).when(F.size(named) > 0, by_age(F.array_max(named), 85)).otherwise(50)
    return F.least(F.lit(100), base + F.when(body.rlike(PRESENT), 10).otherwise(0))


def credibility(rows: DataFrame, as_of_year: int) -> DataFrame:
    """Authority, freshness and density in hundredths, and from them and the
    result's score the credibility in ten-thousandths (``.40`` authority,
    ``.35`` density, ``.15`` freshness, ``.10`` score, one half where null)."""
    flags = text.density_flags(F.col("title"), F.col("snippet"))
    scored = rows.withColumns({
        "authority_pct": authority(F.col("url"), F.col("source")), "freshness_pct": freshness(F.col("title"), F.col("snippet"), as_of_year, F.col("url")),
        "density_pct": flags["density_pct"], "is_serp": urls.is_search_page(F.col("url")),
    })
    score = F.round(F.coalesce("score", F.lit(0.5)) * 1000).cast("long")
    return scored.withColumn("credibility_e4", (40 * F.col("authority_pct") + 35 * F.col("density_pct") + 15 * F.col("freshness_pct") + score).cast("long"))


def boosted_credibility(rows: DataFrame, queries: DataFrame, as_of_year: int) -> DataFrame:
    """Credibility with the consensus of the query's results: strong
    corroboration lifts pages by 500, moderate by 200 ten-thousandths."""
    level = cross_validate(rows, queries).select("query_id", "level")
    lift = F.when(F.col("is_serp"), 0).when(F.col("level") == "strong", 500).when(F.col("level") == "moderate", 200).otherwise(0)
    return credibility(rows, as_of_year).join(level, "query_id").withColumn("final_e4", F.least(F.col("credibility_e4") + lift, F.lit(10_000)).cast("long"))


def credibility_summary(scored: DataFrame) -> DataFrame:
    """Results of each query by credibility: high from 0.7, medium from 0.5."""
    c = F.col("final_e4")
    return scored.groupBy("query_id").agg(F.count("*").alias("total"), F.count_if(c >= 7000).alias("high"), F.count_if((c >= 5000) & (c < 7000)).alias("medium"), F.count_if(c < 5000).alias("low"), F.count_if("is_serp").alias("serp"))


def cross_validate(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Corroboration of each query's results: matches, domains, level.

    Distinct hosts are counted exactly; rows of one query are pre-aggregated
    by host and match before the query is gathered.
    """
    words = F.filter(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")), lambda w: F.length(w) > 1)
    asked = queries.select("query_id", words.alias("words"))
    body = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit(""))))
    told = rows.join(asked, "query_id").select("query_id", urls.host(F.col("url")).alias("host"), urls.is_search_page(F.col("url")).alias("serp"), F.exists("words", lambda w: F.contains(body, w)).alias("match"))
    by_host = told.groupBy("query_id", "host", "serp").agg(F.count("*").alias("n"), F.count_if("match").alias("m"))
    out = by_host.groupBy("query_id").agg(F.sum("n").alias("n_results"), F.sum("m").alias("n_matches"), F.count_distinct(F.when(F.col("host") != "", F.col("host"))).alias("n_domains"), F.count_distinct(F.when(~F.col("serp"), F.col("host"))).alias("n_content"))
    level = F.when(F.col("n_results") < 2, "insufficient").when((F.col("n_matches") * 10 >= 8 * F.col("n_results")) & (F.col("n_content") >= 3), "strong")
    level = level.when((F.col("n_matches") * 10 >= 6 * F.col("n_results")) & (F.col("n_content") >= 2), "moderate").when(F.col("n_matches") * 10 >= 4 * F.col("n_results"), "weak").otherwise("minimal")
    return out.withColumn("level", level)


def facts_by_domain(rows: DataFrame) -> DataFrame:
    """Distinct (query, fact, host): the long table of facts."""
    body = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit("")))
    place = urls.host(F.col("url"))
    kept = rows.select("query_id", F.when(place != "", place).otherwise(F.coalesce(F.col("source"), F.lit("unknown"))).alias("domain"), F.explode(text.facts(body)).alias("f"))
    return kept.select("query_id", "domain", "f.fact_type", "f.fact_value").distinct()


def corroborated(table: DataFrame) -> DataFrame:
    """Facts that at least two domains state."""
    return table.groupBy("query_id", "fact_type", "fact_value").agg(F.count("*").alias("n_domains")).filter("n_domains >= 2")


def value_divergence(table: DataFrame) -> DataFrame:
    """Fact types with at least two values in a query."""
    return table.select("query_id", "fact_type", "fact_value").distinct().groupBy("query_id", "fact_type").agg(F.count("*").alias("n_values")).filter("n_values >= 2")


def cross_references(rows: DataFrame, n: int = 3, most: int = 10) -> DataFrame:
    """Runs of ``n`` tokens that at least two hosts of a query share, the
    ``most`` widest spread of each query, ties by the run. Tokens are Latin
    words, then runs of ``n`` Han characters; pages without a host are one.

    Distinct (query, run, host) are formed map-side first, so a page that
    comes back very often counts once before anything is gathered.
    """
    body = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit("")))
    han = F.regexp_extract_all(body, F.lit(r"[\x{4e00}-\x{9fff}]+"), F.lit(0))
    cut = lambda seg: F.transform(F.sequence(F.lit(1), F.length(seg) - (n - 1)), lambda i: F.substr(seg, i, F.lit(n)))
    words = F.concat(F.regexp_extract_all(F.lower(body), F.lit("[a-z]+"), F.lit(0)), F.flatten(F.transform(F.filter(han, lambda x: F.length(x) >= n), cut)))
    host = urls.host(F.col("url"))
    told = rows.select("query_id", F.when(host == "", F.lit("unknown")).otherwise(host).alias("domain"), words.alias("w")).filter(F.size("w") >= n)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
    runs = F.filter(runs, lambda r: F.length(r) >= 4)
    seen = told.select("query_id", "domain", F.explode(F.array_distinct(runs)).alias("ngram")).distinct()
    shared = seen.groupBy("query_id", "ngram").agg(F.count("*").alias("n_domains")).filter("n_domains >= 2")
    order = Window.partitionBy("query_id").orderBy(F.desc("n_domains"), "ngram")
    return shared.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most)


def static_dimensions(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Relevance and completeness of each result, in ten-thousandths.

    Relevance is the share of the query's tokens that the title (``.65``) and
    the snippet (``.35``) hold, one half where the query has none.
    """
    asked = queries.select("query_id", F.array_distinct(text.tokens(F.col("text"))).alias("q"))
    held = lambda c: F.size(F.array_intersect("q", text.tokens(F.col(c)))).cast("long")
    hits = (65 * held("title") + 35 * held("snippet")) * 100
    relevance = F.when(F.size("q") == 0, F.lit(5000)).otherwise(F.floor(hits / F.greatest(F.size("q"), F.lit(1)) + 1e-9)).cast("long")
    snippet = F.coalesce("snippet", F.lit(""))
    complete = 30 * F.least(F.length(snippet), F.lit(200)) + F.when(snippet.rlike("[0-9]"), 2000).otherwise(0) + F.when(F.trim(F.coalesce("title", F.lit(""))) != "", 2000).otherwise(0)
    return rows.join(asked, "query_id").select("result_id", relevance.alias("relevance_e4"), complete.cast("long").alias("completeness_e4"))
