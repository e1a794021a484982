"""Quality of sources, pages and engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import text, urls

# Hosts by type of source.
NEWS = ["nytimes.com", "bbc.com", "bbc.co.uk", "reuters.com", "theguardian.com", "washingtonpost.com", "bloomberg.com", "apnews.com", "aljazeera.com", "cnbc.com", "ft.com", "economist.com", "techcrunch.com", "theverge.com", "arstechnica.com", "wired.com", "nature.com", "science.org"]
ANSWERS = ["stackoverflow.com", "stackexchange.com", "serverfault.com", "superuser.com", "mathoverflow.com", "askubuntu.com"]
CODE = ["github.com", "raw.githubusercontent.com", "gist.github.com"]
FORUM_PARTS = ["forum", "forums", "community", "discourse", "board"]
# Marks in the markup of a page, by its type.
PAYWALL = ["subscribe to continue", "subscribe to read", "this article is for subscribers", "create a free account to continue", "sign in to continue reading", "you've reached your free article limit", "subscriber-only content", "premium content", "paywall"]
QA_MARKS = ["stackoverflow", "stackexchange", 'class="question', 'class="answer', "data-answerid", "data-questionid"]
FORUM_MARKS = ["phpbb", "discourse", 'class="forum', 'id="forum', 'class="thread', 'class="post-body', 'class="message-body', "data-post-id"]
DOCS_MARKS = ["mkdocs", "docusaurus", "readthedocs", "sphinx-document", "algolia-docsearch", "md-nav", "theme-doc", 'class="rst-content"', "wy-nav-side"]


def source_type(url: Column) -> Column:
    """Type of a URL's source: gov, edu, github, docs-site, qa, forum, blog,
    ecommerce, news or unknown."""

    def of_host(h: Column) -> Column:
        ends = lambda *names: F.greatest(*[h.endswith(n) for n in names]) if len(names) > 1 else h.endswith(names[0])
        news = F.greatest(*[(h == d) | h.endswith("." + d) for d in NEWS])
        return (
            F.when(h == "", "unknown").when(ends(".gov") | (h == "gov") | h.contains(".gov."), "gov").when(ends(".edu", ".ac.uk") | h.rlike(r"\.ac\.[a-z]{2}$"), "edu")
            .when(h.isin(*CODE) | h.endswith(".github.io"), "github").when(h.rlike(r"^(?:docs|developers?)\."), "docs-site").when(h.isin(*ANSWERS) | ends(".stackexchange.com", ".stackoverflow.com"), "qa")
            .when(F.greatest(*[h.contains(p) for p in FORUM_PARTS]) | (h == "reddit.com") | h.endswith(".reddit.com"), "forum")
            .when(h.startswith("blog.") | h.isin("medium.com", "wordpress.com", "substack.com") | ends(".substack.com", ".medium.com"), "blog")
            .when(h.rlike(r"^(?:shop|store)\.") | h.isin("amazon.com", "ebay.com") | h.endswith(".shop"), "ecommerce").when(news, "news").otherwise("unknown")
        )

    host = F.regexp_replace(F.regexp_replace(F.lower(urls.pieces(url)["netloc"]), r"^.*@", ""), r":.*$", "")
    return F.get(F.transform(F.array(host), of_host), F.lit(0))


def is_official(kind: Column) -> Column:
    """Whether a type of source speaks for itself."""
    return kind.isin("gov", "edu", "github", "docs-site")


def content_quality(rows: DataFrame, content: str = "text", title: str = "title") -> DataFrame:
    """Add ``word_count, quality_e4, content_ok``: length .2, density .2,
    structure .2, evidence .3, title .1, in ten-thousandths."""
    raw = F.coalesce(F.col(content), F.lit(""))
    clean = F.trim(F.regexp_replace(F.regexp_replace(raw, r"<[^>]+>", " "), r"\s+", " "))
    df = rows.withColumn("_clean", clean).withColumn("word_count", F.length("_clean"))
    dense = F.length(F.replace("_clean", F.lit(" "), F.lit(""))) / F.greatest(F.length(raw), F.lit(1))
    length = F.least(F.greatest((F.col("word_count") - 50) / 1000, F.lit(0.0)), F.lit(1.0))
    words = F.filter(F.split(F.lower(F.coalesce(F.col(title), F.lit(""))), r"\s+"), lambda w: F.length(w) > 1)
    low = F.lower("_clean")
    bonus = F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: low.contains(w))), F.size(words)), F.lit(0.0))
    evidence = text.density_flags(F.col(title), F.col("_clean"))["density_pct"]
    score = 2000 * length + 2000 * F.least(dense / 0.5, F.lit(1.0)) + F.when(raw.rlike(r"(?i)</?(?:p|li|h[1-6]|pre|blockquote|section|div)\b"), 2000).otherwise(0) + 30 * evidence + 1000 * bonus
    df = df.withColumn("quality_e4", F.least(F.floor(score + 0.5), F.lit(10_000)).cast("long"))
    return df.withColumn("content_ok", (F.col("quality_e4") > 3000) & (F.col("word_count") > 50)).drop("_clean")


def _holds(low: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | low.contains(mark)
    return out


def page_type(html: Column, url: Column) -> Column:
    """Type of a page by its markup: redirect, paywall, qa, forum, docs, list,
    article or unknown."""
    low = F.lower(F.coalesce(html, F.lit("")))
    size = F.length(F.regexp_replace(low, r"<[^>]+>", ""))
    body = F.regexp_replace(low, r"(?s)<(nav|header|footer|aside|script|style|noscript)\b[^>]*>.*?</\1>", "")
    links = F.regexp_extract_all(body, F.lit(r"<a\b[^>]*?href=[\"']([^\"']+)[\"']"), F.lit(1))
    host = urls.pieces(F.lower(url))["netloc"]
    own = F.size(F.filter(links, lambda x: ~x.rlike(r"^(?:#|mailto:|tel:|javascript:)") & (x.rlike(r"^[/?]") | F.coalesce((urls.pieces(x)["netloc"] == host) & x.contains("://"), F.lit(False)))))
    article = low.rlike(r"<article\b")
    listing = (host != "") & ~article & (own >= 20) & ((size < 1500) | (size / F.greatest(own, F.lit(1)) < 200))
    return (
        F.when(F.trim(low) == "", "unknown").when(low.rlike(r"<meta\b[^>]*?http-equiv=[\"']refresh[\"'][^>]*?content=[\"'][^\"']*url="), "redirect")
        .when(low.rlike(r"location\.href\s*=|location\.replace|window\.location\s*=") & (size < 500), "redirect").when(_holds(low, PAYWALL), "paywall").when(_holds(low, QA_MARKS), "qa")
        .when(_holds(low, FORUM_MARKS), "forum").when(_holds(low, DOCS_MARKS), "docs").when(listing, "list").when(article, "article").otherwise("unknown")
    )


def needs_browser(content: Column, html: Column) -> Column:
    """Whether a fetched page must be opened in a browser: too little text, an
    empty shell, a challenge, or a demand for scripts."""
    c, h = F.coalesce(content, F.lit("")), F.coalesce(html, F.lit(""))
    challenge = r"(?i)checking your browser|cf-browser-verification|cf_chl_opt|ray id|challenge-platform|please verify you are a human|cloudflare"
    scripts = r"(?i)enable javascript|javascript is required|javascript to run this app|you need to enable javascript|requires javascript"
    shell = r"(?is)^\s*<html[^>]*>\s*<head>.*?</head>\s*<body>\s*</body>\s*</html>\s*$"
    return (F.length(F.trim(c)) < 100) | h.rlike(shell) | h.rlike(challenge) | c.rlike(challenge) | ((F.length(c) < 300) & h.rlike(scripts))


def engine_quality(queries: DataFrame, rows: DataFrame, engines: DataFrame) -> DataFrame:
    """Quality of each engine over the queries it answered and those of which
    it had no usable result: ``pass_rate``, ``empty_rate`` and ``complete_e4``
    (rows with title, URL and source), and ``quality_e4`` of them (.5, .3, .2).

    A query counts for an engine if the engine has any row of it; a run with no
    row that has a title or a URL is empty, and one passes if half its rows'
    fields are there.
    """
    title, url = F.coalesce("title", F.lit("")) != "", F.coalesce("url", F.lit("")) != ""
    part = F.when(title & url, 2).when(title | url, 1).otherwise(0)
    runs = rows.join(queries.select("query_id"), "query_id").groupBy("engine", "query_id").agg(F.count_if(title | url).alias("n"), F.sum(part).alias("p"), F.count("*").alias("all"))
    complete = F.col("p") * 10_000 / (2 * F.col("all"))
    by = runs.groupBy("engine").agg(F.count("*").alias("runs"), F.count_if(F.col("n") == 0).alias("empty"), F.count_if((F.col("n") > 0) & (complete >= 5000)).alias("passed"), F.sum(F.floor(complete)).alias("c"))
    out = engines.filter("enabled").select("engine").join(by, "engine")
    whole = lambda x: F.floor(x + 1e-9).cast("long")
    score = 5000 * F.col("passed") / F.col("runs") + 3000 * (F.col("runs") - F.col("empty")) / F.col("runs") + 2000 * F.col("c") / (10_000 * F.col("runs"))
    return out.select("engine", "runs", "empty", "passed", whole(F.col("c") / F.col("runs")).alias("complete_e4"), whole(score).alias("quality_e4"))
