"""Queries of security, quality, research packs, the breaker and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import threats
from sievewright.operators import governance, quality, research, security
from sievewright.plans import fragments as sql
from sievewright.plans.core import _FACTS
from sievewright.sources import payloads, sinks
from sievewright.streaming import breaker
from sievewright.runtime import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(twin: str | None = None):
    """Register a query under its name, with its SQL twin."""

    def register(function):
        QUERIES[function.__name__] = function
        if twin is not None:
            SQL[function.__name__] = twin
        return function

    return register


def _results(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "search_results")


_FAMILIES = {"n_injections": threats.INJECTION, "n_exfiltration": threats.EXFILTRATION, "n_impersonation": threats.IMPERSONATION, "n_script": threats.SCRIPT}
_COUNTS = ", ".join("CAST(" + " + ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), {sql.quoted(p)}) THEN 1 ELSE 0 END" for p in patterns) + f" AS INT) AS {name}" for name, patterns in _FAMILIES.items())


@query(f"SELECT doc_id, {_COUNTS} FROM documents")
def threat_patterns(spark: SparkSession, root: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return table(spark, root, "documents").select("doc_id", *[security.matches(body, patterns).alias(name) for name, patterns in _FAMILIES.items()])


@query()
def content_scrub(spark: SparkSession, root: str) -> DataFrame:
    return security.scrub(table(spark, root, "documents").select("doc_id", "text"), "text").drop("text")


_H = rf"regexp_replace(regexp_replace(lower({sql.netloc('url')}), '^.*@', ''), ':.*$', '')"
_LIST = lambda names: ", ".join(f"'{n}'" for n in names)
_TYPE = f"""CASE WHEN h = '' THEN 'unknown' WHEN ends_with(h, '.gov') OR h = 'gov' OR contains(h, '.gov.') THEN 'gov' WHEN ends_with(h, '.edu') OR ends_with(h, '.ac.uk') OR regexp_matches(h, '\\.ac\\.[a-z]{{2}}$') THEN 'edu'
    WHEN h IN ({_LIST(quality.CODE)}) OR ends_with(h, '.github.io') THEN 'github' WHEN regexp_matches(h, '^(?:docs|developers?)\\.') THEN 'docs-site' WHEN h IN ({_LIST(quality.ANSWERS)}) OR ends_with(h, '.stackexchange.com') OR ends_with(h, '.stackoverflow.com') THEN 'qa'
    WHEN regexp_matches(h, 'forum|community|discourse|board') OR h = 'reddit.com' OR ends_with(h, '.reddit.com') THEN 'forum' WHEN starts_with(h, 'blog.') OR h IN ('medium.com', 'wordpress.com', 'substack.com') OR ends_with(h, '.substack.com') OR ends_with(h, '.medium.com') THEN 'blog'
    WHEN regexp_matches(h, '^(?:shop|store)\\.') OR h IN ('amazon.com', 'ebay.com') OR ends_with(h, '.shop') THEN 'ecommerce' WHEN {' OR '.join(f"h = '{d}' OR ends_with(h, '.{d}')" for d in quality.NEWS)} THEN 'news' ELSE 'unknown' END"""


@query(f"WITH x AS (SELECT result_id, {_H} AS h FROM search_results), k AS (SELECT result_id, {_TYPE} AS source_type FROM x) SELECT result_id, source_type, source_type IN ('gov', 'edu', 'github', 'docs-site') AS official FROM k")
def source_types(spark: SparkSession, root: str) -> DataFrame:
    told = _results(spark, root).select("result_id", quality.source_type(F.col("url")).alias("source_type"))
    return told.withColumn("official", quality.is_official(F.col("source_type")))


@query(
    rf"""WITH c AS (SELECT doc_id, title, coalesce(text, '') AS raw, trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS clean FROM documents),
    w AS (SELECT *, length(clean) AS word_count, list_filter(string_split_regex(lower(coalesce(title, '')), '\s+'), lambda w: length(w) > 1) AS words, {sql.density('title', 'clean')} AS density FROM c),
    s AS (SELECT doc_id, word_count, CAST(least(floor(2000::DOUBLE * least(greatest((word_count - 50)::DOUBLE / 1000, 0.0::DOUBLE), 1.0::DOUBLE) + 2000::DOUBLE * least(length(replace(clean, ' ', ''))::DOUBLE / greatest(length(raw), 1) / 0.5::DOUBLE, 1.0::DOUBLE)
        + CASE WHEN regexp_matches(raw, '(?i)</?(?:p|li|h[1-6]|pre|blockquote|section|div)\b') THEN 2000 ELSE 0 END + 30 * density
        + 1000 * CASE WHEN len(words) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(words, lambda w: contains(lower(clean), w)))::DOUBLE / len(words) END + 0.5::DOUBLE), 10000) AS BIGINT) AS quality_e4 FROM w)
    SELECT doc_id, word_count, quality_e4, quality_e4 > 3000 AND word_count > 50 AS content_ok FROM s"""
)
def content_quality(spark: SparkSession, root: str) -> DataFrame:
    return quality.content_quality(table(spark, root, "documents")).select("doc_id", "word_count", "quality_e4", "content_ok")


@query(
    """WITH r AS (SELECT engine, query_id, count(*) FILTER (coalesce(title, '') <> '' OR coalesce(url, '') <> '') AS n, sum(CASE WHEN coalesce(title, '') <> '' AND coalesce(url, '') <> '' THEN 2 WHEN coalesce(title, '') <> '' OR coalesce(url, '') <> '' THEN 1 ELSE 0 END) AS p, count(*) AS c
        FROM search_results JOIN queries USING (query_id) GROUP BY 1, 2),
    g AS (SELECT engine, count(*) AS runs, count(*) FILTER (n = 0) AS empty, count(*) FILTER (n > 0 AND p * 10000 >= 5000 * 2 * c) AS passed, sum((p * 10000) // (2 * c)) AS s FROM r GROUP BY engine)
    SELECT engine, runs, empty, passed, CAST(s // runs AS BIGINT) AS complete_e4, CAST((5000 * passed * 10000 + 3000 * (runs - empty) * 10000 + 2000 * s) // (10000 * runs) AS BIGINT) AS quality_e4 FROM g JOIN engines USING (engine) WHERE enabled"""
)
def engine_quality(spark: SparkSession, root: str) -> DataFrame:
    return quality.engine_quality(table(spark, root, "queries"), _results(spark, root), table(spark, root, "engines"))


_TIER = "CASE WHEN coalesce(source, '') = '' THEN 'unknown' " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(source), '{n}')''' for n in names)} THEN '{tier}'" for tier, names in research.TIERS.items()) + " ELSE 'unknown' END"


@query(f"SELECT {_TIER} AS tier, count(*) AS n_rows FROM search_results GROUP BY 1")
def evidence_tiers(spark: SparkSession, root: str) -> DataFrame:
    return _results(spark, root).groupBy(research.evidence_tier(F.col("source")).alias("tier")).agg(F.count("*").alias("n_rows"))


@query(
    f"""{_FACTS}, c AS (SELECT query_id, count(*) AS c FROM (SELECT query_id, fact_type FROM facts GROUP BY 1, 2 HAVING count(DISTINCT fact_value) >= 2) GROUP BY 1),
    b AS (SELECT query_id, count(*) AS n, count(*) FILTER (coalesce(url, '') <> '') AS u, bool_or({_TIER} = 'primary') AS p FROM search_results GROUP BY 1),
    t AS (SELECT query_id, coalesce(u, 0) AS n_urls, CASE WHEN coalesce(n, 0) >= 3 THEN 'COVERED' WHEN coalesce(n, 0) >= 1 THEN 'PARTIAL' ELSE 'NOT_COVERED' END AS coverage, coalesce(c, 0) AS n_conflicts, coalesce(p, false) AS has_primary FROM queries LEFT JOIN b USING (query_id) LEFT JOIN c USING (query_id)),
    f AS (SELECT *, concat_ws(',', CASE WHEN n_urls = 0 THEN 'no_sources' END, CASE WHEN coverage = 'NOT_COVERED' THEN 'uncovered_dimensions' END) AS failures, concat_ws(',', CASE WHEN n_conflicts > 0 THEN 'fact_conflicts' END, CASE WHEN NOT has_primary THEN 'no_primary_sources' END) AS warnings FROM t)
    SELECT *, failures = '' AS passed, CASE WHEN failures <> '' THEN 'low' WHEN warnings <> '' THEN 'medium' ELSE 'high' END AS conclusion_cap FROM f"""
)
def dossier_gates(spark: SparkSession, root: str) -> DataFrame:
    return research.dossier_gates(table(spark, root, "queries"), _results(spark, root), graded=True)


@query(
    """WITH q AS (SELECT query_id, regexp_extract(coalesce(text, ''), '20[0-9]{2}') AS year FROM queries),
    b AS (SELECT query_id, count(*) AS n, count(DISTINCT nullif(source, '')) AS s, bool_or(contains(coalesce(title, '') || coalesce(snippet, ''), year)) AS y FROM search_results JOIN q USING (query_id) GROUP BY 1),
    t AS (SELECT query_id, year, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(y, false) AS y FROM q LEFT JOIN b USING (query_id))
    SELECT query_id, unnest(list_filter([CASE WHEN n = 0 THEN 'no_results' END, CASE WHEN n = 1 THEN 'few_results' END, CASE WHEN s < 3 THEN 'few_sources' END, CASE WHEN year <> '' AND NOT y THEN 'year_missing' END], lambda g: g IS NOT NULL)) AS gap FROM t"""
)
def knowledge_gaps(spark: SparkSession, root: str) -> DataFrame:
    return research.knowledge_gaps(table(spark, root, "queries"), _results(spark, root))


@query(
    rf"""WITH w AS (SELECT query_id, list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z]{{2,}}'), lambda x: length(x) >= 3) AS a, regexp_extract_all(coalesce(title, ''), '[\x{{4e00}}-\x{{9fff}}]') AS h FROM search_results),
    p AS (SELECT query_id, a || list_transform(list_filter(range(1, len(h)), lambda i: NOT contains('{research.STOP_HAN}', h[i]) AND NOT contains('{research.STOP_HAN}', h[i + 1])), lambda i: h[i] || h[i + 1]) AS t FROM w),
    c AS (SELECT query_id, topic, count(*) AS mentions FROM (SELECT query_id, unnest(t) AS topic FROM p) GROUP BY 1, 2)
    SELECT query_id, topic, mentions, row_number() OVER (PARTITION BY query_id ORDER BY mentions DESC, topic) AS position FROM c QUALIFY position <= 10"""
)
def title_topics(spark: SparkSession, root: str) -> DataFrame:
    return research.topics(_results(spark, root))


_RANKED = {t: i for i, t in enumerate([*research.TIERS, "unknown"])}


@query(
    f"""WITH l AS (SELECT query_id, {sql.canonical_dossier('url')} AS canonical, result_id, {_TIER} AS tier FROM search_results),
    g AS (SELECT query_id, canonical, min(result_id) AS result_id, count(*) AS n_rows, min(CASE tier {' '.join(f"WHEN '{t}' THEN {i}" for t, i in _RANKED.items())} END) AS r FROM l WHERE canonical <> '' GROUP BY 1, 2)
    SELECT query_id, canonical, result_id, n_rows, CASE r {' '.join(f"WHEN {i} THEN '{t}'" for t, i in _RANKED.items())} END AS tier FROM g"""
)
def source_leads(spark: SparkSession, root: str) -> DataFrame:
    return research.source_leads(_results(spark, root))


_STATUS = """a AS (SELECT max(created_at) AS as_of FROM engine_perf), g AS (SELECT engine, max(created_at) FILTER (success = 1) AS ok FROM engine_perf GROUP BY 1),
    r AS (SELECT engine, count(*) AS failures, max(created_at) AS last FROM engine_perf JOIN g USING (engine) WHERE success = 0 AND (ok IS NULL OR created_at > ok) GROUP BY 1),
    t AS (SELECT engine, coalesce(failures, 0) AS failures, greatest(coalesce(failures, 0) - 1, 0) AS openings, coalesce(last, 0) + 60 - as_of AS waits FROM g LEFT JOIN r USING (engine), a),
    s AS (SELECT engine, failures, openings, CASE WHEN failures < 2 THEN 'closed' WHEN waits > 0 THEN 'open' WHEN openings >= 3 THEN 'disabled' ELSE 'half_open' END AS state, waits FROM t)"""


@query(f"WITH {_STATUS} SELECT engine, failures, openings, state, CAST(CASE WHEN state = 'open' THEN ceil(waits) ELSE 0 END AS BIGINT) AS cooldown_s FROM s")
def breaker_status(spark: SparkSession, root: str) -> DataFrame:
    calls = table(spark, root, "engine_perf")
    return breaker.breaker_status(calls, governance.latest(calls))


@query(f"WITH {_STATUS} SELECT engine FROM engines WHERE engine NOT IN (SELECT engine FROM s WHERE state IN ('open', 'disabled'))")
def usable_engines(spark: SparkSession, root: str) -> DataFrame:
    calls = table(spark, root, "engine_perf")
    return breaker.usable(table(spark, root, "engines").select("engine"), breaker.breaker_status(calls, governance.latest(calls)))


def _answers(spark: SparkSession, root: str) -> DataFrame:
    """The results as the engines' answers: one list for each query and engine."""
    item = F.struct(F.struct("rank", "result_id").alias("o"), F.struct("title", F.col("url").alias("html_url"), F.col("snippet").alias("summary")).alias("i"))
    lists = _results(spark, root).groupBy("query_id", "engine").agg(F.array_sort(F.collect_list(item)).alias("l"))
    return lists.select("query_id", "engine", F.transform("l", lambda x: x["i"]).alias("items"))


_ITEMS = "SELECT query_id, engine, row_number() OVER (PARTITION BY query_id, engine ORDER BY rank, result_id) AS position, {title} AS title, {url} AS url, {snippet} AS snippet FROM search_results"
_JSON_FIELD = lambda c, n: f"nullif(substr(trim({c}, ' '), 1, {n}), '')"


@query(f"SELECT * FROM ({_ITEMS.format(title=_JSON_FIELD('title', 200), url=_JSON_FIELD('url', 1000000), snippet=_JSON_FIELD('snippet', 300))}) WHERE title IS NOT NULL OR url IS NOT NULL")
def decode_json_payloads(spark: SparkSession, root: str) -> DataFrame:
    """Answers written as JSON and decoded again give the results."""
    written = _answers(spark, root).select("query_id", "engine", F.to_json(F.struct(F.struct(F.col("items").alias("value")).alias("webPages"))).alias("payload"))
    return payloads.decode_json(written).drop("payload")


_XML_FIELD = lambda c: rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'), ' ')"


_FEED = _ITEMS.format(title=f"substr({_XML_FIELD('title')}, 1, 200)", url=f"nullif({_XML_FIELD('url')}, '')", snippet=f"nullif(substr({_XML_FIELD('snippet')}, 1, 300), '')")


@query(f"SELECT * FROM ({_FEED}) WHERE title <> ''")
def decode_feed_payloads(spark: SparkSession, root: str) -> DataFrame:
    """Answers written as RSS and decoded again give the results."""
    part = lambda name, c: F.concat(F.lit(f"<{name}>"), payloads.escaped(F.coalesce(c, F.lit(""))), F.lit(f"</{name}>"))
    item = lambda i: F.concat(F.lit("<item>"), part("title", i["title"]), part("link", i["html_url"]), part("description", i["summary"]), F.lit("</item>"))
    written = _answers(spark, root).select("query_id", "engine", F.concat(F.lit('<rss version="2.0"><channel>'), F.array_join(F.transform("items", item), ""), F.lit("</channel></rss>")).alias("payload"))
    return payloads.decode_feed(written).drop("payload")


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, result_id) AS n FROM search_results QUALIFY n <= 10),
    l AS (SELECT query_id, n, concat_ws(chr(10), n || '. ' || coalesce(title, '(no title)'), '   ' || nullif(url, ''), '   ' || nullif(substr(snippet, 1, 160), '')) AS line FROM n)
    SELECT query_id, string_agg(line, chr(10) ORDER BY n) AS report FROM l GROUP BY query_id"""
)
def text_report(spark: SparkSession, root: str) -> DataFrame:
    return sinks.text_report(_results(spark, root))
