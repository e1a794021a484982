"""Queries of recovery, envelopes, caching and engine policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import text
from sievewright.operators import envelope, evidence, governance, recovery
from sievewright.plans import fragments as sql
from sievewright.plans.retrieval import _NORMAL, _PLATFORM
from sievewright.runtime import table
from sievewright.sources import payloads
from sievewright.streaming import outcomes

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


_WORDS = lambda words: ", ".join(sql.quoted(w) for w in words)
_BARE = f"regexp_replace(regexp_replace(coalesce(text, ''), {sql.quoted(recovery.QUOTES)}, ' ', 'g'), '{recovery.MODIFIERS}', ' ', 'g')"
_KEPT = rf"array_to_string(list_filter(regexp_extract_all({_BARE}, '[\x{{4e00}}-\x{{9fff}}A-Za-z0-9]+'), lambda w: lower(w) NOT IN ({_WORDS(recovery.STOP)})), ' ')"
_REST = rf"trim(regexp_replace({_BARE}, '\s+', ' ', 'g'), ' ')"
_RELAXED = f"CASE WHEN {_KEPT} <> '' THEN {_KEPT} WHEN {_REST} <> '' THEN {_REST} ELSE coalesce(text, '') END"


@query(
    f"""WITH q AS (SELECT query_id, coalesce(text, '') AS q, {_RELAXED} AS r FROM queries WHERE trim(coalesce(text, ''), ' ') <> ''),
    s AS (SELECT query_id, unnest(list_filter([CASE WHEN r <> q THEN {{'l': 'L1', 's': 'relax', 'q': r}} END, {{'l': 'L3', 's': 'switch_engine', 'q': r}}, CASE WHEN regexp_matches(q, '{recovery.NOT_LATIN}') THEN {{'l': 'L4', 's': 'cross_lang', 'q': q}} END], lambda x: x IS NOT NULL)) AS st FROM q)
    SELECT query_id, st.l AS level, st.s AS strategy, st.q AS query FROM s"""
)
def recovery_plan(spark: SparkSession, root: str) -> DataFrame:
    return recovery.recovery_plan(table(spark, root, "queries"))


_SIGNAL = rf"list_transform(list_filter(regexp_extract_all(coalesce(q.text, ''), '[A-Z]{{2,}}|[a-zA-Z]{{3,}}|[\x{{4e00}}-\x{{9fff}}]{{2,}}'), lambda w: regexp_matches(w, '^[A-Z]{{2,}}$') OR lower(w) NOT IN ({_WORDS(recovery.NO_SIGNAL)})), lambda w: lower(w))"


@query(
    f"""WITH x AS (SELECT result_id, {_SIGNAL} AS w, lower(concat_ws(' ', coalesce(title, ''), coalesce(snippet, ''), coalesce(url, ''))) AS b FROM search_results JOIN queries q USING (query_id))
    SELECT result_id, trim(b, ' ') <> '' AND (len(w) = 0 OR len(list_filter(w, lambda k: contains(b, k))) > 0) AS answers FROM x"""
)
def answer_signal(spark: SparkSession, root: str) -> DataFrame:
    asked = table(spark, root, "queries").select("query_id", F.col("text").alias("q"))
    told = recovery.answers(F.col("q"), F.col("title"), F.col("snippet"), F.col("url"))
    return _results(spark, root).join(asked, "query_id").select("result_id", told.alias("answers"))


_TRIED = "t AS (SELECT query_id, list_sort(list(DISTINCT engine)) AS tried, list_sort(list(DISTINCT family) FILTER (family IS NOT NULL)) AS families FROM search_results LEFT JOIN engines USING (engine) WHERE engine IS NOT NULL GROUP BY 1)"


@query(
    f"""WITH {_TRIED}, m AS (SELECT query_id, engine, coalesce(family IN ('web', 'reference'), false) AS g, coalesce(priority, 0) AS p FROM t, engines WHERE enabled AND (family IN ('web', 'reference') OR list_contains(families, family)) AND NOT list_contains(tried, engine))
    SELECT query_id, engine, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, p DESC, engine) AS position FROM m QUALIFY position <= 2"""
)
def alternative_engines(spark: SparkSession, root: str) -> DataFrame:
    return recovery.alternatives(_results(spark, root).filter("engine is not null"), table(spark, root, "engines"))


_CANON = sql.canonical_envelope("url")


@query(
    f"""WITH c AS (SELECT query_id, result_id, {_CANON} AS canonical_url, {_PLATFORM} AS platform, coalesce(nullif(source, ''), engine, 'unknown') AS backend, coalesce(score, 0) AS s FROM search_results),
    k AS (SELECT *, platform || ':' || substr(sha256(canonical_url), 1, 16) AS candidate_id FROM c QUALIFY row_number() OVER (PARTITION BY query_id, CASE WHEN canonical_url <> '' THEN canonical_url ELSE chr(31) || result_id END ORDER BY s DESC, result_id) = 1)
    SELECT query_id, result_id, candidate_id, platform, canonical_url, backend, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, result_id) AS rank FROM k"""
)
def candidates(spark: SparkSession, root: str) -> DataFrame:
    return envelope.candidates(_results(spark, root))


@query(
    """WITH b AS (SELECT query_id, engine, count(*) AS returned, count(*) FILTER (coalesce(title, '') <> '' OR coalesce(url, '') <> '') AS usable FROM search_results GROUP BY 1, 2)
    SELECT *, CASE WHEN usable = 0 THEN 'no-results' WHEN usable < returned THEN 'partial' ELSE 'ok' END AS status, returned >= 10 AS truncated FROM b"""
)
def engine_coverage(spark: SparkSession, root: str) -> DataFrame:
    return envelope.coverage(_results(spark, root))


@query(
    f"""WITH r AS (SELECT query_id, {_CANON} AS canonical_url, family AS p, trim(coalesce(title, ''), ' ') AS t FROM search_results JOIN engines USING (engine)),
    g AS (SELECT query_id, canonical_url, list_sort(list(DISTINCT p)) AS ps, count(*) AS n_rows, min(t) AS a, max(t) AS b FROM r WHERE canonical_url <> '' GROUP BY 1, 2)
    SELECT query_id, canonical_url, array_to_string(ps, ',') AS partitions, n_rows, len(ps) > 1 AS dual_sourced, len(ps) > 1 AND a <> b AS conflict FROM g"""
)
def partition_merge(spark: SparkSession, root: str) -> DataFrame:
    """Pages that engines of several families return, and whether they agree."""
    families = table(spark, root, "engines").select("engine", F.col("family").alias("partition"))
    return envelope.merge_partitions(_results(spark, root).join(families, "engine"))


@query(
    f"""WITH r AS (SELECT query_id, engine, min(fetched_at) AS ts, count(*) AS n FROM search_results GROUP BY 1, 2),
    x AS (SELECT query_id, engine, epoch_us(ts) AS ts, n, {_NORMAL} AS q, regexp_matches(coalesce(text, ''), {sql.quoted(text.FRESH_QUERY)}) AS f FROM r JOIN queries USING (query_id)),
    l AS (SELECT *, lag(ts) OVER w AS last, lag(n) OVER w AS had FROM x WHERE q <> '' WINDOW w AS (PARTITION BY q, engine ORDER BY ts, query_id)),
    a AS (SELECT *, CAST(floor((ts - last) / 1000000.0::DOUBLE) AS BIGINT) AS age_s FROM l)
    SELECT query_id, engine, age_s, coalesce(age_s < CASE WHEN f THEN 900 ELSE 3600 END AND had >= n, false) AS hit FROM a"""
)
def cache_hits(spark: SparkSession, root: str) -> DataFrame:
    asked = _results(spark, root).groupBy("query_id", "engine").agg(F.min("fetched_at").alias("at"), F.count("*").alias("n"))
    return envelope.cache_hits(asked.join(table(spark, root, "queries").select("query_id", "text"), "query_id"))


@query(
    """WITH b AS (SELECT query_id, engine, min(rank) AS r FROM search_results WHERE engine IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT query_id, engine, r, coalesce(cost_tier, 'free') <> 'paid' AS o FROM b LEFT JOIN engines USING (engine)),
    s AS (SELECT *, bool_or(o) OVER (PARTITION BY query_id) AS any_open, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN o THEN 0 ELSE 1 END, r, engine) AS position FROM k)
    SELECT query_id, engine, position FROM s WHERE (o OR NOT any_open) AND position <= 3"""
)
def policy_filter(spark: SparkSession, root: str) -> DataFrame:
    best = _results(spark, root).filter("engine is not null").groupBy("query_id", "engine").agg(F.min("rank").alias("best_rank"))
    return governance.policy_filter(best, table(spark, root, "engines"))


@query("SELECT family, array_to_string(list_sort(list(DISTINCT engine)), ',') AS engines, count(*) FILTER (enabled) AS n_enabled FROM engines GROUP BY family")
def engine_families(spark: SparkSession, root: str) -> DataFrame:
    return governance.families(table(spark, root, "engines"))


@query(
    """WITH c AS (SELECT engine, CAST(floor(created_at * 1000) AS BIGINT) AS ts FROM engine_perf WHERE created_at IS NOT NULL),
    n AS (SELECT engine, count(*) OVER (PARTITION BY engine ORDER BY ts RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS n FROM c) SELECT engine, max(n) AS peak FROM n GROUP BY engine"""
)
def peak_rate(spark: SparkSession, root: str) -> DataFrame:
    return governance.peak_rate(table(spark, root, "engine_perf"))


@query(
    """WITH d AS (SELECT engine, CAST(DATE '1970-01-01' + CAST(floor(created_at / 86400) AS INTEGER) AS DATE) AS day, CAST(sum(CAST(round(latency_ms * 1000) AS BIGINT)) // count(*) AS BIGINT) AS mean_us FROM engine_perf WHERE latency_ms >= 0 GROUP BY 1, 2),
    l AS (SELECT *, lag(mean_us) OVER (PARTITION BY engine ORDER BY day) AS previous_us FROM d QUALIFY row_number() OVER (PARTITION BY engine ORDER BY day DESC) = 1)
    SELECT *, CASE WHEN previous_us IS NULL THEN 'new' WHEN mean_us > previous_us THEN 'up' WHEN mean_us < previous_us THEN 'down' ELSE 'flat' END AS trend FROM l"""
)
def latency_trend(spark: SparkSession, root: str) -> DataFrame:
    return governance.latency_trend(table(spark, root, "engine_perf"))


@query(
    """WITH a AS (SELECT max(created_at) AS as_of FROM engine_perf), s AS (SELECT engine, count(*) AS h, count(*) FILTER (created_at > as_of - 60) AS m, count(*) FILTER (success = 0) AS e FROM engine_perf, a WHERE created_at > as_of - 3600 GROUP BY engine)
    SELECT engine, coalesce(m, 0) AS calls_minute, CAST(CASE WHEN coalesce(h, 0) = 0 THEN 0 ELSE e * 10000 // h END AS BIGINT) AS error_e4, qps IS NULL OR coalesce(m, 0) < qps * 60 AS available FROM engines LEFT JOIN s USING (engine) WHERE enabled"""
)
def quota_status(spark: SparkSession, root: str) -> DataFrame:
    calls = table(spark, root, "engine_perf")
    return governance.quota_status(calls, table(spark, root, "engines"), governance.latest(calls))


@query(
    """WITH w AS (SELECT engine, success, CAST(epoch_us(time_bucket(INTERVAL 15 MINUTE, logged_at)) // 1000000 AS BIGINT) - 900 * k AS hour_s FROM engine_perf, (SELECT unnest(range(0, 4)) AS k))
    SELECT engine, hour_s, count(*) AS n_calls, count(*) FILTER (success = 0) AS n_failed FROM w GROUP BY 1, 2"""
)
def sliding_outcomes(spark: SparkSession, root: str) -> DataFrame:
    return outcomes.outcome_windows(table(spark, root, "engine_perf"), slide="15 minutes")


@query(
    """WITH f AS (SELECT engine, epoch_us(logged_at) AS t FROM engine_perf WHERE success = 0 AND logged_at IS NOT NULL), l AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY engine ORDER BY t) >= 1800000000, true) AS first FROM f),
    g AS (SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY engine ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM l)
    SELECT engine, min(t) AS start_us, max(t) + 1800000000 AS end_us, count(*) AS n_failed FROM g GROUP BY engine, s"""
)
def failure_sessions(spark: SparkSession, root: str) -> DataFrame:
    return outcomes.failure_sessions(table(spark, root, "engine_perf"))


@query(
    r"""WITH l AS (SELECT doc_id, coalesce(title, '') AS title, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[\r\n]+', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')), lambda x: length(x) > 20) AS b FROM documents)
    SELECT doc_id, nullif(trim(title, ' '), '') AS title, array_to_string(b, chr(10) || chr(10)) AS body FROM l"""
)
def page_extraction(spark: SparkSession, root: str) -> DataFrame:
    """Documents written as pages, and their titles and blocks read again."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", "\n"), "\n")
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), payloads.escaped(x), F.lit("</p>"))), "<script>var p = '<p>not the text of this page</p>';</script>")
    html = F.concat(F.lit("<html><head><title>"), payloads.escaped(F.coalesce("title", F.lit(""))), F.lit("</title></head><body><nav><p>Home, news, about and contact</p></nav>"), body, F.lit("</body></html>"))
    pages = table(spark, root, "documents").select("doc_id", html.alias("html"))
    return pages.select("doc_id", payloads.page_metadata(F.col("html"))["title"].alias("title"), payloads.page_text(F.col("html")).alias("body"))


@query("SELECT lang, scenario, count(*) AS n_queries, count(expected_domain) AS n_labelled, count(*) FILTER (soft) AS n_soft FROM queries GROUP BY ROLLUP (lang, scenario)")
def query_rollup(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "queries").rollup("lang", "scenario").agg(F.count("*").alias("n_queries"), F.count("expected_domain").alias("n_labelled"), F.count_if("soft").alias("n_soft"))


@query(
    f"""WITH d AS (SELECT query_id, lang, expected_primary, {sql.detect_language('text')} AS detected FROM queries), r AS (SELECT query_id, list(DISTINCT engine) AS engines FROM search_results GROUP BY 1)
    SELECT lang, count(*) AS n_queries, count(*) FILTER (detected = CASE WHEN lang = 'ru' THEN 'cyrillic' WHEN lang IN ('de', 'fr', 'es', 'pt', 'it', 'nl') THEN 'latin' ELSE lang END) AS n_language, count(*) FILTER (list_contains(engines, expected_primary)) AS n_primary
    FROM d LEFT JOIN r USING (query_id) GROUP BY lang"""
)
def eval_summary(spark: SparkSession, root: str) -> DataFrame:
    """By language: queries whose language is told right, and queries that
    their expected engine answered."""
    used = _results(spark, root).groupBy("query_id").agg(F.collect_set("engine").alias("engines"))
    told = table(spark, root, "queries").select("query_id", "lang", "expected_primary", text.detect_language(F.col("text")).alias("detected")).join(used, "query_id", "left")
    want = F.when(F.col("lang") == "ru", "cyrillic").when(F.col("lang").isin("de", "fr", "es", "pt", "it", "nl"), "latin").otherwise(F.col("lang"))
    return told.groupBy("lang").agg(F.count("*").alias("n_queries"), F.count_if(F.col("detected") == want).alias("n_language"), F.count_if(F.array_contains("engines", F.col("expected_primary"))).alias("n_primary"))


@query()
def sorted_by_time(spark: SparkSession, root: str) -> DataFrame:
    """Results of each query, the newest first."""
    from sievewright.operators.timestamps import normalize_timestamps
    from sievewright.operators.timestamps import sorted_by_time as by_time

    rows = _results(spark, root).select("result_id", "query_id", "rank", "engine", "published_at", "fetched_at")
    return by_time(normalize_timestamps(rows, table(spark, root, "engines"))).select("query_id", "result_id", "position")


@query(f"SELECT query_id, engine, min({sql.authority('url', 'source')}) AS least_pct, max({sql.authority('url', 'source')}) AS most_pct FROM search_results GROUP BY 1, 2")
def authority_span(spark: SparkSession, root: str) -> DataFrame:
    told = _results(spark, root).withColumn("a", evidence.authority(F.col("url"), F.col("source")))
    return told.groupBy("query_id", "engine").agg(F.min("a").alias("least_pct"), F.max("a").alias("most_pct"))
