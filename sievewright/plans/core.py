"""Queries over the operators of the retrieval engine, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import text, urls
from sievewright.operators import evidence, fusion, governance
from sievewright.operators.timestamps import normalize_timestamps, within_window
from sievewright.plans import fragments as sql
from sievewright.runtime import table

AS_OF_YEAR = 2026
# The window of the registered time filters, its end day included.
WINDOW = ("2026-01-01", "2026-01-31")
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


_URL = "coalesce(url, '')"
_KEY = (
    f"CASE WHEN {sql.canonical_fusion('url')} <> '' THEN {sql.canonical_fusion('url')} WHEN coalesce(title, '') <> '' THEN '__title__:' || title "
    "WHEN coalesce(card_type, '') <> '' THEN '__card__:' || card_type ELSE '__idx__:' || CAST(coalesce(rank - 1, 0) AS VARCHAR) END"
)
_WEIGHT = "CASE w.n " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fusion.ENGINE_WEIGHTS.items()) + " ELSE 100 END"
_WEIGHTS = f"coalesce(list_max(list_transform(list_filter(list_transform(string_split(coalesce(nullif(engine, ''), source, ''), '/'), lambda x: trim(x)), lambda x: x <> ''), lambda x: {_WEIGHT.replace('w.n', 'x')})), 100)"
_FUSED = f"""
    WITH keyed AS (SELECT *, {_KEY} AS key, {_WEIGHTS} AS weight FROM search_results),
    fused AS (SELECT query_id, key, CAST(sum(CAST(floor(weight * 10000000 / (60 + coalesce(rank, 1))) AS BIGINT)) AS BIGINT) AS score_e9, count(DISTINCT engine) AS consensus, count(*) AS n_rows,
        arg_min(result_id, struct_pack(n := -length(coalesce(title, '') || ' ' || coalesce(snippet, '')), i := result_id)) AS best_id FROM keyed GROUP BY query_id, key)"""


def _results(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "search_results")


def _fused(spark: SparkSession, root: str) -> DataFrame:
    return fusion.fuse(fusion.with_weights(_results(spark, root)))


@query(f"SELECT result_id, {sql.canonical_fusion('url')} AS canonical FROM search_results")
def canonical_url_fusion(spark: SparkSession, root: str) -> DataFrame:
    return _results(spark, root).select("result_id", urls.canonical_fusion(F.col("url")).alias("canonical"))


@query(f"SELECT result_id, {sql.canonical_dossier('url')} AS canonical FROM search_results")
def canonical_url_dossier(spark: SparkSession, root: str) -> DataFrame:
    return _results(spark, root).select("result_id", urls.canonical_dossier(F.col("url")).alias("canonical"))


@query(f"SELECT result_id, {sql.canonical_envelope('url')} AS canonical FROM search_results")
def canonical_url_envelope(spark: SparkSession, root: str) -> DataFrame:
    return _results(spark, root).select("result_id", urls.canonical_envelope(F.col("url")).alias("canonical"))


@query(f"SELECT {sql.host('url')} AS host, count(*) AS n_rows FROM search_results GROUP BY 1")
def host_counts(spark: SparkSession, root: str) -> DataFrame:
    return _results(spark, root).groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n_rows"))


@query(f"SELECT result_id FROM search_results WHERE NOT {sql.is_search_page('url')}")
def serp_filter(spark: SparkSession, root: str) -> DataFrame:
    return _results(spark, root).filter(~urls.is_search_page(F.col("url"))).select("result_id")


@query(f"SELECT query_id, {sql.canonical_fusion('url')} AS key, min(result_id) AS result_id, count(*) AS n_rows FROM search_results WHERE {sql.canonical_fusion('url')} <> '' GROUP BY 1, 2")
def url_dedupe(spark: SparkSession, root: str) -> DataFrame:
    return fusion.url_dedupe(_results(spark, root))


@query(f"SELECT result_id, engine || ':' || substr(sha256({sql.canonical_envelope('url')}), 1, 16) AS candidate_id FROM search_results")
def candidate_ids(spark: SparkSession, root: str) -> DataFrame:
    return _results(spark, root).select("result_id", F.concat("engine", F.lit(":"), F.substring(F.sha2(urls.canonical_envelope(F.col("url")), 256), 1, 16)).alias("candidate_id"))


@query(f"{_FUSED} SELECT query_id, key, score_e9, consensus, n_rows FROM fused")
def rrf_weighted(spark: SparkSession, root: str) -> DataFrame:
    return _fused(spark, root).drop("best_id")


@query(f"{_FUSED} SELECT query_id, key, CAST(floor(score_e9 * (100 + 5 * least(consensus - 1, 3)) / 100) AS BIGINT) AS boosted_e9 FROM fused")
def consensus_boost(spark: SparkSession, root: str) -> DataFrame:
    return fusion.consensus_boost(_fused(spark, root)).select("query_id", "key", "boosted_e9")


@query(f"{_FUSED} SELECT query_id, key, best_id FROM fused")
def best_text_pick(spark: SparkSession, root: str) -> DataFrame:
    return _fused(spark, root).select("query_id", "key", "best_id")


@query(f"{_FUSED} SELECT query_id, key, score_e9, row_number() OVER (PARTITION BY query_id ORDER BY score_e9 DESC, key) AS position FROM fused QUALIFY position <= 15")
def overfetch_truncate(spark: SparkSession, root: str) -> DataFrame:
    return fusion.top_ranked(_fused(spark, root), 15).select("query_id", "key", "score_e9", "position")


@query(
    """WITH best AS (SELECT query_id, engine, min(rank) AS best_rank FROM search_results GROUP BY 1, 2)
    SELECT query_id, family, engine, best_rank FROM best JOIN engines USING (engine) QUALIFY row_number() OVER (PARTITION BY query_id, family ORDER BY best_rank, engine) <= 2"""
)
def family_cap(spark: SparkSession, root: str) -> DataFrame:
    return fusion.family_cap(_results(spark, root), table(spark, root, "engines"))


@query(
    """SELECT query_id, result_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, result_id) AS number, substr(title, 1, 160) AS title, substr(snippet, 1, 160) AS snippet
    FROM search_results WHERE url <> ''"""
)
def numbered_sources(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "result_id")
    kept = _results(spark, root).filter("url <> ''").select("query_id", "result_id", "score", F.substring("title", 1, 160).alias("title"), F.substring("snippet", 1, 160).alias("snippet"))
    return kept.withColumn("number", F.row_number().over(order)).drop("score")


def _windowed(spark: SparkSession, root: str, strict: bool) -> DataFrame:
    rows = _results(spark, root).select("result_id", "engine", "published_at", "fetched_at")
    return within_window(normalize_timestamps(rows, table(spark, root, "engines")), WINDOW[0], WINDOW[1], strict).select("result_id")


@query()
def time_window_lenient(spark: SparkSession, root: str) -> DataFrame:
    """Results not known to lie outside the window, whatever their notation."""
    return _windowed(spark, root, False)


@query()
def time_window_strict(spark: SparkSession, root: str) -> DataFrame:
    """Results known to lie inside the window."""
    return _windowed(spark, root, True)


@query(f"SELECT query_id, array_to_string({sql.excluded('text')}, ' ') AS excluded FROM queries")
def parse_negation(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "queries").select("query_id", F.array_join(text.excluded_terms(F.col("text")), " ").alias("excluded"))


@query(
    f"""WITH q AS (SELECT query_id, {sql.excluded('text')} AS terms FROM queries)
    SELECT result_id FROM search_results JOIN q USING (query_id) WHERE len(list_filter(terms, lambda t: contains(lower(coalesce(title, '') || coalesce(snippet, '') || {_URL}), t))) = 0"""
)
def negation_filter(spark: SparkSession, root: str) -> DataFrame:
    asked = table(spark, root, "queries").select("query_id", text.excluded_terms(F.col("text")).alias("terms"))
    body = F.lower(F.concat(F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), F.coalesce("url", F.lit(""))))
    return _results(spark, root).join(asked, "query_id").filter(~F.exists("terms", lambda t: F.contains(body, t))).select("result_id")


@query(f"SELECT query_id, {sql.detect_language('text')} AS detected FROM queries")
def detect_language(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "queries").select("query_id", text.detect_language(F.col("text")).alias("detected"))


@query(f"SELECT lang, {sql.detect_language('text')} AS detected, count(*) AS n_queries FROM queries GROUP BY 1, 2")
def language_confusion(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "queries").groupBy("lang", text.detect_language(F.col("text")).alias("detected")).agg(F.count("*").alias("n_queries"))


@query(f"SELECT query_id, {sql.intents('text')} AS intents FROM queries")
def classify_intents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "queries").select("query_id", text.intents(F.col("text")).alias("intents"))


@query(f"SELECT doc_id, len({sql.tokens('text')}) AS n_tokens, len(list_distinct({sql.tokens('text')})) AS n_distinct FROM documents")
def tokenize_counts(spark: SparkSession, root: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    return table(spark, root, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query(
    r"""WITH t AS (SELECT result_id, regexp_replace(coalesce(title, ''), '\s+', '', 'g') AS f FROM search_results)
    SELECT result_id, len(list_distinct(list_transform(range(1, greatest(length(f) - 2, 1) + 1), lambda i: substr(f, i, 3)))) AS n_grams FROM t"""
)
def char_ngrams(spark: SparkSession, root: str) -> DataFrame:
    return _results(spark, root).select("result_id", F.size(text.char_ngrams(F.col("title"))).alias("n_grams"))


@query(
    f"""WITH t AS (SELECT DISTINCT query_id, unnest({sql.tokens('text')}) AS token FROM queries), n AS (SELECT count(*) AS n FROM queries)
    SELECT token, count(*) AS df, CAST(round((ln((n + 1.0) / (count(*) + 1.0)) + 1.0) * 1000) AS BIGINT) AS idf_e3 FROM t, n GROUP BY token, n"""
)
def tfidf_weights(spark: SparkSession, root: str) -> DataFrame:
    asked = table(spark, root, "queries")
    total = asked.agg(F.count("*").alias("n"))
    df = asked.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0
    return df.crossJoin(F.broadcast(total)).select("token", "df", F.round(idf * 1000).cast("long").alias("idf_e3"))


@query(f"SELECT result_id, {sql.authority('url', 'source')} AS authority_pct FROM search_results")
def authority_suffix(spark: SparkSession, root: str) -> DataFrame:
    return _results(spark, root).select("result_id", evidence.authority(F.col("url"), F.col("source")).alias("authority_pct"))


@query(f"SELECT result_id, {sql.density('title', 'snippet')} AS density_pct FROM search_results")
def evidence_density(spark: SparkSession, root: str) -> DataFrame:
    return _results(spark, root).select("result_id", text.density_flags(F.col("title"), F.col("snippet"))["density_pct"].alias("density_pct"))


@query(f"SELECT result_id, {sql.freshness('title', 'snippet', 'url', AS_OF_YEAR)} AS freshness_pct FROM search_results")
def freshness_as_of(spark: SparkSession, root: str) -> DataFrame:
    return _results(spark, root).select("result_id", evidence.freshness(F.col("title"), F.col("snippet"), AS_OF_YEAR, F.col("url")).alias("freshness_pct"))


_SCORED = f"""
    c AS (SELECT result_id, query_id, {sql.authority('url', 'source')} AS authority_pct, {sql.freshness('title', 'snippet', 'url', AS_OF_YEAR)} AS freshness_pct, {sql.density('title', 'snippet')} AS density_pct,
          {sql.is_search_page('url')} AS is_serp, CAST(round(coalesce(score, 0.5) * 1000) AS BIGINT) AS score_e3 FROM search_results),
    scored AS (SELECT *, CAST(40 * authority_pct + 35 * density_pct + 15 * freshness_pct + score_e3 AS BIGINT) AS credibility_e4 FROM c)"""


@query(f"WITH {_SCORED} SELECT result_id, authority_pct, freshness_pct, density_pct, credibility_e4 FROM scored")
def credibility_fast(spark: SparkSession, root: str) -> DataFrame:
    return evidence.credibility(_results(spark, root), AS_OF_YEAR).select("result_id", "authority_pct", "freshness_pct", "density_pct", "credibility_e4")


_LEVELS = rf"""WITH q AS (SELECT query_id, list_filter(list_distinct(string_split_regex(lower(coalesce(text, '')), '\s+')), lambda w: length(w) > 1) AS words FROM queries),
    r AS (SELECT query_id, {sql.host('url')} AS host, {sql.is_search_page('url')} AS serp, len(list_filter(words, lambda w: contains(lower(coalesce(title, '') || ' ' || coalesce(snippet, '')), w))) > 0 AS match
          FROM search_results JOIN q USING (query_id)),
    n AS (SELECT query_id, count(*) AS n_results, sum(CASE WHEN match THEN 1 ELSE 0 END) AS n_matches, count(DISTINCT CASE WHEN NOT serp THEN host END) AS n_content FROM r GROUP BY query_id),
    l AS (SELECT query_id, CASE WHEN n_results < 2 THEN 0 WHEN n_matches * 10 >= 8 * n_results AND n_content >= 3 THEN 500 WHEN n_matches * 10 >= 6 * n_results AND n_content >= 2 THEN 200 ELSE 0 END AS lift FROM n),"""
_FINAL = f"{_LEVELS} {_SCORED}, final AS (SELECT result_id, query_id, is_serp, CAST(least(credibility_e4 + CASE WHEN is_serp THEN 0 ELSE lift END, 10000) AS BIGINT) AS final_e4 FROM scored JOIN l USING (query_id))"


@query(f"{_FINAL} SELECT result_id, final_e4 FROM final")
def credibility_final(spark: SparkSession, root: str) -> DataFrame:
    return evidence.boosted_credibility(_results(spark, root), table(spark, root, "queries"), AS_OF_YEAR).select("result_id", "final_e4")


@query(f"{_FINAL} SELECT query_id, count(*) AS total, count(*) FILTER (final_e4 >= 7000) AS high, count(*) FILTER (final_e4 >= 5000 AND final_e4 < 7000) AS medium, count(*) FILTER (final_e4 < 5000) AS low, count(*) FILTER (is_serp) AS serp FROM final GROUP BY query_id")
def credibility_summary(spark: SparkSession, root: str) -> DataFrame:
    return evidence.credibility_summary(evidence.boosted_credibility(_results(spark, root), table(spark, root, "queries"), AS_OF_YEAR))


@query(
    rf"""WITH q AS (SELECT query_id, list_filter(list_distinct(string_split_regex(lower(coalesce(text, '')), '\s+')), lambda w: length(w) > 1) AS words FROM queries),
    r AS (SELECT query_id, {sql.host('url')} AS host, {sql.is_search_page('url')} AS serp, len(list_filter(words, lambda w: contains(lower(coalesce(title, '') || ' ' || coalesce(snippet, '')), w))) > 0 AS match
          FROM search_results JOIN q USING (query_id)),
    c AS (SELECT query_id, count(*) AS n_results, CAST(sum(CASE WHEN match THEN 1 ELSE 0 END) AS BIGINT) AS n_matches, count(DISTINCT CASE WHEN host <> '' THEN host END) AS n_domains, count(DISTINCT CASE WHEN NOT serp THEN host END) AS n_content FROM r GROUP BY query_id)
    SELECT *, CASE WHEN n_results < 2 THEN 'insufficient' WHEN n_matches * 10 >= 8 * n_results AND n_content >= 3 THEN 'strong' WHEN n_matches * 10 >= 6 * n_results AND n_content >= 2 THEN 'moderate'
        WHEN n_matches * 10 >= 4 * n_results THEN 'weak' ELSE 'minimal' END AS level FROM c"""
)
def cross_validate(spark: SparkSession, root: str) -> DataFrame:
    return evidence.cross_validate(_results(spark, root), table(spark, root, "queries"))


_FACTS = f"""
    WITH x AS (SELECT query_id, CASE WHEN {sql.host('url')} <> '' THEN {sql.host('url')} ELSE coalesce(source, 'unknown') END AS domain, unnest({sql.facts("(coalesce(title, '') || ' ' || coalesce(snippet, ''))")}) AS f FROM search_results),
    facts AS (SELECT DISTINCT query_id, domain, f.t AS fact_type, f.v AS fact_value FROM x)"""


def _facts(spark: SparkSession, root: str) -> DataFrame:
    return evidence.facts_by_domain(_results(spark, root))


@query(f"{_FACTS} SELECT * FROM facts")
def extract_facts(spark: SparkSession, root: str) -> DataFrame:
    return _facts(spark, root)


@query(f"{_FACTS} SELECT query_id, fact_type, fact_value, count(*) AS n_domains FROM facts GROUP BY ALL HAVING count(*) >= 2")
def fact_corroborated(spark: SparkSession, root: str) -> DataFrame:
    return evidence.corroborated(_facts(spark, root))


@query(f"{_FACTS} SELECT query_id, fact_type, count(DISTINCT fact_value) AS n_values FROM facts GROUP BY ALL HAVING count(DISTINCT fact_value) >= 2")
def fact_divergence(spark: SparkSession, root: str) -> DataFrame:
    return evidence.value_divergence(_facts(spark, root))


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS n_rows, count(DISTINCT query_id) AS n_queries FROM search_results GROUP BY 1")
def source_distribution(spark: SparkSession, root: str) -> DataFrame:
    return _results(spark, root).groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n_rows"), F.count_distinct("query_id").alias("n_queries"))


@query(
    """SELECT q.query_id, count(s.result_id) AS n_results, count(DISTINCT s.engine) AS n_engines, CASE WHEN count(s.result_id) >= 3 THEN 'COVERED' WHEN count(s.result_id) >= 1 THEN 'PARTIAL' ELSE 'NOT_COVERED' END AS status
    FROM queries q LEFT JOIN search_results s USING (query_id) GROUP BY q.query_id"""
)
def coverage_map(spark: SparkSession, root: str) -> DataFrame:
    got = _results(spark, root).groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("engine").alias("e"))
    out = table(spark, root, "queries").select("query_id").join(got, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_results"), F.coalesce("e", F.lit(0)).alias("n_engines"))
    return out.withColumn("status", F.when(F.col("n_results") >= 3, "COVERED").when(F.col("n_results") >= 1, "PARTIAL").otherwise("NOT_COVERED"))


@query(
    """WITH a AS (SELECT max(created_at) AS as_of FROM engine_perf),
    g AS (SELECT engine, count(*) AS n_calls, sum(success) AS n_success, sum(CAST(round(latency_ms * 1000) AS BIGINT)) AS us, count(latency_ms) AS n_latency, sum(CAST(round(cost * 1000000) AS BIGINT)) AS millionths, count(cost) AS n_cost,
          max(created_at) AS last, any_value(as_of) AS as_of FROM engine_perf, a WHERE created_at > as_of - 7 * 86400 GROUP BY engine),
    s AS (SELECT *, CASE WHEN n_success = 0 THEN 0.5::DOUBLE ELSE n_success::DOUBLE / n_calls END AS success_rate, CASE WHEN n_latency = 0 THEN 2000.0::DOUBLE ELSE us::DOUBLE / (n_latency * 1000.0::DOUBLE) END AS latency,
          CASE WHEN n_cost = 0 THEN 0.0::DOUBLE ELSE millionths::DOUBLE / (n_cost * 1000000.0::DOUBLE) END AS cost FROM g)
    SELECT engine, n_calls, CAST(n_success AS BIGINT) AS n_success, CAST(floor(CASE WHEN as_of - last > 86400 THEN 0.5::DOUBLE
        ELSE success_rate * least(1.0::DOUBLE, 2000.0::DOUBLE / greatest(latency, 1.0::DOUBLE)) * greatest(0.3::DOUBLE, 1.0::DOUBLE - cost * 10) END * 10000 + 0.5) AS BIGINT) AS score_e4 FROM s"""
)
def adaptive_scores(spark: SparkSession, root: str) -> DataFrame:
    calls = table(spark, root, "engine_perf")
    return governance.adaptive_scores(calls, governance.latest(calls))


@query(
    """WITH a AS (SELECT max(created_at) AS as_of FROM engine_perf)
    SELECT engine, count(*) AS calls_hour, count(*) FILTER (created_at > as_of - 60) AS calls_minute, count(*) FILTER (success = 0) AS errors_hour, CAST(coalesce(sum(CAST(round(cost * 1000000) AS BIGINT)), 0) AS BIGINT) AS cost_e6
    FROM engine_perf, a WHERE created_at > as_of - 3600 GROUP BY engine"""
)
def quota_stats(spark: SparkSession, root: str) -> DataFrame:
    calls = table(spark, root, "engine_perf")
    return governance.quota_stats(calls, governance.latest(calls))


@query(
    """WITH g AS (SELECT family, sum(CAST(round(latency_ms * 1000) AS BIGINT)) AS us, count(*) AS n_calls FROM engine_perf JOIN engines USING (engine) WHERE latency_ms >= 0 GROUP BY family), m AS (SELECT *, us::DOUBLE / (n_calls * 1000) AS mean FROM g)
    SELECT family, n_calls, CASE WHEN mean < 800 THEN 'fast' WHEN mean > 3000 THEN 'slow' ELSE 'normal' END AS network, CASE WHEN mean < 800 THEN 8 WHEN mean > 3000 THEN 18 ELSE 10 END AS timeout_tenths FROM m"""
)
def network_profile(spark: SparkSession, root: str) -> DataFrame:
    return governance.network_profile(table(spark, root, "engine_perf"), table(spark, root, "engines"))


@query(
    """WITH c AS (SELECT engine, count(*) AS n FROM engine_perf GROUP BY engine)
    SELECT engine, family, coalesce(n, 0) AS n_calls, CASE WHEN NOT enabled THEN 'disabled' WHEN n IS NULL THEN 'unused' ELSE 'ready' END AS status, enabled AND coalesce(cost_tier, 'free') <> 'paid' AS routable FROM engines LEFT JOIN c USING (engine)"""
)
def engine_status(spark: SparkSession, root: str) -> DataFrame:
    return governance.engine_status(table(spark, root, "engines"), table(spark, root, "engine_perf"))


def _combos(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import Window

    best = _results(spark, root).filter("engine is not null").groupBy("query_id", "engine").agg(F.min("rank").alias("rank"))
    return best.select("query_id", "engine", (F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "engine")) == 1).alias("is_primary"))


@query(
    """WITH best AS (SELECT query_id, engine, min(rank) AS rank FROM search_results WHERE engine IS NOT NULL GROUP BY 1, 2),
    combos AS (SELECT query_id, engine, row_number() OVER (PARTITION BY query_id ORDER BY rank, engine) = 1 AS is_primary FROM best),
    k AS (SELECT query_id, bool_and(coalesce(family = 'web', false)) AS g FROM combos LEFT JOIN engines USING (engine) GROUP BY query_id),
    t AS (SELECT DISTINCT query_id, unnest(coverage) AS topic FROM combos JOIN engines USING (engine) JOIN k USING (query_id) WHERE is_primary AND g),
    o AS (SELECT engine, coalesce(priority, 0) AS priority, unnest(coverage) AS topic FROM engines WHERE enabled AND family <> 'web' AND family NOT IN ('misc_vertical', 'hot_trending', 'media_book', 'archive')),
    m AS (SELECT DISTINCT query_id, engine, priority FROM t JOIN o USING (topic))
    SELECT query_id, engine, priority FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, engine) <= 2"""
)
def complement_refill(spark: SparkSession, root: str) -> DataFrame:
    return governance.complement_refill(_combos(spark, root), table(spark, root, "engines"))


@query(
    """SELECT engine, CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, logged_at)) // 1000000 AS BIGINT) AS hour_s, count(*) AS n_calls, count(*) FILTER (success = 0) AS n_failed FROM engine_perf GROUP BY 1, 2"""
)
def outcome_windows(spark: SparkSession, root: str) -> DataFrame:
    from sievewright.streaming.outcomes import outcome_windows as windows

    return windows(table(spark, root, "engine_perf")).select("engine", "hour_s", "n_calls", "n_failed")


@query(
    rf"""WITH b AS (SELECT query_id, CASE WHEN {sql.host('url')} = '' THEN 'unknown' ELSE {sql.host('url')} END AS domain, coalesce(title, '') || ' ' || coalesce(snippet, '') AS b FROM search_results),
    w AS (SELECT query_id, domain, regexp_extract_all(lower(b), '[a-z]+') || flatten(list_transform(list_filter(regexp_extract_all(b, '[\x{{4e00}}-\x{{9fff}}]+'), lambda x: length(x) >= 3), lambda x: list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)))) AS w FROM b),
    r AS (SELECT DISTINCT query_id, domain, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS ngram FROM w WHERE len(w) >= 3),
    s AS (SELECT query_id, ngram, count(*) AS n_domains FROM r WHERE length(ngram) >= 4 GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT query_id, ngram, n_domains, row_number() OVER (PARTITION BY query_id ORDER BY n_domains DESC, ngram) AS position FROM s QUALIFY position <= 10"""
)
def cross_references(spark: SparkSession, root: str) -> DataFrame:
    return evidence.cross_references(_results(spark, root))


@query(
    f"""WITH q AS (SELECT query_id, list_distinct({sql.tokens('text')}) AS q FROM queries),
    h AS (SELECT result_id, title, coalesce(snippet, '') AS s, q, len(list_intersect(q, {sql.tokens('title')})) AS t, len(list_intersect(q, {sql.tokens('snippet')})) AS n FROM search_results JOIN q USING (query_id))
    SELECT result_id, CAST(CASE WHEN len(q) = 0 THEN 5000 ELSE (65 * t + 35 * n) * 100 // len(q) END AS BIGINT) AS relevance_e4,
        CAST(30 * least(length(s), 200) + CASE WHEN regexp_matches(s, '[0-9]') THEN 2000 ELSE 0 END + CASE WHEN trim(coalesce(title, ''), ' ') <> '' THEN 2000 ELSE 0 END AS BIGINT) AS completeness_e4 FROM h"""
)
def rerank_static_dims(spark: SparkSession, root: str) -> DataFrame:
    return evidence.static_dimensions(_results(spark, root), table(spark, root, "queries"))
