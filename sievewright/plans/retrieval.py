"""Queries of near-duplicates, reranking, relevance and query understanding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import text, urls
from sievewright.operators import relevance, rerank, similarity
from sievewright.operators.relevance import B, BLOCK_TOKEN, FALLBACK, K1, LEAST, LONG, RESEARCH
from sievewright.operators.similarity import GRAM, HASHES, MULTIPLIER, SEED
from sievewright.plans import fragments as sql
from sievewright.plans.core import AS_OF_YEAR
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


def _signature_sql(flat: str) -> str:
    """MinHash of a text without white space."""
    grams = f"list_transform(range(1, greatest(length({flat}) - {GRAM - 1}, 1) + 1), lambda i: substr({flat}, i, {GRAM}))"
    step = f"lambda a, c: (xor(a::UBIGINT, c::UBIGINT)::HUGEINT * {MULTIPLIER}) % 18446744073709551616"
    letters = "CASE WHEN g = '' THEN []::HUGEINT[] ELSE list_transform(string_split(g, ''), lambda c: unicode(c)::HUGEINT) END"
    one = lambda seed: f"list_min(list_transform({grams}, lambda g: list_reduce(list_prepend({seed * SEED}::HUGEINT, {letters}), {step})))"
    return "[" + ", ".join(one(s) for s in range(HASHES)) + "]"


_EQUAL = f"list_sum(list_transform(range(1, {HASHES + 1}), lambda i: CASE WHEN a.sig[i] = b.sig[i] THEN 1 ELSE 0 END))"
_NORMAL = r"lower(trim(regexp_replace(coalesce(text, ''), '[\s\x{3000}]+', ' ', 'g'), ' '))"


@query(
    f"""WITH t AS (SELECT {_NORMAL} AS t, min(query_id) AS id FROM queries GROUP BY 1 HAVING t <> ''), s AS (SELECT id, length(t) AS n, {_signature_sql("replace(t, ' ', '')")} AS sig FROM t)
    SELECT a.id AS first_id, b.id AS second_id, CAST({_EQUAL} AS INT) AS n_equal FROM s a JOIN s b ON a.id < b.id WHERE {_EQUAL} >= 6 AND abs(a.n - b.n) * 2 <= greatest(a.n, b.n)"""
)
def query_links(spark: SparkSession, root: str) -> DataFrame:
    return similarity.query_links(table(spark, root, "queries"))


@query(f"SELECT query_id, min(query_id) OVER (PARTITION BY {_NORMAL}) AS first_id FROM queries WHERE {_NORMAL} <> ''")
def query_classes(spark: SparkSession, root: str) -> DataFrame:
    return similarity.query_classes(table(spark, root, "queries"))


_BODY = "trim(coalesce(title, '') || ' ' || coalesce(snippet, ''), ' ')"


@query(
    rf"""WITH RECURSIVE s AS (SELECT query_id, result_id, {_BODY} AS body, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, coalesce(selection, 0) DESC, result_id) AS n,
        {_signature_sql(rf"regexp_replace({_BODY}, '(?:\s|[\x1c-\x1f\x{{85}}\p{{Z}}])+', '', 'g')")} AS sig FROM search_results),
    g AS (SELECT query_id, 0::BIGINT AS n, NULL::BIGINT AS result_id, true AS kept, []::HUGEINT[][] AS chosen FROM (SELECT DISTINCT query_id FROM s)
        UNION ALL SELECT s.query_id, s.n, s.result_id, s.body = '' OR len(list_filter(g.chosen, lambda c: list_sum(list_transform(range(1, {HASHES + 1}), lambda i: CASE WHEN c[i] = s.sig[i] THEN 1 ELSE 0 END)) >= 7)) = 0,
            CASE WHEN s.body <> '' AND len(list_filter(g.chosen, lambda c: list_sum(list_transform(range(1, {HASHES + 1}), lambda i: CASE WHEN c[i] = s.sig[i] THEN 1 ELSE 0 END)) >= 7)) = 0 THEN list_append(g.chosen, s.sig) ELSE g.chosen END
        FROM g JOIN s ON s.query_id IS NOT DISTINCT FROM g.query_id AND s.n = g.n + 1)
    SELECT query_id, result_id, kept FROM g WHERE n > 0"""
)
def minhash_dedupe(spark: SparkSession, root: str) -> DataFrame:
    return similarity.minhash_dedupe(table(spark, root, "search_results"))


_PAIRS = "list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]))"
_STATIC = f"""
    q AS (SELECT query_id, list_distinct({sql.tokens('text')}) AS q FROM queries),
    h AS (SELECT result_id, query_id, {sql.tokens('title')} AS t, {sql.authority('url', 'source')} AS auth, {sql.freshness('title', 'snippet', 'url', AS_OF_YEAR)} AS fresh, title, coalesce(snippet, '') AS s, q,
          len(list_intersect(q, {sql.tokens('title')})) AS a, len(list_intersect(q, {sql.tokens('snippet')})) AS n FROM search_results JOIN q USING (query_id)),
    d AS (SELECT result_id, query_id, {_PAIRS} AS pairs, CAST(30 * CASE WHEN len(q) = 0 THEN 5000 ELSE (65 * a + 35 * n) * 100 // len(q) END + 3000 * auth + 2000 * fresh
          + 15 * (30 * least(length(s), 200) + CASE WHEN regexp_matches(s, '[0-9]') THEN 2000 ELSE 0 END + CASE WHEN trim(coalesce(title, ''), ' ') <> '' THEN 2000 ELSE 0 END) AS BIGINT) AS static_e6 FROM h)"""


@query(f"WITH {_STATIC} SELECT result_id, static_e6, CAST(len(pairs) AS INT) AS n_pairs FROM d")
def rerank_static(spark: SparkSession, root: str) -> DataFrame:
    scored = rerank.static_scores(table(spark, root, "search_results"), table(spark, root, "queries"), AS_OF_YEAR)
    return scored.select("result_id", "static_e6", F.size("pairs").alias("n_pairs"))


_NOVELTY = "CASE WHEN len(d.pairs) = 0 OR len(g.seen) = 0 THEN 10000 ELSE (len(list_distinct(d.pairs || g.seen)) - len(list_intersect(d.pairs, g.seen))) * 10000 // len(list_distinct(d.pairs || g.seen)) END"


@query(
    f"""WITH RECURSIVE {_STATIC},
    g AS (SELECT query_id, 0 AS position, NULL::BIGINT AS result_id, NULL::BIGINT AS score_e6, NULL::BIGINT AS novelty_e4, []::BIGINT[] AS chosen, []::VARCHAR[] AS seen FROM (SELECT DISTINCT query_id FROM d)
        UNION ALL SELECT query_id, position + 1, result_id, score_e6, novelty_e4, list_append(chosen, result_id), list_distinct(seen || pairs) FROM (
            SELECT g.query_id, g.position, g.chosen, g.seen, d.pairs, d.result_id, CAST({_NOVELTY} AS BIGINT) AS novelty_e4, CAST(d.static_e6 + 5 * {_NOVELTY} AS BIGINT) AS score_e6,
                row_number() OVER (PARTITION BY g.query_id ORDER BY d.static_e6 + 5 * {_NOVELTY} DESC, d.result_id) AS r
            FROM g JOIN d USING (query_id) WHERE g.position < 10 AND NOT list_contains(g.chosen, d.result_id)) WHERE r = 1)
    SELECT query_id, result_id, position, score_e6, novelty_e4 FROM g WHERE position > 0"""
)
def rerank_five_dimensions(spark: SparkSession, root: str) -> DataFrame:
    scored = rerank.static_scores(table(spark, root, "search_results"), table(spark, root, "queries"), AS_OF_YEAR)
    return rerank.five_dimensions(scored)


_TOKENS2 = lambda x: f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), {sql.quoted(BLOCK_TOKEN)}), lambda t: length(t) >= 2)"


@query(
    rf"""WITH p AS (SELECT doc_id, text AS body, title AS query FROM documents),
    b AS (SELECT doc_id, coalesce(body, '') AS body, list_filter(string_split_regex(regexp_replace(coalesce(body, ''), '\r\n?', chr(10), 'g'), '\n(?:[ \t]*\n)+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ') <> '') AS blocks, list_distinct({_TOKENS2('query')}) AS terms FROM p),
    t AS (SELECT *, list_transform(blocks, lambda x: {_TOKENS2('x')}) AS t, len(blocks) AS n FROM b),
    m AS (SELECT *, CASE WHEN coalesce(list_sum(list_transform(t, lambda x: len(x))), 0) > 0 THEN list_sum(list_transform(t, lambda x: len(x)))::DOUBLE / n ELSE 1.0::DOUBLE END AS mean FROM t),
    i AS (SELECT *, list_transform(terms, lambda q: {{'q': q, 'w': ln((n - len(list_filter(t, lambda x: list_contains(x, q))) + 0.5::DOUBLE) / (len(list_filter(t, lambda x: list_contains(x, q))) + 0.5::DOUBLE) + 1)}}) AS idf FROM m),
    s AS (SELECT *, list_transform(t, lambda k: CAST(round(coalesce(list_sum(list_transform(idf, lambda x: x.w * len(list_filter(k, lambda y: y = x.q)) * {K1 + 1}::DOUBLE / (len(list_filter(k, lambda y: y = x.q)) + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * len(k) / mean)))), 0) * 10000) AS BIGINT)) AS e FROM i),
    k AS (SELECT *, list_filter(range(0, n), lambda j: e[j + 1] >= {int(LEAST * 10000)}) AS good, list_transform(list_sort(list_transform(range(0, n), lambda j: {{'s': -e[j + 1], 'j': j}}))[1:{FALLBACK}], lambda x: x.j) AS best FROM s),
    c AS (SELECT *, CASE WHEN len(good) > 0 THEN good ELSE best END AS kept FROM k)
    SELECT doc_id, n AS n_blocks, CASE WHEN n = 0 THEN 0 WHEN length(body) < {LONG} OR n <= 1 OR len(terms) = 0 THEN n
        ELSE len(list_distinct(kept || list_filter(list_transform(kept, lambda j: j - 1), lambda j: j >= 0 AND starts_with(ltrim(blocks[j + 1], ' '), '#') AND NOT starts_with(ltrim(blocks[j + 2], ' '), '#')))) END AS n_kept FROM c"""
)
def focus_blocks(spark: SparkSession, root: str) -> DataFrame:
    """What of each page its own title asks for."""
    told = relevance.focus_blocks(table(spark, root, "documents").select("doc_id", "text", F.col("title").alias("query")))
    return told.select("doc_id", F.col("n_blocks").cast("long").alias("n_blocks"), F.size("keep").cast("long").alias("n_kept"))


def _profiles(spark: SparkSession, root: str) -> DataFrame:
    """One document for each expected domain: the texts of its queries."""
    labelled = table(spark, root, "queries").filter("expected_domain is not null and text is not null")
    return labelled.groupBy(F.col("expected_domain").alias("profile")).agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("document"))


_PROFILE = lambda x: f"list_filter({sql.tokens(x)}, lambda x: length(x) > 1 OR x >= '一')"
_PROFILE_TOKENS = lambda x: f"({_PROFILE(x)} || list_transform(range(1, len({_PROFILE(x)})), lambda i: {_PROFILE(x)}[i] || '_' || {_PROFILE(x)}[i + 1]))"
_ROUTED = f"""
    p AS (SELECT expected_domain AS profile, string_agg(text, ' ' ORDER BY text) AS document FROM queries WHERE expected_domain IS NOT NULL AND text IS NOT NULL GROUP BY 1),
    pc AS (SELECT profile, token, count(*) AS n FROM (SELECT profile, unnest({_PROFILE_TOKENS('document')}) AS token FROM p) GROUP BY 1, 2),
    idf AS (SELECT token, ln(((SELECT count(*) FROM p) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf FROM pc GROUP BY 1),
    pv AS (SELECT profile, token, n::DOUBLE / sum(n) OVER (PARTITION BY profile) * idf AS w FROM pc JOIN idf USING (token)),
    qc AS (SELECT query_id, token, count(*) AS n FROM (SELECT query_id, unnest({_PROFILE_TOKENS('text')}) AS token FROM queries) GROUP BY 1, 2),
    qs AS (SELECT query_id, sum(n) AS size FROM qc GROUP BY 1),
    qv AS (SELECT query_id, token, n::DOUBLE / size * idf AS w FROM qc JOIN idf USING (token) JOIN qs USING (query_id)),
    x AS (SELECT query_id, profile, sum(qv.w * pv.w) AS dot FROM qv JOIN pv USING (token) GROUP BY 1, 2),
    qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qv GROUP BY 1), pn AS (SELECT profile, sqrt(sum(w * w)) AS n FROM pv GROUP BY 1),
    routed AS (SELECT query_id, profile, CAST(round(dot / (qn.n * pn.n) * 10000) AS BIGINT) AS score_e4 FROM x JOIN qn USING (query_id) JOIN pn USING (profile)),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_e4 DESC, profile) AS position FROM routed QUALIFY position <= 3)"""


def _routed(spark: SparkSession, root: str) -> DataFrame:
    return relevance.route_by_profile(table(spark, root, "queries"), _profiles(spark, root))


@query(f"WITH {_ROUTED} SELECT query_id, profile, score_e4, position FROM top")
def route_by_profile(spark: SparkSession, root: str) -> DataFrame:
    return _routed(spark, root)


_ASKS = " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in RESEARCH)


@query(
    f"""WITH {_ROUTED}, b AS (SELECT query_id, max(score_e4) FILTER (position = 1) AS a, max(score_e4) FILTER (position = 2) AS b FROM top GROUP BY 1)
    SELECT query_id, {_ASKS} OR coalesce(a, 0) < 1500 OR coalesce(a > 0 AND (a - b) * 5 < a, false) AS parallel FROM queries LEFT JOIN b USING (query_id)"""
)
def needs_parallel(spark: SparkSession, root: str) -> DataFrame:
    return relevance.needs_parallel(table(spark, root, "queries"), _routed(spark, root))


_CLEAN = "coalesce(text, '')"
for _span in text.EXCLUDED_SPANS:
    _CLEAN = f"regexp_replace({_CLEAN}, {sql.quoted(_span)}, '\\1 ', 'g')"
_CLEAN = rf"regexp_replace(trim(regexp_replace({_CLEAN}, '\s+', ' ', 'g'), ' '), '^[的了，,、\s]+', '')"
_CLEANED = f"(CASE WHEN {_CLEAN} = '' THEN coalesce(text, '') ELSE {_CLEAN} END)"
_TWO = r"list_filter(list_transform(string_split_regex(c, '以及|和|与|、'), lambda p: trim(p, ' ')), lambda p: len(regexp_extract_all(p, '[\x{4e00}-\x{9fff}]|[a-zA-Z0-9]+')) >= 2)"


@query(
    f"""WITH u AS (SELECT query_id, {_CLEANED} AS c, {sql.excluded('text')} AS x, {sql.intents('text')} AS i, nullif(regexp_extract(coalesce(text, ''), {sql.quoted(text.GEO)}, 1), '') AS place FROM queries),
    p AS (SELECT *, CASE WHEN len({_TWO}) >= 2 THEN array_to_string({_TWO}[1:2], '|') ELSE '' END AS parts, CASE WHEN i = '' THEN 0 ELSE len(string_split(i, ',')) END AS n FROM u)
    SELECT query_id, c AS clean_query, array_to_string(x, ' ') AS excluded, i AS intents, place, parts, CAST(least(CASE WHEN len(x) > 0 THEN 30 ELSE 0 END + CASE WHEN place IS NOT NULL THEN 25 ELSE 0 END
        + CASE WHEN n > 0 THEN 20 + 5 * least(n, 2) ELSE 0 END + CASE WHEN parts <> '' THEN 20 ELSE 0 END, 95) AS INT) AS confidence_pct FROM p"""
)
def understand(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("text")
    told = table(spark, root, "queries").select(
        "query_id", text.clean_query(t).alias("clean_query"), text.excluded_terms(t).alias("x"), text.intents(t).alias("intents"), text.asks_place(t).alias("place"),
    ).withColumn("parts", F.array_join(text.split_intents(F.col("clean_query")), "|"))
    n = F.when(F.col("intents") == "", 0).otherwise(F.size(F.split("intents", ",")))
    confidence = F.when(F.size("x") > 0, 30).otherwise(0) + F.when(F.col("place").isNotNull(), 25).otherwise(0) + F.when(n > 0, 20 + 5 * F.least(n, F.lit(2))).otherwise(0) + F.when(F.col("parts") != "", 20).otherwise(0)
    return told.select("query_id", "clean_query", F.array_join("x", " ").alias("excluded"), "intents", "place", "parts", F.least(confidence, F.lit(95)).alias("confidence_pct"))


@query(f"SELECT query_id, {_NORMAL} AS normalized, regexp_matches(coalesce(text, ''), {sql.quoted(text.FRESH_QUERY)}) AS fresh FROM queries")
def normalized_queries(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("text")
    return table(spark, root, "queries").select("query_id", text.normalized_query(t).alias("normalized"), text.is_fresh_query(t).alias("fresh"))


_NETLOC = f"lower({sql.netloc('url')})"
_PLATFORM = "CASE " + " ".join(
    f"WHEN {_NETLOC} IN ('x.com', 'twitter.com') OR ends_with({_NETLOC}, '.x.com') THEN 'x'" if name == "x" else "WHEN " + " OR ".join(f"contains({_NETLOC}, '{p}')" for p in parts) + f" THEN '{name}'"
    for name, parts in urls.PLATFORM_PARTS.items()
) + " ELSE 'web' END"


@query(f"SELECT {_PLATFORM} AS platform, count(*) AS n_rows FROM search_results GROUP BY 1")
def platform_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "search_results").groupBy(urls.platform(F.col("url")).alias("platform")).agg(F.count("*").alias("n_rows"))
