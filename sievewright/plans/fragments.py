"""SQL fragments for the DuckDB twins of column expressions."""

from __future__ import annotations

from sievewright.functions.text import DENSITY, EXCLUDED, FACTS, INTENTS, JAPANESE_HAN, QA_FORMAT, SCRIPTS, TOKEN
from sievewright.functions.urls import SEARCH_HOSTS, SEARCH_PARTS, TRACKING
from sievewright.operators.evidence import AUTHORITY, DEMOTED, FULL_DATE, NARRATIVE, PRESENT, PUBLISHED, SINCE, SOURCE_CEILING, SOURCE_FLOOR


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _plain(url: str) -> str:
    return rf"regexp_replace(coalesce(trim({url}, ' '), ''), '#[\s\S]*$', '')"


def scheme(url: str) -> str:
    return rf"regexp_extract({_plain(url)}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)"


def _rest(url: str) -> str:
    return rf"regexp_replace({_plain(url)}, '^[A-Za-z][A-Za-z0-9+.-]*://', '')"


def netloc(url: str) -> str:
    return rf"regexp_extract({_rest(url)}, '^([^/?]*)', 1)"


def path(url: str) -> str:
    return rf"regexp_extract({_rest(url)}, '^[^/?]*([^?]*)', 1)"


def query(url: str) -> str:
    return rf"regexp_extract({_rest(url)}, '\?([\s\S]*)$', 1)"


def kept(url: str, form: str) -> str:
    names = ", ".join(map(quoted, TRACKING[form]))
    return (
        f"array_to_string(list_transform(list_filter(string_split({query(url)}, '&'), lambda p: p <> '' AND lower(regexp_extract(p, '^([^=]*)', 1)) NOT IN ({names})), "
        "lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&')"
    )


def assembled(head: str, place: str, way: str, rest: str) -> str:
    return f"(CASE WHEN {head} = '' THEN '' ELSE {head} || '://' END || {place} || {way} || CASE WHEN {rest} = '' THEN '' ELSE '?' || {rest} END)"


def canonical_fusion(url: str) -> str:
    low = f"lower({url})"
    head = f"CASE WHEN {scheme(low)} IN ('http', 'https') THEN 'https' ELSE {scheme(low)} END"
    return assembled(head, rf"regexp_replace({netloc(low)}, '^www\.', '')", f"regexp_replace({path(low)}, '/+$', '')", kept(low, "fusion"))


def canonical_dossier(url: str) -> str:
    way = f"(CASE WHEN {path(url)} = '/' THEN '/' ELSE regexp_replace({path(url)}, '/$', '') END)"
    return assembled(f"lower({scheme(url)})", rf"regexp_replace(lower({netloc(url)}), '^www\.', '')", way, kept(url, "dossier"))


def canonical_envelope(url: str) -> str:
    return assembled(scheme(url), netloc(url), path(url), kept(url, "envelope"))


def host(url: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({netloc(url)}), '^.*@', ''), ':.*$', ''), '^www\.', '')"


def is_search_page(url: str) -> str:
    low = f"lower(coalesce({url}, ''))"
    parts = " OR ".join(f"contains({low}, {quoted(p)})" for p in SEARCH_PARTS)
    way, rest = path(low), query(low)
    shell = f"({way} IN ('', '/', '/s', '/web', '/search') OR starts_with({way}, '/s') OR contains({way}, 'link') OR contains({way}, 'search') OR contains({rest}, 'q=') OR contains({rest}, 'wd='))"
    return f"({low} = '' OR {parts} OR ({host(url)} IN ({', '.join(map(quoted, SEARCH_HOSTS))}) AND {shell}))"


def _suffix(h: str, table: dict[str, int], missing: str) -> str:
    known = " ".join(f"WHEN {h} = {quoted(k)} OR ends_with({h}, {quoted('.' + k)}) THEN {v}" for k, v in sorted(table.items(), key=lambda x: -len(x[0])))
    return f"(CASE {known} ELSE {missing} END)"


def authority(url: str, source: str | None = None) -> str:
    h, way = host(url), f"lower({path(url)})"
    base = f"least({_suffix(h, DEMOTED, _suffix(h, AUTHORITY, '50'))}, {_suffix(h, NARRATIVE, '100')})"
    base = f"least({base} + CASE WHEN contains({way}, '/docs/') OR contains({way}, '/documentation/') THEN 5 ELSE 0 END, 100)"
    base = f"least({base} + CASE WHEN contains({way}, '/paper/') OR contains({way}, '/arxiv/') OR contains({way}, '/abs/') THEN 5 ELSE 0 END, 100)"
    if source is not None:
        lookup = lambda table, missing: f"(CASE {source} " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in table.items()) + f" ELSE {missing} END)"
        base = f"least(greatest({base}, {lookup(SOURCE_FLOOR, 0)}), {lookup(SOURCE_CEILING, 100)})"
    return f"CASE WHEN coalesce({url}, '') = '' THEN 30 WHEN {is_search_page(url)} THEN 12 ELSE {base} END"


def freshness(title: str, snippet: str, url: str, year: int) -> str:
    body = f"(coalesce({title}, '') || ' ' || coalesce({snippet}, ''))"
    full = f"list_max(regexp_extract_all({body}, {quoted(FULL_DATE)}, 1))"
    loose = f"list_filter(regexp_extract_all(regexp_replace({body}, {quoted(SINCE)}, ' ', 'g'), '[0-9]+'), lambda y: length(y) = 4 AND starts_with(y, '20'))"
    hints = " || ".join(f"regexp_extract_all({body}, {quoted(p)}, 1)" for p in PUBLISHED)
    in_path = f"regexp_extract(coalesce({url}, ''), '/(20[0-9]{{2}})(?:/|-)', 1)"
    named = f"list_max(list_filter({loose} || {hints}, lambda y: CAST(y AS INT) <= {year + 1}) || CASE WHEN {in_path} <> '' THEN [{in_path}] ELSE [] END)"
    by_age = lambda y, now: f"(CASE WHEN CAST({y} AS INT) > {year} THEN 40 WHEN CAST({y} AS INT) = {year} THEN {now} WHEN CAST({y} AS INT) = {year - 1} THEN 80 WHEN CAST({y} AS INT) >= {year - 2} THEN 65 WHEN CAST({y} AS INT) >= {year - 5} THEN 45 ELSE 25 END)"
    return f"least(100, CASE WHEN {full} IS NOT NULL THEN {by_age(full, 90)} WHEN {named} IS NOT NULL THEN {by_age(named, 85)} ELSE 50 END + CASE WHEN regexp_matches({body}, {quoted(PRESENT)}) THEN 10 ELSE 0 END)"


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), {quoted(TOKEN)})"


def _n(text: str, script: str) -> str:
    return f"length(regexp_replace({text}, '[^{SCRIPTS[script]}]', '', 'g'))"


def detect_language(text: str) -> str:
    q = f"coalesce({text}, '')"
    total = rf"length(regexp_replace({q}, '\s', '', 'g'))"
    share = lambda s, p: f"{_n(q, s)} * 100 >= {total} * {p}"
    japanese = " OR ".join(f"contains({q}, {quoted(w)})" for w in JAPANESE_HAN)
    both = f"({_n(q, 'latin')} + {_n(q, 'latin_ext')}) * 100 >= {total} * 50"
    others = " ".join(f"WHEN {share(s, 20)} THEN '{s}'" for s in ("thai", "arabic", "hebrew", "greek", "devanagari", "cyrillic"))
    return (
        f"CASE WHEN {total} = 0 THEN 'other' WHEN {share('kana', 15)} THEN 'ja' WHEN {share('hangul', 15)} THEN 'ko' WHEN {_n(q, 'kana')} > 0 AND {share('han', 30)} THEN 'ja' {others} "
        f"WHEN {_n(q, 'han')} > 0 AND ({japanese}) THEN 'ja' WHEN {share('han', 30)} THEN 'zh' WHEN {both} AND {share('latin_ext', 8)} THEN 'latin' "
        f"WHEN {both} THEN CASE WHEN {_n(q, 'latin')} > 0 THEN 'en' ELSE 'latin' END WHEN {_n(q, 'han')} > 0 AND {_n(q, 'latin')} > 0 THEN 'mixed' ELSE 'other' END"
    )


def intents(text: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(coalesce({text}, ''), {quoted(p)}) THEN '{name}' END" for name, p in INTENTS.items()) + ")"


def excluded(text: str) -> str:
    found = " || ".join(f"regexp_extract_all(coalesce({text}, ''), {quoted(p)}, 1)" for p in EXCLUDED)
    return f"list_sort(list_distinct(list_transform({found}, lambda x: lower(x))))"


def density(title: str, text: str) -> str:
    body = f"(coalesce({title}, '') || chr(10) || coalesce({text}, ''))"
    parts = " + ".join(f"CASE WHEN regexp_matches({body}, {quoted(p)}) THEN {w} ELSE 0 END" for w, p in DENSITY.values())
    qa = f"regexp_matches({body}, {quoted(QA_FORMAT)}) OR regexp_matches(coalesce({title}, ''), '[?？]\\s*$')"
    return f"greatest(0, least(100, 15 + {parts} + CASE WHEN length({body}) >= 80 THEN 5 ELSE 0 END - CASE WHEN {qa} THEN 8 ELSE 0 END))"


def _fact_value(kind: str, raw: str) -> str:
    flat = rf"regexp_replace({raw}, '\s+', '', 'g')"
    if kind == "percent":
        return f"{flat} || '%'"
    if kind == "date":
        return f"regexp_replace(replace(regexp_replace({flat}, '[年月]', '-', 'g'), '日', ''), '-+$', '')"
    return flat


def facts(text: str) -> str:
    parts = []
    for kind, pattern in FACTS:
        groups = pattern.count("(") - pattern.count("(?")
        zipped = "list_zip(" + ", ".join(f"regexp_extract_all({text}, {quoted(pattern)}, {g})" for g in range(1, groups + 1)) + ")"
        first = "coalesce(" + ", ".join(f"nullif(v[{g}], '')" for g in range(1, groups + 1)) + ")"
        parts.append(f"list_transform({zipped}, lambda v: {{'t': '{kind}', 'v': {_fact_value(kind, first)}}})")
    return " || ".join(parts)
