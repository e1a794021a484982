"""URL expressions: canonical forms, hosts, search-page and platform tests.

Nulls give empty strings, as for empty URLs. Percent escapes stay as written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, by canonical form.
TRACKING = {
    "fusion": ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "ref", "from", "share_token", "source", "refer", "trace", "clicktime", "clickid", "scid", "scene", "sessionid"],
    "dossier": ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "from", "ref", "fbclid", "gclid"],
    "envelope": ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "fbclid", "gclid", "mc_cid", "mc_eid"],
}
# Hosts of search pages, and parts of URLs that are result
# pages or jumps.
SEARCH_HOSTS = ["baidu.com", "sogou.com", "so.com", "bing.com", "google.com", "google.com.hk", "weixin.sogou.com"]
SEARCH_PARTS = ["baidu.com/s?", "baidu.com/link", "baidu.com/baidu.php", "sogou.com/link", "sogou.com/web?", "so.com/s?", "bing.com/search?", "google.com/search?", "google.com/url?", "google.com.hk/search?", "google.com.hk/url?", "weixin.sogou.com/weixin"]

# Parts of hosts by platform, in order of precedence; those of
# "x" are whole hosts.
PLATFORM_PARTS = {
    "github": ["github.com"], "zhihu": ["zhihu.com"], "xiaohongshu": ["xiaohongshu.com", "xhslink.com"], "bilibili": ["bilibili.com"], "weibo": ["weibo.com"],
    "youtube": ["youtube.com", "youtu.be"], "x": ["x.com", "twitter.com"], "wechat": ["mp.weixin.qq.com"],
}

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"


def pieces(url: Column) -> dict[str, Column]:
    """Scheme, host part, path and query of a URL, without its fragment."""
    plain = F.regexp_replace(F.coalesce(F.trim(url), F.lit("")), r"#[\s\S]*$", "")
    rest = F.regexp_replace(plain, _SCHEME, "")
    return {
        "scheme": F.regexp_extract(plain, _SCHEME, 1),
        "netloc": F.regexp_extract(rest, r"^([^/?]*)", 1),
        "path": F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1),
        "query": F.regexp_extract(rest, r"\?([\s\S]*)$", 1),
    }


def _kept(query: Column, form: str) -> Column:
    key = lambda p: F.lower(F.regexp_extract(p, r"^([^=]*)", 1))
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).isin(TRACKING[form]))
    return F.array_join(F.transform(parts, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))), "&")


def _assembled(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    head = F.when(scheme == "", F.lit("")).otherwise(F.concat(scheme, F.lit("://")))
    return F.concat(head, netloc, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def canonical_fusion(url: Column) -> Column:
    """Fusion key: lower case, https, no www., no tracking, no end slash."""
    p = pieces(F.lower(url))
    scheme = F.when(p["scheme"].isin("http", "https"), F.lit("https")).otherwise(p["scheme"])
    return _assembled(scheme, F.regexp_replace(p["netloc"], r"^www\.", ""), F.regexp_replace(p["path"], r"/+$", ""), _kept(p["query"], "fusion"))


def canonical_dossier(url: Column) -> Column:
    """Citation key: scheme and host in lower case, no www., no tracking, one
    end slash dropped unless it is the whole path."""
    p = pieces(url)
    path = F.when(p["path"] == "/", p["path"]).otherwise(F.regexp_replace(p["path"], r"/$", ""))
    return _assembled(F.lower(p["scheme"]), F.regexp_replace(F.lower(p["netloc"]), r"^www\.", ""), path, _kept(p["query"], "dossier"))


def canonical_envelope(url: Column) -> Column:
    """Candidate key: case kept, tracking dropped."""
    p = pieces(url)
    return _assembled(p["scheme"], p["netloc"], p["path"], _kept(p["query"], "envelope"))


def host(url: Column) -> Column:
    """Host without user, port and www."""
    netloc = F.regexp_replace(F.lower(pieces(url)["netloc"]), r"^.*@", "")
    return F.regexp_replace(F.regexp_replace(netloc, r":.*$", ""), r"^www\.", "")


def is_search_page(url: Column) -> Column:
    """Whether a URL is a result page or a jump; empty URLs are."""
    low, h, p = F.lower(F.coalesce(url, F.lit(""))), host(url), pieces(F.lower(url))
    part = F.lit(False)
    for x in SEARCH_PARTS:
        part = part | low.contains(x)
    shell = p["path"].isin("", "/", "/s", "/web", "/search") | p["path"].startswith("/s") | p["path"].contains("link") | p["path"].contains("search") | p["query"].contains("q=") | p["query"].contains("wd=")
    return (low == "") | part | (h.isin(SEARCH_HOSTS) & shell)


def platform(url: Column) -> Column:
    """Platform of a URL by its host; ``web`` where none is known."""
    h = F.lower(pieces(url)["netloc"])
    out = F.lit("web")
    for name, parts in reversed(PLATFORM_PARTS.items()):
        hit = F.lit(False)
        for part in parts:
            hit = hit | h.contains(part)
        if name == "x":
            hit = h.isin(*PLATFORM_PARTS["x"]) | h.endswith(".x.com")
        out = F.when(hit, name).otherwise(out)
    return out


def is_private_host(url: Column) -> Column:
    """Whether a URL's host is a loopback, private, link-local or local name."""
    h = host(url)
    octets = F.transform(F.split(h, r"\."), lambda x: x.try_cast("int"))
    a, b = F.get(octets, F.lit(0)), F.get(octets, F.lit(1))
    dotted = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    private = (a == 10) | (a == 127) | (a == 0) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    return (h == "localhost") | h.endswith(".localhost") | h.endswith(".local") | h.endswith(".internal") | F.coalesce(dotted & private, F.lit(False))
