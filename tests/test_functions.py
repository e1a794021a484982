"""Scalar expressions against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from sievewright.functions import text, urls
from sievewright.operators import evidence
from sievewright.operators.fusion import engine_weight
from sievewright.operators.governance import complement_refill


def one(spark, expression, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expression(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://www.A.com/B/?utm_source=x&k=1#f", "https://a.com/b?k=1"),
        ("https://a.com", "https://a.com"),
        ("https://a.com/x?a&b=", "https://a.com/x?a=&b="),
        (None, ""),
        ("", ""),
    ],
)
def test_canonical_fusion(spark, url, want):
    assert one(spark, urls.canonical_fusion, url) == want


def test_canonical_forms_differ(spark):
    url = "HTTPS://Www.A.com/B/?fbclid=1&spm=2&k=V"
    assert one(spark, urls.canonical_dossier, url) == "https://a.com/B?k=V"
    assert one(spark, urls.canonical_dossier, "https://a.com/?source=x") == "https://a.com/?source=x"
    assert one(spark, urls.canonical_envelope, url) == "HTTPS://Www.A.com/B/?k=V"


@pytest.mark.parametrize(("url", "want"), [("https://user@www.a.com:80/x", "a.com"), ("a.com/x", "a.com"), (None, "")])
def test_host(spark, url, want):
    assert one(spark, urls.host, url) == want


@pytest.mark.parametrize(("url", "want"), [("https://www.baidu.com/s?wd=1", True), ("https://www.baidu.com/link?url=1", True), ("https://google.com/search?q=1", True), ("https://a.com/article", False), (None, True)])
def test_search_page(spark, url, want):
    assert one(spark, urls.is_search_page, url) is want


@pytest.mark.parametrize(
    ("q", "want"),
    [("アニメ おすすめ", "ja"), ("café français", "latin"), ("Python 异步编程", "zh"), ("天气预报", "zh"), ("погода", "cyrillic"), ("hello world", "en"), ("", "other"), (None, "other"), ("非同期処理", "ja")],
)
def test_language(spark, q, want):
    assert one(spark, text.detect_language, q) == want


def test_intents_and_exclusions(spark):
    assert one(spark, text.intents, "python vs go 最新 评价") == "compare,social,news"
    assert one(spark, text.excluded_terms, "search -Google NOT bing without yahoo a-b") == ["bing", "google", "yahoo"]


def test_tokens(spark):
    assert one(spark, text.tokens, "Go 语言 v1.2") == ["go", "语", "言", "v1", "2"]
    assert one(spark, text.tokens, None) == []


def test_facts(spark):
    found = lambda t: {tuple(f) for f in one(spark, text.facts, t)}
    assert found("Python 3.12 提速 5% 发布于 2023-10-02 营收120亿元") == {("version", "3.12"), ("percent", "5%"), ("date", "2023-10-02"), ("money", "120")}
    assert found("v1.2 and 3.12.4, 94.9 on 1/2/2024 or 2024年5月 and 2024 年 5 月 6 日") == {("version", "1.2"), ("version", "3.12.4"), ("date", "1/2/2024"), ("date", "2024-5"), ("date", "2024-5-6")}
    assert found("《数据安全法》第三条 和 法释〔2020〕17号") == {("law_code", "《数据安全法》第三条"), ("law_code", "法释〔2020〕17号")}
    assert found(None) == set()


def test_negation_in_chinese(spark):
    assert one(spark, text.excluded_terms, "除了百度以外的搜索引擎") == ["百度"]
    assert one(spark, text.clean_query, "除了百度以外的搜索引擎") == "搜索引擎"
    assert one(spark, text.excluded_terms, "不要知乎 排除微博 python") == ["微博", "知乎"]
    assert one(spark, text.clean_query, "rust -java not go") == "rust"
    assert one(spark, text.clean_query, "-java") == "-java" and one(spark, text.clean_query, None) == ""


def test_understanding_parts(spark):
    assert one(spark, text.split_intents, "北京天气和上海天气") == ["北京天气", "上海天气"] and one(spark, text.split_intents, "和平") == []
    assert one(spark, text.asks_place, "where is Kego") == "where is" and one(spark, text.asks_place, "go") is None
    assert one(spark, text.is_fresh_query, "今日金价") is True and one(spark, text.is_fresh_query, None) is False
    assert one(spark, text.normalized_query, " A\u3000 b ") == "a b"


def test_platform_and_private_hosts(spark):
    assert [one(spark, urls.platform, u) for u in ("https://gist.github.com/x", "https://x.com/a", "https://xx.com", None)] == ["github", "x", "web", "web"]
    assert [one(spark, urls.is_private_host, u) for u in ("http://10.1.2.3/x", "http://172.20.0.1", "http://8.8.8.8", "http://LOCALHOST:80", "https://a.com")] == [True, True, False, True, False]


def test_density(spark):
    flags = lambda k: lambda t, s: text.density_flags(t, s)[k]
    assert one(spark, flags("density_pct"), "", "2026年金价上涨43%，环比上升") >= 45
    assert one(spark, flags("is_qa"), "基金怎么样？", "") is True


def test_authority_and_freshness(spark):
    pages = {"https://x.arxiv.org/list/1": 90, "https://a.gov/x": 95, "https://news.hexun.com/1": 70, "https://thepaper.cn/1": 82, "https://weibo.com/1": 40, "https://canyin88.com": 35, "https://a.edu.cn/docs/x": 100, "https://b.example": 50}
    assert {u: one(spark, evidence.authority, u) for u in pages} == pages
    assert one(spark, evidence.authority, None) == 30
    assert one(spark, evidence.authority, "https://b.example", "eastmoney") >= 85
    assert one(spark, evidence.authority, "https://b.example", "local_bing") == 40
    assert one(spark, lambda t, s: evidence.freshness(t, s, 2026), "", "创2015年以来新高 2026年") == 85
    assert one(spark, lambda t, s: evidence.freshness(t, s, 2026), "", "数据 2026年07月21日") == 90
    assert one(spark, lambda t, s, u: evidence.freshness(t, s, 2026, u), "", "", "https://a.example/2024/05/x") == 65
    assert one(spark, lambda t, s: evidence.freshness(t, s, 2026), None, None) == 50


def test_engine_weights(spark):
    assert [one(spark, engine_weight, e) for e in ("arxiv", "x/reddit", "reddit", "local_bing/sina_quote", None, "")] == [130, 100, 70, 120, 100, 100]


def test_complement_refill(spark):
    engines = spark.createDataFrame([("g1", "web", True, 5, ["a"]), ("g2", "web", True, 5, ["b"]), ("n", "news", True, 9, ["a"]), ("o", "other", False, 99, ["a"]), ("h", "hot_trending", True, 50, ["a"]), ("p", "paper", True, 9, ["b"])], "engine string, family string, enabled boolean, priority int, coverage array<string>")
    combos = spark.createDataFrame([("q1", "g1", True), ("q1", "g2", False), ("q2", "g1", True), ("q2", "n", False), ("q3", "g2", True)], "query_id string, engine string, is_primary boolean")
    assert sorted(map(tuple, complement_refill(combos, engines).collect())) == [("q1", "n", 9), ("q3", "p", 9)]
    assert complement_refill(combos.limit(0), engines).count() == 0
