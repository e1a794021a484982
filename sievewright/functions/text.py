"""Text expressions: tokens, n-grams, language, intents, facts, density."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\x{4e00}-\x{9fff}]|[a-z0-9]+"

# Code point ranges of scripts.
SCRIPTS = {
    "han": r"\x{4e00}-\x{9fff}", "kana": r"\x{3040}-\x{30ff}", "hangul": r"\x{ac00}-\x{d7af}", "latin": "A-Za-z", "latin_ext": r"\x{00c0}-\x{024f}",
    "cyrillic": r"\x{0400}-\x{04ff}", "thai": r"\x{0e00}-\x{0e7f}", "arabic": r"\x{0600}-\x{06ff}", "hebrew": r"\x{0590}-\x{05ff}", "greek": r"\x{0370}-\x{03ff}", "devanagari": r"\x{0900}-\x{097f}",
}
# Words of Han characters that only Japanese writes so.
JAPANESE_HAN = (
    "非同期 処理 予報 検索 天気 株式 映画 配信 報道 速報 転職 面接 給料 応募 卒業 受験 大学院 授業 講義 宿題 就活 新卒 口座 振込 残高 通帳 介護 処方 発熱 予定 営業 退職 "
    "支払 申告 円高 円安 株価 参議院 衆議院 住民票 印鑑 免許 交番 弁護士 捜査 容疑者 津波 断水 変電 給湯 残業 有給 退院 受診 処方箋 薬局 予約 出張 帰省 新幹線 改札 切符 "
    "乗車 納期 発注 受注 出荷 納品 売上 仕入 原価 在庫 領収書 請求書 見積"
).split()
# Signs of query intents, in order of precedence.
INTENTS = {
    "compare": r"(?i)\b(?:vs|versus)\b|对比|比较|区别|相比|哪个好|哪个更|谁更|优缺点|pk",
    "social": r"(?i)小红书|抖音|推特|twitter|reddit|b站|bilibili|微博|舆情|舆论|网友|口碑|种草|拔草|评价|讨论|热议",
    "news": r"(?i)\b(?:news|latest|breaking)\b|最新|新闻|快讯|突发|今天|近期|最近|进展|动态",
    "definition": r"(?i)\b(?:what is|what are|define|definition)\b|是什么|什么是|定义|含义|概念|指的是",
    "fact": r"(?i)\b(?:how many|how much|when did|where is|who is)\b|多少|几个|几号|什么时候|哪一年|哪里|谁是|是谁",
}
# Signs of evidence, with their weight in hundredths.
DENSITY = {
    "has_numbers": (22, r"(?i)(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?\s*(?:%|％|亿|万|万亿|pct|bp|元|美元|吨|倍)|(?:环比|同比|较上[季年]度?)[^\n]{0,12}[+\-＋－]?[0-9]|Q[1-4]\b|20[0-9]{2}\s*年"),
    "has_definition": (18, r"(?i)是指|定义为|所谓|即指|指的是|是一种|可定义为|definition of|is defined as|refers to"),
    "has_comparison": (16, r"(?i)对比|比较|相较|相比|环比|同比|分别|vs\.?|versus|增持|减持|上升|下降|提升|回落|高于|低于|超过|不及"),
    "has_howto": (12, r"(?i)步骤|如何|怎么做|操作建议|方法如下|第[一二三四五六七八九十1-9][步、.]|step\s*[0-9]|how to|tutorial"),
    "has_disclose": (8, r"(?i)截至|根据|数据显示|研究报告|披露|公告|季报|年报|来源[：:]"),
}
QA_FORMAT = r"(?im)(?:^|\n)\s*(?:Q\s*[:：]|A\s*[:：]|问\s*[:：]|答\s*[:：])|(?:怎么样|好不好|靠谱吗)\s*$"
# Fact patterns (type, pattern); the first group that matched is
# the fact. Alternatives of one type are one pattern, so they don't overlap.
FACTS = [
    (
        "version",
        r"(?i)(?:\b(?:version|ver|release|rel)\b[\s.]*([0-9]+(?:\.[0-9]+){1,3})"
        r"|(?:版本|版号)[\s.]*([0-9]+(?:\.[0-9]+){1,3})"
        r"|\bv[\s.]*([0-9]+(?:\.[0-9]+){1,3})\b"
        r"|\b([0-9]+\.[0-9]+\.[0-9]+)\b"
        r"|\b(?:python|node|java|kubernetes|k8s|docker|react|vue|angular|tensorflow|pytorch|django|flask|ubuntu|windows|macos|ios|android)[\s.]*([0-9]+(?:\.[0-9]+){1,2}))",
    ),
    ("percent", r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:%|percent)"),
    ("money", r"(?i)(?:(?:[￥$€]|人民币|美元)\s*([0-9]+(?:\.[0-9]+)?(?:\s*(?:亿|万|千|百万))?)|([0-9]+(?:\.[0-9]+)?)\s*(?:亿元|万元|亿美元|billion|million))"),
    ("date", r"([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})|([0-9]{4}\s*年\s*[0-9]{1,2}\s*月(?:\s*[0-9]{1,2}\s*日)?)|([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"),
    ("law_code", r"(《[^》]{2,20}(?:法|条例|规定|办法|解释)》(?:第[0-9一二三四五六七八九十百]+条)?)|(法释〔?[0-9]{4}〕?[0-9]+号)"),
]
_ENTITY = r"([\x{4e00}-\x{9fff}A-Za-z0-9]{1,20}?)(?:的|[,，、\s]|以外|之外|外|$)"
_WORD = r"([A-Za-z0-9\x{4e00}-\x{9fff}]{1,20})"
# Forms of exclusion, with the term as the group.
EXCLUDED = [
    "除了" + _ENTITY, "不想(?:要|用|看)?" + _ENTITY, "不要" + _ENTITY, "排除" + _ENTITY,
    r"(?:^|[^A-Za-z0-9])-" + _WORD, r"(?i)\bNOT\s+" + _WORD, r"(?i)\bwithout\s+" + _WORD,
]
# What of them is cut from the query: the words up to the mark that ends them.
EXCLUDED_SPANS = [
    r"除了[\x{4e00}-\x{9fff}A-Za-z0-9]{1,20}?(?:以外|之外|外|(的|[,，、\s]|$))", r"不想(?:要|用|看)?[\x{4e00}-\x{9fff}A-Za-z0-9]{1,20}?(的|[,，、\s]|$)", r"不要[\x{4e00}-\x{9fff}A-Za-z0-9]{1,20}?(的|[,，、\s]|$)",
    r"排除[\x{4e00}-\x{9fff}A-Za-z0-9]{1,20}?(的|[,，、\s]|$)", r"(^|[^A-Za-z0-9])-[A-Za-z0-9\x{4e00}-\x{9fff}]{1,20}", r"(?i)()\bNOT\s+[A-Za-z0-9\x{4e00}-\x{9fff}]{1,20}", r"(?i)()\bwithout\s+[A-Za-z0-9\x{4e00}-\x{9fff}]{1,20}",
]
# Signs that a query asks for what is happening now.
FRESH_QUERY = r"(?i)今日|今天|昨晚|昨夜|本周|本月|实时|即时|最新|刚刚|盘中|盘前|盘后|快讯|直播|热点新闻|头条|today|tonight|breaking|live\s*update|just\s*now|right\s*now|this\s*(?:morning|week|month)"
# Words that ask for a place.
GEO = (
    r"(?i)(附近|本地|同城|周边|在哪里|在哪儿|在哪|位于|坐落|坐标|经纬度|海拔|发源地|地标|名胜|景点|流经|途经|贯穿|横跨|流域|水系|汇入|注入|源头|入海|省份|省区|"
    r"山脉|河流|湖泊|岛屿|沙漠|高原|峡谷|海峡|首都|省会|where\s+is|located\s+in|capital\s+of|latitude|longitude|coordinates?|flows?\s+through|passes\s+through|drainage|basin|openstreetmap|nominatim|geonames)"
)


def tokens(text: Column) -> Column:
    """Han characters and runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams without white space; one at least."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(flat) - (n - 1), F.lit(1))), lambda i: F.substr(flat, i, F.lit(n))))


def _count(text: Column, script: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SCRIPTS[script]}]", ""))


def detect_language(text: Column) -> Column:
    """Language label by the shares of scripts, tested in a fixed order."""
    q = F.coalesce(text, F.lit(""))
    scripts = list(SCRIPTS)

    def label(counts: Column) -> Column:
        total, n = F.get(counts, F.lit(0)), {s: F.get(counts, F.lit(i + 1)) for i, s in enumerate(scripts)}
        share = lambda x, percent: x * 100 >= total * percent
        japanese = (n["han"] > 0) & q.rlike("|".join(JAPANESE_HAN))
        out = F.when(total == 0, "other").when(share(n["kana"], 15), "ja").when(share(n["hangul"], 15), "ko").when((n["kana"] > 0) & share(n["han"], 30), "ja")
        for s in ("thai", "arabic", "hebrew", "greek", "devanagari", "cyrillic"):
            out = out.when(share(n[s], 20), s)
        out = out.when(japanese, "ja").when(share(n["han"], 30), "zh")
        letters = n["latin"] + n["latin_ext"]
        out = out.when(share(letters, 50) & share(n["latin_ext"], 8), "latin").when(share(letters, 50), F.when(n["latin"] > 0, "en").otherwise("latin"))
        return out.when((n["han"] > 0) & (n["latin"] > 0), "mixed").otherwise("other")

    # The counts stand in a list of one, so that each is made once a text.
    counts = F.array(F.length(F.regexp_replace(q, r"\s", "")), *[_count(q, s) for s in scripts])
    return F.get(F.transform(F.array(counts), label), F.lit(0))


def intents(text: Column) -> Column:
    """Intents of a query in order of precedence, joined by commas."""
    return F.concat_ws(",", *[F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(name)) for name, p in INTENTS.items()])


def excluded_terms(text: Column) -> Column:
    """Distinct negated terms of a query, in lower case, sorted."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in EXCLUDED]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*found), F.lower)))


def clean_query(text: Column) -> Column:
    """The query without what it excludes; the query itself if nothing is left."""
    out = F.coalesce(text, F.lit(""))
    for span in EXCLUDED_SPANS:
        out = F.regexp_replace(out, span, "$1 ")
    out = F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), r"^[的了，,、\s]+", "")
    return F.when(out == "", F.coalesce(text, F.lit(""))).otherwise(out)


def split_intents(text: Column) -> Column:
    """The first two parts of a query that a conjunction sets apart, if both
    have two tokens or more; else none."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "以及|和|与|、"), F.trim), lambda p: F.regexp_count(p, F.lit(r"[\x{4e00}-\x{9fff}]|[a-zA-Z0-9]+")) >= 2)
    return F.when(F.size(parts) >= 2, F.slice(parts, 1, 2)).otherwise(F.array().cast("array<string>"))


def asks_place(text: Column) -> Column:
    """The word by which a query asks for a place, or null."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), GEO, 1)
    return F.when(found != "", found)


def is_fresh_query(text: Column) -> Column:
    """Whether a query asks for what is happening now."""
    return F.coalesce(text, F.lit("")).rlike(FRESH_QUERY)


def normalized_query(text: Column) -> Column:
    """The form of a query in cache keys: single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{3000}]+", " ")))


def density_flags(title: Column, text: Column) -> dict[str, Column]:
    """Evidence flags of a title and text, and the density in hundredths."""
    body = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    # Lower case once and plain patterns: several times faster than folding in each.
    low = F.lower(body)
    flags = {name: low.rlike(p.removeprefix("(?i)").lower()) for name, (_, p) in DENSITY.items()}
    flags["is_qa"] = body.rlike(QA_FORMAT) | F.coalesce(title, F.lit("")).rlike(r"[?？]\s*$")
    score = F.lit(15)
    for name, (weight, _) in DENSITY.items():
        score = score + F.when(flags[name], weight).otherwise(0)
    score = score + F.when(F.length(body) >= 80, 5).otherwise(0) - F.when(flags["is_qa"], 8).otherwise(0)
    return flags | {"density_pct": F.greatest(F.lit(0), F.least(F.lit(100), score))}


def _fact_value(kind: str, raw: Column) -> Column:
    flat = F.regexp_replace(raw, r"\s+", "")
    if kind == "percent":
        return F.concat(flat, F.lit("%"))
    if kind == "date":
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(flat, "[年月]", "-"), "日", ""), "-+$", "")
    return flat


def _fact_list(text: Column, kind: str, pattern: str) -> Column:
    groups = range(1, re.compile(pattern.replace(r"\x{4e00}", "\u4e00").replace(r"\x{9fff}", "\u9fff")).groups + 1)
    # Texts are searched once; the groups are told from the few matches.
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    first = lambda m: F.coalesce(*[F.when(x != "", x) for x in (F.regexp_extract(m, pattern, g) for g in groups)])
    return F.filter(F.transform(found, lambda m: F.struct(F.lit(kind).alias("fact_type"), _fact_value(kind, first(m)).alias("fact_value"))), lambda f: f["fact_value"].isNotNull())


def facts(text: Column) -> Column:
    """Distinct (type, value) facts of a text; none for null."""
    return F.array_distinct(F.concat(*[_fact_list(F.coalesce(text, F.lit("")), kind, p) for kind, p in FACTS]))
