"""What to try where a query found nothing, and which finds answer it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import text
from sievewright.runtime import join_small

# Words and modifiers that a relaxed query does without.
STOP = "的 了 呢 吧 啊 呀 吗 哦 嘛 些 个 请问 怎么 如何 一下 帮我 我想 想要 关于 有关 求 跪求 谁知道 有没有 是不是 the a an of for to please how what".split()
QUOTES = "[\"'“”‘’「」『』]"
MODIFIERS = "最新|最全|详细|完整|全面|2020|2021|2022|2023|2024|2025|2026|知乎|贴吧|论坛|大全|汇总|排行榜|一览"
# Words that say nothing of what a query is about.
NO_SIGNAL = (
    "the a an of for to in on at is are was were how what which when where whom whose why who and or with from that this year years founded founding headquarters please latest about "
    "请问 怎么 如何 关于 有关 年份 时间 成立 创办 创立 总部 职能 简介 最新 详细"
).split()
# Scripts in which a query is tried again on general engines.
NOT_LATIN = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{0400}-\x{04ff}\x{0e00}-\x{0e7f}\x{0600}-\x{06ff}\x{0590}-\x{05ff}\x{0370}-\x{03ff}\x{0900}-\x{097f}]"


def relaxed(query: Column) -> Column:
    """A query without quotes, tail modifiers and stop words; what is left of
    it without the latter two if that is nothing; the query itself at last."""
    q = F.coalesce(query, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(q, QUOTES, " "), MODIFIERS, " ")
    words = F.filter(F.regexp_extract_all(bare, F.lit(r"[\x{4e00}-\x{9fff}A-Za-z0-9]+"), F.lit(0)), lambda w: ~F.lower(w).isin(STOP))
    kept, rest = F.array_join(words, " "), F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.when(kept != "", kept).when(rest != "", rest).otherwise(q)


def signal_words(query: Column) -> Column:
    """The words by which a find is told to answer a query, in lower case:
    abbreviations, words of three letters and runs of two Han characters, that
    are no stop words."""
    found = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"[A-Z]{2,}|[a-zA-Z]{3,}|[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda w: w.rlike("^[A-Z]{2,}$") | ~F.lower(w).isin(NO_SIGNAL)), F.lower))


def answers(query: Column, title: Column, snippet: Column, url: Column) -> Column:
    """Whether a result shares a signal word with a query; one that has none
    is answered by any result with some text."""
    blob = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")), F.coalesce(url, F.lit(""))))
    words = signal_words(query)
    return (F.trim(blob) != "") & ((F.size(words) == 0) | F.exists(words, lambda w: blob.contains(w)))


def alternatives(tried: DataFrame, engines: DataFrame, general: tuple[str, ...] = ("web", "reference"), most: int = 2) -> DataFrame:
    """Engines to switch to: ``query_id, engine, position``, at most ``most``.

    ``tried`` has ``query_id, engine``. Enabled engines that were not tried are
    taken if they are of a ``general`` family or of a family that was; general
    ones first, then by priority and name.
    """
    known = join_small(tried.select("query_id", "engine").distinct(), engines.select("engine", "family"), ["engine"])
    asked = known.groupBy("query_id").agg(F.array_sort(F.collect_set("engine")).alias("tried"), F.array_sort(F.collect_set("family")).alias("families"))
    # Queries that tried alike switch alike, so combinations are joined once.
    kinds = asked.select("tried", "families").distinct()
    offered = engines.filter("enabled").select(F.col("engine").alias("other"), "family", F.coalesce("priority", F.lit(0)).alias("priority"))
    allowed = F.col("family").isin(*general) | F.array_contains("families", F.col("family"))
    met = kinds.join(F.broadcast(offered), allowed & ~F.array_contains("tried", F.col("other")))
    order = Window.partitionBy("tried", "families").orderBy((~F.col("family").isin(*general)).cast("int"), F.desc("priority"), "other")
    best = met.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most)
    return asked.join(best, ["tried", "families"]).select("query_id", F.col("other").alias("engine"), "position")


def recovery_plan(queries: DataFrame) -> DataFrame:
    """The steps to try for each query: ``query_id, level, strategy, query``:
    L1 the relaxed query if it differs, L3 other engines, L4 the query itself
    on general engines where its script is not Latin. Blank queries have none.
    """
    q = F.coalesce("text", F.lit(""))
    told = queries.select("query_id", q.alias("q"), relaxed(F.col("text")).alias("r"), q.rlike(NOT_LATIN).alias("x")).filter(F.trim("q") != "")
    step = lambda level, strategy, query: F.struct(F.lit(level).alias("level"), F.lit(strategy).alias("strategy"), query.alias("query"))
    steps = F.array_compact(F.array(F.when(F.col("r") != F.col("q"), step("L1", "relax", F.col("r"))), step("L3", "switch_engine", F.col("r")), F.when(F.col("x"), step("L4", "cross_lang", F.col("q")))))
    return told.select("query_id", F.explode(steps).alias("s")).select("query_id", "s.*")
