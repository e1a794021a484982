"""Texts that end before their text does, and how often each source cuts.

A stack automaton reads a text once: brackets and quotes open and close,
markup and entities must end, and what remains open at the end was cut, as
was a text that ends in an ellipsis, in a broken byte sequence or escape, or
without a terminator. A missing terminator alone is weighed against the
source: where texts without one are the rule it says nothing, nor where the
text is a complete entry (a list of facts), unless the text's length is at a
limit of the source: a peak of the lengths beyond which there is little.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm.visual import normalize_all
from sievewright.runtime import join_small, materialize

# Brackets and quotes that pair.
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "「": "」", "『": "』", "《": "》", "【": "】", "（": "）", "‹": "›"}
_CLOSERS = {v: k for k, v in PAIRS.items()}
_MARK = re.compile(r"(?:…|\.\.\.|。。|\[(?:…|\.\.\.|&hellip;)\]|\((?:…|\.\.\.)\)|&hellip;|&#8230;|\[more\]|read more|weiterlesen|lire la suite|leer más|続きを読む|更多)\W*$", re.IGNORECASE)
_BROKEN = re.compile(r"(?:�|&#?\w*|<[A-Za-z/!][^<>]*|%[0-9A-F]?|%[0-9A-F]{2}(?:%[0-9A-F]?)|\\u?[0-9a-f]{0,3})$")
_FINAL = re.compile(r"[.!?。！？]['\"”’»」』》）)\]】›]*$")
# Complete entries: facts set off from each other, each of them few words.
_STRONG = re.compile(r"\s*(?:[·•|｜;；:：]|\s[-–—/]\s)\s*")
_WEAK = re.compile(r"\s*[,，、]\s*")
_WIDE = re.compile("[\u3040-\u9fff\uac00-\ud7a3]")
_NUMBER = re.compile(r"\d[\d.,]*")
_SENTENCE_INSIDE = re.compile(r"[.!?。！？](?:\s|[^\x00-\x7f])")
_PAIRED = re.compile("[" + re.escape("".join([*PAIRS, *_CLOSERS, '"'])) + "]")
# A terminator as wrong decodings read it, whole or without its first byte,
# which can have become part of the letter before it; a lone mark of loss isn't.
_LOST_FINAL = tuple({
    x for t in "。？！" for page in ("gb18030", "shift_jis", "euc_jp", "cp949", "big5", "cp1252", "cp1250") for skip in (0, 1)
    if (x := t.encode("utf-8")[skip:].decode(page, "replace")) != "�"
})


def is_entry(text: str, words: int = 6, listed: int = 5, wide: int = 10) -> bool:
    """Whether a text is a complete entry, which needs no terminator: facts
    parted by separators, or by commas where there is a number among them,
    none of which has more words (or wide characters) than a fact has."""
    flat = _NUMBER.sub("0", text)
    # A separator at the end waits for a further fact.
    if _SENTENCE_INSIDE.search(flat) or re.search(r"[·•|｜;；:：,，、/–—-]\s*$", flat):
        return False
    parts = [p for p in _STRONG.split(flat) if p]
    if len(parts) < 2 and not ("0" in flat and _WEAK.search(flat) and not _WIDE.search(flat)):
        return False
    for part in parts:
        facts = [f for f in _WEAK.split(part) if f]
        if any(len(f.split()) > (listed if len(facts) > 1 else words) or len(_WIDE.findall(f)) > wide for f in facts):
            return False
    return True


def scan_structure(text: str) -> tuple[bool, bool, bool, bool]:
    """(marked or broken, open at the end, terminated, an entry)."""
    body = text.rstrip()
    marked = bool(_MARK.search(body) or _BROKEN.search(body))
    stack: list[str] = []
    straight = 0
    for c in _PAIRED.findall(body):
        if c == '"':
            straight += 1
        elif c in PAIRS:
            stack.append(c)
        elif stack and stack[-1] == _CLOSERS[c]:
            stack.pop()
    final = bool(_FINAL.search(body))
    return marked, bool(stack) or straight % 2 == 1, final, not final and is_entry(body)


def _examined(rows: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """Structure of each text: ``key, source, size,
    strong, ended, entry``, and a hash of the text."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = list(zip(frame[text], frame["_lost"]))
            unique = list(dict.fromkeys(values))
            seen: dict[tuple[str, bool], tuple] = {}
            for (value, lost), plain in zip(unique, normalize_all([v for v, _ in unique])):
                if lost and value.rstrip().endswith(_LOST_FINAL):
                    seen[value, lost] = (False, True, False)
                    continue
                marked, unclosed, final, entry = scan_structure(plain)
                # A quote left open is no cut if the text is terminated:
                # it may have been opened before the excerpt began.
                seen[value, lost] = (marked or unclosed and not final, final, entry)
            out = [seen[v] for v in values]
            done = pd.DataFrame(out, columns=["strong", "ended", "entry"], index=frame.index)
            yield pd.concat([frame[[key, source]], frame[text].str.rstrip().str.len().rename("size"), done, frame["_text"]], axis=1)

    kinds = f"{key} {rows.schema[key].dataType.simpleString()}, {source} string, size int, strong boolean, ended boolean, entry boolean, _text long"
    return rows.select(key, source, text, "_lost", F.xxhash64(text).alias("_text")).mapInPandas(scan, kinds)


def _limits(examined: DataFrame, source: str, edge: int, least: int = 3) -> DataFrame:
    """Lengths at which a source cuts: ``source, _limits``.

    A limit has at least ``least`` different open texts up to ``edge`` shorter,
    one of them of its very length, more of them (by four deviations of a
    count and two) than the lengths below let expect, and no more texts beyond
    it than a tenth of those at it.
    """
    sizes = examined.groupBy(source, "size").agg(
        F.count_distinct(F.when(~F.col("ended") & ~F.col("strong") & ~F.col("entry"), F.col("_text"))).alias("n"), F.count_distinct("_text").alias("all")
    )
    line = Window.partitionBy(source).orderBy("size")
    at = F.sum("n").over(line.rangeBetween(1 - edge, 0))
    below = F.coalesce(F.sum("n").over(line.rangeBetween(-5 * edge, -edge)), F.lit(0)) / 4
    beyond = F.coalesce(F.sum("all").over(line.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    found = sizes.select(source, "size", "n", at.alias("at"), below.alias("below"), beyond.alias("beyond"))
    peak = (F.col("n") > 0) & (F.col("at") >= least) & (F.col("at") > F.col("below") + 4 * F.sqrt("below") + 2) & (F.col("beyond") <= F.col("at") / 10)
    return found.filter(peak).groupBy(source).agg(F.collect_set("size").alias("_limits"))


def cut_texts(
    rows: DataFrame, garbled: DataFrame | None = None, residue: DataFrame | None = None, key: str = "result_id", source: str = "source", text: str = "snippet",
    rule_share: float = 0.9, edge: int = 12,
) -> DataFrame:
    """One row per text that is no residue: ``key, source, cut``.

    ``garbled`` (``key, restored``) gives the original of texts of wrong
    decoding, or null where letters are lost; ``residue`` (``key``) lists
    texts to leave out. Texts without a terminator are a source's rule if they
    are ``rule_share`` of its texts, to which two texts of each kind are added,
    as a few texts show no rule. A text is at a limit if it is less than ``edge``
    characters (a word) shorter. Null, empty and blank texts are left out. A null
    source is a source of its own. Repeated rows count each.
    """
    some = rows.select(key, source, text).filter(F.col(text).rlike(r"(?U)\S"))
    if residue is not None:
        some = some.join(residue.select(key).distinct(), key, "left_anti")
    if garbled is not None:
        known = garbled.groupBy(key).agg(F.first("restored").alias("_r")).withColumn("_g", F.lit(True))
        some = some.join(known, key, "left").withColumns({text: F.coalesce("_r", text), "_lost": F.coalesce(F.col("_g") & (F.col("_r").isNull() | F.rtrim("_r").endswith("�")), F.lit(False))})
    else:
        some = some.withColumn("_lost", F.lit(False))
    # Written once, as the baseline and the verdict both read it.
    examined = materialize(_examined(some.withColumn(source, F.coalesce(F.col(source).cast("string"), F.lit(""))), key, source, text), "text-ends")
    # Baseline: how a source ends its texts, and the lengths it cuts them to.
    opened = (~F.col("ended") & ~F.col("strong")).cast("double")
    baseline = examined.groupBy(source).agg(((F.sum(opened) + 2) / (F.count("*") + 4)).alias("_open"))
    baseline = baseline.join(_limits(examined, source, edge), source, "left")
    told = join_small(examined, baseline, [source])
    rule = F.col("_open") >= rule_share
    at_limit = F.coalesce(F.exists("_limits", lambda x: (F.col("size") <= x) & (F.col("size") > x - edge)), F.lit(False))
    exact = F.coalesce(F.array_contains("_limits", F.col("size")), F.lit(False))
    missing = ~F.col("ended") & F.when(F.col("entry"), exact & ~rule).otherwise(~rule | at_limit)
    return told.select(key, F.when(F.col(source) != "", F.col(source)).alias(source), (F.col("strong") | missing).alias("cut"))


def cut_rates(cut: DataFrame, source: str = "source") -> DataFrame:
    """Texts, cut texts and the share of cut texts by source."""
    return cut.groupBy(source).agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), (F.count_if("cut") / F.count("*")).alias("cut_share"))
