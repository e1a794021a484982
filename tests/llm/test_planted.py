"""Recall on planted cases: clean fields of the tables, damaged here.

Damage is drawn over all rows taken, whatever their wording; sources, pages
and wordings are those of the tables, the damage is not.
"""

import random

import pytest
from pyspark.sql import functions as F

from sievewright.llm.encoding import KEYS, garbled_fields, prose_model
from sievewright.llm.records import collapse_records
from sievewright.llm.truncation import cut_texts
from sievewright.llm.visual import LOOK_ALIKES, disguised_fields, normalize

SCHEMA = "result_id long, engine string, source string, title string, snippet string"


@pytest.fixture(scope="module")
def clean(spark):
    """Sentences of documents, by language: whole, and none of them damaged."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null and lang is not null").select("lang", "text").limit(600).collect()
    out = {}
    for r in rows:
        for line in r["text"].split("\n"):
            if 40 < len(line) < 400 and line[-1] in ".。" and "http" not in line and "�" not in line:
                out.setdefault(r["lang"][:2].lower(), []).append(line.strip())
    return out


@pytest.fixture(scope="module")
def model(spark):
    return prose_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def misread(text, read, written):
    raw = text.encode(written)
    if read == "cp1252":
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)
    return raw.decode(read, "replace")


# Swaps as they happen: pages of the language, read with a page in common use.
SWAPS = [("cp1252", "utf-8", ("de", "fr", "es", "pt", "ru", "zh", "ja", "ko")), ("cp1251", "koi8_r", ("ru",)), ("koi8_r", "cp1251", ("ru",)), ("cp1251", "utf-8", ("ru", "de", "fr")), ("cp866", "utf-8", ("ru",)), ("cp437", "utf-8", ("de", "fr", "es")), ("gb18030", "utf-8", ("zh", "ja")), ("cp1252", "gb18030", ("zh",)), ("cp1252", "cp1251", ("ru",)), ("cp1251", "cp1252", ("de", "fr")), ("mac_roman", "utf-8", ("fr", "pt"))]


def test_garbled(spark, clean, model):
    rng, rows, truth = random.Random(11), [], {}
    for read, written, languages in SWAPS:
        for language in languages:
            texts = [t for t in clean.get(language, []) if not t.isascii() and sum(ord(c) > 127 and c.isalpha() for c in t) >= 2]
            for text in rng.sample(texts, min(12, len(texts))):
                try:
                    bad = misread(text, read, written)
                except UnicodeError:
                    continue
                if bad != text:
                    truth[len(rows)] = text
                    rows.append((len(rows), f"e{len(rows) % 5}", "s", None, bad))
    n_bad = len(rows)
    for language in clean:
        rows += [(len(rows) + i, f"e{i % 5}", "s", None, t) for i, t in enumerate(rng.sample(clean[language], min(30, len(clean[language]))))]
    got = {r["result_id"]: r["restored"] for r in garbled_fields(spark.createDataFrame(rows, SCHEMA), model).collect()}
    found = sum(i in got for i in truth)
    whole = sum(got.get(i) == t for i, t in truth.items())
    wrong = sum(i not in truth for i in got)
    print(f"garbled: {n_bad} planted, {found} found, {whole} restored whole, {wrong} wrong of {len(rows) - n_bad}")
    assert found >= 0.95 * n_bad and whole >= 0.85 * n_bad and wrong <= 0.01 * (len(rows) - n_bad)


def test_one_byte_swaps_go_through_the_learned_table(spark, clean, model):
    narrow = [(read, written) for read, written, languages in SWAPS if languages == ("ru",) and "utf-8" not in (read, written) and "gb18030" != written]
    assert narrow and all(f"{a}+{b}" in KEYS for a, b in narrow)
    texts = [t for t in clean["ru"] if all(c.isascii() or "\u0400" <= c < "\u0460" for c in t)][:40]
    assert len(texts) >= 20
    for read, written in narrow:
        rows = [(i, "e", "s", None, misread(t, read, written)) for i, t in enumerate(texts)]
        got = {r["result_id"]: r["restored"] for r in garbled_fields(spark.createDataFrame(rows, SCHEMA), model).collect()}
        assert sum(got.get(i) == t for i, t in enumerate(texts)) >= 0.9 * len(texts)


def test_disguised(spark, clean):
    rng = random.Random(12)
    swaps = {a: b[0] for a, b in LOOK_ALIKES.items()}

    def damaged(text):
        kind, at = rng.randrange(6), rng.randrange(1, len(text) - 1)
        letters = [i for i, c in enumerate(text) if c in swaps]
        if kind == 0 and letters:
            i = rng.choice(letters)
            return text[:i] + swaps[text[i]] + text[i + 1 :]
        if kind == 1:
            return text[:at] + rng.choice("\u200b\u200d\u2060\ufeff\u00ad\U000e0041") + text[at:]
        if kind == 2 and " " in text:
            return text.replace(" ", rng.choice("\u00a0\u2003\u2009\u202f"), 1)
        ascii_letters = [i for i, c in enumerate(text) if c.isascii() and c.isalpha()]
        if kind == 3 and ascii_letters:
            i = rng.choice(ascii_letters)
            return text[:i] + chr(ord(text[i]) + 0xFEE0) + text[i + 1 :]
        if kind == 4 and ascii_letters:
            i = rng.choice(ascii_letters)
            return text[:i] + chr(0x1D400 + (ord(text[i].lower()) - 97) + 26) + text[i + 1 :]
        return text[:at] + "\u200e" + text[at:]

    base = [t for language in ("en", "de", "fr", "es", "nl", "it", "zh", "ja") for t in clean.get(language, [])[:25]]
    rows = [(i, "e", "s", None, damaged(t)) for i, t in enumerate(base)] + [(1000 + i, "e", "s", None, t) for i, t in enumerate(base)]
    got = {r["result_id"] for r in disguised_fields(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = sum(i in got for i in range(len(base)))
    print(f"disguised: {len(base)} planted, {found} found, {len(got) - found} wrong")
    assert found >= 0.97 * len(base) and not any(i >= 1000 for i in got)
    assert sum(normalize(r[4]) == t for r, t in zip(rows, base)) >= 0.9 * len(base)


def test_cut(spark, clean):
    rng = random.Random(13)
    base = [t for language in ("en", "de", "fr", "es", "ru", "zh", "ja", "ko") for t in clean.get(language, [])[:30]]

    def cut(text):
        at = rng.randrange(len(text) // 3, len(text) - 2)
        return text[:at].rstrip(" .,;:。，、") + rng.choice(["", "", "…", "..."])

    rows = [(i, "e", f"s{i % 4}", None, cut(t)) for i, t in enumerate(base)] + [(1000 + i, "e", f"s{i % 4}", None, t) for i, t in enumerate(base)]
    got = {r["result_id"] for r in cut_texts(spark.createDataFrame(rows, SCHEMA)).filter("cut").collect()}
    found = sum(i in got for i in range(len(base)))
    print(f"cut: {len(base)} planted, {found} found, {len(got) - found} wrong of {len(base)}")
    assert found >= 0.95 * len(base) and len(got) - found <= 0.02 * len(base)


def test_records(spark, clean):
    rng = random.Random(14)
    base = [t[:80] for t in clean["en"][:60] + clean["fr"][:40] + clean["ru"][:40]]
    base = list(dict.fromkeys(base))

    def reformed(text):
        text = rng.choice([str.upper, str.lower, str.title, str])(text)
        return rng.choice(["  ", " ", "\t"]).join(text.split(" ")) + rng.choice(["", "!", " .", "…"])

    rows = []
    for i, t in enumerate(base):
        url = f"https://h{i}.example/p?a={i}&b=2"
        rows += [(3 * i, f"{t} | Site {i}", url), (3 * i + 1, f"Site {i} — {reformed(t)}", f"HTTPS://H{i}.example/p/?b=2&a={i}#"), (3 * i + 2, f"{t} x | Site {i}", url)]
    got = collapse_records(spark.createDataFrame(rows, "result_id long, title string, url string"))
    pairs = {(r["first_id"], r["copy_id"]) for r in got.filter(F.col("first_id") != F.col("copy_id")).collect()}
    want = {(3 * i, 3 * i + 1) for i in range(len(base))}
    print(f"records: {len(want)} planted, {len(pairs & want)} found, {len(pairs - want)} wrong")
    assert len(pairs & want) >= 0.98 * len(want) and not pairs - want
