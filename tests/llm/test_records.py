"""Records that differ in form: against a brute-force canonical form."""

import re
import unicodedata

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.llm.records import canonical_key, collapse_records, record_counts, same_title, same_url, title_hashes, url_hashes

ROWS = [
    (1, "What changed | Site", "https://a.example/x?b=2&a=1"),
    (2, "SITE — what  CHANGED!", "HTTPS://A.example/x/?a=1&&b=2#"),
    (3, "What changed | Site", "http://a.example/x?b=2&a=1"),
    (4, "What changed 2 | Site", "https://a.example/x?b=2&a=1"),
    (5, None, "https://a.example/x"),
    (6, " ", "https://a.example/x"),
    (7, "What changed | Site", ""),
    (8, "Größe", "https://b.example/"),
    (9, "GRÖSSE.", " https://B.EXAMPLE"),
    (10, "What changed | Site", "https://a.example/x?b=2&a=1"),
]


def brute(rows):
    def title(t):
        parts = re.split(r"[|｜·»«_•¦‖]|::|(?:(?<=\s)|^)[-–—―](?=\s|$)", t)
        parts = ["".join(c for c in p.casefold() if unicodedata.category(c)[0] in "LNM") for p in parts]
        return tuple(sorted(filter(None, parts)))

    firsts, out = {}, set()
    for i, t, u in sorted(rows):
        if t and u and t.strip() and u.strip():
            flat = "".join(u.split()).lower()
            path, _, frag = flat.partition("#")
            path, _, query = path.partition("?")
            tidy = lambda s: re.sub("/+", "/", s).rstrip("/&.,;:!?#")
            k = (title(t), tidy(path), frozenset(filter(None, map(tidy, query.split("&")))), tidy(frag))
            out.add((firsts.setdefault(k, i), i))
    return out


def test_against_brute_force(spark):
    rows = spark.createDataFrame(ROWS, "result_id long, title string, url string")
    assert {tuple(r) for r in collapse_records(rows).collect()} == brute(ROWS)


def test_hot_record_and_counts(spark):
    rows = [(i, "Same | Page" if i % 2 else "page - SAME", "http://h.example/p") for i in range(3000)] + [(9000, "Other", "http://h.example/p")]
    got = {r["first_id"]: r["n_copies"] for r in record_counts(spark.createDataFrame(rows, "result_id long, title string, url string"), salts=2).collect()}
    assert got == {0: 3000, 9000: 1}


def test_empty_and_extra_columns(spark):
    rows = spark.createDataFrame([], "result_id long, title string, url string, t string, id long")
    assert collapse_records(rows).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aßÉ 1-|·:.", max_size=12), min_size=2, max_size=6))
def test_hash_agrees_with_comparison(titles):
    hashes = title_hashes(pd.Series(titles))
    for i, a in enumerate(titles):
        for j, b in enumerate(titles):
            assert (hashes[i] == hashes[j]) == same_title(a, b)
            assert same_title(a, b) == (canonical_key(a, "u") == canonical_key(b, "u"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB/?&=#. :1", max_size=14), min_size=2, max_size=6))
def test_url_hash_agrees_with_comparison(urls):
    hashes = url_hashes(pd.Series(urls))
    for i, a in enumerate(urls):
        for j, b in enumerate(urls):
            assert (hashes[i] == hashes[j]) == same_url(a, b), (a, b)


def test_letters_beyond_the_assigned_planes_count(spark):
    """Letters of any plane tell titles apart, also those of later use."""
    pairs = [("\U00030000 x", "\U00030001 x"), ("\U0003134b x", "\U0003134c x"), ("\U000f0001 x", "\U000f0002 x")]
    for a, b in pairs:
        assert not same_title(a, b) and title_hashes(pd.Series([a]))[0] != title_hashes(pd.Series([b]))[0]
    rows = spark.createDataFrame([(2 * i + j, t, "http://h.example/p") for i, p in enumerate(pairs) for j, t in enumerate(p)], "result_id long, title string, url string")
    assert record_counts(rows).count() == 6
