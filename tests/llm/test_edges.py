"""Nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import pytest
from pyspark.sql import functions as F

from sievewright.llm.encoding import garbled_fields, prose_model
from sievewright.llm.languages import fit_languages, segments
from sievewright.llm.mixing import draw_mixture, mixture_report
from sievewright.llm.packing import pack_documents, packing_report
from sievewright.llm.percentiles import digest, left_out, merge_digests, quantiles, valid_calls
from sievewright.llm.records import collapse_records, record_counts
from sievewright.llm.residue import residue_fields
from sievewright.llm.tokens import with_tokens
from sievewright.llm.truncation import cut_rates, cut_texts
from sievewright.llm.visual import disguised_fields, normalized

LONG = "The index of Kego grew by 5% last spring, and most of the comments praise it. " * 13_000
CLASH = ["field", "kind", "restored", "swap", "cut", "size", "first_id", "copy_id", "id", "h", "salt", "keys", "gains", "raw", "key"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def rows(spark):
    """Twice the same row, nulls in any column, empty and very long texts, and
    columns named like those the operators make."""
    base = [(1, "e", "s", "Kego forecast", LONG, "https://a.example/x"), (1, "e", "s", "Kego forecast", LONG, "https://a.example/x"), (2, None, None, None, None, None), (3, "e", "s", "", "", ""), (4, "e", None, " ", " \t", " "), (5, None, "s", "Lorem ipsum dolor sit amet", "Die BrÃ¼cke fÃ¼r alle GerÃ¤te", "https://a.example/y"), (6, "e", "s", "wіth", "x" * 100_000, None)]
    frame = spark.createDataFrame(base, "result_id long, engine string, source string, title string, snippet string, url string")
    return frame.withColumns({c: F.lit("clash") for c in CLASH})


def ids(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_rows(rows, documents):
    garbled = garbled_fields(rows, prose_model(documents))
    assert ids(garbled, "result_id", "field") == [(5, "snippet")]
    assert ids(disguised_fields(rows, garbled), "result_id", "field") == [(6, "title")]
    assert normalized(rows).columns == rows.columns and normalized(rows).count() == rows.count()
    residue = residue_fields(rows, documents)
    assert ids(residue, "result_id", "field") == [(5, "title")]
    cut = cut_texts(rows, garbled.filter("field = 'snippet'"), residue.filter("field = 'snippet'"))
    assert ids(cut, "result_id", "cut") == [(1, False), (1, False), (5, True), (6, True)]
    assert ids(cut_rates(cut), "n_texts", "n_cut") == [(4, 2)]
    unique = rows.dropDuplicates(["result_id"])
    assert ids(collapse_records(unique), "first_id", "copy_id") == [(1, 1), (5, 5)] and record_counts(unique).count() == 2


def test_empty_tables(rows, documents):
    none, model = rows.limit(0), prose_model(documents.limit(0))
    assert garbled_fields(none, model).count() == disguised_fields(none).count() == residue_fields(none, documents.limit(0)).count() == cut_texts(none).count() == collapse_records(none).count() == 0


def test_numbers(spark):
    calls = spark.createDataFrame([(1, "a", 5.0, 0.0), (1, "a", 5.0, 0.0), (2, None, 7.0, 86400.0), (3, "a", None, None), (4, "a", -1.0, 0.0), (5, "a", 9e9, 0.0)], "call_id long, engine string, latency_ms double, created_at double")
    clash = calls.withColumns({c: F.lit(3) for c in ("n", "level", "node", "p50", "rank_error")})
    assert [c for c in valid_calls(clash).columns] == ["call_id", "engine", "latency_ms", "day"]
    told = quantiles(merge_digests(digest(valid_calls(clash), "latency_ms", ["engine", "day"]), ["engine"]), ["engine"])
    assert {(r["engine"], r["n"]) for r in told.collect()} == {("a", 1), (None, 1)}
    assert ids(left_out(clash).filter("engine = 'a'"), "n_calls", "n_null", "n_negative", "n_implausible") == [(4, 1, 1, 1)]
    assert digest(clash.limit(0), "latency_ms", ["engine"]).count() == 0


def test_documents(spark):
    texts = [(1, LONG, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "Le rapport est utile, même si les données ont changé.", "fr", "b"), (5, "Le rapport est utile, même si les données ont changé.", "fr", "b")]
    frame = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    clash = frame.withColumns({c: F.lit(9) for c in ("seg_no", "confidence", "n", "bucket", "rank", "full", "item", "container", "round", "share", "epoch", "slot", "t")})
    sized = with_tokens(clash)
    assert {r["doc_id"]: r["n_tokens"] > 0 for r in sized.collect()} == {1: True, 2: False, 3: False, 4: True, 5: True}
    caps = spark.createDataFrame([("c", 100, 1)], "capacity_name string, capacity_tokens int, room int")
    placed = pack_documents(sized, caps, buckets=4)
    assert {r["doc_id"] for r in placed.collect()} == {1, 2, 3, 4, 5} and packing_report(placed, caps).first()["fullest"] <= 100
    targets = spark.createDataFrame([("a", 0.5, 1, 1), ("b", 0.5, 3, 1), (None, 0.1, 1, 1)], "source string, target_share double, max_repeats int, n int")
    drawn = draw_mixture(sized, targets, buckets=4)
    assert {r["doc_id"] for r in drawn.collect()} <= {1, 4, 5} and mixture_report(drawn, targets).count() == 3
    found = segments(clash, fit_languages(clash))
    assert {r["doc_id"]: r["lang"] for r in found.collect()} == {1: "en", 4: "fr", 5: "fr"}
