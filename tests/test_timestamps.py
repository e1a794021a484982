"""Publication times: notations, zones, daylight saving, ambiguity, empties."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sievewright.operators.timestamps import normalize_timestamps, sorted_by_time, window_bound, within_window

FETCHED = datetime(2026, 2, 10, 12, 0, 0, tzinfo=timezone.utc)
ENGINES = [("berlin", "Europe/Berlin", "dmy"), ("york", "America/New_York", "mdy"), ("tokyo", "Asia/Tokyo", "ymd"), ("open", "UTC", None)]


def us(*parts):
    d = datetime(*parts, tzinfo=timezone.utc)
    return int((d - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000


CASES = [
    ("berlin", "2026-01-24T04:05:17+01:00", us(2026, 1, 24, 3, 5, 17)),
    ("berlin", "2026-01-24T04:05:17.250Z", us(2026, 1, 24, 4, 5, 17) + 250_000),
    ("berlin", "2026-01-24", us(2026, 1, 23, 23)),
    ("berlin", "2026-01", us(2025, 12, 31, 23)),
    ("berlin", "2025-10-26 02:30:00", us(2025, 10, 26, 0, 30)),  # occurs twice: the earlier
    ("berlin", "2025-03-30 02:30:00", us(2025, 3, 30, 1, 30)),  # skipped: offset before the change
    ("berlin", "17.8.2025, 14:13 Uhr", us(2025, 8, 17, 12, 13)),
    ("berlin", "13/01/26 14:58", us(2026, 1, 13, 13, 58)),
    ("york", "01/13/26 14:58", us(2026, 1, 13, 19, 58)),
    ("york", "December 22, 2025 4:59 pm", us(2025, 12, 22, 21, 59)),
    ("york", "2025-05-25 23:10:17 EDT", us(2025, 5, 26, 3, 10, 17)),
    ("tokyo", "2025年9月5日", us(2025, 9, 4, 15)),
    ("tokyo", "1763319058", 1763319058_000_000),
    ("tokyo", "1766646449745", 1766646449745_000),
    ("tokyo", "20260109053912", us(2026, 1, 8, 20, 39, 12)),
    ("tokyo", "20260109", us(2026, 1, 8, 15)),
    ("tokyo", "\t3小时前 ", us(2026, 2, 10, 9)),
    ("tokyo", "vor 2 Tagen", us(2026, 2, 8, 12)),
    ("tokyo", "Wed, 07 Jan 2026 11:52:04 +1400", us(2026, 1, 6, 21, 52, 4)),
    ("tokyo", "2026-01-15T10:36:21+08:00[Asia/Shanghai]", us(2026, 1, 15, 2, 36, 21)),
    ("tokyo", "31/11/2025", None),
    ("tokyo", "2025-06-10T27:15:00Z", None),
    ("tokyo", "unknown", None),
    ("tokyo", "", None),
    ("tokyo", None, None),
    (None, "2026-01-24T00:00:00", us(2026, 1, 24)),
]


@pytest.fixture(scope="module")
def result(spark):
    rows = spark.createDataFrame([(i, e, v, FETCHED, "x") for i, (e, v, _) in enumerate(CASES)], "result_id long, engine string, published_at string, fetched_at timestamp, notation string")
    engines = spark.createDataFrame(ENGINES, "engine string, default_tz string, date_order string")
    return {r["result_id"]: r for r in normalize_timestamps(rows, engines).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_reading(result, i):
    assert result[i]["published_us"] == CASES[i][2], CASES[i]


def test_one_row_each_and_clashing_column(result):
    assert len(result) == len(CASES)
    assert result[0]["notation"] == "iso"


def test_undeclared_order_is_learned(spark):
    sure = [(i, "open", f"{20 + i % 8}/0{1 + i % 9}/2025", FETCHED) for i in range(40)]
    rows = spark.createDataFrame([*sure, (99, "open", "03/04/2025", FETCHED)], "result_id long, engine string, published_at string, fetched_at timestamp")
    engines = spark.createDataFrame(ENGINES, "engine string, default_tz string, date_order string")
    got = {r["result_id"]: r for r in normalize_timestamps(rows, engines).collect()}
    assert got[99]["published_us"] == us(2025, 4, 3) and not got[99]["ambiguous"]
    alone = spark.createDataFrame([(1, "open", "03/04/2025", FETCHED)], rows.schema)
    assert normalize_timestamps(alone, engines).first()["ambiguous"]


def test_empty(spark):
    rows = spark.createDataFrame([], "result_id long, engine string, published_at string, fetched_at timestamp")
    engines = spark.createDataFrame([], "engine string, default_tz string, date_order string")
    assert normalize_timestamps(rows, engines).count() == 0


def frame(spark, rows):
    return spark.createDataFrame([(i, e, v, FETCHED) for i, (e, v) in enumerate(rows)], "result_id long, engine string, published_at string, fetched_at timestamp")


def test_contradicted_declaration_is_marked(spark):
    """An engine that declares day first but writes month first most often."""
    engines = spark.createDataFrame(ENGINES, "engine string, default_tz string, date_order string")
    rows = [("berlin", f"0{1 + i % 9}/{13 + i % 15}/2025") for i in range(60)] + [("berlin", "03/04/2025"), ("york", "03/04/2025")]
    got = {r["result_id"]: r for r in normalize_timestamps(frame(spark, rows), engines).collect()}
    assert got[0]["notation"] == "slash_mdy" and not got[0]["ambiguous"]
    assert got[60]["ambiguous"] and got[60]["posterior"] < 0.9
    assert not got[61]["ambiguous"] and got[61]["published_us"] == us(2025, 3, 4, 5)


def test_dots_and_shared_letters(spark):
    """Dots are day first unless the engine writes otherwise; letters that
    several zones share are read by the engine's zone, and marked elsewhere."""
    engines = spark.createDataFrame([*ENGINES, ("delhi", "Asia/Kolkata", None), ("china", "Asia/Shanghai", None)], "engine string, default_tz string, date_order string")
    rows = [("berlin", "3.4.2025"), ("delhi", "2025-06-01 10:00 IST"), ("china", "2025-06-01 10:00 CST"), ("york", "2025-06-01 10:00 CST"), ("tokyo", "2025-06-01 10:00 CST")]
    rows += [("open", f"0{1 + i % 9}.{13 + i % 15}.2025") for i in range(300)] + [("open", "3.4.2025")]
    got = {r["result_id"]: r for r in normalize_timestamps(frame(spark, rows), engines).collect()}
    assert got[0]["published_us"] == us(2025, 4, 2, 22) and not got[0]["ambiguous"]
    assert [got[i]["published_us"] for i in (1, 2, 3)] == [us(2025, 6, 1, 4, 30), us(2025, 6, 1, 2), us(2025, 6, 1, 16)]
    assert not any(got[i]["ambiguous"] for i in (1, 2, 3)) and got[4]["ambiguous"] and got[4]["published_us"] == us(2025, 6, 1, 16)
    assert got[305]["notation"] == "dots_mdy" and got[305]["published_us"] == us(2025, 3, 4)


def test_windows(spark):
    """Known times outside are dropped, unknown ones kept unless strict."""
    engines = spark.createDataFrame([("open", "UTC", None)], "engine string, default_tz string, date_order string")
    rows = [("open", v) for v in ("2026-08-08", "2026-07-01", None, "2026-08-01", "1700000000")]
    read = normalize_timestamps(frame(spark, rows), engines)
    ids = lambda f: sorted(r["result_id"] for r in f.collect())
    assert ids(within_window(read, "2026-08-01")) == [0, 2, 3] and ids(within_window(read, "2026-08-01", strict=True)) == [0, 3]
    assert ids(within_window(read, "2026-08-01", "2026-08-01")) == [2, 3]
    late = normalize_timestamps(frame(spark, [("open", v) for v in ("2026-08-05T23:59:59", "2026-08-06T00:00:00", "2026-08-06T12:00:00")]), engines)
    assert ids(within_window(late, until="2026-08-05")) == [0] and ids(within_window(late, until="2026-08-06 00:00:00")) == [0, 1]
    order = {r["result_id"]: r["position"] for r in sorted_by_time(read.withColumn("rank", F.lit(1)), by=("engine",)).collect()}
    assert order == {0: 1, 3: 2, 1: 3, 4: 4, 2: 5}


def test_window_bounds(spark):
    cases = {"7d": us(2026, 2, 3), "24h": us(2026, 2, 9), "2W": us(2026, 1, 27), "2026-01-05": us(2026, 1, 5), "2026-01-05 10:30": us(2026, 1, 5, 10, 30), "2026-01-05T10:30:00+02:00": us(2026, 1, 5, 8, 30), "1700000000": 1700000000_000_000, "soon": None, "": None, None: None}
    rows = spark.createDataFrame([(v, FETCHED) for v in cases], "v string, now timestamp").select("v", window_bound(F.col("v"), F.col("now")).alias("b")).collect()
    assert {r["v"]: r["b"] for r in rows} == cases
