"""Call outcomes by tumbling window, for batches and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcome_windows(calls: DataFrame, width: str = "1 hour", lateness: str | None = None, slide: str | None = None) -> DataFrame:
    """Calls and failures by engine and window of ``logged_at``; with ``slide``
    the windows overlap, each call standing in all that hold it.

    With ``lateness`` the watermark bounds the state of a stream; rows later
    than that are left out, as the stream's contract says. A batch needs none.
    """
    if lateness is not None:
        calls = calls.withWatermark("logged_at", lateness)
    by = calls.groupBy("engine", F.window("logged_at", width, slide))
    out = by.agg(F.count("*").alias("n_calls"), F.count_if(F.col("success") == 0).alias("n_failed"))
    return out.select("engine", F.unix_seconds("window.start").alias("hour_s"), "n_calls", "n_failed")


def failure_sessions(calls: DataFrame, gap: str = "30 minutes", lateness: str | None = None) -> DataFrame:
    """Runs of failures of an engine with no ``gap`` between them: ``engine,
    start_us, end_us`` (the last failure and the gap), ``n_failed``. Rows of
    null time are left out; for streams as for batches."""
    if lateness is not None:
        calls = calls.withWatermark("logged_at", lateness)
    failed = calls.filter("success = 0 and logged_at is not null")
    by = failed.groupBy("engine", F.session_window("logged_at", gap).alias("w")).agg(F.count("*").alias("n_failed"))
    return by.select("engine", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n_failed")
