"""Circuit breaker of engines, from their call outcomes.

A success resets an engine wholly, so its state is told by its trailing run of
failures: how many they are and when the last one was. A batch needs no
replay: the last success of each engine is one aggregate, the failures after
it another. The stream keeps the same three numbers as state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.runtime import join_small

# Failures that open, seconds it stays open, openings in a row
# after which an engine is disabled.
FAILURES, OPEN_SECONDS, DISABLE_AFTER = 2, 60, 3


def _told(failures: Column, last: Column, now: Column) -> dict[str, Column]:
    openings = F.greatest(failures - (FAILURES - 1), F.lit(0))
    waits = last + OPEN_SECONDS - now
    state = F.when(failures < FAILURES, "closed").when(waits > 0, "open").when(openings >= DISABLE_AFTER, "disabled").otherwise("half_open")
    return {"openings": openings, "state": state, "cooldown_s": F.when(state == "open", F.ceil(waits)).otherwise(0).cast("long")}


def breaker_status(calls: DataFrame, as_of: DataFrame) -> DataFrame:
    """State of each engine at ``as_of`` (one row): ``engine, failures,
    openings, state, cooldown_s``.

    Calls count once each; null times are left out. Both aggregates combine
    map-side, so a hot engine is no hot spot.
    """
    once = calls.filter("created_at is not null").select("engine", "success", "created_at")
    good = once.filter("success = 1").groupBy("engine").agg(F.max("created_at").alias("ok"))
    bad = join_small(once.filter("success = 0"), good, ["engine"]).filter(F.col("ok").isNull() | (F.col("created_at") > F.col("ok")))
    runs = bad.groupBy("engine").agg(F.count("*").alias("failures"), F.max("created_at").alias("last"))
    every = once.select("engine").distinct().join(runs, "engine", "left").crossJoin(F.broadcast(as_of))
    told = _told(F.coalesce("failures", F.lit(0)), F.coalesce("last", F.lit(0.0)), F.col("as_of"))
    return every.select("engine", F.coalesce("failures", F.lit(0)).alias("failures"), *[c.alias(n) for n, c in told.items()])


def usable(engines: DataFrame, status: DataFrame) -> DataFrame:
    """Engines that may be called: neither open nor disabled; engines without
    calls may."""
    return engines.join(status.filter("state in ('open', 'disabled')").select("engine"), "engine", "left_anti")


def breaker_stream(calls: DataFrame) -> DataFrame:
    """State of each engine after every batch of a stream: ``engine, failures,
    openings, opened_at``. Within a batch calls are taken by time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, last = state.get if state.exists else (0, 0.0)
        # A success resets, so of the batch only its trailing failures count.
        ok, bad = None, []
        for frame in frames:
            good = frame.loc[frame["success"] == 1, "created_at"]
            if len(good):
                ok = max(ok, float(good.max())) if ok is not None else float(good.max())
            bad.append(frame.loc[frame["success"] == 0, "created_at"])
        after = pd.concat(bad) if bad else pd.Series(dtype=float)
        if ok is not None:
            failures, after = 0, after[after > ok]
        failures += len(after)
        last = float(max([last, *after.tolist()])) if len(after) else float(last)
        state.update((int(failures), last))
        yield pd.DataFrame({"engine": [key[0]], "failures": [failures], "openings": [max(0, failures - FAILURES + 1)], "opened_at": [last if failures >= FAILURES else None]})

    return calls.select("engine", "success", "created_at").groupBy("engine").applyInPandasWithState(step, "engine string, failures long, openings long, opened_at double", "failures long, last double", "update", "NoTimeout")
