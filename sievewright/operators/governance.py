"""Source governance: adaptive scores, quotas, network profile, catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adaptive_scores(calls: DataFrame, as_of: DataFrame, window_days: int = 7, stale_seconds: int = 86_400) -> DataFrame:
    """Score of each engine over the window before ``as_of`` (one row), in
    ten-thousandths: success rate (one half where it is 0), times the latency
    factor, times the cost factor; one half where the last call is stale.

    Sums are of whole microseconds and millionths, so they don't depend on
    the order of rows.
    """
    recent = calls.crossJoin(F.broadcast(as_of)).filter(F.col("created_at") > F.col("as_of") - window_days * 86_400)
    out = recent.groupBy("engine").agg(
        F.count("*").alias("n_calls"), F.sum("success").alias("n_success"), F.sum(F.round(F.col("latency_ms") * 1000).cast("long")).alias("us"), F.count("latency_ms").alias("n_latency"),
        F.sum(F.round(F.col("cost") * 1_000_000).cast("long")).alias("millionths"), F.count("cost").alias("n_cost"), F.max("created_at").alias("last"), F.first("as_of").alias("as_of"),
    )
    success = F.when(F.col("n_success") == 0, F.lit(0.5)).otherwise(F.col("n_success") / F.col("n_calls"))
    latency = F.coalesce(F.try_divide(F.col("us").cast("double"), F.col("n_latency") * F.lit(1000.0)), F.lit(2000.0))
    cost = F.coalesce(F.try_divide(F.col("millionths").cast("double"), F.col("n_cost") * F.lit(1_000_000.0)), F.lit(0.0))
    score = success * F.least(F.lit(1.0), F.lit(2000.0) / F.greatest(latency, F.lit(1.0))) * F.greatest(F.lit(0.3), F.lit(1.0) - cost * 10)
    return out.select("engine", "n_calls", "n_success", F.floor(F.when(F.col("as_of") - F.col("last") > stale_seconds, F.lit(0.5)).otherwise(score) * 10_000 + 0.5).cast("long").alias("score_e4"))


def latest(calls: DataFrame) -> DataFrame:
    """The time of the last call, one row."""
    return calls.agg(F.max("created_at").alias("as_of"))


def quota_stats(calls: DataFrame, as_of: DataFrame) -> DataFrame:
    """Calls of the last hour and minute, errors of the hour, cost in millionths."""
    recent = calls.crossJoin(F.broadcast(as_of)).filter(F.col("created_at") > F.col("as_of") - 3600)
    return recent.groupBy("engine").agg(
        F.count("*").alias("calls_hour"), F.count_if(F.col("created_at") > F.col("as_of") - 60).alias("calls_minute"),
        F.count_if(F.col("success") == 0).alias("errors_hour"), F.coalesce(F.sum(F.round(F.col("cost") * 1_000_000).cast("long")), F.lit(0)).alias("cost_e6"),
    )


def quota_status(calls: DataFrame, engines: DataFrame, as_of: DataFrame) -> DataFrame:
    """Use of each enabled engine against its rate at ``as_of``: ``engine,
    calls_minute, error_e4`` (share of failed calls of the hour), ``available``:
    fewer calls in the last minute than a minute of its ``qps``, where it has
    one. Engines without calls are available."""
    told = engines.filter("enabled").select("engine", "qps").join(quota_stats(calls, as_of), "engine", "left")
    minute, hour = F.coalesce("calls_minute", F.lit(0)), F.coalesce("calls_hour", F.lit(0))
    error = F.coalesce(F.try_divide(F.coalesce("errors_hour", F.lit(0)) * 10_000, hour), F.lit(0.0))
    free = F.col("qps").isNull() | (minute < F.col("qps") * 60)
    return told.select("engine", minute.alias("calls_minute"), F.floor(error).cast("long").alias("error_e4"), free.alias("available"))


def network_profile(calls: DataFrame, engines: DataFrame) -> DataFrame:
    """Mean latency class of each family: fast, normal or slow, with the
    scale of timeouts in tenths."""
    by = calls.filter("latency_ms >= 0").groupBy("engine").agg(F.sum(F.round(F.col("latency_ms") * 1000).cast("long")).alias("us"), F.count("*").alias("n"))
    fam = by.join(engines.select("engine", "family"), "engine").groupBy("family").agg(F.sum("us").alias("us"), F.sum("n").alias("n_calls"))
    mean = F.col("us") / (F.col("n_calls") * 1000)
    return fam.select("family", "n_calls", F.when(mean < 800, "fast").when(mean > 3000, "slow").otherwise("normal").alias("network"), F.when(mean < 800, 8).when(mean > 3000, 18).otherwise(10).alias("timeout_tenths"))


def engine_status(engines: DataFrame, calls: DataFrame) -> DataFrame:
    """Catalog with what was called: disabled, unused or ready."""
    used = calls.groupBy("engine").agg(F.count("*").alias("n_calls"))
    out = engines.select("engine", "family", "enabled", "cost_tier").join(used, "engine", "left")
    return out.select("engine", "family", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.when(~F.col("enabled"), "disabled").when(F.col("n_calls").isNull(), "unused").otherwise("ready").alias("status"), (F.col("enabled") & (F.coalesce("cost_tier", F.lit("free")) != "paid")).alias("routable"))


# Families that are no complement of a general search.
NO_COMPLEMENT = ("misc_vertical", "hot_trending", "media_book", "archive")


def complement_refill(combos: DataFrame, engines: DataFrame, general: str = "web", most: int = 2, excluded: tuple[str, ...] = NO_COMPLEMENT) -> DataFrame:
    """Engines that complete a query's engines: ``query_id, engine, priority``.

    ``combos`` has ``query_id, engine, is_primary``. Only queries all of whose
    engines are of the ``general`` family, and whose primary engine has topics,
    are completed: by enabled engines of families that they don't have, other
    than the ``excluded``, which share a topic with the primary engine, the
    ``most`` of highest priority, ties by name.
    """
    known = combos.join(engines.select("engine", "family", "coverage"), "engine", "left")
    asked = known.groupBy("query_id").agg(
        F.bool_and(F.coalesce(F.col("family") == general, F.lit(False))).alias("all_general"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("is_primary"), F.col("coverage"))))).alias("topics"),
    )
    # Queries of the same topics are completed alike, so topics are joined once.
    topics = asked.filter("all_general and size(topics) > 0").withColumn("key", F.array_join(F.array_sort("topics"), "\x1f"))
    distinct = topics.select("key", F.explode("topics").alias("topic")).distinct()
    offered = engines.filter(F.col("enabled") & (F.col("family") != general) & ~F.col("family").isin(*excluded)).select("engine", F.coalesce("priority", F.lit(0)).alias("priority"), F.explode("coverage").alias("topic"))
    met = distinct.join(offered, "topic").select("key", "engine", "priority").distinct()
    order = Window.partitionBy("key").orderBy(F.desc("priority"), "engine")
    best = met.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    return topics.select("query_id", "key").join(best, "key").select("query_id", "engine", "priority")


def policy_filter(combos: DataFrame, engines: DataFrame, budget: int | None = 3, blocked: str = "paid") -> DataFrame:
    """The engines of a query that a policy lets through: ``query_id, engine,
    position``: without those of the ``blocked`` cost tier, unless that leaves
    none, and at most ``budget`` by best rank.

    ``combos`` has ``query_id, engine, best_rank``.
    """
    known = combos.join(engines.select("engine", F.coalesce("cost_tier", F.lit("free")).alias("tier")), "engine", "left")
    open_ = F.coalesce(F.col("tier") != blocked, F.lit(True))
    line = Window.partitionBy("query_id").orderBy(F.when(open_, 0).otherwise(1), "best_rank", "engine")
    some = F.max(open_).over(Window.partitionBy("query_id"))
    kept = known.withColumn("some", some).withColumn("position", F.row_number().over(line)).filter(open_ | ~F.col("some"))
    return (kept if budget is None else kept.filter(F.col("position") <= budget)).select("query_id", "engine", "position")


def families(engines: DataFrame) -> DataFrame:
    """The engines of each family, and how many of them are enabled."""
    return engines.groupBy("family").agg(F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"), F.count_if("enabled").alias("n_enabled"))


def peak_rate(calls: DataFrame, width: int = 60, slice_s: int = 3600) -> DataFrame:
    """The most calls that each engine had within ``width`` seconds up to and
    with one of them: ``engine, peak``.

    Time is cut into slices, and each call stands in the next one too where it
    can be in reach, so that a hot engine is as many groups as slices.
    """
    at = F.floor(F.col("created_at") * 1000).cast("long")
    own = F.floor(at / (slice_s * 1000))
    reach = F.floor((at + width * 1000) / (slice_s * 1000))
    told = calls.filter("created_at is not null").select("engine", at.alias("at"), own.alias("own"), F.explode(F.sequence(own, reach)).alias("slice"))
    line = Window.partitionBy("engine", "slice").orderBy("at").rangeBetween(-(width * 1000 - 1), 0)
    return told.withColumn("n", F.count("*").over(line)).filter("own = slice").groupBy("engine").agg(F.max("n").alias("peak"))


def latency_trend(calls: DataFrame) -> DataFrame:
    """The last two days of each engine with usable latencies: ``engine, day,
    mean_us, previous_us, trend`` (up, down, flat or new)."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("created_at") / 86400).cast("int"))
    us = F.round(F.col("latency_ms") * 1000).cast("long")
    by = calls.filter("latency_ms >= 0").groupBy("engine", day.alias("day")).agg(F.floor(F.sum(us) / F.count("*")).cast("long").alias("mean_us"))
    line = Window.partitionBy("engine").orderBy("day")
    told = by.withColumn("previous_us", F.lag("mean_us").over(line)).withColumn("r", F.row_number().over(Window.partitionBy("engine").orderBy(F.desc("day")))).filter("r = 1")
    trend = F.when(F.col("previous_us").isNull(), "new").when(F.col("mean_us") > F.col("previous_us"), "up").when(F.col("mean_us") < F.col("previous_us"), "down").otherwise("flat")
    return told.select("engine", "day", "mean_us", "previous_us", trend.alias("trend"))
