"""Pages reached from seeds over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.runtime import materialize


def crawl(links: DataFrame, seeds: DataFrame, depth: int = 2, same_host: bool = True) -> DataFrame:
    """Pages within ``depth`` links of the seeds: ``url, depth`` (the least).

    ``links`` has ``url, target``, ``seeds`` has ``url``. With ``same_host``
    only links within a host are followed. Fragments don't make another page;
    null and empty ones are none. Breadth first, one written frontier a level:
    a level joins its frontier with the links, so a page of very many links is
    spread by its targets, and nothing comes to the driver.
    """
    from sievewright.functions import urls

    bare = lambda c: F.regexp_replace(F.trim(F.col(c)), "#[\\s\\S]*$", "")
    edges = links.select(bare("url").alias("url"), bare("target").alias("target")).filter("url <> '' and target <> '' and url <> target").distinct()
    if same_host:
        edges = edges.filter(urls.host(F.col("url")) == urls.host(F.col("target")))
    frontier = materialize(seeds.select(bare("url").alias("url")).filter("url <> ''").distinct().withColumn("depth", F.lit(0)), "crawl-frontier")
    seen = frontier
    for level in range(1, depth + 1):
        step = edges.join(frontier.select("url"), "url").select(F.col("target").alias("url")).distinct()
        frontier = materialize(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(level)), "crawl-frontier")
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen
