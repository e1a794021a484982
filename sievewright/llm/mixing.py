"""Sources mixed to target shares of the tokens, with capped repeats.

Every draw of a document is a block of its source. With the shares as rates,
a block that follows ``s`` tokens of its source and ends at ``e`` is released
at virtual time ``s / share`` and due at ``e / share`` (Pfair windows). Blocks
are drawn earliest deadline first among those released, which keeps every
source within one block of its share. As virtual time and the tokens drawn run
alike, the schedule is cut into epochs of virtual time, and the epochs are
played apart: a block belongs to the epoch it is released in. A source's
blocks are its documents in a hashed order, round after round, so running sums
need no gathering of a source: they are counted in hashed parts.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.runtime import join_small, materialize


def play_epoch(release: list[float], deadline: list[float], tokens: list[int], begin: float) -> list[int]:
    """Slot of each block: earliest deadline first among the blocks released
    by the tokens drawn so far; where none is, the next one released. Blocks
    come with their ties settled by their order."""
    waiting = sorted(range(len(release)), key=lambda i: (release[i], i))
    ready: list[tuple[float, int]] = []
    slots, now, at = [0] * len(release), begin, 0
    for slot in range(len(release)):
        while at < len(waiting) and (release[waiting[at]] <= now or not ready):
            heapq.heappush(ready, (deadline[waiting[at]], waiting[at]))
            at += 1
        block = heapq.heappop(ready)[1]
        slots[block] = slot
        now += tokens[block]
    return slots


def draw_mixture(
    sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, key: str = "doc_id", source: str = "source", tokens: str = "n_tokens", buckets: int = 512, epoch_blocks: int = 20_000
) -> DataFrame:
    """The drawn blocks: ``doc_id, source, round, n_tokens, release, deadline,
    epoch, slot``; the order of the mixture is that of ``epoch``, then ``slot``.

    ``targets`` has ``source, target_share, max_repeats``. ``total_tokens`` is
    the size of the mixture; by default the largest at which every listed
    source that has documents reaches its share within its repeats (shares
    taken among those), so the scarcest source sets it. At a larger size the
    scarce sources fall short, as ``mixture_report`` tells. Sources without
    documents, documents of no tokens, null sources and sources not listed are
    not drawn. An epoch is as long as ``epoch_blocks`` documents of mean size,
    so the blocks that one task plays don't grow with the mixture.

    While this is built, the documents are written with their buckets, and one
    row of sums comes to the driver.
    """
    listed = targets.filter("target_share > 0 and max_repeats > 0").groupBy(source).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    docs = join_small(sized.select(key, source, F.col(tokens).cast("long").alias("n")).filter("n > 0"), listed, [source], "inner")
    docs = materialize(docs.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "mixture-documents")
    parts = docs.groupBy(source, "bucket", "share", "repeats").agg(F.sum("n").alias("t"), F.count("*").alias("c"))
    before = Window.partitionBy(source).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("t").over(before), F.lit(0))).withColumn("whole", F.sum("t").over(Window.partitionBy(source))).select(source, "bucket", "start", "whole")
    sums = parts.groupBy(source, "share", "repeats").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    found = sums.agg(F.sum("share").alias("shares"), F.min(F.col("t") * F.col("repeats") / F.col("share")).alias("least"), F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    shares = found["shares"] or 1.0
    size = float(total_tokens if total_tokens is not None else (found["least"] or 0.0) * shares)
    epoch = epoch_blocks * float(found["t"] or 1) / float(found["c"] or 1)
    rate = F.col("share") / F.lit(shares)
    local = Window.partitionBy(source, "bucket").orderBy(F.xxhash64(key), key).rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("prior", F.coalesce(F.sum("n").over(local), F.lit(0))).join(starts, [source, "bucket"])
    rounds = F.least(F.col("repeats").cast("long"), F.ceil(rate * F.lit(size) / F.col("whole")))
    blocks = placed.filter(rounds > 0).withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), rounds - 1)))
    begin = F.col("round") * F.col("whole") + F.col("start") + F.col("prior")
    blocks = blocks.select(key, source, "round", F.col("n").alias("n_tokens"), (begin / rate).alias("release"), ((begin + F.col("n")) / rate).alias("deadline"))
    # The last block of a source is drawn if more than half of it is due.
    blocks = blocks.filter((F.col("release") + F.col("deadline")) / 2 <= size * (1 + 1e-12)).withColumn("epoch", F.floor(F.col("release") / epoch).cast("long"))

    def play(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["deadline", source, key, "round"], kind="stable")
        slots = play_epoch(group["release"].tolist(), group["deadline"].tolist(), group["n_tokens"].tolist(), float(group["epoch"].iloc[0]) * epoch)
        return group.assign(slot=slots)[[*group.columns, "slot"]]

    schema = ", ".join(f"{c} {t}" for c, t in blocks.dtypes)
    return blocks.groupBy("epoch").applyInPandas(play, f"{schema}, slot long")


def mixture_report(drawn: DataFrame, targets: DataFrame, total_tokens: int | None = None, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Target and reached share of every listed source, its repeats, and by
    how many tokens it falls short of its target in a mixture of
    ``total_tokens`` (by default: of the tokens drawn)."""
    uses = drawn.groupBy(source, key).agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("t"))
    got = uses.groupBy(source).agg(F.sum("t").alias("n_tokens"), F.count("*").alias("n_documents"), F.max("uses").alias("most_uses"))
    all_tokens = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))
    told = join_small(targets.select(source, "target_share", "max_repeats"), got, [source])
    told = told.select(source, "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tokens", "n_documents", "most_uses")])
    asked = F.lit(total_tokens).cast("double") if total_tokens is not None else all_tokens.cast("double")
    return told.withColumns({
        "reached_share": F.try_divide(F.col("n_tokens"), all_tokens), "asked_tokens": F.round(asked).cast("long"), "reached_tokens": all_tokens,
        "shortfall_tokens": F.greatest(F.lit(0), F.round(asked * F.col("target_share") - F.col("n_tokens"))).cast("long"),
    })
