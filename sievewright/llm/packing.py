"""Documents packed whole into containers of a fixed number of tokens.

Only sizes matter for a packing, so the problem is solved on the histogram of
sizes, which has at most as many entries as the container has tokens,
whatever the corpus. Martello and Toth's dominance reduction first fixes the
sets that no other choice around an item can beat: the item alone where
nothing fits beside it, and the item with its largest partner where no two
items fit beside it, where the partner fills the container, or where no
fitting pair is larger than the partner. The remainder is filled best fit,
preferring fillings by two or three items that leave nothing. A filling is
repeated as often as the counts allow. Each document then finds its container
from its rank among those of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.runtime import join_small, materialize


class _Sizes:
    """Counts by size, with the next smaller size that is left."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        for size, n in histogram.items():
            if 0 < size <= capacity:
                self.count[size] = n
        self.below = np.arange(capacity + 1)
        gone = self.count == 0
        self.below[gone] = np.flatnonzero(gone) - 1
        self.below[0] = 0
        self.left = int((self.count > 0).sum())

    def take(self, items: dict[int, int]) -> int:
        """Take a filling as often as it can be taken."""
        times = min(int(self.count[s]) // m for s, m in items.items())
        for s, m in items.items():
            self.count[s] -= times * m
            if not self.count[s]:
                self.below[s], self.left = s - 1, self.left - 1
        return times

    def largest(self, limit: int, without: dict[int, int]) -> int:
        """The largest size of at most ``limit`` left beside ``without``, or 0."""
        while limit > 0:
            path = []
            while limit > 0 and self.below[limit] != limit:
                path.append(limit)
                limit = int(self.below[limit])
            self.below[path] = limit
            if limit == 0 or self.count[limit] > without.get(limit, 0):
                return limit
            limit -= 1
        return 0

    def least(self, many: int, without: dict[int, int]) -> int:
        """The sum of the ``many`` smallest items left beside ``without``."""
        total = 0
        for s in np.flatnonzero(self.count[: 1 + self.top()]):
            n = min(many, int(self.count[s]) - without.get(int(s), 0))
            total, many = total + n * int(s), many - n
            if not many:
                return total
        return len(self.count) * 2

    def top(self) -> int:
        return self.largest(len(self.count) - 1, {})

    def has(self, size: int, without: dict[int, int]) -> bool:
        return size > 0 and self.count[size] > without.get(size, 0)

    def best_pair(self, room: int, without: dict[int, int]) -> int:
        """The largest sum of two items of at most ``room``, or 0."""
        free = self.count[: room + 1].copy()
        for s, m in without.items():
            if s <= room:
                free[s] -= m
        sizes = np.flatnonzero(free > 0)
        if not len(sizes):
            return 0
        at = np.searchsorted(sizes, room - sizes, "right") - 1
        # An item is no partner of itself unless there are two.
        own = (at >= 0) & (sizes[at] == sizes) & (free[sizes] < 2)
        at = np.where(own, at - 1, at)
        good = at >= 0
        return int((sizes[good] + sizes[at[good]]).max(initial=0))

    def exact_pair(self, room: int, without: dict[int, int]) -> tuple[int, int] | None:
        """Two items that fill ``room``, the first as large as can be."""
        free = self.count[: room + 1].copy()
        for s, m in without.items():
            if s <= room:
                free[s] -= m
        half = (room + 1) // 2
        large, small = free[half:room], free[room - half : 0 : -1]
        good = np.flatnonzero((large > 0) & (small > 0))
        for i in good[::-1]:
            s = half + int(i)
            if s * 2 != room or free[s] > 1:
                return s, room - s
        return None


def _with(items: dict[int, int], *sizes: int) -> dict[int, int]:
    out = dict(items)
    for s in sizes:
        out[s] = out.get(s, 0) + 1
    return out


def _reduce(sizes: _Sizes, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """The fillings that dominate all others."""
    fixed: list[tuple[int, dict[int, int]]] = []
    for j in range(sizes.top(), 0, -1):
        while sizes.count[j]:
            own, room = {j: 1}, capacity - j
            partner = sizes.largest(room, own)
            if not partner:
                fixed.append((sizes.take(own), own))
                continue
            pair = _with(own, partner)
            fills = partner == room or sizes.least(2, own) > room
            if not fills and (sizes.least(3, own) <= room or sizes.best_pair(room, own) > partner):
                break
            fixed.append((sizes.take(pair), pair))
    return fixed


def _fill(sizes: _Sizes, capacity: int) -> dict[int, int]:
    """A filling around the largest size left."""
    items = {sizes.top(): 1}
    room = capacity - next(iter(items))
    while room > 0:
        if sizes.has(room, items):
            return _with(items, room)
        first = sizes.largest(room, items)
        if not first:
            break
        pair = sizes.exact_pair(room, items)
        if pair:
            return _with(items, *pair)
        items, room = _with(items, first), room - first
    return items


def pack_sizes(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Fillings of containers: (times used, {size: items}); sizes 1..capacity."""
    sizes = _Sizes(histogram, capacity)
    out = _reduce(sizes, capacity)
    while sizes.left:
        items = _fill(sizes, capacity)
        out.append((sizes.take(items), items))
    return out


def _intervals(fillings: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """Arrays sorted by (size, rank): where each run of ranks is placed."""
    used: dict[int, int] = {}
    rows, at = [], 0
    for times, items in fillings:
        for s, m in items.items():
            rows.append((s, used.get(s, 0), m, at))
            used[s] = used.get(s, 0) + m * times
        at += times
    table = np.array(sorted(rows) or np.empty((0, 4)), dtype=np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def pack_documents(sized: DataFrame, capacities: DataFrame, key: str = "doc_id", tokens: str = "n_tokens", buckets: int = 512) -> DataFrame:
    """Placement: ``capacity_name, doc_id, piece_no, n_tokens, container``.

    A document larger than a container is divided: its full pieces fill
    containers of their own, the rest is an item like others. Documents of no
    tokens (null or empty text) go into container 0. Capacities that are null
    or below 1 are left out. Ties are settled by ``key``, which must be
    unique. Documents are ranked once, by size in ``buckets`` hashed parts, so
    no size is gathered in one task; all capacities share the ranks.

    While this is built, the sizes are written and the histogram of items of
    each capacity, at most ``capacity_tokens`` rows, comes to the driver.
    """
    spark = sized.sparkSession
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sized = materialize(sized.select(key, F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("n")).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "sizes")
    kind = sized.schema[key].dataType.simpleString()
    caps = capacities.filter("capacity_tokens >= 1").groupBy("capacity_name").agg(F.max("capacity_tokens").cast("long").alias("room"))
    # One row for each capacity, size and bucket that occur.
    full = F.when(F.col("n") > F.col("room"), F.floor(F.col("n") / F.col("room"))).otherwise(0).cast("long")
    counts = join_small(sized.groupBy("n", "bucket").agg(F.count("*").alias("c"), F.lit(1).alias("_all")), caps.withColumn("_all", F.lit(1)), ["_all"], "inner").drop("_all").withColumn("full", full).withColumn("item", F.col("n") - F.col("full") * F.col("room"))
    counts = materialize(counts, "size-counts")
    fillings: dict[str, tuple[int, dict[int, int]]] = {}
    for r in counts.groupBy("capacity_name", "room", "item").agg(F.sum("c").alias("c")).toLocalIterator():
        fillings.setdefault(r["capacity_name"], (int(r["room"]), {}))[1][int(r["item"])] = int(r["c"])
    out = f"capacity_name string, {key} {kind}, piece_no long, n_tokens long, container long"
    if not fillings:
        return spark.createDataFrame([], out)
    packed = {name: pack_sizes(histogram, room) for name, (room, histogram) in fillings.items()}
    used = {name: max(sum(times for times, _ in packed[name]), int(0 in fillings[name][1])) for name in packed}
    shared = spark.sparkContext.broadcast({name: _intervals(f) for name, f in packed.items()})
    # Where the ranks of a size and bucket begin: among the items of equal
    # size, and among the full pieces, whose buckets are summed up first.
    start = F.coalesce(F.sum("c").over(before("capacity_name", "item").orderBy("n", "bucket")), F.lit(0))
    inside = F.coalesce(F.sum(F.col("c") * F.col("full")).over(before("capacity_name", "bucket").orderBy("n")), F.lit(0))
    by_bucket = counts.groupBy("capacity_name", "bucket").agg(F.sum(F.col("c") * F.col("full")).alias("f"))
    by_bucket = by_bucket.select("capacity_name", "bucket", F.coalesce(F.sum("f").over(before("capacity_name").orderBy("bucket")), F.lit(0)).alias("outside"))
    spans = counts.withColumn("start", start).withColumn("inside", inside).join(by_bucket, ["capacity_name", "bucket"])
    spans = spans.groupBy("n", "bucket").agg(F.collect_list(F.struct("capacity_name", "room", "full", "item", "start", (F.col("inside") + F.col("outside")).alias("whole"))).alias("spans"))
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("n", "bucket").orderBy(key)) - 1)
    placed = ranked.join(spans, ["n", "bucket"]).select(key, "rank", F.explode("spans").alias("s")).select(key, F.col("rank").cast("long").alias("rank"), "s.*")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            container = np.zeros(len(frame), dtype=np.int64)
            names = frame["capacity_name"].to_numpy(dtype=object)
            for name, (size, begin, each, base) in shared.value.items():
                mine = np.flatnonzero((names == name) & (frame["item"].to_numpy() > 0))
                if not len(mine) or not len(size):
                    continue
                item = frame["item"].to_numpy(dtype=np.int64)[mine]
                rank = (frame["rank"] + frame["start"]).to_numpy(dtype=np.int64)[mine]
                # One sorted key of (size, rank): ranks stay under the widest span.
                span = int(begin.max(initial=0)) + 1
                at = np.searchsorted(size * (span + 1) + begin, item * (span + 1) + np.minimum(rank, span), "right") - 1
                container[mine] = base[at] + (rank - begin[at]) // each[at]
            yield frame.assign(container=container)[["capacity_name", key, "room", "full", "item", "rank", "whole", "container"]]

    placed = placed.mapInPandas(place, f"capacity_name string, {key} {kind}, room long, full long, item long, rank long, whole long, container long")
    # Full pieces: containers after those of the items.
    first = F.create_map(*[F.lit(x) for kv in used.items() for x in kv])[F.col("capacity_name")]
    rest = F.when((F.col("item") > 0) | (F.col("full") == 0), F.array(F.struct(F.col("full").alias("piece_no"), F.col("item").alias("n_tokens"), F.col("container"))))
    pieces = F.transform(
        F.when(F.col("full") > 0, F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda i: F.struct(i.alias("piece_no"), F.col("room").alias("n_tokens"), (first + F.col("whole") + F.col("rank") * F.col("full") + i).alias("container")),
    )
    every = F.concat(pieces, F.coalesce(rest, F.array().cast("array<struct<piece_no:bigint,n_tokens:bigint,container:bigint>>")))
    return placed.select("capacity_name", key, F.explode(every).alias("p")).select("capacity_name", key, "p.*")


def packing_report(placement: DataFrame, capacities: DataFrame) -> DataFrame:
    """Containers used, the least possible number, and the share of unused room."""
    by = placement.groupBy("capacity_name", "container").agg(F.sum("n_tokens").alias("t")).groupBy("capacity_name")
    used = by.agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    caps = capacities.groupBy("capacity_name").agg(F.max("capacity_tokens").cast("long").alias("capacity_tokens"))
    return join_small(used, caps, ["capacity_name"], "inner").select(
        "capacity_name", "capacity_tokens", "n_containers", "n_tokens", "fullest",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"),
        (1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("unused_share"),
    )
