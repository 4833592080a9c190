"""Filling containers of a fixed capacity with items, by cost-balanced packing.

An item's cost is estimated as a part linear and a part quadratic in its tokens (attention). Items are taken in descending order of tokens, and each goes
to the container with the lowest cost so far among those with room for it. As many containers are open from the start as the tokens need at least; another
is opened only when none has room. Only items longer than a container are cut, into full containers and a remainder.

Items are dealt to buckets by a hash of their key; a bucket is packed in one task and has a bounded size whatever the table's. The number of buckets
follows the tokens, and each wastes less than about one container.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import durable

#: Containers and items that a bucket should have.
CONTAINERS, ITEMS = 1024, 100_000


class Room:
    """Containers by remaining capacity; the cheapest with at least a given room is found in log(capacity) steps."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves = capacity, 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.tree: list[tuple[float, int, int] | None] = [None] * (2 * self.leaves)

    def _renew(self, room: int) -> None:
        at = room + self.leaves
        self.tree[at] = (*self.heaps[room][0], room) if self.heaps[room] else None
        while at > 1:
            at >>= 1
            a, b = self.tree[2 * at], self.tree[2 * at + 1]
            self.tree[at] = a if b is None or a is not None and a <= b else b

    def put(self, cost: float, container: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (cost, container))
        self._renew(room)

    def take(self, room: int) -> tuple[float, int, int] | None:
        """Removes and returns (cost, container, its room) of the cheapest with at least `room`."""
        best, at, end = None, room + self.leaves, 2 * self.leaves
        while at < end:
            if at & 1:
                if (x := self.tree[at]) is not None and (best is None or x < best):
                    best = x
                at += 1
            at >>= 1
            end >>= 1
        if best is not None:
            heapq.heappop(self.heaps[best[2]])
            self._renew(best[2])
        return best


def pack(sizes: list[int], capacity: int, linear: float = 1.0, quadratic: float | None = None) -> tuple[list[int], list[int]]:
    """The container and the place in it of each item; sizes must not exceed the capacity. quadratic: per token squared, 1 / capacity by default."""
    quadratic = 1.0 / capacity if quadratic is None else quadratic
    containers, starts, room = [0] * len(sizes), [0] * len(sizes), Room(capacity)
    opened = math.ceil(sum(sizes) / capacity)
    for c in range(opened):
        room.put(0.0, c, capacity)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[i]
        found = room.take(n)
        if found is None:
            found = (0.0, opened, capacity)
            opened += 1
        cost, c, left = found
        containers[i], starts[i] = c, capacity - left
        room.put(cost + linear * n + quadratic * n * n, c, left - n)
    return containers, starts


def pack_items(items: DataFrame, key: str, size: str, capacity: int = 2048) -> DataFrame:
    """(key, piece, first, size, container, start): every item, or every piece of an item over the capacity, in its container. first: its first unit in the
    item; start: its first unit in the container. Containers are numbered over all buckets, with gaps.

    A null or negative size counts as 0; an item of size 0 takes no room but has a container. Repeated rows are items of their own. An empty table gives no rows.
    """
    kind = dict(items.dtypes)[key]
    # The sizes are counted before they are dealt out, and must not be computed twice.
    s = durable(items.select(F.col(key).alias("id"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("n")))
    total = s.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("units"), F.count("*").alias("rows")).first()
    buckets = max(1, math.ceil(total.units / (capacity * CONTAINERS)), math.ceil(total.rows / ITEMS))
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0))
    pieces = s.select("id", "n", F.posexplode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece", "p")).select(
        "id", "piece", (F.col("p") * capacity).alias("first"), F.least(F.col("n") - F.col("p") * capacity, F.lit(capacity)).cast("int").alias("size")
    )
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("bigint"))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "piece"], kind="stable").reset_index(drop=True)
        containers, starts = pack(rows["size"].tolist(), capacity)
        return rows.assign(container=pd.Series(containers, dtype="int64") + rows["bucket"] * 2**32, start=starts)[["id", "piece", "first", "size", "container", "start"]]

    done = pieces.groupBy("bucket").applyInPandas(fill, f"id {kind}, piece int, first bigint, size int, container bigint, start int")
    return done.withColumnRenamed("id", key)


def balance(packed: DataFrame, capacity: int, linear: float = 1.0, quadratic: float | None = None) -> DataFrame:
    """(containers, least_containers, items, units, unused_share, least_cost, mean_cost, greatest_cost) of a packing: one row. least_containers: as many as the units need at least; costs as in `pack`."""
    quadratic = 1.0 / capacity if quadratic is None else quadratic
    n = F.col("size").cast("double")
    each = packed.groupBy("container").agg(F.sum(n * linear + n * n * quadratic).alias("cost"), F.sum("size").alias("units"), F.count("*").alias("items"))
    whole = each.agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("units").alias("units"), F.min("cost").alias("least_cost"), F.avg("cost").alias("mean_cost"), F.max("cost").alias("greatest_cost"))
    return whole.select("containers", F.ceil(F.col("units") / capacity).alias("least_containers"), "items", "units", (1 - F.col("units") / (F.col("containers") * capacity)).alias("unused_share"), "least_cost", "mean_cost", "greatest_cost")
