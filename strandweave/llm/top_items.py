"""The most frequent items of a huge column, exactly, in bounded memory.

External sort and run-length counting: each task turns its rows into sorted runs with combined counts, runs are partitioned by ranges of
the values, and each range is merged in order: equal values are then neighbours, their counts are added up while they pass,
and a heap of the k best is all that is kept. Combining before the exchange leaves a hot value at most one row for each run.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.common import durable

#: Rows in a sorted run.
RUN_ROWS = 100_000


class _Late:
    """A string that is less where the other is greater, so that a min-heap drops the last of equals."""

    __slots__ = ("s",)

    def __init__(self, s: str):
        self.s = s

    def __lt__(self, other: _Late) -> bool:
        return self.s > other.s


def _combined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = pa.Table.from_batches(parts).group_by(["g", "v"], use_threads=False).aggregate([("c", "sum")]).rename_columns(["g", "v", "c"])
    yield from sums.sort_by([("g", "ascending"), ("v", "ascending")]).to_batches()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows >= RUN_ROWS:
            yield from _combined(held)
            held, rows = [], 0
    if rows:
        yield from _combined(held)


def most_frequent(rows: DataFrame, group: str, value: str, weight: str | None = None, k: int = 20) -> DataFrame:
    """(group, value, n, rank): for each group the k values with the greatest sum of weights (rows, without a weight); of equals the first in byte order.

    Rows without a group or a value don't count, a null weight counts as 0. A group of fewer values gives them all. Memory is one run, one batch and k items, whatever the number of values.
    """
    c = F.lit(1) if weight is None else F.coalesce(F.col(weight), F.lit(0))
    r = rows.select(F.col(group).cast("string").alias("g"), F.col(value).cast("string").alias("v"), c.cast("bigint").alias("c")).where(F.col("g").isNotNull() & F.col("v").isNotNull())

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heap: list[tuple[int, _Late]] = []
        now, open_value, open_count = None, None, 0

        def offer(v: str, n: int) -> None:
            if len(heap) < k:
                heapq.heappush(heap, (n, _Late(v)))
            elif (n, _Late(v)) > heap[0]:
                heapq.heapreplace(heap, (n, _Late(v)))

        def flush() -> pd.DataFrame:
            if open_value is not None:
                offer(open_value, open_count)
            out = pd.DataFrame([(now, x.s, n) for n, x in heap], columns=["g", "v", "c"])
            heap.clear()
            return out

        for b in batches:
            if not len(b):
                continue
            g, v, n = b["g"].to_numpy(), b["v"].to_numpy(), b["c"].to_numpy()
            new = np.ones(len(b), dtype=bool)
            new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
            at = np.flatnonzero(new)
            sums = np.add.reduceat(n, at)
            group_of, value_of = g[at], v[at]
            turns = np.append(np.flatnonzero(np.append(True, group_of[1:] != group_of[:-1])), len(at))
            for a, z in zip(turns[:-1], turns[1:]):  # the groups in this batch
                if group_of[a] != now:
                    if now is not None:
                        yield flush()
                    now, open_value, open_count = group_of[a], None, 0
                if value_of[a] == open_value:
                    sums[a] += open_count
                elif open_value is not None:
                    offer(open_value, open_count)
                done = sums[a : z - 1]  # the last value may go on in the next batch
                if len(heap) == k:
                    inside = np.flatnonzero(done >= heap[0][0])
                elif len(done) > k:
                    least = np.partition(done, len(done) - k)[len(done) - k]
                    inside = np.flatnonzero(done >= least)
                else:
                    inside = np.arange(len(done))
                for i in inside:
                    offer(value_of[a + i], int(done[i]))
                open_value, open_count = value_of[z - 1], int(sums[z - 1])
        if now is not None:
            yield flush()

    runs = durable(r.mapInArrow(_runs, "g string, v string, c bigint"))  # read once more, for the ranges' limits
    ranged = runs.repartitionByRange("g", "v").sortWithinPartitions("g", "v")
    best = ranged.mapInPandas(merge, "g string, v string, c bigint")
    order = W.partitionBy("g").orderBy(F.col("c").desc(), "v")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("g").alias(group), F.col("v").alias(value), F.col("c").alias("n"), "rank")
