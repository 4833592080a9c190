"""Counts of distinct sequences, their rank curve and its knee."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import place_within


def segment_counts(segments: DataFrame, names: list[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., segment, seq, n): rows with each sequence of each named column, missing ones (null) included; one pass over the rows for all columns and groups."""
    long = segments.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("segment"), F.col(n).alias("seq")) for n in names])).alias("_s")).select(*by, "_s.*")
    return long.groupBy(*by, "segment", "seq").agg(F.count("*").alias("n"))


def rank_counts(counts: DataFrame, seq: str = "seq", n: str = "n", least: int = 1, by: Sequence[str] = (), stored: bool = False) -> DataFrame:
    """(by..., seq, n, rank, log_rank): present sequences of each group by descending count (of equals by name), from `least` on. A missing one keeps its place in the ranks; a null group is one like any other.

    The rows are numbered in range partitions over all groups: no count and no group, however frequent, meets in one task. `stored`: the counts are cheap to read again.
    """
    c = counts.select(*by, F.col(seq).alias("s"), F.col(n).alias("n"))
    placed = place_within(c, by, [F.desc("n"), F.col("s").asc_nulls_last()], "place", stored)
    r = placed.withColumn("rank", F.col("place") + 1).where(F.col("s").isNotNull() & (F.col("n") >= least))
    return r.select(*by, F.col("s").alias(seq), F.col("n").alias(n), "rank", F.log10("rank").alias("log_rank"))


def knee(levels: list[tuple[int, int]], sensitivity: float = 10.0) -> int | None:
    """The knee's rank of a curve given as (count, number of sequences with it); ranks from 1, counts descending. None without a knee.

    The curve is convex and falls. Both axes are scaled to 0..1 and the counts turned over; the difference of the curve and the diagonal rises to a maximum where the
    fall slows down. The knee is the first maximum after which the difference drops by `sensitivity` mean steps of the rank axis before a minimum resets the threshold to 0. As
    counts are constant within a level, where the difference falls, it suffices to look at each level's first and last rank. The first rank, which nothing precedes, is no maximum.
    All is computed in whole numbers (the difference times both extents), so that equal heights are equal.
    """
    levels = sorted(((c, m) for c, m in levels if m > 0), reverse=True)
    total = sum(m for _, m in levels)
    if total < 3 or len(levels) < 2:
        return None
    high, fall = levels[0][0], levels[0][0] - levels[-1][0]
    spans, at = [], 0
    for c, m in levels:
        spans.append((at, at + m - 1, (high - c) * (total - 1)))
        at += m
    drop = Fraction(sensitivity) * fall
    threshold = candidate = None
    for k, (a, z, h) in enumerate(spans):
        top, bottom = h - a * fall, h - z * fall
        before = spans[k - 1][2] - (a - 1) * fall if k else None
        following = spans[k + 1][2] - (z + 1) * fall if k + 1 < len(spans) else None
        if before is not None and top >= before and (z > a or following is None or top >= following):
            threshold, candidate = top - drop, a
        if z > a and candidate is not None and bottom < threshold:
            return candidate + 1
        if candidate is not None and (following is None or bottom <= following) and (z > a or before is None or bottom <= before):
            threshold = 0
        if candidate is not None and following is not None and following < threshold:
            return candidate + 1
    return None


def knee_ranks(counts: DataFrame, n: str = "n", sensitivity: float = 10.0, by: Sequence[str] = ()) -> DataFrame:
    """(by..., at): the `knee` of each group of a table of counts, null without one. A group's part is one row for each distinct count, at most about the root of twice the rows counted."""
    levels = counts.groupBy(*by, F.col(n).alias("_n")).agg(F.count("*").alias("_m"))

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        at = knee(list(zip(rows["_n"].tolist(), rows["_m"].tolist())), sensitivity)
        return rows[list(by)].head(1).assign(at=pd.array([at], dtype="Int64"))

    kinds = dict(levels.dtypes)
    return levels.groupBy(*by).applyInPandas(find, ", ".join([*[f"`{k}` {kinds[k]}" for k in by], "at bigint"]))
