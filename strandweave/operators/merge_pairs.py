"""Merging of read pairs that overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPLEMENT = str.maketrans("ACGTNacgtn", "TGCANtgcan")


def reverse_complement(seq: str) -> str:
    return seq.translate(_COMPLEMENT)[::-1]


def merge_pair(s1: str, q1: str, s2: str, q2: str, least: int = 20, most: int = 30, density: float = 0.25) -> tuple[str, str] | None:
    """The merged read, or None if no overlap is good enough.

    The second read is turned round. Of the overlaps of at least `least` bases the one with the lowest share of mismatches is taken (of equals that with the lower quality at
    its mismatches, then the longest); shares are taken over at most `most` bases, so that longer overlaps are not preferred. A base called N is no mismatch. Where both reads agree
    the better quality is kept; where not, the better base with the difference of the qualities, at least 2.
    """
    t, r = reverse_complement(s2), q2[::-1]
    a, b = np.frombuffer(s1.encode(), np.uint8), np.frombuffer(t.encode(), np.uint8)
    qa, qb = np.frombuffer(q1.encode(), np.uint8).astype(int), np.frombuffer(r.encode(), np.uint8).astype(int)
    best = None
    for n in range(min(len(a), len(b)), least - 1, -1):
        x, y = a[len(a) - n :], b[:n]
        called = (x != 78) & (y != 78)
        length = int(called.sum())
        if length < least:
            continue
        wrong = called & (x != y)
        share = wrong.sum() / min(length, most)
        worst = np.minimum(qa[len(a) - n :], qb[:n])[wrong].sum() / min(length, most)
        if share <= density and (best is None or (share, worst) < best[:2]):
            best = (share, worst, n)
    if best is None:
        return None
    n = best[2]
    x, y, u, v = a[len(a) - n :], b[:n], qa[len(a) - n :], qb[:n]
    first = (u >= v) & (x != 78) | (y == 78)
    seq = np.where(first, x, y).astype(np.uint8)
    qual = np.where((x == y) | (x == 78) | (y == 78), np.maximum(u, v), np.maximum(np.abs(u - v), 2) + 33).astype(np.uint8)
    return s1[: len(a) - n] + seq.tobytes().decode() + t[n:], q1[: len(a) - n] + qual.tobytes().decode() + r[n:]


def merged(s1: Column, q1: Column, s2: Column, q2: Column, least: int = 20, most: int = 30, density: float = 0.25) -> Column:
    """struct<seq, qual> of the merged pair; null if it can't be merged or a read is null."""

    @F.pandas_udf("struct<seq: string, qual: string>")
    def merge(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [merge_pair(*r, least, most, density) if all(x is not None for x in r) else None for r in zip(*rows)]
            yield pd.DataFrame({"seq": [m and m[0] for m in out], "qual": [m and m[1] for m in out]})

    return merge(s1, q1, s2, q2)


def merge_reads(pairs: DataFrame, first: str, second: str, least: int = 20, most: int = 30, density: float = 0.25) -> DataFrame:
    """`pairs` (columns <read>_seq, <read>_qual) with merged_seq, merged_qual and is_merged; the reads of a merged pair become null, those of others stay."""
    names = [f"{r}_{c}" for r in (first, second) for c in ("seq", "qual")]
    m = pairs.withColumn("_m", merged(*[F.col(n) for n in names], least, most, density))
    done = F.col("_m")["seq"].isNotNull()
    m = m.withColumns({"merged_seq": F.col("_m")["seq"], "merged_qual": F.col("_m")["qual"], "is_merged": done})
    return m.withColumns({n: F.when(~F.col("is_merged"), F.col(n)) for n in names}).drop("_m")
