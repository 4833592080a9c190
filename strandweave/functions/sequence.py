"""Column functions on sequences, qualities and edit distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset of quality characters.
PHRED = 33


def byte_sums(quals: pa.Array) -> pa.Array:
    """Sum of the bytes of each string of an Arrow array; null for null."""
    if len(quals) == 0:
        return pa.array([], pa.int64())
    wide = pa.types.is_large_string(quals.type)
    ends = np.frombuffer(quals.buffers()[1], dtype=np.int64 if wide else np.int32)[quals.offset : quals.offset + len(quals) + 1].astype(np.int64)
    data = quals.buffers()[2]
    running = np.zeros(int(ends[-1] - ends[0]) + 1, dtype=np.int64)
    if data is not None:
        np.cumsum(np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], dtype=np.int64, out=running[1:])
    at = ends - ends[0]
    return pa.array(running[at[1:]] - running[at[:-1]], pa.int64(), mask=quals.is_null().to_numpy(zero_copy_only=False))


def code_sum(qual: Column) -> Column:
    """Sum of the character codes of a quality string (ASCII): whole Arrow batches are added up, no string becomes an object. Null for null."""
    return F.arrow_udf(byte_sums, "bigint")(qual)


def phred_sum(qual: Column) -> Column:
    """Sum of the Phred scores of a quality string."""
    return code_sum(qual) - F.length(qual) * PHRED


def quality_ok(qual: Column, least_base: float = 5, least_mean: float = 20) -> Column:
    """Whether no base is below `least_base` and the mean is not below `least_mean`; false for empty and null qualities.

    The least base is a character class that generated code can match; only qualities that pass it are sent to be summed.
    """
    import math

    low = max(0, math.ceil(least_base) - 1)  # the greatest score that fails
    base = F.lit(True) if least_base <= 0 else ~qual.rlike(f"[\\x21-\\x{PHRED + low:02x}]")
    base = F.coalesce((F.length(qual) > 0) & base, F.lit(False))
    return base if least_mean <= 0 else base & (code_sum(F.when(base, qual)) - F.length(qual) * PHRED >= F.lit(float(least_mean)) * F.length(qual))


def mean_quality_code(qual: Column) -> Column:
    """Mean of the quality's character codes, rounded half to even, as INT; null for empty and null."""
    return F.when(F.length(qual) > 0, F.bround(code_sum(qual) / F.length(qual)).cast("int"))


def constant_quality(code: Column, seq: Column) -> Column:
    """A quality string of one character for every base of `seq`."""
    return F.repeat(F.chr(code), F.length(seq))


def transposed(a: Column, b: Column) -> Column:
    """Whether exchanging one pair of neighbours turns `a` into `b`."""
    swap = lambda i: F.concat(b.substr(F.lit(1), i - 1), b.substr(i + 1, F.lit(1)), b.substr(i, F.lit(1)), b.substr(i + 2, F.length(b)))
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 1), F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: a == swap(i))).otherwise(False)


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (a transposition costs 1), or -1 beyond `most`."""
    if abs(len(a) - len(b)) > most:
        return -1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        if min(now) > most and (i == 1 or min(row) > most):
            return -1
        before, row = row, now
    return row[-1] if row[-1] <= most else -1


def edit_distance(a: Column, b: Column, most: int, metric: str = "osa") -> Column:
    """Distance of two strings, -1 beyond `most`. metric: `levenshtein`, or `osa`, where exchanging two neighbours counts 1."""
    if metric == "levenshtein" or most < 1:
        return F.levenshtein(a, b, most)
    if metric != "osa":
        raise ValueError(f"unknown metric {metric}")
    if most == 1:
        plain = F.levenshtein(a, b, 1)
        return F.when(plain >= 0, plain).when(transposed(a, b), 1).otherwise(-1)

    # Generated code decides all pairs but those near enough that exchanges of neighbours may count: only these go to Python.
    plain = F.levenshtein(a, b, 2 * most)

    @F.pandas_udf("int")
    def distance(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in pairs:
            yield pd.Series([-1 if p is None or q is None else osa(p, q, most) for p, q in zip(x, y)], dtype="int32")

    return F.when(plain < 2, plain).when(plain.isNotNull(), distance(F.when(plain >= 2, a), F.when(plain >= 2, b)))


def deletions(s: Column, most: int) -> Column:
    """All distinct strings that deleting at most `most` characters leaves, with `s` itself."""
    out = F.array(s)
    for _ in range(most):
        one = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(t.substr(F.lit(1), i - 1), t.substr(i + 1, F.length(t))))).otherwise(F.array(t))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, one))))
    return out
