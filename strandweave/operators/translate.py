"""Translation to destination sequences by table, and assembly of reads from components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import constant_quality
from .common import broadcast_if_small
from .tree import complete

#: Quality character of constants (Phred 40).
CONSTANT_QUALITY = "I"


def seq2seq(rows: DataFrame, table: DataFrame, sources: dict[str, str], dests: dict[str, str], strict: bool = False) -> DataFrame:
    """`rows` with columns of a conversion table: sources maps the table's source columns to columns of `rows`, dests its destination columns to new ones.

    A row with a null source, or with no entry, gets null (and with `strict` an unknown combination raises when the plan runs). Of repeated entries the first destination by
    name holds.
    """
    keys = list(sources)
    t = table.where(complete(keys)).groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min(F.struct(*[F.col(d).alias(f"_d_{d}") for d in dests])).alias("_to"))
    on = None
    for k, column in sources.items():
        c = F.col(column) == F.col(f"_k_{k}")
        on = c if on is None else on & c
    got = rows.join(broadcast_if_small(t), on, "left")
    if strict:
        known = F.col("_to").isNotNull() | ~complete(list(sources.values()))
        got = got.withColumn("_to", F.when(known, F.col("_to")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no entry for"), *[F.col(c) for c in sources.values()]))))
    return got.withColumns({new: F.col("_to")[f"_d_{d}"] for d, new in dests.items()}).drop("_to", *[f"_k_{k}" for k in keys])


def constant(seq: str) -> tuple[Column, Column]:
    """Sequence and quality of a constant."""
    return F.lit(seq), F.lit(CONSTANT_QUALITY * len(seq))


def passed(clean: Column, raw_qual: Column, code: Column | None = None, length: int | None = None, filler: str = "N") -> tuple[Column, Column]:
    """Sequence and quality of a segment that is passed on: the quality slice of the read, or, where an indel was corrected and lengths differ, its mean (or `code`) repeated. With `length` both are padded."""
    from ..functions.sequence import mean_quality_code

    qual = F.when(F.length(raw_qual) == F.length(clean), raw_qual).otherwise(constant_quality(mean_quality_code(raw_qual) if code is None else code, clean))
    if length is not None:
        clean, qual = F.rpad(clean, length, filler), F.rpad(qual, length, CONSTANT_QUALITY)
    return clean, qual


def mean_code(codes: Sequence[Column]) -> Column:
    """Mean of quality codes, rounded half to even, as INT; null if any is null."""
    return F.bround(sum(codes[1:], codes[0]) / len(codes)).cast("int")


def synthesized(seq: Column, code: Column) -> tuple[Column, Column]:
    """A sequence with one quality throughout."""
    return seq, constant_quality(code, seq)


def assembled(parts: Sequence[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Sequence and quality of a read from its components in order; null if any component is null, so that the complete-case filter drops the read."""
    return F.concat(*[s for s, _ in parts]), F.concat(*[q for _, q in parts])


def complete_cases(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows with none of the columns null: a read survives in all its mates or in none."""
    return rows.where(complete(columns))
