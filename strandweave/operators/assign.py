"""Destination sequences for ids: references from allowlists or IUPAC patterns, and the decoding of ids into them."""

from __future__ import annotations

import random
from array import array
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The IUPAC codes of bases.
IUPAC = {"A": "A", "T": "T", "G": "G", "C": "C", "R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ATGC"}
#: Words of a generated reference, and combinations of references, unless more ids are needed.
WORDS, COMBINATIONS = 7_000_000, 200_000


def alphabets(pattern: str, shuffled: bool = False) -> list[str]:
    """The letters of each place of an IUPAC pattern; shuffled by a generator seeded with the place."""
    out = []
    for i, code in enumerate(pattern.upper()):
        if code not in IUPAC:
            raise ValueError(f"{code} is no IUPAC code of bases")
        letters = IUPAC[code]
        if shuffled:
            rng = random.Random(i)
            letters = "".join(rng.sample(list(letters), len(letters)))
        out.append(letters)
    return out


def pattern_size(pattern: str) -> int:
    n = 1
    for letters in alphabets(pattern):
        n *= len(letters)
    return n


def word(index: Column, letters: Sequence[str]) -> Column:
    """The word of an index in mixed radix, the last place fastest; null outside the pattern's space. No words are materialised."""
    total, parts = 1, []
    for a in reversed(letters):
        parts.insert(0, F.substring(F.lit(a), (F.floor(index / F.lit(total)) % len(a) + 1).cast("int"), F.lit(1)) if len(a) > 1 else F.lit(a))
        total *= len(a)
    return F.when((index >= 0) & (index < F.lit(total)), F.concat(*parts))


def random_order(spark: SparkSession, n: int, seed: int = 0, wanted: int | None = None) -> DataFrame:
    """(id, index): the first `wanted` of a permutation of 0..n-1 by Python's seeded shuffle. It is made on the driver because only that generator gives it, in compact arrays of 8 bytes a number; n is
    bounded by the caller's cap, and only what is wanted becomes a table."""
    order = array("q", range(n))
    random.Random(seed).shuffle(order)
    import numpy as np
    import pandas as pd

    kept = np.frombuffer(order, dtype="int64")[:wanted] if n else np.zeros(0, dtype="int64")
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(kept), dtype="int64"), "index": kept.copy()}), "id bigint, index bigint")


def pattern_reference(spark: SparkSession, pattern: str, size: int, mode: str = "random", cap: int = WORDS, wanted: int | None = None) -> DataFrame:
    """(id, seq): sequences of an IUPAC pattern for ids from 0 (below `wanted`, if it is given). ordered: in the order of their letters; random: each place's letters and then the words shuffled with
    fixed seeds."""
    n = min(pattern_size(pattern), max(size, cap if mode == "random" else size))
    letters = alphabets(pattern, mode == "random")
    ids = random_order(spark, n, wanted=wanted) if mode == "random" else spark.range(n if wanted is None else min(n, wanted)).select("id", F.col("id").alias("index"))
    return ids.select("id", word(F.col("index"), letters).alias("seq"))


def list_reference(spark: SparkSession, sequences: Sequence[str], mode: str = "random") -> DataFrame:
    """(id, seq) of an allowlist, shuffled with a fixed seed unless ordered; repeated lines count once."""
    rows = list(dict.fromkeys(s for s in sequences if s))
    if mode == "random":
        random.Random(0).shuffle(rows)
    return spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "id bigint, seq string")


def combine_ids(index: Column, sizes: Sequence[int], cap: int | None = None) -> list[Column]:
    """One id for each reference, from an id of their product (the last fastest); null beyond the product or the cap. The product is never made."""
    total = 1
    for n in sizes:
        total *= n
    limit = total if cap is None else min(total, cap)
    out, rest = [], 1
    for n in reversed(sizes):
        out.insert(0, F.when((index >= 0) & (index < F.lit(limit)), (F.floor(index / F.lit(rest)) % n).cast("bigint")))
        rest *= n
    return out


def assign_sequences(rows: DataFrame, id_column: str, references: Sequence[tuple[str, DataFrame | Sequence[str], int]], cap: int | None = None) -> DataFrame:
    """`rows` with a sequence column for each (name, reference, its size) of an id. A reference is a table (id, seq), or the letters of each place, whose words are computed without a
    join. Ids without a sequence give null, and the read is dropped by the complete-case filter."""
    from .common import broadcast_if_small

    ids = combine_ids(F.col(id_column), [n for _, _, n in references], cap)
    for (name, reference, _), i in zip(references, ids):
        if isinstance(reference, DataFrame):
            rows = rows.withColumn("_id", i).join(broadcast_if_small(reference.select(F.col("id").alias("_rid"), F.col("seq").alias(name))), F.col("_id") == F.col("_rid"), "left").drop("_id", "_rid")
        else:
            rows = rows.withColumn(name, word(i, reference))
    return rows


def overflow(rows: DataFrame, id_column: str, capacity: int) -> DataFrame:
    """(rows, beyond): rows with an id, and those whose id has no sequence; they would leave silently."""
    return rows.where(F.col(id_column).isNotNull()).agg(F.count("*").alias("rows"), F.coalesce(F.sum((F.col(id_column) >= capacity).cast("bigint")), F.lit(0)).alias("beyond"))
