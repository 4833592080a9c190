"""Demultiplexing by key, and annotation of headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tree import complete

#: Mark of a missing value in tables that leave the engine.
MISSING = "-"


def normal_header(header: Column) -> Column:
    """The header up to its first blank, bar or tab."""
    return F.split(header, "[ |\t]+")[0]


def key_column(keys: Sequence[str]) -> Column:
    """The key segments joined by `_`; null if any is missing."""
    return F.when(complete(keys), F.concat_ws("_", *keys))


def tagged_header(header: Column, tags: Sequence[str]) -> Column:
    """The header followed by segments, joined by `_`; null if any is missing."""
    return F.when(complete(tags), F.concat_ws("_", header, *tags)) if tags else header


def demux_table(rows: DataFrame, keys: Sequence[str], targets: Sequence[str], header: str = "header", into: str = "key", sample: str | None = None) -> DataFrame:
    """(sample, key, header, targets...): rows whose key is complete; other missing values are written as `-`. Without `sample` there is none."""
    own = [F.col(sample)] if sample else []
    return rows.select(*own, key_column(keys).alias(into), F.col(header), *[F.coalesce(F.col(t), F.lit(MISSING)).alias(t) for t in targets]).where(F.col(into).isNotNull())


def annotate(rows: DataFrame, tags: Sequence[str], needed: Sequence[str], header: str = "header") -> DataFrame:
    """Complete rows with their header annotated."""
    return rows.where(complete([*needed, *tags])).withColumn(header, tagged_header(F.col(header), tags))


def demux_counts(rows: DataFrame, keys: Sequence[str], into: str = "key", sample: str | None = None) -> DataFrame:
    """(sample, key, n) of complete keys, within each sample. Without `sample` there is none."""
    own = [sample] if sample else []
    return rows.select(*own, key_column(keys).alias(into)).where(F.col(into).isNotNull()).groupBy(*own, into).agg(F.count("*").alias("n"))
