"""Reads as a stream: the operators that look at one read at a time run on streaming DataFrames unchanged; counts that need all reads are kept per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import quality_ok
from ..operators.correct import apply_map
from ..operators.demux import key_column
from ..operators.segment import extract_segments


def stream_segments(reads: DataFrame, patterns: list[str], least_base: float = 5, least_mean: float = 20) -> DataFrame:
    """The stream with its segments as columns, null where missing or of low quality."""
    before = set(reads.columns)
    rows = extract_segments(reads, patterns)
    made = [c for c in rows.columns if c not in before]
    return rows.withColumns({c: F.when(quality_ok(F.col(c)["qual"], least_base, least_mean), F.col(c)["seq"]) for c in made})


def stream_corrected(segments: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """The stream with clean_<segment> by static correction maps of an earlier batch run."""
    for name, mapping in maps.items():
        segments = apply_map(segments, name, mapping, f"clean_{name}")
    return segments


def stream_keyed(rows: DataFrame, keys: list[str], into: str = "key") -> DataFrame:
    """The rows with a complete key."""
    return rows.withColumn(into, key_column(keys)).where(F.col(into).isNotNull())


def counting_batches(path: str, name: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes the counts of a column, one folder a batch; a batch that runs again replaces its own, so counts stay exact. Sum them by `stream_counts`."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.groupBy(name).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write


def stream_counts(spark, path: str, name: str) -> DataFrame:
    """(name, n) over all batches written so far."""
    return spark.read.parquet(path).groupBy(name).agg(F.sum("n").alias("n"))
