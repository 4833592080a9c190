"""Reports on plates: dominant values of wells, and positions of 96-well plates on 384-well plates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Places of four 96-well plates on one 384-well plate, as (row, column) of the well within its square of four.
QUADRANTS = {"TL": (0, 0), "TR": (0, 1), "BL": (1, 0), "BR": (1, 1)}


def dominance(rows: DataFrame, well: Sequence[str], value: str, threshold: float = 0.7, expected: str | None = None) -> DataFrame:
    """well..., total, top, top_count, ratio, passed: the most frequent value of each well (of equals the first by name), and whether its share is above the threshold and, if one is
    `expected`, it is that value. Null values don't count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*well, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    best = counts.groupBy(*well).agg(F.sum("c").alias("total"), F.min(F.struct((-F.col("c")).alias("m"), F.col("v"))).alias("b"))
    got = best.select(*well, "total", F.col("b.v").alias("top"), (-F.col("b.m")).alias("top_count"))
    return got.withColumn("ratio", F.col("top_count") / F.col("total")).withColumn("passed", (F.col("ratio") > threshold) & (F.lit(True) if expected is None else F.col("top") == expected))


def well_384(row: Column, column: Column, quadrant: Column) -> tuple[Column, Column, Column]:
    """(row letter, column, name) on the 384-well plate of a 96-well plate's well (row and column from 1) in a quadrant; null for an unknown quadrant."""
    r = c = None
    for name, (dr, dc) in QUADRANTS.items():
        r = F.when(quadrant == name, row * 2 - 1 + dr) if r is None else r.when(quadrant == name, row * 2 - 1 + dr)
        c = F.when(quadrant == name, column * 2 - 1 + dc) if c is None else c.when(quadrant == name, column * 2 - 1 + dc)
    letter = F.chr(r + 64)
    return letter, c, F.concat(letter, F.lpad(c.cast("string"), 2, "0"))


def correspondence(first: DataFrame, second: DataFrame, well: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """well..., each column of both profiles as <c>_1 and <c>_2, and verdict: same, different, or missing where a side has none."""
    a = first.select(*well, *[F.col(c).alias(f"{c}_1") for c in columns])
    b = second.select(*well, *[F.col(c).alias(f"{c}_2") for c in columns])
    same, there = F.lit(True), F.lit(True)
    for c in columns:
        same = same & (F.col(f"{c}_1") == F.col(f"{c}_2"))
        there = there & F.col(f"{c}_1").isNotNull() & F.col(f"{c}_2").isNotNull()
    return a.join(b, list(well), "full").withColumn("verdict", F.when(~there, "missing").when(same, "same").otherwise("different"))


def index_from_header(header: Column) -> tuple[Column, Column]:
    """Sequence and quality of an index read kept in the header: the second word up to its first colon, all bases with Phred 30; null without one."""
    second = F.split(header, " ")
    seq = F.when(F.size(second) > 1, F.regexp_replace(F.get(second, F.lit(1)), ":.*$", ""))
    seq = F.when(seq != "", seq)
    return seq, F.repeat(F.lit("?"), F.length(seq))


def sorted_correspondence(ids: DataFrame, table: DataFrame, source: str, value: str = "value") -> DataFrame:
    """The conversion table's rows whose source has an id, with that id (reindex), in order of it: allowlists sorted so that ids point into them."""
    return table.join(ids.select(F.col(value).alias(source), F.col("id").alias("reindex")), source).orderBy("reindex")
