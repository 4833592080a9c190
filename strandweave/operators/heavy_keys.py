"""Per-key results when a few keys hold most rows.

Heavy keys are found by a sketch over all rows, kept as a bounded table and marked by a broadcast join. Rows of heavy keys are counted by
(key, value), which spreads each of them over all tasks with a partial count before the shuffle; the other keys take the
ordinary shuffle on the key alone. The union of both is the result. The sketch only chooses the way a row takes, never the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys treated as heavy: the size of the broadcast table.
MOST_HEAVY = 256
#: Items that the sketch follows; its memory, whatever the number of keys.
SKETCH_ITEMS = 8192


def heavy_keys(rows: DataFrame, key: str, share: float = 0.002) -> DataFrame:
    """(heavy): keys with at least `share` of the rows by a frequent-items sketch; at most MOST_HEAVY rows. Null is no key."""
    top = rows.agg(F.expr(f"approx_top_k({key}, {MOST_HEAVY}, {SKETCH_ITEMS})").alias("top"), F.count(key).alias("n"))
    return top.select(F.explode("top").alias("t"), "n").where(F.col("t.count") >= F.greatest(F.col("n") * share, F.lit(1000))).select(F.col("t.item").alias("heavy"))


def most_frequent_value(rows: DataFrame, key: str, value: str, sketch_over: DataFrame | None = None, share: float = 0.002) -> DataFrame:
    """(key, value, n): for each key its most frequent value and that count; of equals the first in byte order.

    Rows with a null key or value don't count. `sketch_over`: rows to sketch instead of `rows` (the same ones before an expensive step). No task gets
    all rows of a heavy key: they are spread by value, and a value's rows are combined before they are sent.
    """
    r = rows.select(F.col(key).alias("k"), F.col(value).alias("v")).where(F.col("k").isNotNull() & F.col("v").isNotNull())
    seen = (sketch_over if sketch_over is not None else rows).select(F.col(key).alias("k")).where(F.col("k").isNotNull())
    marked = r.join(F.broadcast(heavy_keys(seen, "k", share).limit(MOST_HEAVY)), F.col("k") == F.col("heavy"), "left")
    best = lambda counted: counted.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("v"))).alias("b"))
    heavy = best(marked.where("heavy is not null").groupBy("k", "v").agg(F.count("*").alias("n")))
    light = best(marked.where("heavy is null").repartition("k").groupBy("k", "v").agg(F.count("*").alias("n")))
    return heavy.unionByName(light).select(F.col("k").alias(key), F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))
