"""Value trees: counts of values in their hierarchy, and dense ids by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import broadcast_if_small, durable, place_within

#: Values below one path that a task can sort by the way.
LARGE = 1_000_000


def complete(columns: Sequence[str]) -> Column:
    """Whether none of the columns is null."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return ok


def tree_counts(values: DataFrame, value: Sequence[str], parents: Sequence[str] = (), sample: str | None = None, weight: str | None = None) -> DataFrame:
    """Counts of a (combined) value under its path of ancestors, within a sample: columns of all of them, and n. Rows with a null in any of them don't count. `weight`: a column of counts, if the rows are
    already combined."""
    keys = [*([sample] if sample else []), *parents, *value]
    return values.where(complete(keys)).groupBy(*keys).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))


def value_ids(counts: DataFrame, value: Sequence[str], parents: Sequence[str] = (), sample: str | None = None, per_sample: bool = False) -> DataFrame:
    """`counts` with id: from 0 by descending count, of equals by value (then by sample), for each path of ancestors.

    Without parents the ids run over all samples together, unless `per_sample`: then equal values of two samples have ids of their own. Global ids, and those below a path with more than LARGE values,
    come from range partitions, so that no task gets all of them; those of other paths from a window over the path.
    """
    keys = [*([sample] if sample and (parents or per_sample) else []), *parents]
    order = [F.desc("n"), *[F.col(t) for t in [*value, *([sample] if sample and sample not in keys else [])]]]
    if not keys:
        return place_within(counts, keys, order, "id")
    counts = durable(counts)
    large = durable(counts.groupBy(*keys).agg(F.count("*").alias("_values")).where(F.col("_values") > LARGE).select(*keys))
    number = lambda rows: rows.withColumn("id", (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))
    if large.isEmpty():
        return number(counts)
    large = broadcast_if_small(large)
    return number(counts.join(large, keys, "left_anti")).unionByName(place_within(counts.join(large, keys, "left_semi"), keys, order, "id"))


def size_info(ids: DataFrame, parents: Sequence[str] = (), sample: str | None = None) -> DataFrame:
    """(sample,) size: how many ids an assignment must provide: all of them for a global value, the most children of one parent for a local one."""
    if not parents:
        return ids.agg(F.count("*").alias("size"))
    per = ids.groupBy(*([sample] if sample else []), *parents).agg(F.count("*").alias("c"))
    return (per.groupBy(sample) if sample else per).agg(F.max("c").alias("size"))


def attach_ids(values: DataFrame, ids: DataFrame, value: Sequence[str], parents: Sequence[str], sample: str | None, name: str) -> DataFrame:
    """`values` with the id of each row's value under its path, null where the path or value is not in the tree."""
    keys = [*([sample] if sample else []), *parents, *value]
    return values.join(broadcast_if_small(ids.select(*keys, F.col("id").alias(name))), keys, "left")


def classify(edges: Sequence[tuple[tuple[str, ...], tuple[str, ...]]], values: Sequence[tuple[str, ...]]) -> tuple[list[tuple[str, ...]], list[tuple[str, ...]], dict[tuple[str, ...], tuple[str, ...]]]:
    """(roots, globals, parent of each child) of (children, parents) edges and the values in use; a group is a tuple of names in sorted order."""
    parent = {c: p for c, p in edges}
    children, parents = set(parent), set(parent.values())
    roots = sorted(parents - children)
    return roots, sorted(set(values) - children - set(roots)), parent


def ancestors(group: tuple[str, ...], parent: dict[tuple[str, ...], tuple[str, ...]]) -> list[str]:
    """The names on the path from the root down to above a group."""
    path: list[tuple[str, ...]] = []
    while group in parent:
        group = parent[group]
        if group in path:
            raise ValueError(f"{group} is its own ancestor")
        path.insert(0, group)
    return [n for g in path for n in g]
