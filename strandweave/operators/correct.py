"""Error correction of distinct sequences: similarity joins, majority and allowlist maps, and their application.

All maps take `by`: columns of groups (samples) that are corrected apart. They are keys of every step, so that any number of groups is corrected in one pass. A null group is none. Maps are
written once (`durable`), as every use of one is a join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import deletions, edit_distance
from .common import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, durable, widths
from .counts import knee_ranks, rank_counts


class DistanceError(ValueError):
    """The distance of a correction is so great that the shortest terms are like anything."""


def similar(left: DataFrame, right: DataFrame, distance: int = 1, metric: str = "osa", by: Sequence[str] = ()) -> DataFrame:
    """(by..., l, r, d): pairs of distinct strings of `left` (column l) and `right` (column r) of one group at most `distance` apart. A `right` without the group's columns is the same for all groups.

    Strings meet in what deleting up to `distance` characters leaves of them: an equi-join with candidates only, which are then verified. A small dictionary's remainders are broadcast.
    """
    on = [k for k in by if k in right.columns]
    lefts, rights = left.select(*by, "l").where("l is not null").distinct(), right.select(*on, "r").where("r is not null").distinct()
    a = lefts.withColumn("v", F.explode(deletions(F.col("l"), distance)))
    b = rights.withColumn("v", F.explode(deletions(F.col("r"), distance)))
    pairs = a.join(broadcast_if_small(b), [*on, "v"]).select(*by, "l", "r").distinct()
    return pairs.withColumn("d", edit_distance(F.col("l"), F.col("r"), distance, metric)).where("d >= 0")


def nearest(raws: DataFrame, dictionary: DataFrame, distance: int = 1, metric: str = "osa", by: Sequence[str] = ()) -> DataFrame:
    """(by..., raw, clean, d): each string of `raws` (column raw) with the closest of `dictionary` (columns term, weight); of equally close ones the greatest weight, then the first
    by name. Strings without one don't come out. A dictionary without the group's columns is the same for all groups. If a string has to be corrected, the distance must be below half of the
    shortest term's length (rounded down), else DistanceError is raised."""
    on = [k for k in by if k in dictionary.columns]
    d = dictionary.groupBy(*on, "term").agg(F.max("weight").alias("weight"))
    seen = d.agg(F.count("*").alias("rows"), F.sum(widths(d)).alias("bytes"), F.min(F.length("term")).alias("shortest")).first()  # one row
    small = F.broadcast if seen.rows <= BROADCAST_ROWS and (seen.bytes or 0) <= BROADCAST_BYTES else lambda side: side
    terms = d.select(*on, F.col("term").alias("raw"), F.lit(True).alias("known"))
    exact = raws.select(*by, "raw").distinct().join(small(terms), [*on, "raw"], "left")
    hit = exact.where("known").select(*by, "raw", F.col("raw").alias("clean"), F.lit(0).alias("d"))
    rest = exact.where("known is null").select(*by, F.col("raw").alias("l"))
    if seen.shortest is not None and seen.shortest // 2 <= distance > 0 and not rest.isEmpty():
        raise DistanceError(f"a distance of {distance} is not below half of the shortest term, {seen.shortest} long")
    weighed = d.select(*on, F.col("term").alias("r"), "weight")
    close = similar(rest, weighed, distance, metric, by).join(small(weighed), [*on, "r"])
    best = close.groupBy(*by, "l").agg(F.min(F.struct("d", (-F.col("weight")).alias("w"), "r")).alias("b"))
    return hit.unionByName(best.select(*by, F.col("l").alias("raw"), F.col("b.r").alias("clean"), F.col("b.d").alias("d")))


def _terms(allowlist: DataFrame) -> DataFrame:
    return allowlist.select(F.col("seq").alias("term"), F.lit(0).cast("bigint").alias("weight")).where("term is not null")


def _kept(counts: DataFrame, least: int, by: Sequence[str]) -> DataFrame:
    return counts.where(F.col("seq").isNotNull() & (F.col("n") >= least)).select(*by, F.col("seq").alias("raw"))


def allowlist_map(counts: DataFrame, allowlist: DataFrame, distance: int = 1, metric: str = "osa", least: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """(by..., raw, clean): M2A, mapping to an allowlist (column seq). Sequences below `least` reads or too far from all are not in the map. `counts`: seq, n; null is no sequence."""
    kept = durable(_kept(counts, least, by))  # used by several jobs
    return durable(nearest(kept, durable(_terms(allowlist)), distance, metric, by).select(*by, "raw", "clean"))


def majority(counts: DataFrame, rank: int | str = "auto", least: int = 1, sensitivity: float = 10.0, by: Sequence[str] = (), stored: bool = False) -> DataFrame:
    """(by..., seq, n, rank) of the majority: the first `rank` sequences of a group by count (a missing one is no sequence and has no rank here), or those before the knee, where a missing
    one keeps its place. Without a knee all are. `stored`: the counts are cheap to read again."""
    if rank != "auto":
        return rank_counts(counts.where("seq is not null"), least=least, by=by, stored=stored).where(F.col("rank") <= int(rank)).drop("log_rank")
    ranked = rank_counts(counts, least=least, by=by, stored=stored).drop("log_rank")
    at = durable(knee_ranks(counts.where(F.col("seq").isNotNull() & (F.col("n") >= least)), sensitivity=sensitivity, by=by))  # one row a group
    joined = ranked.join(broadcast_if_small(at), list(by), "left") if by else ranked.join(F.broadcast(at), how="left")
    return joined.where(F.col("at").isNull() | (F.col("rank") < F.col("at"))).drop("at")


def majority_map(counts: DataFrame, rank: int | str = "auto", distance: int = 1, metric: str = "osa", least: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """(by..., raw, clean): I2M, imputation to the majority. A majority sequence stays itself, another goes to the closest of the majority (of equals the one with more reads), or is not in the map."""
    counts = durable(counts.select(*by, "seq", "n"))  # used by several jobs
    top = durable(majority(counts, rank, least, by=by, stored=True).select(*by, F.col("seq").alias("term"), F.col("n").alias("weight")))
    return durable(nearest(_kept(counts, least, by), top, distance, metric, by).select(*by, "raw", "clean"))


def chained_map(first: DataFrame, second: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., raw, clean): `second` after `first`."""
    return first.withColumnRenamed("clean", "mid").join(second.select(*by, F.col("raw").alias("mid"), "clean"), [*by, "mid"]).select(*by, "raw", "clean")


def majority_allowlist_map(counts: DataFrame, allowlist: DataFrame, rank: int | str = "auto", distance: int = 1, allow_distance: int = 1, metric: str = "osa", least: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """(by..., raw, clean): I2M, then M2A of the majority; a minority sequence follows its majority sequence."""
    to_major = majority_map(counts, rank, distance, metric, least, by)
    major = durable(to_major.select(*by, F.col("clean").alias("raw")).distinct())
    return durable(chained_map(to_major, nearest(major, durable(_terms(allowlist)), allow_distance, metric, by), by))


def custom_map(counts: DataFrame, function: Callable[[DataFrame], DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """(by..., raw, clean) by the user's function of the distinct sequences (columns by..., raw, n), which is called once for all groups; a clean `-` or null means no value. Of repeated raws the
    first clean by name holds. A function that returns no column of the groups gives one map for all of them."""
    asked = counts.where("seq is not null").select(*by, F.col("seq").alias("raw"), "n")
    got = function(asked)
    on = [k for k in by if k in got.columns]
    made = got.where((F.col("clean") != "-") & F.col("clean").isNotNull()).groupBy(*on, "raw").agg(F.min("clean").alias("clean"))
    if len(on) < len(by):
        made = asked.select(*by, "raw").distinct().join(made, [*on, "raw"])
    return durable(made.select(*by, "raw", "clean"))


def cluster_map(barcodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(raw, clean) of an external clustering: barcodes (`Unique.reads`, `Cluster.ID`) with their cluster's `Center`."""
    b = barcodes.select(F.col("`Unique.reads`").alias("raw"), F.col("`Cluster.ID`").alias("c"))
    return b.join(clusters.select(F.col("`Cluster.ID`").alias("c"), F.col("Center").alias("clean")), "c").select("raw", "clean").distinct()


def apply_map(rows: DataFrame, column: str, mapping: DataFrame, into: str, by: Sequence[str] = ()) -> DataFrame:
    """`rows` with the clean value of `column` in `into`; null where the map has none. A small map is broadcast; a large one is joined by a shuffle."""
    m = broadcast_if_small(mapping.select(*[F.col(k).alias(f"_by_{k}") for k in by], F.col("raw").alias("_raw"), F.col("clean").alias("_clean")))
    same = F.col(column) == F.col("_raw")
    for k in by:
        same = same & (F.col(k) == F.col(f"_by_{k}"))
    return rows.join(m, same, "left").withColumn(into, F.col("_clean")).drop("_raw", "_clean", *[f"_by_{k}" for k in by])
