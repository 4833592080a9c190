"""Correspondence of two sets of places: scaling, tiling and the nearest spot of every bead."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import broadcast_if_small, durable


def bounds(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(x0, x1, y0, y1, n) of a set of points."""
    return points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count("*").alias("n"))


def aligned(points: DataFrame, scale: float = 1.0, x: str = "x", y: str = "y") -> DataFrame:
    """The points scaled and moved so that the lower left corner of their box is the origin."""
    left, bottom = points.agg(F.min(x), F.min(y)).first()  # one row
    if left is None or bottom is None:
        return points
    return points.withColumns({x: (F.col(x) - F.lit(float(left))) * scale, y: (F.col(y) - F.lit(float(bottom))) * scale})


def tiled(points: DataFrame, width: float, height: float, x: str = "x", y: str = "y") -> DataFrame:
    """The points with the tile (tx, ty) they lie in and their place in it."""
    tx, ty = F.floor(F.col(x) / width), F.floor(F.col(y) / height)
    return points.withColumns({"tx": tx, "ty": ty, x: F.col(x) - tx * width, y: F.col(y) - ty * height})


def nearest_spot(beads: DataFrame, spots: DataFrame, cell: float, bead: str = "bead", spot: str = "spot", x: str = "x", y: str = "y", rings: int = 1, exhaustive: bool = True, others: bool = False) -> DataFrame:
    """(bead, spot, dist2): for each bead the nearest spot, of equally near ones the first by name.

    Spots are put into the cells around theirs, `rings` wide: a spot found nearer than the ring's width is surely nearest, as all nearer spots share a cell. Beads without one (few, if `cell` is
    about the spots' spacing) descend through coarser cells that hold spots, see `_descended`; unless `exhaustive`, they come out with what the rings have, or not at all. Beads and spots without a place don't count.
    `others`: a spot of the bead's own name doesn't count.
    """
    place = lambda d, name: d.select(F.col(name).alias(name), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(~F.isnan("x") & ~F.isnan("y") & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(name).isNotNull())
    b, s = place(beads, bead), place(spots, spot).select(F.col(spot).alias("_spot"), F.col("x").alias("sx"), F.col("y").alias("sy")).distinct()
    steps = F.array(*[F.lit(i) for i in range(-rings, rings + 1)])
    spread = s.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).select("_spot", "sx", "sy", (F.floor(F.col("sx") / cell) + F.col("i")).alias("cx"), (F.floor(F.col("sy") / cell) + F.col("j")).alias("cy"))
    at = b.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    met = (at.cx == spread.cx) & (at.cy == spread.cy) & ((F.col(bead) != F.col("_spot")) if others else F.lit(True))
    best = durable(_best(at.join(spread, met, "left"), bead))
    sure = F.coalesce(F.col("m.dist2") <= (cell * rings) ** 2, F.lit(False))
    if not exhaustive:
        found = best.where("m is not null")
    else:
        found = best.where(sure)
        left = best.where(~sure).select(bead, "x", "y")
        if not left.isEmpty() and not s.isEmpty():
            found = found.unionByName(_best(_descended(left, s, cell, bead, others), bead).where("m is not null"))
    return found.select(bead, F.col("m._spot").alias(spot), F.col("m.dist2").alias("dist2"))


def _best(pairs: DataFrame, bead: str) -> DataFrame:
    d2 = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
    return pairs.groupBy(bead, "x", "y").agg(F.min(F.when(F.col("sx").isNotNull(), F.struct(d2.alias("dist2"), F.col("_spot")))).alias("m"))


def _descended(left: DataFrame, s: DataFrame, cell: float, bead: str, others: bool) -> DataFrame:
    """Beads with the spots that may be nearest to them: from the few coarsest cells that hold spots, each level keeps the cells that begin nearer than some cell ends, and joins their occupied parts (64
    at most) by the cell. No bead meets all spots, however far it is."""
    same = lambda c, by: F.floor(F.col(c) / by)
    levels = [durable(s.groupBy(same("sx", cell).alias("cx"), same("sy", cell).alias("cy")).agg(F.min("_spot").alias("a"), F.max("_spot").alias("z")))]
    box = levels[0].agg(F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()  # one row
    extent = max(box[1] - box[0], box[3] - box[2]) + 1
    while 8 ** (len(levels) - 1) < extent:
        levels.append(durable(levels[-1].groupBy(same("cx", 8).alias("cx"), same("cy", 8).alias("cy")).agg(F.min("a").alias("a"), F.max("z").alias("z"))))
    top = levels[-1].select("cx", "cy", (F.col("a") != F.col("z")).alias("several")).collect()  # at most four cells
    near = left.withColumn("c", F.explode(F.array(*[F.struct(F.lit(r.cx).alias("cx"), F.lit(r.cy).alias("cy"), F.lit(r.several).alias("several")) for r in top]))).select(bead, "x", "y", "c.*")
    for k in range(len(levels) - 1, -1, -1):
        side = cell * 8**k
        edges = {c: (F.col(f"c{c}") * side - F.col(c), F.col(c) - (F.col(f"c{c}") + 1) * side) for c in "xy"}
        begins = sum((F.pow(F.greatest(lo, hi, F.lit(0.0)), F.lit(2.0)) for lo, hi in edges.values()), F.lit(0.0))
        ends = sum((F.pow(F.greatest(F.abs(lo), F.abs(hi)), F.lit(2.0)) for lo, hi in edges.values()), F.lit(0.0))
        # A cell with only the bead's own spot says nothing of others. Rounding must not lose a cell that touches the limit.
        limit = F.min(F.when(F.col("several") | F.lit(not others), ends)).over(W.partitionBy(bead, "x", "y"))
        near = near.withColumns({"begins": begins, "limit": limit}).where(F.col("limit").isNull() | (F.col("begins") <= F.col("limit") * (1 + 1e-9) + 1e-9)).drop("begins", "limit", "several")
        if k:
            parts = levels[k - 1].select(same("cx", 8).alias("px"), same("cy", 8).alias("py"), "cx", "cy", (F.col("a") != F.col("z")).alias("several"))
            near = near.withColumnsRenamed({"cx": "px", "cy": "py"}).join(broadcast_if_small(parts), ["px", "py"]).drop("px", "py")
    own = (F.col(bead) != F.col("_spot")) if others else F.lit(True)
    return near.join(s.withColumns({"cx": same("sx", cell), "cy": same("sy", cell)}), ["cx", "cy"]).where(own)


def least_distance(points: DataFrame, cell: float, name: str = "spot", x: str = "x", y: str = "y") -> float | None:
    """The least distance of two different points: the spacing by which coordinates are scaled. None for fewer than two."""
    beads = points.select(F.col(name).alias("bead"), F.col(x).alias("x"), F.col(y).alias("y"))
    spots = points.select(F.col(name).alias("spot"), F.col(x).alias("x"), F.col(y).alias("y"))
    least = nearest_spot(beads, spots, cell, others=True).agg(F.min("dist2")).first()[0]
    return None if least is None else least**0.5


def greatest_below(points: DataFrame, limit: float, name: str = "spot", x: str = "x", y: str = "y") -> float | None:
    """The greatest distance of two places of points that is above 0 and below `limit`; None without one. Places meet in cells of that side, so the limit should be about their spacing."""
    p = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(~F.isnan("x") & ~F.isnan("y") & F.col("x").isNotNull() & F.col("y").isNotNull()).distinct()
    at = p.withColumns({"cx": F.floor(F.col("x") / limit), "cy": F.floor(F.col("y") / limit)})
    # Each pair is found from the side of the lesser cell: the half of the neighbours that follow it.
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    spread = at.withColumn("s", F.explode(steps)).select(F.col("x").alias("sx"), F.col("y").alias("sy"), (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    d2 = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
    greatest = at.join(spread, ["cx", "cy"]).select(d2.alias("d2")).where((F.col("d2") > 0) & (F.col("d2") < limit * limit)).agg(F.max("d2")).first()[0]
    return None if greatest is None else greatest**0.5


def expansion_rate(sources: DataFrame, dests: DataFrame, source_cell: float, dest_cell: float) -> float | None:
    """The factor by which sources are spread so that no two of them share a nearest destination: the destinations' ring of neighbours (the greatest of their distances below 1.5 times the
    least, rounded up, as the diameter of the hexagon round a spot, rounded up) over the sources' least distance. None for fewer than two of either. Columns spot, x, y."""
    apart = lambda p: p.groupBy("x", "y").agg(F.min("spot").alias("spot"))
    spacing, least = least_distance(apart(dests), dest_cell), least_distance(apart(sources), source_cell)
    if spacing is None or least is None:
        return None
    ring = greatest_below(dests, spacing * 1.5)
    return math.ceil(math.ceil(ring) * 2 / math.sqrt(3)) / least


def _spacing(points: DataFrame) -> float:
    """About the distance of neighbours if points were even: a width for cells."""
    b = bounds(points).first()
    return max(math.sqrt(max((b.x1 - b.x0) * (b.y1 - b.y0), 0) / b.n), max(b.x1 - b.x0, b.y1 - b.y0) / b.n, 2.0**-20)


def spot_correspondence(sources: DataFrame, dests: DataFrame, expansion: float | None = None) -> DataFrame:
    """(bead, tx, ty, spot): for each source place (columns spot, x, y) the nearest destination (spot, x, y), of equally near ones the first by name.

    Sources are spread by `expansion` (by `expansion_rate` without it), destinations are moved so that both have one lower left corner, and are repeated in tiles of the destinations' box to the right
    and above, in each but the first row and column moved on by half the distance of the first two spots of the lowest row (those less than 5 above it). A source looks for its spot in its own tile
    (tx, ty). Tiles are not made: sources are moved into the first one. Rows without a place or name don't count; without sources or destinations there are no rows.
    """
    there = lambda p: p.select("spot", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("spot is not null and x is not null and y is not null and not isnan(x) and not isnan(y)")
    s, d = durable(there(sources)), durable(there(dests))
    none = s.select(F.col("spot").alias("bead"), F.lit(0).cast("bigint").alias("tx"), F.lit(0).cast("bigint").alias("ty"), F.lit(None).cast(dict(d.dtypes)["spot"]).alias("spot")).limit(0)
    if s.isEmpty() or d.isEmpty():
        return none
    if expansion is None:
        expansion = expansion_rate(s, d, _spacing(s), _spacing(d)) or 1.0
    s = s.withColumns({"x": F.col("x") * expansion, "y": F.col("y") * expansion})
    at, to = bounds(s).first(), bounds(d).first()  # a row each
    d = d.withColumns({"x": F.col("x") - F.lit(to.x0 - at.x0), "y": F.col("y") - F.lit(to.y0 - at.y0)})
    box = bounds(d).first()
    lowest = [r.x for r in d.where(F.col("y") < box.y0 + 5).orderBy("x").select("x").limit(2).collect()]  # two rows
    blank = (lowest[1] - lowest[0]) / 2 if len(lowest) > 1 else 0.0
    wide, high = box.x1 - box.x0, box.y1 - box.y0
    tile = lambda c, least, size: (F.floor((F.col(c) - F.lit(least)) / F.lit(size)) if size > 0 else F.lit(0)).cast("bigint")
    s = s.select(F.col("spot").alias("bead"), "x", "y", tile("x", at.x0, wide).alias("tx"), tile("y", at.y0, high).alias("ty"))
    moved = lambda c, t, size: F.when(F.col(t) == 0, F.col(c)).otherwise(F.col(c) - (F.lit(size) * F.col(t) + F.lit(blank)))
    s = s.select(F.struct("bead", "tx", "ty").alias("bead"), moved("x", "tx", wide).alias("x"), moved("y", "ty", high).alias("y"))
    near = nearest_spot(s, d, _spacing(d)).groupBy("bead").agg(F.min(F.struct("dist2", "spot")).alias("m"))
    return near.select("bead.bead", "bead.tx", "bead.ty", F.col("m.spot").alias("spot"))
