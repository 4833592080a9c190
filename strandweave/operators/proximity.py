"""Points near points, and points in regions, by adaptive coverage with cells.

A region (a disc round a point, or a polygon) is covered by square cells. A cell that lies wholly in the region is *interior*: every point in it
belongs to the region, so an equi-join on the cell is the answer. A cell that the outline crosses is a *boundary* cell: points in it are
candidates, and only they get the exact test. Cells have sides that are powers of two, so with coordinates that are binary fractions the
interior test is as exact as the distance itself.

The coverage adapts: discs descend from tiles to the cells that hold points, and where these are crowded to finer ones; polygons are
descended as a quadtree that stops at interior cells. No step gathers a cell's points in one place: crowded cells are split into
finer cells and, past that, into salted blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable

#: Cells along the side of a tile; the occupied ones are the bits of one number.
TILE = 8
#: A cell with more points than this is refined into FINE x FINE cells: below, testing its points costs less than sending a disc to more cells.
CROWDED = 48
FINE = 4
#: Points of one crowded cell that share a salt.
BLOCK = 4096
#: Corners of all regions together up to which their outlines are broadcast (16 bytes each); beyond, they are joined by a shuffle.
CORNERS = 1_000_000


def located(x: Column, y: Column, missing: float = -9999.0) -> Column:
    """Whether a point has a place: neither coordinate null, NaN or infinite, and not both the mark for missing."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return finite(x) & finite(y) & ~((x == missing) & (y == missing))


def _reach(left: Column, bottom: Column, side: float, radius: float) -> tuple[Column, Column]:
    """Whether a disc meets a cell, and whether it holds all of it; left and bottom are the cell's edges seen from the centre."""
    right, top = left + side, bottom + side
    nx, ny = (F.greatest(lo, -hi, F.lit(0.0)) for lo, hi in ((left, right), (bottom, top)))
    fx, fy = (F.greatest(F.abs(lo), F.abs(hi)) for lo, hi in ((left, right), (bottom, top)))
    return nx * nx + ny * ny <= radius * radius, fx * fx + fy * fy <= radius * radius


def disc_covers(p: DataFrame, radius: float, side: float) -> tuple[DataFrame, DataFrame]:
    """(covers, members) of points (g, p, x, y, cx, cy: the cell of the given side).

    covers: a row for each point's half disc (its own cell and those after it) and each cell there that holds other points: g, cx, cy, sub, salt, p, x, y, interior, own. members: the points by
    the same cells. A disc is sent to the tiles it meets, learns there which cells are occupied, and descends to them alone; empty cells get no row.
    """
    bit = lambda cx, cy: ((cx - F.floor(cx / TILE) * TILE) * TILE + cy - F.floor(cy / TILE) * TILE).cast("int")
    tile = lambda c: F.floor(F.col(c) / TILE)
    cells = p.groupBy("g", "cx", "cy").agg(F.count("*").alias("n")).withColumns({"tx": tile("cx"), "ty": tile("cy"), "bit": bit(F.col("cx"), F.col("cy"))})
    blocks = F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    tiles = durable(
        cells.groupBy("g", "tx", "ty").agg(
            F.expr("bit_or(shiftleft(1L, bit))").alias("occupied"),
            F.expr("bit_or(CASE WHEN n > 1 THEN shiftleft(1L, bit) ELSE 0L END)").alias("shared"),
            F.collect_list(F.when(F.col("n") > CROWDED, F.struct("bit", blocks, "cx", "cy"))).alias("crowded"),  # at most TILE x TILE of them
        )
    )
    # At most rows / CROWDED cells: broadcast when counting shows few, else joined by a shuffle.
    crowded = broadcast_if_small(tiles.where(F.size("crowded") > 0).select("g", F.explode("crowded").alias("c")).select("g", "c.cx", "c.cy", "c.blocks"))
    fine = side / FINE
    fine_index = (F.floor(F.col("x") / fine) - F.col("cx") * FINE) * FINE + (F.floor(F.col("y") / fine) - F.col("cy") * FINE)
    members = p.join(crowded, ["g", "cx", "cy"], "left").select(
        "g", "cx", "cy", "p", "x", "y",
        F.when(F.col("blocks").isNull(), F.lit(-1)).otherwise(fine_index).cast("int").alias("sub"),
        F.coalesce(F.pmod(F.xxhash64("p", "x", "y"), F.col("blocks")), F.lit(0)).cast("int").alias("salt"),
    )

    # explode, not array functions: rows stay in generated code
    at = lambda c, by: F.floor((F.col(c) + by) / side)
    discs = p.select("g", "p", "x", "y", F.col("cx").alias("own_x"), F.col("cy").alias("own_y"), at("x", radius).alias("right"), at("y", -radius).alias("bottom"), at("y", radius).alias("top"))
    sent = discs.withColumn("tx", F.explode(F.sequence(tile("own_x"), tile("right")))).withColumn("ty", F.explode(F.sequence(tile("bottom"), tile("top"))))
    sent = sent.where(_reach(F.col("tx") * TILE * side - F.col("x"), F.col("ty") * TILE * side - F.col("y"), TILE * side, radius)[0])
    met = sent.join(broadcast_if_small(tiles.select("g", "tx", "ty", "occupied", "shared", F.transform("crowded", lambda c: F.struct(c.bit, c.blocks)).alias("crowded"))), ["g", "tx", "ty"])

    first, last = F.greatest(F.col("tx") * TILE, F.col("own_x")), F.least(F.col("tx") * TILE + TILE - 1, F.col("right"))
    met = met.withColumn("cx", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("ty") * TILE, F.when(F.col("cx") == F.col("own_x"), F.col("own_y")).otherwise(F.col("bottom")))
    high = F.least(F.col("ty") * TILE + TILE - 1, F.col("top"))
    met = met.withColumn("cy", F.explode(F.when(low <= high, F.sequence(low, high)))).withColumn("bit", bit(F.col("cx"), F.col("cy")))
    meets, interior = _reach(F.col("cx") * side - F.col("x"), F.col("cy") * side - F.col("y"), side, radius)
    own = (F.col("cx") == F.col("own_x")) & (F.col("cy") == F.col("own_y"))
    # A point's own cell holds it; there must be another.
    met = met.where((F.getbit(F.when(own, F.col("shared")).otherwise(F.col("occupied")), F.col("bit")) == 1) & meets).withColumns({"interior": interior, "own": own})
    # A crowded cell becomes FINE x FINE cells (sub) times its blocks (salt).
    met = met.withColumn("blocks", F.when(F.size("crowded") > 0, F.get(F.filter("crowded", lambda c: c.bit == F.col("bit")), F.lit(0))["blocks"]))
    lone = F.col("blocks").isNull()
    met = met.withColumn("sub", F.explode(F.sequence(F.when(lone, -1).otherwise(0), F.when(lone, -1).otherwise(FINE * FINE - 1))))
    meets, interior = _reach((F.col("cx") * FINE + F.floor(F.col("sub") / FINE)) * fine - F.col("x"), (F.col("cy") * FINE + F.col("sub") % FINE) * fine - F.col("y"), fine, radius)
    met = met.where(lone | meets).withColumn("interior", F.col("interior") | (~lone & interior))
    met = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)).cast("int"))))
    return met.select("g", "cx", "cy", "sub", "salt", "p", "x", "y", "interior", "own"), members


def pairs_within(points: DataFrame, radius: float, group: str = "puck", point: str = "barcode", x: str = "x", y: str = "y") -> DataFrame:
    """Pairs (point_a, point_b), point_a < point_b, of two different points of one group with some place of one at most `radius` from some place of the other.

    Every pair comes out once, whatever the number of places. Rows without a group, a point or a place are no points. Other columns are ignored. An
    empty table gives no rows. Only the half of each disc that follows its own cell is covered: the other half is found from the other point.
    """
    side = 2.0 ** (math.floor(math.log2(radius)) - 1)  # a disc holds several such cells wholly
    # Written once: its cells are counted, its points are members, and its discs are covers.
    p = durable(
        points.select(F.col(group).alias("g"), F.col(point).alias("p"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .where(located(F.col("x"), F.col("y")) & F.col("g").isNotNull() & F.col("p").isNotNull())
        .distinct()
        .withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    )
    covers, members = disc_covers(p, radius, side)
    covers = durable(covers)  # read by both branches
    cell = ["g", "cx", "cy", "sub", "salt"]
    # Within the disc's own cell both points see each other; the order of names then keeps one of the two.
    new = F.when(F.col("own"), F.col("p") < F.col("q")).otherwise(F.col("p") != F.col("q"))
    sure = covers.where("interior").select(*cell, "p", "own").join(members.select(*cell, F.col("p").alias("q")), cell).where(new)
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    tested = covers.where("not interior").select(*cell, "p", "own", "x", "y").join(members.select(*cell, F.col("p").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy")), cell).where(new & (dx * dx + dy * dy <= radius * radius))
    return sure.select("p", "q").unionByName(tested.select("p", "q")).select(F.least("p", "q").alias("point_a"), F.greatest("p", "q").alias("point_b")).distinct()


def _crosses(px1: np.ndarray, py1: np.ndarray, px2: np.ndarray, py2: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Which segments meet the closed rectangle: their boxes overlap and its corners aren't all strictly on one side of the line."""
    box = (np.minimum(px1, px2) <= x1) & (np.maximum(px1, px2) >= x0) & (np.minimum(py1, py2) <= y1) & (np.maximum(py1, py2) >= y0)
    sides = np.stack([np.sign((px2 - px1) * (cy - py1) - (cx - px1) * (py2 - py1)) for cx in (x0, x1) for cy in (y0, y1)])
    return box & ~((sides > 0).all(0) | (sides < 0).all(0))


def _inside(xs: np.ndarray, ys: np.ndarray, x: float, y: float) -> bool:
    """Even-odd rule, in the same form as `contains`."""
    x2, y2 = np.roll(xs, -1), np.roll(ys, -1)
    spans = (ys > y) != (y2 > y)
    cross = (x2 - xs) * (y - ys) - (x - xs) * (y2 - ys)
    return bool((spans & (np.where(y2 > ys, cross, -cross) > 0)).sum() % 2)


def cover_polygon(xs: np.ndarray, ys: np.ndarray, most: int = 256, deepest: int = 12) -> list[tuple[int, int, int, bool]]:
    """Quadtree cells (level, cx, cy, interior) of a polygon; a cell of level k has the side 2**k. Boundary cells are split, largest first, until there are `most` cells or they are `deepest` levels under the first."""
    keep = np.isfinite(xs) & np.isfinite(ys)
    xs, ys = xs[keep], ys[keep]
    if len(xs) < 3:
        return []
    extent = max(xs.max() - xs.min(), ys.max() - ys.min(), 2.0**-20)
    top = math.ceil(math.log2(extent))
    x2, y2 = np.roll(xs, -1), np.roll(ys, -1)
    done: list[tuple[int, int, int, bool]] = []

    def classify(level: int, cx: int, cy: int, edges: np.ndarray) -> np.ndarray | None:
        side = 2.0**level
        hit = edges[_crosses(xs[edges], ys[edges], x2[edges], y2[edges], cx * side, cy * side, (cx + 1) * side, (cy + 1) * side)]
        if len(hit):
            return hit
        if _inside(xs, ys, (cx + 0.5) * side, (cy + 0.5) * side):
            done.append((level, cx, cy, True))
        return None

    open_cells: list[tuple[int, int, int, np.ndarray]] = []
    side, every = 2.0**top, np.arange(len(xs))
    for cx in range(math.floor(xs.min() / side), math.floor(xs.max() / side) + 1):
        for cy in range(math.floor(ys.min() / side), math.floor(ys.max() / side) + 1):
            if (hit := classify(top, cx, cy, every)) is not None:
                open_cells.append((top, cx, cy, hit))
    at = 0
    while at < len(open_cells) and len(done) + len(open_cells) - at + 3 <= most and open_cells[at][0] > top - deepest:
        level, cx, cy, edges = open_cells[at]
        at += 1
        for sx in (0, 1):
            for sy in (0, 1):
                if (hit := classify(level - 1, 2 * cx + sx, 2 * cy + sy, edges)) is not None:
                    open_cells.append((level - 1, 2 * cx + sx, 2 * cy + sy, hit))
    return done + [(level, cx, cy, False) for level, cx, cy, _ in open_cells[at:]]


def contains(vertices: Column, x: Column, y: Column) -> Column:
    """Whether a polygon (array of struct x, y, without a repeated first vertex) holds the point by the even-odd rule; of two regions that share an edge, a point on it is in one."""
    following = F.concat(F.slice(vertices, 2, F.greatest(F.size(vertices) - 1, F.lit(0))), F.slice(vertices, 1, 1))

    def crossing(v: Column) -> Column:
        ax, ay, bx, by = v.a.x, v.a.y, v.b.x, v.b.y
        cross = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        return F.when(((ay > y) != (by > y)) & (F.when(by > ay, cross).otherwise(-cross) > 0), 1).otherwise(0)

    edges = F.zip_with(vertices, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(edges, F.lit(0), lambda n, v: n + crossing(v)) % 2 == 1


def points_in_regions(points: DataFrame, regions: DataFrame, keys: list[str], x: str, y: str, region: str = "region", vertices: str = "vertices", group: str | None = None, most_cells: int = 256) -> DataFrame:
    """(keys..., region): each point with each region that contains it. `regions` has region, vertices (array of struct<x,y>) and, if `group` is given, that column, which must agree.

    Points without a place and regions of fewer than three vertices match nothing. A region is covered by at most about `most_cells` cells, so the
    coverage grows with the regions and not with the points; both sides may be of any size. A small coverage is broadcast, and points are not sent at all. Repeated rows of points come out as often as they are. Regions of one name are regions of
    their own: each that contains a point gives a row; equal rows of regions count once.
    """
    own = F.col(group) if group else F.lit(0)
    shape = regions.select(F.col(region).alias("r"), own.alias("rg"), F.col(vertices).cast("array<struct<x:double,y:double>>").alias("v")).distinct()
    shape = durable(shape.withColumn("id", F.md5(F.to_json(F.struct("r", "rg", "v")))))  # regions of one name are told apart

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, v in enumerate(rows["v"]):
                if v is None:
                    continue
                xs, ys = (np.array([np.nan if p is None or p[c] is None else p[c] for p in v], dtype=float) for c in ("x", "y"))
                out += [(k, *cell) for cell in cover_polygon(xs, ys, most_cells)]
            cells = pd.DataFrame(out, columns=["k", "level", "cx", "cy", "interior"])
            at = cells.pop("k").to_numpy(dtype=int)
            for c in ("r", "rg", "id"):
                cells[c] = rows[c].to_numpy()[at]
            yield cells

    kinds = dict(shape.dtypes)
    spread = shape.repartition(shape.sparkSession.sparkContext.defaultParallelism, "id")  # few bytes, but much to compute
    cells = durable(spread.mapInPandas(cover, f"level int, cx bigint, cy bigint, interior boolean, r {kinds['r']}, rg {kinds['rg']}, id string"))
    levels = [row.level for row in cells.select("level").distinct().collect()]  # one number for each size of cell in use, at most about a hundred
    p = points.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], (F.col(group) if group else F.lit(0)).alias("pg"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).where(located(F.col("px"), F.col("py")))
    side = F.pow(F.lit(2.0), F.col("level"))
    p = p.withColumn("level", F.explode(F.array(*[F.lit(v).cast("int") for v in levels]).cast("array<int>"))).withColumns({"cx": F.floor(F.col("px") / side), "cy": F.floor(F.col("py") / side)})
    candidates = p.join(broadcast_if_small(cells.withColumnRenamed("rg", "pg")), ["pg", "level", "cx", "cy"])
    names = [F.col(f"k{i}").alias(k) for i, k in enumerate(keys)]
    sure = candidates.where("interior").select(*names, F.col("r").alias(region))
    outlines = shape.where("v is not null").select("id", "v")
    corners = outlines.agg(F.sum(F.size("v"))).first()[0] or 0  # one number
    outlines = F.broadcast(outlines) if corners <= CORNERS else outlines
    tested = candidates.where("not interior").join(outlines, "id").where(contains(F.col("v"), F.col("px"), F.col("py")))
    return sure.unionByName(tested.select(*names, F.col("r").alias(region)))
