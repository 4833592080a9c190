import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.operators.proximity import cover_polygon, pairs_within, points_in_regions

SCHEMA = "puck string, barcode string, x double, y double, p string, blocks int"


def brute(rows, radius):
    out = set()
    for a in rows:
        for b in rows:
            if None in a[:4] or None in b[:4] or a[0] != b[0] or a[1] >= b[1]:
                continue
            if any(math.isnan(v) or math.isinf(v) or v == -9999 for v in (a[2], a[3], b[2], b[3])):
                continue
            if (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= radius**2:
                out.add((a[1], b[1]))
    return out


def test_pairs_match_brute_force_with_crowds_nulls_and_repeats(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(2)}", f"b{i:04d}", rng.randrange(-800, 800) / 8, rng.randrange(-800, 800) / 8, "clash", 1) for i in range(500)]
    rows += [("k0", f"c{i:04d}", 3 + rng.randrange(40) / 8, 4.0, "clash", 2) for i in range(90)]  # a crowded cell is refined
    rows += [rows[0], rows[1], ("k0", "b0001", 50.0, 50.0, None, None)]  # repeats, and a bead at two places
    rows += [(None, "n1", 1.0, 1.0, None, 1), ("k0", None, 1.0, 1.0, None, 1), ("k0", "n2", None, 1.0, None, 1), ("k0", "n3", float("nan"), 1.0, None, 1), ("k0", "n4", -9999.0, -9999.0, None, 1), ("k0", "n5", float("inf"), 1.0, None, 1)]
    got = [tuple(r) for r in pairs_within(spark.createDataFrame(rows, SCHEMA), 10.0).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 10.0)


def test_limit_is_included_and_empty_tables_are_fine(spark):
    rows = [("k", "a", 0.0, 0.0, None, 1), ("k", "b", 6.0, 8.0, None, 1), ("k", "c", 6.0, 8.125, None, 1), ("k", "a2", 0.0, 0.0, None, 1)]
    got = {tuple(r) for r in pairs_within(spark.createDataFrame(rows, SCHEMA), 10.0).collect()}
    assert got == {("a", "b"), ("a2", "b"), ("b", "c"), ("a", "a2")}
    assert pairs_within(spark.createDataFrame([], SCHEMA), 10.0).count() == 0


def test_blocks_of_a_very_crowded_cell(spark, monkeypatch):
    from strandweave.operators import proximity

    monkeypatch.setattr(proximity, "BLOCK", 16)
    rows = [("k", f"b{i:03d}", (i % 12) / 4, (i // 12) / 4, None, 1) for i in range(120)]
    got = {tuple(r) for r in pairs_within(spark.createDataFrame(rows, SCHEMA), 1.0).collect()}
    assert got == brute(rows, 1.0)


def test_discs_hold_cells_where_points_are_sparse(spark, monkeypatch):
    from strandweave.operators import proximity

    rng = random.Random(5)
    rows = [("k", f"b{i:03d}", rng.randrange(-400, 400) / 8, rng.randrange(-400, 400) / 8, None, 1) for i in range(150)]
    made = []
    monkeypatch.setattr(proximity, "disc_covers", lambda *a, covers=proximity.disc_covers: made.append(covers(*a)) or made[-1])
    assert {tuple(r) for r in pairs_within(spark.createDataFrame(rows, SCHEMA), 10.0).collect()} == brute(rows, 10.0)
    covers, members = ([r.asDict() for r in d.collect()] for d in made[0])
    place = {r["p"]: (r["x"], r["y"]) for r in members}
    by_cell = {}
    for m in members:
        by_cell.setdefault((m["cx"], m["cy"]), []).append(m["p"])
    accepted = tested = 0
    for c in covers:  # every cell with a cover holds points, and all points of an interior cell are near
        there = [q for q in by_cell[c["cx"], c["cy"]] if (q > c["p"] if c["own"] else q != c["p"])]
        near = [math.dist(place[q], (c["x"], c["y"])) <= 10 for q in there]
        assert not c["interior"] or all(near)
        accepted, tested = accepted + c["interior"] * len(there), tested + (not c["interior"]) * sum(near)
    assert accepted + tested == len(brute(rows, 10.0)) and accepted > 0.3 * (accepted + tested)


def test_coverage_has_interior_and_boundary_cells():
    square = np.array([0.0, 8.0, 8.0, 0.0]), np.array([0.0, 0.0, 8.0, 8.0])
    cells = cover_polygon(*square, most=64)
    assert any(c[3] for c in cells) and any(not c[3] for c in cells)
    assert cover_polygon(np.array([0.0, 1.0]), np.array([0.0, 1.0])) == []


def test_points_in_regions_match_the_rule(spark):
    rng = random.Random(3)
    points = [(i, rng.randrange(-64, 640) / 8, rng.randrange(-64, 640) / 8, "x") for i in range(600)] + [(9999, None, 1.0, "x"), (9998, float("nan"), 1.0, "x"), (0, 1.0, 1.0, "x")]
    shapes = {"star": [(40, 70), (46, 46), (70, 40), (46, 34), (40, 10), (34, 34), (10, 40), (34, 46)], "box": [(0, 0), (20, 0), (20, 30), (0, 30)], "line": [(0, 0), (1, 1)]}
    regions = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in v]) for k, v in shapes.items()] + [("none", None)], "region string, vertices array<struct<x:double,y:double>>")
    got = sorted((r.id, r.region) for r in points_in_regions(spark.createDataFrame(points, "id int, x double, y double, vertices string"), regions, ["id"], "x", "y").collect())

    def inside(v, x, y):
        n = 0
        for (ax, ay), (bx, by) in zip(v, v[1:] + v[:1]):
            if (ay > y) != (by > y):
                c = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
                n += (c if by > ay else -c) > 0
        return n % 2 == 1

    want = sorted((i, k) for i, x, y, _ in points if x is not None and x == x for k, v in shapes.items() if len(v) > 2 and inside(v, x, y))
    assert got == want and len(want) > 50
    assert points_in_regions(spark.createDataFrame([], "id int, x double, y double"), regions, ["id"], "x", "y").count() == 0
    assert points_in_regions(spark.createDataFrame([(1, 1.0, 1.0)], "id int, x double, y double"), regions.where("false"), ["id"], "x", "y").where(F.lit(True)).count() == 0


def test_regions_of_one_name_keep_apart(spark):
    box = lambda x, y, n: [(float(x), float(y)), (x + n, float(y)), (x + n, y + n / 2), (x + n / 2, y + n), (float(x), y + n)]
    shapes = [box(0, 0, 20.0), box(50, 50, 20.0), box(10, 0, 20.0), box(0, 0, 20.0)]
    regions = spark.createDataFrame([("same", v) for v in shapes], "region string, vertices array<struct<x:double,y:double>>")
    rng = random.Random(8)
    points = [(i, rng.randrange(0, 800) / 8 + 1 / 16, rng.randrange(0, 800) / 8 + 1 / 32) for i in range(600)]

    def inside(v, x, y):
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(v, v[1:] + v[:1])) % 2 == 1

    got = sorted(r.id for r in points_in_regions(spark.createDataFrame(points, "id int, x double, y double"), regions, ["id"], "x", "y").collect())
    assert got == sorted(i for i, x, y in points for v in shapes[:3] if inside(v, x, y)) and len(set(got)) < len(got)
