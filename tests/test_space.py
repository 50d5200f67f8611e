"""Geometry, spatial joins and rasters against worked values and brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F
from tidewright.functions import geometry as g
from tidewright.operators import raster, spatial
from tidewright.operators.graph import connected

SHAPE = "array<array<struct<x:double,y:double>>>"


def rings(*parts):
    return [[{"x": float(x), "y": float(y)} for x, y in part] for part in parts]


L = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
HOLE = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]]


def shapes(spark, items):
    return spark.createDataFrame(list(items.items()), f"id long, rings {SHAPE}")


def test_area_and_centroid(spark):
    df = shapes(spark, {1: rings(L), 2: rings(*HOLE), 3: rings(list(reversed(L)))})
    got = {r["id"]: (r["a"], r["c"]["x"], r["c"]["y"]) for r in df.select("id", g.area(F.col("rings")).alias("a"), g.centroid(F.col("rings")).alias("c")).collect()}
    assert got[1] == pytest.approx((7, 19 / 14, 19 / 14)) and got[3] == pytest.approx(got[1]) and got[2] == pytest.approx((96, 5, 5))


def test_points_on_and_in(spark):
    df = shapes(spark, {1: rings(L), 2: rings(*HOLE)})
    inside = lambda i, x, y: df.where(f"id = {i}").select(g.contains_point(F.col("rings"), F.lit(float(x)), F.lit(float(y)))).first()[0]
    assert inside(1, 0.5, 3) and inside(1, 1, 2) and inside(1, 0, 0) and not inside(1, 2, 2)
    assert not inside(2, 5, 5) and inside(2, 4, 5) and inside(2, 3, 5) and not inside(2, 11, 5)


def test_relations(spark):
    square = lambda x, y, s: rings([(x, y), (x + s, y), (x + s, y + s), (x, y + s)])
    df = spark.createDataFrame([(1, square(0, 0, 1), square(1, 0, 1)), (2, square(0, 0, 1), square(1.1, 0, 1)), (3, square(2, 2, 1), square(0, 0, 9)), (4, square(0, 0, 2), square(1, 1, 2))], f"id long, a {SHAPE}, b {SHAPE}")
    got = {r["id"]: (r["i"], r["w"]) for r in df.select("id", g.intersects(F.col("a"), F.col("b")).alias("i"), g.within(F.col("a"), F.col("b")).alias("w")).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (True, True), 4: (True, False)}


def test_point_join_is_the_cross_join(spark):
    draw = random.Random(1)
    points = spark.createDataFrame([(k, draw.uniform(-3, 12), draw.uniform(-3, 12)) for k in range(300)] + [(900, 4.0, 4.0), (901, 0.0, 0.0)], "p long, x double, y double")
    s = shapes(spark, {1: rings(L), 2: rings(*HOLE), 3: rings([(-2, -2), (11, 3), (2, 11)])})
    brute = points.join(s, how="cross").where(g.contains_point(F.col("rings"), F.col("x"), F.col("y")))
    for size in (0.7, 3.0, 50.0):
        assert sorted(map(tuple, spatial.points_in_shapes(points, s, size).select("p", "id").collect())) == sorted(map(tuple, brute.select("p", "id").collect()))


def test_shape_join_has_each_pair_once(spark):
    draw = random.Random(2)
    square = lambda: (lambda x, y, s: rings([(x, y), (x + s, y), (x + s, y + s), (x, y + s)]))(draw.uniform(-5, 5), draw.uniform(-5, 5), draw.uniform(0.1, 4))
    a, b = shapes(spark, {k: square() for k in range(30)}), shapes(spark, {k: square() for k in range(30)})
    b = b.select(F.col("id").alias("other"), F.col("rings").alias("other_rings"))
    brute = a.join(b, how="cross").where(g.intersects(F.col("rings"), F.col("other_rings")))
    assert sorted(map(tuple, spatial.shapes_to_shapes(a, b, 1.0).select("id", "other").collect())) == sorted(map(tuple, brute.select("id", "other").collect()))


def test_nearest_is_exact(spark):
    draw = random.Random(3)
    points = [(k, draw.uniform(0, 100), draw.uniform(0, 100)) for k in range(60)]
    targets = [(k, draw.uniform(0, 20), draw.uniform(0, 20)) for k in range(25)]
    got = {r["id"]: (r["target"], r["distance"]) for r in spatial.nearest(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(targets, "target long, x double, y double"), 2.0).collect()}
    for k, x, y in points:
        d, t = min((math.hypot(x - a, y - b), t) for t, a, b in targets)
        assert got[k] == (t, pytest.approx(d))
    empty = spark.createDataFrame([], "target long, x double, y double")
    assert spatial.nearest(spark.createDataFrame(points, "id long, x double, y double"), empty, 2.0).where("target is null").count() == 60


@pytest.mark.parametrize("kind", ["uniform", "dense", "far", "line", "same"])
def test_nearest_through_tiles(spark, kind):
    """Tiles of 64 places, found through tiles of their first targets: dense and far clusters, ties, equal places, no place."""
    draw = random.Random(kind)
    at = {"uniform": lambda: (draw.uniform(0, 10), draw.uniform(0, 10)), "dense": lambda: (draw.gauss(5, 1e-4), draw.gauss(5, 1e-4)), "far": lambda: (1e3 + draw.random(), -1e3 + draw.random()),
          "line": lambda: (float(draw.randrange(600)), 0.0), "same": lambda: (float(draw.randrange(25)), float(draw.randrange(25)))}[kind]
    points = [(k, draw.uniform(0, 10), draw.uniform(0, 10)) for k in range(150)] + [(150 + k, *at()) for k in range(150)]
    targets = [(k, *at()) for k in range(700)] + [(700 + k, draw.uniform(0, 10), draw.uniform(0, 10)) for k in range(40)]
    p = spark.createDataFrame([*points, (-1, None, 1.0)], "id long, x double, y double")
    got = {r["id"]: (r["target"], r["distance"]) for r in spatial.nearest(p, spark.createDataFrame([*targets, (-1, None, 1.0)], "target long, x double, y double"), 0.5, most=64).collect()}
    assert got == {k: min((math.sqrt((x - a) ** 2 + (y - b) ** 2), t) for t, a, b in targets)[::-1] for k, x, y in points}


def test_nearest_meets_few_targets(spark):
    """All places in one cell of the given size: the pairs of points and tiles follow the points, and no join takes rows of points to rows of targets."""
    place = [F.rand(s) / 100 for s in (1, 2)]
    p = spark.range(3000).select("id", place[0].alias("x"), place[1].alias("y"))
    t = spark.range(3000).select(F.col("id").alias("target"), (F.rand(3) / 100).alias("x"), (F.rand(4) / 100).alias("y"))
    joined = spatial.nearest(p, t, 1.0, most=128)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "cx" in plan and "dx" not in plan and "CoGroup" in plan.replace("cogroup", "CoGroup")
    assert joined.count() == 3000


def test_outermost_keeps_outer_and_smaller_ids(spark):
    s = {1: rings([(0, 0), (10, 0), (10, 10), (0, 10)]), 2: rings([(1, 1), (2, 1), (2, 2), (1, 2)]), 3: rings([(20, 0), (30, 0), (30, 10), (20, 10)]), 4: rings([(21, -1), (31, -1), (31, 9), (21, 9)])}
    assert sorted(r["id"] for r in spatial.outermost(shapes(spark, s), 5.0).collect()) == [1, 3]


def test_distance_simplify_and_antimeridian(spark):
    df = shapes(spark, {1: rings([(0, 0), (2, 0.001), (4, 0), (4, 4), (0, 4)])})
    d = df.select(*(g.distance_to(F.col("rings"), F.lit(x), F.lit(y)) for x, y in ((1.0, 1.0), (7.0, 8.0), (2.0, 5.0)))).first()
    assert list(d) == pytest.approx([0, 5, 1])
    assert len(spatial.simplified(df, 0.01).first()["rings"][0]) == 4
    parts = df.select(g.split_antimeridian(g.box(F.lit(170.0), F.lit(0.0), F.lit(190.0), F.lit(2.0))[0]).alias("p")).first()["p"]
    assert sorted(min(q["x"] for q in r) for r in parts) == [-180, 170]


def test_projection_keeps_area(spark):
    step = 0.01
    p = lambda dx, dy: g.laea(F.lit(12.0 + dx), F.lit(48.0 + dy), 10.0, 45.0)
    df = spark.range(1).select(*(p(*c).alias(f"c{k}") for k, c in enumerate([(0, 0), (step, 0), (step, step), (0, step)])), g.laea(F.lit(10.0), F.lit(45.0), 10.0, 45.0).alias("o"), g.lcc(F.lit(10.0), F.lit(45.0), 10.0, 45.0, 40.0, 50.0).alias("q"))
    r = df.first()
    xs, ys = zip(*((r[f"c{k}"]["x"], r[f"c{k}"]["y"]) for k in range(4)))
    area = abs(sum(xs[k] * ys[(k + 1) % 4] - xs[(k + 1) % 4] * ys[k] for k in range(4))) / 2
    e2 = g.FLATTENING * (2 - g.FLATTENING)
    lat = math.radians(48 + step / 2)
    m = g.SEMI_MAJOR**2 * (1 - e2) / (1 - e2 * math.sin(lat) ** 2) ** 2 * math.cos(lat)
    assert area == pytest.approx(m * math.radians(step) ** 2, rel=1e-5)
    assert tuple(r["o"]) == pytest.approx((0, 0), abs=1e-6) and tuple(r["q"]) == pytest.approx((0, 0), abs=1e-6)


def lattice(spark, rows):
    return spark.createDataFrame([(r, c, v) for r, line in enumerate(rows) for c, v in enumerate(line)], "row int, col int, v int")


def test_zones_and_bodies(spark):
    px = lattice(spark, [[1, 1, 0, 0, 0, 1], [1, 0, 0, 0, 0, 1], [0, 0, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0], [0, 0, 0, 1, 1, 0], [0, 0, 0, 0, 1, 0]])
    gt = (0.0, 1.0, 0.0, 6.0, 0.0, -1.0)
    zones = spark.createDataFrame([(1, 1, rings([(0, 0), (3, 0), (3, 6), (0, 6)])), (2, 2, rings([(2, 0), (6, 0), (6, 6), (2, 6)])), (3, 3, rings([(50, 50), (51, 50), (51, 51)]))], f"zone long, draw_order int, rings {SHAPE}")
    z = raster.zoned(raster.centres(px, gt), zones, 2.0)
    assert z.where("row = 3 and col = 2").first()["zone"] == 2
    areas = {r["zone"]: r["area"] for r in raster.zone_areas(zones, z, F.col("v") == 1, 1.0).collect()}
    assert areas == {1: 3, 2: 6, 3: 0} and sum(areas.values()) == px.where("v = 1").count()
    b = raster.bodies(px, F.col("v") == 1, 6)
    assert {(r["body"], r["area"]) for r in b.collect()} == {(0, 3), (5, 2), (20, 1), (27, 3)}
    given = {r["zone"]: r["area"] for r in raster.body_areas(b, zones, gt, 2.0).collect()}
    assert given == {1: 4, 2: 5, 3: 0}


def test_bodies_of_every_month(spark):
    """Bodies don't join over months, and a month without a key is one of its own."""
    months = {"a": [[1, 1, 0], [0, 0, 1]], "b": [[0, 1, 1], [0, 0, 1]], None: [[1, 0, 0], [1, 0, 0]]}
    rows = [(m, r, c, v) for m, lines in months.items() for r, line in enumerate(lines) for c, v in enumerate(line)]
    px = spark.createDataFrame(rows, "period string, row int, col int, v int")
    b = raster.bodies(px, F.col("v") == 1, 3, by=["period"])
    assert {(r["period"], r["body"], r["area"]) for r in b.collect()} == {("a", 0, 2), ("a", 5, 1), ("b", 1, 3), (None, 0, 2)}
    zones = spark.createDataFrame([(1, 1, rings([(0, 0), (2, 0), (2, 2), (0, 2)])), (2, 2, rings([(2, 0), (3, 0), (3, 2), (2, 2)]))], f"zone long, draw_order int, rings {SHAPE}")
    areas = lambda **kw: {(r["period"], r["zone"]): r["area"] for r in raster.body_areas(b, zones, (0.0, 1.0, 0.0, 2.0, 0.0, -1.0), 2.0, by=["period"], **kw).collect()}
    wet = {("a", 1): 2, ("a", 2): 1, ("b", 2): 3, (None, 1): 2}
    assert areas() == wet and areas(zeros=True) == {("b", 1): 0, (None, 2): 0, **wet}


@pytest.mark.parametrize("tile", [5, 64])
def test_bodies_over_tiles(spark, tile):
    """Random water, a spiral, negative rows and a repeated pixel, at any tile size, against a flood."""
    draw = random.Random(tile)
    wet = {("noise", r - 5, c) for r in range(23) for c in range(20) if draw.random() < 0.6}
    r, c, dr, dc, turns = 0, 0, 0, 1, 0
    line = {(0, 0)}
    for length in (19, 19, 19, 17, 17, 15, 15, 13, 13, 11, 11, 9, 9, 7, 7, 5, 5, 3, 3):
        for _ in range(length):
            r, c = r + dr, c + dc
            line.add((r, c))
        dr, dc, turns = dc, -dr, turns + 1
    wet |= {(None, r, c) for r, c in line}
    root = {}
    for m, r, c in sorted(wet, key=lambda x: (str(x[0]), x[1], x[2])):
        todo = [] if (m, r, c) in root else [(m, r, c)]
        for p in todo:
            if p in wet and p not in root:
                root[p] = (m, r * 20 + c)
                todo += [(m, p[1] + i, p[2] + j) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))]
    rows = [*wet, max(wet, key=lambda x: (str(x[0]), x[1], x[2]))]
    px = spark.createDataFrame([(*p, 1) for p in rows] + [("noise", None, 3, 1), ("dry", 1, 1, 0)], "period string, row int, col int, v int")
    got = raster.bodies(px, F.col("v") == 1, 20, 2.0, ["period"], tile).collect()
    size = {}
    for p in rows:
        size[root[p]] = size.get(root[p], 0) + 2.0
    assert len(got) == len(rows)
    assert {(g["period"], g["row"], g["col"], g["body"], g["area"]) for g in got} == {(*p, root[p][1], size[root[p]]) for p in wet}
    assert raster.bodies(px.where("v = 0"), F.col("v") == 1, 20).count() == 0


def test_windows_give_the_raster_back(spark):
    px = lattice(spark, [[r * 8 + c for c in range(8)] for r in range(8)])
    w = raster.windows(px, 8, 8, 4, 2, ["v"])
    assert w.select("xoff", "yoff").distinct().count() == 9 == raster.window_positions(spark, 8, 8, 4, 2).count()
    back = raster.reassembled(w, px, "v")
    assert back.join(px.withColumnRenamed("v", "w"), ["row", "col"]).where("v != w").count() == 0
    p = raster.patches(w, "v").where("xoff = 2 and yoff = 4").first()["v"]
    assert p[0] == [34, 35, 36, 37] and len(p) == 4


def test_tiles_and_resampling(spark):
    tiles = spark.createDataFrame([(0, 1, [[1, 2], [3, 4]])], "tile_r int, tile_c int, data array<array<int>>")
    got = {(r["row"], r["col"]): r["value"] for r in raster.from_tiles(tiles, tile=2).collect()}
    assert got == {(0, 2): 1, (0, 3): 2, (1, 2): 3, (1, 3): 4}


def test_connected_against_union(spark):
    draw = random.Random(4)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)]
    root = {k: k for k in range(60)}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got.get(k, k) == find(k) for k in range(60))
