"""Projections there and back, runs of pixels, unions of polygons: against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F
from tidewright.functions import geometry as g
from tidewright.operators import raster, spatial, union

SHAPE = "array<array<struct<x:double,y:double>>>"
GT = (10.0, 2.0, 0.0, 50.0, 0.0, -2.0)
CONICS = [(10.0, 40.0, 30.0, 50.0), (0.0, 30.0, 20.0, 40.0), (-70.0, -30.0, -20.0, -40.0), (100.0, 45.0, 45.0, 45.0)]


def rings(*parts):
    return [[{"x": float(x), "y": float(y)} for x, y in part] for part in parts]


def star(draw, x, y, size, corners, whole=False):
    angles = sorted(draw.uniform(0, 2 * math.pi) for _ in range(corners))
    out = [(x + draw.uniform(0.2, 1) * size * math.cos(a), y + draw.uniform(0.2, 1) * size * math.sin(a)) for a in angles]
    return [(round(a), round(b)) for a, b in out] if whole else out


@pytest.mark.parametrize("conic", CONICS)
def test_conic_there_and_back(spark, conic):
    """Within a millimetre, as 1e-8 degrees are."""
    lon0, lat0 = conic[:2]
    rows = [(lon0 + a, max(-85.0, min(85.0, lat0 + b))) for a in (-40, -7.5, -1e-6, 0, 3, 55) for b in (-35, -10, -1e-7, 0, 12.25, 40)]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("p", g.lcc(F.col("lon"), F.col("lat"), *conic))
    for r in df.withColumn("q", g.lcc_inverse(F.col("p.x"), F.col("p.y"), *conic)).collect():
        assert abs(r["q"]["lon"] - r["lon"]) < 1e-9 and abs(r["q"]["lat"] - r["lat"]) < 1e-9


@pytest.mark.parametrize("centre", [(0.0, 30.0), (170.0, -52.0), (-60.0, 0.0), (20.0, 85.0)])
def test_equal_area_there_and_back(spark, centre):
    lon0, lat0 = centre
    rows = [(lon0 + a, max(-89.9, min(89.9, lat0 + b))) for a in (-60, -7.5, -1e-6, 0, 3, 80) for b in (-60, -10, -1e-7, 0, 12.25, 50)]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("p", g.laea(F.col("lon"), F.col("lat"), lon0, lat0))
    for r in df.withColumn("q", g.laea_inverse(F.col("p.x"), F.col("p.y"), lon0, lat0)).collect():
        assert abs(r["q"]["lon"] - r["lon"]) < 1e-8 and abs(r["q"]["lat"] - r["lat"]) < 1e-9


def test_warp_of_a_plane(spark):
    """Bilinear values of a linear raster are linear in the source's coordinates."""
    px = spark.createDataFrame([(r, c, 3.0 * r + c) for r in range(40) for c in range(40)], "row int, col int, v double")
    turn = lambda x, y: F.struct((0.8 * x - 0.3 * y + 9).alias("x"), (0.3 * x + 0.8 * y - 4).alias("y"))
    target = spark.createDataFrame([(r, c) for r in range(8) for c in range(8)], "row int, col int")
    got = raster.resampled(px, (0.0, 1.0, 0.0, 40.0, 0.0, -1.0), target, (12.0, 1.5, 0.0, 32.0, 0.0, -1.5), "v", "bilinear", turn).collect()
    assert len(got) == 64
    for r in got:
        x, y = 12 + (r["col"] + 0.5) * 1.5, 32 - (r["row"] + 0.5) * 1.5
        sx, sy = 0.8 * x - 0.3 * y + 9, 0.3 * x + 0.8 * y - 4
        assert r["v"] == pytest.approx(3 * (40 - sy - 0.5) + sx - 0.5)


def cases(seed: int, whole: bool):
    draw = random.Random(seed)
    out = [(k, k % 7, rings(star(draw, draw.uniform(10, 50), draw.uniform(10, 50), draw.choice([0.4, 3, 12]), draw.randint(3, 9), whole))) for k in range(40)]
    out.append((90, 20, rings([(12, 12), (40, 12), (40, 40), (12, 40)], [(20, 20), (30, 20), (30, 31), (20, 31)])))
    out.append((91, 3, rings([(10, 10), (60, 10.2), (60, 10.21)])))
    return out


@pytest.mark.parametrize("whole", [False, True])
def test_scanlines_find_what_points_find(spark, whole):
    """Holes, slivers, corners on pixel centres, shapes beyond the raster; the last drawn wins."""
    shapes = spark.createDataFrame(cases(3, whole), f"zone long, draw_order int, rings {SHAPE}").repartition(3)
    shapes = shapes.withColumn("draw_order", F.col("draw_order") * 100 + F.col("zone").cast("int"))
    px = spark.createDataFrame([(r, c) for r in range(20) for c in range(22)], "row int, col int")
    gt = (10.0, 2.0, 0.0, 51.0, 0.0, -2.0) if whole else GT
    plain = {(r["row"], r["col"]): r["zone"] for r in raster.zoned(raster.centres(px, gt), shapes, 8.0).collect()}
    assert {(r["row"], r["col"]): r["zone"] for r in raster.scanned(px, shapes, gt).collect()} == plain and len(set(plain.values())) > 8


def passes(a, b, r, c) -> bool:
    """Whether a side in pixel coordinates passes through the inside of a pixel: no line separates them."""
    (x1, y1), (x2, y2) = a, b
    turns = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (c, c + 1) for y in (r, r + 1)]
    return min(x1, x2) < c + 1 and max(x1, x2) > c and min(y1, y2) < r + 1 and max(y1, y2) > r and min(turns) < 0 < max(turns)


@pytest.mark.parametrize(("seed", "whole"), [(4, False), (5, True)])
def test_all_touched(spark, seed, whole):
    items = cases(seed, whole)
    shapes = spark.createDataFrame(items, f"zone long, draw_order int, rings {SHAPE}").repartition(3)
    got = {}
    for r in raster.spans(shapes, GT, ["zone"], all_touched=True).collect():
        got.setdefault(r["zone"], set()).update((r["row"], c) for c in range(r["first"], r["last"] + 1))
    inside = {}
    for r in raster.spans(shapes, GT, ["zone"]).collect():
        inside.setdefault(r["zone"], set()).update((r["row"], c) for c in range(r["first"], r["last"] + 1))
    for zone, _, shape in items:
        want = set(inside.get(zone, ()))
        for ring in shape:
            at = [((p["x"] - GT[0]) / GT[1], (p["y"] - GT[3]) / GT[5]) for p in ring]
            for a, b in zip(at, at[1:] + at[:1]):
                rows, cols = (range(math.floor(min(a[k], b[k])) - 1, math.ceil(max(a[k], b[k])) + 1) for k in (1, 0))
                want |= {(r, c) for r in rows for c in cols if passes(a, b, r, c)}
        assert got.get(zone, set()) == want, zone


def test_touched_squares_on_pixel_borders(spark):
    """Sides along borders pass through no pixel's inside, so a square of whole pixels is just these."""
    shapes = spark.createDataFrame([(1, rings([(12, 40), (16, 40), (16, 44), (12, 44)])), (2, rings([(20.5, 20.5), (20.7, 20.5), (20.7, 20.7)]))], f"zone long, rings {SHAPE}")
    got = {(r["zone"], r["row"], r["first"], r["last"]) for r in raster.spans(shapes, GT, ["zone"], all_touched=True).collect()}
    assert got == {(1, 3, 1, 2), (1, 4, 1, 2), (2, 14, 5, 5)}
    assert raster.spans(shapes.where("zone = 2"), GT, ["zone"]).count() == 0


def square(x, y, s):
    return rings([(x, y), (x + s, y), (x + s, y + s), (x, y + s)])


def area_of(shape) -> float:
    return sum(sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(r, r[1:] + r[:1])) / 2 for r in shape)


@pytest.mark.parametrize("size", [0.7, 3.0, 100.0])
def test_union_of_squares(spark, size):
    """Overlapping, touching, nested and repeated squares; a ring of squares leaves a hole; cells of any size."""
    frame = [square(0, 0, 2), square(1, 0, 2), square(2, 0, 2), square(0, 1, 2), square(0, 2, 2), square(2, 2, 2), square(1, 2.5, 1.5), square(2.5, 1, 1.5)]
    rows = [("a", s) for s in frame] + [("b", square(0, 0, 1)), ("b", square(0, 0, 1)), ("b", square(1, 0, 1)), ("c", square(0, 0, 3)), ("c", square(1, 1, 1)), ("d", square(5, 5, 1)), ("d", square(6, 6, 1)), (None, square(0, 0, 1)), ("e", None)]
    df = spark.createDataFrame(rows, f"k string, rings {SHAPE}").repartition(3)
    cells = 200
    want = {}
    for k, s in rows:
        if s:
            (x, y), (z, w) = (s[0][0]["x"], s[0][0]["y"]), (s[0][2]["x"], s[0][2]["y"])
            want.setdefault(k, set()).update((i, j) for i in range(round(x * cells / 4), round(z * cells / 4)) for j in range(round(y * cells / 4), round(w * cells / 4)))
    got = {r["k"]: r["area"] for r in union.united_areas(union.boundary(df, "k", size), "k").collect()}
    assert got == pytest.approx({k: len(v) * (4 / cells) ** 2 for k, v in want.items()})
    shapes = {r["k"]: [[p.asDict() for p in ring] for ring in r["rings"]] for r in union.united(df, "k", size).collect()}
    assert {k: area_of(s) for k, s in shapes.items()} == pytest.approx(got)
    assert len(shapes["c"]) == 1 and len(shapes["b"]) == 1 and sorted(len(r) for r in shapes["b"]) == [4] and len(shapes["d"]) == 2


def test_union_of_stars(spark):
    """Random polygons with slanted sides: area and membership by sampled points."""
    draw = random.Random(8)
    rows = [(k % 3, rings(star(draw, draw.uniform(0, 10), draw.uniform(0, 10), 3, draw.randint(3, 8)))) for k in range(45)]
    df = spark.createDataFrame(rows, f"k int, rings {SHAPE}").repartition(4)
    united = union.united(df, "k", 2.5)
    shapes = {r["k"]: [[p.asDict() for p in ring] for ring in r["rings"]] for r in united.collect()}
    areas = {r["k"]: r["area"] for r in union.united_areas(union.boundary(df, "k", 2.5), "k").collect()}
    other = {r["k"]: r["area"] for r in union.united_areas(union.boundary(df, "k", 40.0), "k").collect()}
    assert {k: area_of(s) for k, s in shapes.items()} == pytest.approx(areas) and areas == pytest.approx(other)
    pts = spark.createDataFrame([(j, draw.uniform(-3, 13), draw.uniform(-3, 13)) for j in range(400)], "id int, x double, y double")
    own = {(r["id"], r["k"]) for r in spatial.points_in_shapes(pts, df, 2.5).collect()}
    assert {(r["id"], r["k"]) for r in spatial.points_in_shapes(pts, united, 2.5).collect()} == own and len(own) > 100


def test_a_stored_model(spark, tmp_path):
    """Two layers against plain loops; a patch with a null or of another size has no mask."""
    import numpy as np

    draw = np.random.default_rng(1)
    layers = [(draw.normal(size=(3, 1, 3, 3)), draw.normal(size=3)), (draw.normal(size=(1, 3, 3, 3)), np.array([0.1]))]
    raster.store_model(spark, layers, f"{tmp_path}/m")
    patches = [draw.normal(size=(6, 7)).tolist() for _ in range(9)]
    rows = [(k, v) for k, v in enumerate(patches)] + [(90, [[1.0, None], *patches[0][1:]]), (91, [[1.0]]), (92, None)]
    df = spark.createDataFrame(rows, "id int, v array<array<double>>").repartition(3)
    got = {r["id"]: r["mask"] for r in raster.predicted_patches(df, raster.loaded_model(spark, f"{tmp_path}/m"), "v", 6, 7, border=1, batch_size=4).collect()}
    for key, v in enumerate(patches):
        x = np.array(v)[None]
        for j, (w, b) in enumerate(layers):
            pad = np.pad(x, ((0, 0), (1, 1), (1, 1)))
            x = np.array([[[(pad[:, r : r + 3, c : c + 3] * w[o]).sum() + b[o] for c in range(7)] for r in range(6)] for o in range(len(w))])
            x = np.maximum(x, 0) if j == 0 else x
        assert got[key] == (x[0, 1:-1, 1:-1] > 0).astype(int).tolist()
    assert got[90] is None and got[91] is None and got[92] is None
