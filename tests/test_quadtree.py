"""Joins over a quadtree and raster tables in Morton order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tidewright.functions import geometry as g
from tidewright.operators import quadtree
from tidewright.sources import rasters

SHAPE = "array<array<struct<x:double,y:double>>>"


def square(x, y, w, h):
    return [[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]]


def items(seed: int, n: int):
    draw = random.Random(seed)
    return [(k, square(draw.uniform(-50, 50), draw.uniform(-50, 50), 10 ** draw.uniform(-2, 3), 10 ** draw.uniform(-2, 3))) for k in range(n)]


@pytest.mark.parametrize(("size", "per_side", "dense"), [(0.5, 4, 100_000), (3.0, 1, 5), (1000.0, 2, 1)])
def test_points_at_any_depth(spark, size, per_side, dense):
    draw = random.Random(2)
    rows = [(j, draw.uniform(-60, 60), draw.uniform(-60, 60)) for j in range(200)] + [(500 + j, 1.25, 2.5) for j in range(60)]
    pts = spark.createDataFrame(rows, "pid int, x double, y double").repartition(3)
    shapes = spark.createDataFrame([*items(1, 40), (99, None), (98, [])], f"sid int, rings {SHAPE}")
    want = {(p, s) for p, x, y in rows for s, r in items(1, 40) if r[0][0]["x"] <= x <= r[0][2]["x"] and r[0][0]["y"] <= y <= r[0][2]["y"]}
    got = [(r["pid"], r["sid"]) for r in quadtree.points_in_shapes(pts, shapes, size, per_side=per_side, dense=dense).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert quadtree.points_in_shapes(pts, shapes.where("false"), size).collect() == []


@pytest.mark.parametrize(("size", "per_side", "dense"), [(0.5, 4, 100_000), (3.0, 2, 3)])
def test_shapes_of_all_sizes(spark, size, per_side, dense):
    a, b = items(3, 50), items(4, 60)
    left = spark.createDataFrame(a, f"a int, rings {SHAPE}").repartition(2)
    right = spark.createDataFrame(b, f"b int, other_rings {SHAPE}").repartition(2)
    over = lambda r, s: r[0][0]["x"] <= s[0][2]["x"] and s[0][0]["x"] <= r[0][2]["x"] and r[0][0]["y"] <= s[0][2]["y"] and s[0][0]["y"] <= r[0][2]["y"]
    got = [(r["a"], r["b"]) for r in quadtree.shapes_to_shapes(left, right, size, per_side=per_side, dense=dense).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, r in a for j, s in b if over(r, s)}


def test_large_shapes_and_dense_cells_stay_bounded(spark):
    """A shape over a million cells has sixteen of them at most; 90 % of the points in one place are dealt evenly."""
    shapes = spark.createDataFrame([(1, square(-500, -500, 1000, 1000)), (2, square(0, 0, 0.5, 0.5))], f"sid int, rings {SHAPE}")
    own = quadtree.held(shapes, "rings", 1.0, name="__b")
    cells = {r["sid"]: r["n"] for r in quadtree._cells(own, "__b", 1.0, F.col("__b_k")).groupBy("sid").agg(F.count("*").alias("n")).collect()}
    assert cells[1] <= 16 and cells[2] <= 16
    pts = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") / 1000).otherwise(0.25).alias("x"), F.lit(0.25).alias("y"))
    at = pts.withColumn("__k", F.lit(0)).withColumns({"__cx": F.floor("x"), "__cy": F.floor("y")})
    few = quadtree._cells(own, "__b", 1.0, F.col("__b_k"))
    met = quadtree._met(at, few, 500).where("sid = 2").groupBy("__cx", "__cy", "__salt").count().collect()
    assert max(r["count"] for r in met) < 700 and sum(r["count"] for r in met) > 18_000
    assert quadtree.points_in_shapes(pts, shapes, 1.0, dense=500).count() == 20_000 + pts.where("x <= 0.5").count()


def test_morton_keys_and_ranges():
    draw = random.Random(6)
    for _ in range(30):
        r1, c1 = draw.randint(0, 40), draw.randint(0, 40)
        r2, c2 = r1 + draw.randint(0, 20), c1 + draw.randint(0, 20)
        exact = {rasters._key(r, c) for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)}
        for pieces in (4, 64, 10_000):
            found = rasters.ranges(r1, r2, c1, c2, pieces)
            assert all(any(a <= k <= b for a, b in found) for k in exact) and all(x[1] + 1 < y[0] for x, y in zip(found, found[1:]))
        assert sum(b - a + 1 for a, b in found) == len(exact)
    assert rasters.ranges(5, 4, 0, 0) == []


def test_crop_reads_few_row_groups(spark, tmp_path):
    """The scan gives fewer rows than the table has; the key is the interleaved bits."""
    px = spark.range(512 * 512).select((F.col("id") % 512).cast("int").alias("row"), F.floor(F.col("id") / 512).cast("int").alias("col"), F.col("id").alias("v"))
    keys = px.where("row % 97 = 3 and col % 89 = 5").select("row", "col", rasters.morton(F.col("row"), F.col("col")).alias("m")).collect()
    assert keys and all(r["m"] == rasters._key(r["row"], r["col"]) for r in keys)
    rasters.write(px, f"{tmp_path}/t", parts=16, row_group_bytes=65_536)
    cut = rasters.read(spark, f"{tmp_path}/t", 100, 140, 300, 333)
    rows = cut.collect()
    assert {(r["row"], r["col"], r["v"]) for r in rows} == {(r, c, c * 512 + r) for r in range(100, 141) for c in range(300, 334)} and cut.columns == ["row", "col", "v"]
    scans, todo = [], [cut._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            plan = plan.executedPlan()
        if plan.nodeName().startswith("Scan"):
            scans.append(plan.metrics().apply("numOutputRows").value())
        todo += [plan.children().apply(k) for k in range(plan.children().size())]
    assert scans and len(rows) <= scans[0] < 512 * 512 / 4


def test_bounds_of_parts(spark):
    df = spark.createDataFrame([(1, square(0, 0, 1, 1) + square(5, 6, 1, 1))], f"id int, rings {SHAPE}")
    assert df.select(g.bounds(F.col("rings")).alias("b")).first()["b"].asDict() == {"x1": 0, "y1": 0, "x2": 6, "y2": 7}
