"""Spatial joins as equi-joins on cell numbers, with an exact test behind them.

A shape covers the cells its bounds touch; a point lies in one. Choose the cell size near that of the shapes: a shape
then has a few cells, and a cell a few shapes. A pair of shapes that share several cells is kept in one of them only,
so no distinct is needed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geometry as g
from .graph import settled


#: Halvings of an extent that tiles may take, and points that meet a tile in one group.
_DEEPEST, _DENSE = 40, 50_000


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def covered(shapes: DataFrame, rings: str, size: float, margin: float = 0.0) -> DataFrame:
    """A row for each cell that a shape's bounds, widened by margin, touch: cx, cy, and the bounds as b."""
    out = shapes.withColumn("b", g.bounds(F.col(rings)))
    span = lambda a: F.explode(F.sequence(_cell(F.col(f"b.{a}1") - margin, size), _cell(F.col(f"b.{a}2") + margin, size)))
    return out.withColumn("cx", span("x")).withColumn("cy", span("y"))


def points_in_shapes(points: DataFrame, shapes: DataFrame, size: float, x: str = "x", y: str = "y", rings: str = "rings") -> DataFrame:
    """Pairs of points and the shapes that contain them. Columns of both; names must differ."""
    at = points.withColumns({"cx": _cell(F.col(x), size), "cy": _cell(F.col(y), size)})
    pairs = at.join(covered(shapes, rings, size), ["cx", "cy"])
    return pairs.where(g.contains_point(F.col(rings), F.col(x), F.col(y))).drop("cx", "cy", "b")


def shapes_to_shapes(left: DataFrame, right: DataFrame, size: float, test: Callable[[Column, Column], Column] = g.intersects, left_rings: str = "rings", right_rings: str = "other_rings") -> DataFrame:
    """Pairs of shapes that pass the test. Columns of both; names must differ."""
    a = covered(left, left_rings, size).withColumnRenamed("b", "ba")
    b = covered(right, right_rings, size).withColumnRenamed("b", "bb")
    pairs = a.join(b, ["cx", "cy"])
    overlap = (F.col("ba.x1") <= F.col("bb.x2")) & (F.col("bb.x1") <= F.col("ba.x2")) & (F.col("ba.y1") <= F.col("bb.y2")) & (F.col("bb.y1") <= F.col("ba.y2"))
    once = (F.col("cx") == _cell(F.greatest("ba.x1", "bb.x1"), size)) & (F.col("cy") == _cell(F.greatest("ba.y1", "bb.y1"), size))
    return pairs.where(overlap & once).where(test(F.col(left_rings), F.col(right_rings))).drop("cx", "cy", "ba", "bb")


def largest_match(pairs: DataFrame, key: str, measure: str, tie: str) -> DataFrame:
    """Of each key's pairs the one with the largest measure, of ties the smallest tie key."""
    own = F.max_by(F.struct(*pairs.columns), F.struct(F.col(measure), -F.col(tie)))
    return pairs.groupBy(F.col(key).alias("__key")).agg(own.alias("r")).select("r.*")


def outermost(shapes: DataFrame, size: float, key: str = "id", rings: str = "rings") -> DataFrame:
    """Shapes that lie in no other, and whose centroid lies in none with a smaller key."""
    other = shapes.select(F.col(key).alias("other"), F.col(rings).alias("other_rings"))
    pairs = shapes_to_shapes(shapes.select(key, rings), other, size, g.intersects, rings).where(F.col(key) != F.col("other"))
    c = g.centroid(F.col(rings))
    inner = g.within(F.col(rings), F.col("other_rings")) & ~(g.within(F.col("other_rings"), F.col(rings)) & (F.col("other") > F.col(key)))
    held = g.contains_point(F.col("other_rings"), c["x"], c["y"]) & (F.col("other") < F.col(key))
    return shapes.join(pairs.where(inner | held).select(key).distinct(), key, "left_anti")


def nearest(points: DataFrame, targets: DataFrame, size: float, key: str = "id", target: str = "target", most: int = 1024) -> DataFrame:
    """(key, target, distance): the nearest target of every point, of ties the smallest; null without targets.

    Both have x and y; rows without a finite place are passed over. Targets lie in tiles, cells of size times a power of two with
    no more than `most` places each, and one target of each tile is tried first: the nearest of those, found in the same way
    until they are few, bounds a point's distance, and a point meets the tiles within that bound only. So no point meets all
    targets of a dense cell, near or far.
    """
    if most < 64:  # a split makes up to 16 tiles, and tiles must be fewer than targets
        raise ValueError(f"{most} places are too few for a tile")
    t = targets.select(F.col(target), F.col("x").cast("double").alias("tx"), F.col("y").cast("double").alias("ty")).where(_finite("tx") & _finite("ty"))
    t = settled(t.groupBy("tx", "ty").agg(F.min(target).alias(target)))
    if not t.take(1):
        return points.select(key, F.lit(None).cast(targets.schema[target].dataType).alias(target), F.lit(None).cast("double").alias("distance"))
    p = points.select(F.col(key), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(_finite("x") & _finite("y"))
    best = _nearest_of(p, t, size, key, target, most).groupBy(key).agg(F.min(F.struct("distance", target)).alias("m"))
    return best.select(key, F.col(f"m.{target}").alias(target), F.col("m.distance").alias("distance"))


def _finite(c: str) -> Column:
    return F.abs(c) < float("inf")


def _meeting(key: str, target: str) -> Callable:
    """A function of an Arrow table of points and one of targets, which are sorted by target: the points with their nearest, a block of distances at a time."""

    def met(points, targets):
        import numpy as np
        import pyarrow as pa

        x, y, tx, ty = (c.to_numpy() for c in (points["x"], points["y"], targets["tx"], targets["ty"]))
        at, d = np.empty(len(x), np.int64), np.empty(len(x))
        step = max(1, 1_000_000 // max(1, len(tx)))
        for k in range(0, len(x), step):
            own = slice(k, k + step)
            far = np.sqrt((x[own, None] - tx) ** 2 + (y[own, None] - ty) ** 2)
            at[own] = far.argmin(1)  # the first of equals
            d[own] = far[np.arange(len(far)), at[own]]
        return pa.table({key: points[key], "x": points["x"], "y": points["y"], target: targets[target].take(pa.array(at)), "distance": pa.array(d)})

    return met


def _nearest_of(p: DataFrame, t: DataFrame, size: float, key: str, target: str, most: int) -> DataFrame:
    """(key, x, y, target, distance), a row for each place of a key; targets are of different places."""
    met_by = _meeting(key, target)
    schema = T.StructType([*p.schema.fields, t.schema[target], T.StructField("distance", T.DoubleType())])
    n, x1, x2, y1, y2 = t.agg(F.count(F.lit(1)), F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty")).first()
    if n <= 4 * most:
        few = t.orderBy(target).toArrow().combine_chunks()

        def first(batches):
            import pyarrow as pa

            for batch in batches:
                yield from met_by(pa.Table.from_batches([batch]), few).to_batches()

        return p.mapInArrow(first, schema)

    top = size * 2.0 ** max(0, math.ceil(math.log2(max(x2 - x1, y2 - y1) / size)))
    u, v = (F.col("tx") - x1) / top, (F.col("ty") - y1) / top
    # Products with powers of two are exact, so a cell's number shifted is that of the cell around it.
    within = lambda df, k: df.withColumns({"k": F.lit(k), "cx": F.floor(u * 2.0**k), "cy": F.floor(v * 2.0**k)})
    tile, tiled, open_, k = ["k", "cx", "cy"], None, t, int(math.log(n / most, 4))
    while True:
        cut = within(open_, k)
        crowded = settled(cut.groupBy(*tile).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).drop("n"))
        last = k >= _DEEPEST or not crowded.take(1)
        held = cut if last else cut.join(F.broadcast(crowded), tile, "left_anti")
        tiled = held if tiled is None else tiled.unionByName(held)
        if last:
            break
        open_ = cut.join(F.broadcast(crowded), tile, "left_semi").drop(*tile)
        k += 2
    tiled = settled(tiled)
    spans = {f"b{c}{e}": f(f"t{c}") for c in "xy" for e, f in (("1", F.min), ("2", F.max))}
    tiles = settled(tiled.groupBy(*tile).agg(*(f.alias(c) for c, f in spans.items()), F.min(F.struct(target, "tx", "ty")).alias("one")))
    bound = _nearest_of(p, tiles.select("one.*"), size, key, target, most).select(key, "x", "y", F.col("distance").alias("d"))

    # A point looks at the depth whose cells its circle touches two of each way, where each tile counts in the cell around it, and in the
    # larger tiles it touches.
    depths = sorted(r[0] for r in tiles.select("k").distinct().collect())
    radius = F.col("d") / top * (1 + 1e-9) + 1e-12
    depth = F.greatest(F.lit(0), F.least(F.lit(depths[-1]), F.floor(-F.log2(2 * radius)).cast("int")))
    looks = bound.withColumns({"pu": (F.col("x") - x1) / top, "pv": (F.col("y") - y1) / top, "r": radius, "own": depth})
    looks = looks.withColumn("at", F.explode(F.array_append(F.filter(F.array(*map(F.lit, depths)), lambda z: z < F.col("own")), F.col("own"))))
    wide = F.pow(F.lit(2.0), F.col("at"))
    cell = lambda c: F.least(wide, F.greatest(F.lit(0.0), F.floor(c * wide).cast("double"))).cast("long")
    span = lambda c: F.explode(F.sequence(cell(F.col(c) - F.col("r")), cell(F.col(c) + F.col("r"))))
    looks = looks.withColumn("ax", span("pu")).withColumn("ay", span("pv"))
    around = tiles.drop("one").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("k"))))
    around = around.withColumns({a: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("k") - F.col("at"))) for a, c in (("ax", "cx"), ("ay", "cy"))})
    gap = lambda c: F.greatest(F.col(f"b{c}1") - F.col(c), F.lit(0.0), F.col(c) - F.col(f"b{c}2"))
    near = looks.join(around, ["at", "ax", "ay"]).where((F.col("at") == F.col("own")) | (F.col("at") == F.col("k")))
    near = settled(near.where(F.sqrt(gap("x") * gap("x") + gap("y") * gap("y")) <= F.col("d") * (1 + 1e-9)).select(key, "x", "y", *tile))

    # Tiles that many points meet are dealt to salts.
    salts = settled(near.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / _DENSE).cast("int").alias("salts")).where("salts > 1"))
    many = F.coalesce("salts", F.lit(1))
    near = near.join(F.broadcast(salts), tile, "left").withColumn("salt", F.pmod(F.xxhash64("x", "y", key), many).cast("int")).drop("salts")
    held = tiled.join(F.broadcast(salts), tile, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("salts")

    none = to_arrow_schema(schema).empty_table()

    def second(points, targets):
        # A tile with points has targets, but not the other way about.
        return met_by(points, targets.sort_by(target)) if points.num_rows else none

    near = near.select(key, "x", "y", *(F.col(c).alias(f"p_{c}") for c in [*tile, "salt"]))
    met = near.groupBy(*(f"p_{c}" for c in [*tile, "salt"])).cogroup(held.groupBy(*tile, "salt")).applyInArrow(second, schema)
    best = met.groupBy(key, "x", "y").agg(F.min(F.struct("distance", target)).alias("m"))
    return best.select(key, "x", "y", F.col(f"m.{target}").alias(target), F.col("m.distance").alias("distance"))


def grid(spark, x1: float, y1: float, x2: float, y2: float, size: float) -> DataFrame:
    """(cell, rings): squares over an extent, numbered down the columns; edges may overhang."""
    nx, ny = (math.ceil(round(d / size, 9)) for d in (x2 - x1, y2 - y1))
    out = spark.range(nx * ny).select(F.col("id").alias("cell"), F.floor(F.col("id") / ny).alias("i"), (F.col("id") % ny).alias("j"))
    x, y = x1 + F.col("i") * size, y1 + F.col("j") * size
    return out.select("cell", g.box(x, y, x + size, y + size).alias("rings"))


def cell_of(x: Column, y: Column, x1: float, y1: float, size: float, rows: int) -> Column:
    """The number of the first grid cell that holds a point, both edges included: a point on an edge takes the lower one."""
    at = lambda v, low: F.greatest(F.lit(0), F.ceil((v - low) / size) - 1)
    return at(x, x1) * rows + at(y, y1)


def dissolved(parts: DataFrame, key: str, rings: str = "rings", attributes: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """One multipart shape for each key, with the attributes of its first part."""
    o = F.col(order or key)
    return parts.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(o.alias("o"), F.col(rings).alias("r")))), lambda s: s["r"])).alias(rings), *(F.min_by(a, o).alias(a) for a in attributes))


def touching(tiles: DataFrame, boundary: DataFrame, size: float, key: str = "tile") -> DataFrame:
    """Tiles that touch a boundary shape."""
    other = boundary.select(F.col("rings").alias("other_rings"))
    return tiles.join(shapes_to_shapes(tiles.select(key, "rings"), other, size).select(key).distinct(), key, "left_semi")


def within_distance(points: DataFrame, shapes: DataFrame, distance: str, size: float, most: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs of points and shapes no farther than the shape's own distance (at most `most`): a buffer that is never drawn."""
    at = points.withColumns({"cx": _cell(F.col(x), size), "cy": _cell(F.col(y), size)})
    pairs = at.join(covered(shapes, "rings", size, most), ["cx", "cy"])
    return pairs.where(g.distance_to(F.col("rings"), F.col(x), F.col(y)) <= F.col(distance)).drop("cx", "cy", "b")


def simplified(shapes: DataFrame, tolerance: float, rings: str = "rings") -> DataFrame:
    """Douglas-Peucker on every ring; rings keep their first corner and at least three."""
    def thin(points: list, tolerance: float) -> list:
        keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
        while todo:
            a, b = todo.pop()
            (x1, y1), (x2, y2) = points[a], points[b]
            size = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
            far, at = 0.0, None
            for k in range(a + 1, b):
                x, y = points[k]
                d = abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / size if size else ((x - x1) ** 2 + (y - y1) ** 2) ** 0.5
                if d > far:
                    far, at = d, k
            if at is not None and far > tolerance:
                keep.add(at)
                todo += [(a, at), (at, b)]
        return [points[k] for k in sorted(keep)]

    kind = shapes.schema[rings].dataType

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for shape in batch.column(rings).to_pylist():
                new = []
                for r in shape or []:
                    corners = [(p["x"], p["y"]) for p in r]
                    less = thin([*corners, corners[0]], tolerance)[:-1]
                    new.append([{"x": x, "y": y} for x, y in (less if len(less) >= 3 else corners)])
                out.append(new if shape is not None else None)
            column = pa.array(out, pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
            yield pa.RecordBatch.from_arrays([column if c == rings else batch.column(c) for c in batch.schema.names], batch.schema.names)

    assert isinstance(kind, T.ArrayType)
    return shapes.mapInArrow(run, shapes.schema)


def with_shapes(areas: DataFrame, shapes: DataFrame, key: str, shape_key: str, to_centroid: bool = False, to: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Areas with the rings of the shape whose key matches, or with its centroid's x and y instead; entities without a shape drop out.

    to(x, y) moves the corners to another coordinate system first.
    """
    own = shapes.select(F.col(shape_key).alias(key), (g.reprojected(F.col("rings"), to) if to else F.col("rings")).alias("rings"))
    if to_centroid:
        own = own.select(key, g.centroid(F.col("rings")).alias("c")).select(key, F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    return areas.join(own, key)
