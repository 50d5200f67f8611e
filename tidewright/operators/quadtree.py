"""Spatial joins over a quadtree: shapes of any sizes and cells of any density.

Depth k has cells of size * 2^k. A shape is held at the smallest depth where its bounds touch no more than `per_side` cells
each way, so it never has more than per_side^2 of them, however large it is. A point looks in its cell of every depth that
some shape has: there are no more of these than doublings from the smallest shape to the largest. A pair meets at one depth, the
deeper one of two shapes, and in one cell of it.

Cells with over `dense` rows are split: their rows are dealt to salts of about that many, and what they meet goes to each.
There are no more such cells than rows divided by `dense`, so the list of them is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .graph import settled
from .spatial import _cell

KEY = ["__k", "__cx", "__cy"]


def _depth(b: str, size: float, per_side: int) -> Column:
    span = F.greatest(F.col(f"{b}.x2") - F.col(f"{b}.x1"), F.col(f"{b}.y2") - F.col(f"{b}.y1"))
    # A span of per_side - 1 cells touches per_side of them.
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(span, F.lit(size)) / (size * max(1, per_side - 1)))).cast("int"))


def held(shapes: DataFrame, rings: str, size: float, per_side: int = 4, name: str = "b") -> DataFrame:
    """shapes with their bounds (`name`) and depth (`name`_k); shapes without a corner drop out."""
    out = shapes.withColumn(name, g.bounds(F.col(rings))).where(F.col(f"{name}.x1").isNotNull())
    return out.withColumn(f"{name}_k", _depth(name, size, per_side))


def _cells(shapes: DataFrame, b: str, size: float, depth: Column) -> DataFrame:
    """A row for each cell of a depth that the bounds touch."""
    out = shapes.withColumn("__k", depth)
    wide = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("__k"))
    span = lambda a: F.explode(F.sequence(_cell(F.col(f"{b}.{a}1"), wide), _cell(F.col(f"{b}.{a}2"), wide)))
    return out.withColumn("__cx", span("x")).withColumn("__cy", span("y"))


def _depths(shapes: DataFrame, column: str) -> list[int]:
    return sorted(r[0] for r in shapes.select(column).distinct().collect())


def _met(many: DataFrame, few: DataFrame, dense: int) -> DataFrame:
    """The equi-join by cell; rows of `many` in dense cells are salted, those of `few` that meet them repeated."""
    counts = many.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense)
    crowded = settled(counts.select(*KEY, F.ceil(F.col("n") / dense).cast("int").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    left = many.join(F.broadcast(crowded), KEY, "left").withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), salts).cast("int")).drop("__salts")
    right = few.join(F.broadcast(crowded), KEY, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return left.join(right, [*KEY, "__salt"])


def points_in_shapes(points: DataFrame, shapes: DataFrame, size: float, x: str = "x", y: str = "y", rings: str = "rings", per_side: int = 4, dense: int = 100_000) -> DataFrame:
    """Pairs of points and the shapes that contain them. Columns of both; names must differ."""
    own = held(shapes, rings, size, per_side, "__b")
    depths = _depths(own, "__b_k")
    if not depths:
        return points.join(shapes, F.lit(False))
    at = points.withColumn("__k", F.explode(F.array(*map(F.lit, depths))))
    wide = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("__k"))
    at = at.withColumns({"__cx": _cell(F.col(x), wide), "__cy": _cell(F.col(y), wide)})
    pairs = _met(at, _cells(own, "__b", size, F.col("__b_k")), dense)
    near = F.col(x).between(F.col("__b.x1"), F.col("__b.x2")) & F.col(y).between(F.col("__b.y1"), F.col("__b.y2"))
    return pairs.where(near & g.contains_point(F.col(rings), F.col(x), F.col(y))).select(*points.columns, *shapes.columns)


def shapes_to_shapes(
    left: DataFrame, right: DataFrame, size: float, test: Callable[[Column, Column], Column] = g.intersects, left_rings: str = "rings", right_rings: str = "other_rings", per_side: int = 4, dense: int = 100_000
) -> DataFrame:
    """Pairs of shapes that pass the test. Columns of both; names must differ."""
    a, b = held(left, left_rings, size, per_side, "__a"), held(right, right_rings, size, per_side, "__b")
    depths = sorted({*_depths(a, "__a_k"), *_depths(b, "__b_k")})
    if not depths:
        return left.join(right, F.lit(False))
    # A shape is there at its own depth and at all deeper ones that the other side has; the pair meets at the larger of both.
    of = lambda s, k: _cells(s, k.removesuffix("_k"), size, F.explode(F.filter(F.array(*map(F.lit, depths)), lambda d: d >= F.col(k))))
    pairs = _met(of(a, "__a_k"), of(b, "__b_k"), dense).where(F.col("__k") == F.greatest("__a_k", "__b_k"))
    overlap = (F.col("__a.x1") <= F.col("__b.x2")) & (F.col("__b.x1") <= F.col("__a.x2")) & (F.col("__a.y1") <= F.col("__b.y2")) & (F.col("__b.y1") <= F.col("__a.y2"))
    wide = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("__k"))
    once = (F.col("__cx") == _cell(F.greatest("__a.x1", "__b.x1"), wide)) & (F.col("__cy") == _cell(F.greatest("__a.y1", "__b.y1"), wide))
    return pairs.where(overlap & once).where(test(F.col(left_rings), F.col(right_rings))).select(*left.columns, *right.columns)
