"""Queries of geometry, spatial joins and rasters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import quadtree, raster, rollup, spatial, union
from . import Plans
from .proxies import BOXES_SQL, PIXELS_SQL, POINTS_SQL, SUPPLIERS_SQL, boxes, pixels, points, suppliers, table
from .series_plans import _rounded

plans = Plans()
_PB = f"{POINTS_SQL}, {BOXES_SQL}"
GT = (0.0, 30.0, 0.0, 1920.0, 0.0, -30.0)


def _shapes(spark: SparkSession, sf_dir: str, kind=g.box) -> DataFrame:
    return boxes(spark, sf_dir).select("box", kind(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("rings"))


def _zones(spark: SparkSession) -> DataFrame:
    """Zones over the 64 by 64 raster, drawn in order; the third lies over parts of the first two."""
    rows = [(k, k, *map(float, b)) for k, b in enumerate([(0, 0, 960, 960), (960, 0, 1920, 960), (480, 480, 1440, 1440), (1500, 1500, 1530, 1530), (5000, 0, 5100, 100)], 1)]
    return spark.createDataFrame(rows, "zone long, draw_order int, x1 double, y1 double, x2 double, y2 double").select("zone", "draw_order", g.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("rings"))


_ZONE_SQL = "CASE WHEN x BETWEEN 1500 AND 1530 AND yy BETWEEN 1500 AND 1530 THEN 4 WHEN x BETWEEN 480 AND 1440 AND yy BETWEEN 480 AND 1440 THEN 3 WHEN x BETWEEN 960 AND 1920 AND yy BETWEEN 0 AND 960 THEN 2 WHEN x BETWEEN 0 AND 960 AND yy BETWEEN 0 AND 960 THEN 1 ELSE -1 END"
_PZ = f"{PIXELS_SQL}, pc AS (SELECT *, (col + 0.5) * 30 AS x, 1920 - (row + 0.5) * 30 AS yy FROM px), pz AS (SELECT *, {_ZONE_SQL} AS zone FROM pc)"


@plans.add(f"WITH {_PB} SELECT box, round((x2 - x1) * (y2 - y1), 9) AS area, round((x1 + x2) / 2, 9) + 0.0 AS cx, round((y1 + y2) / 2, 9) + 0.0 AS cy, round((x2 - x1) * (y2 - y1) / 2, 9) AS diamond_area FROM b")
def areas_and_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = boxes(spark, sf_dir)
    at = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    s = s.select("box", g.box(*at).alias("r"), g.diamond(*at).alias("d"))
    out = s.select("box", g.area(F.col("r")).alias("area"), g.centroid(F.col("r")).alias("c"), g.area(F.col("d")).alias("diamond_area"))
    return _rounded(out.select("box", "area", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), "diamond_area"), 9)


@plans.add(f"WITH {_PB} SELECT box, id FROM p JOIN b ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2")
def points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.points_in_shapes(points(spark, sf_dir), _shapes(spark, sf_dir), 0.1).select("box", "id")


@plans.add(f"WITH {_PB} SELECT box, id FROM p JOIN b ON abs(x - (x1 + x2) / 2) / ((x2 - x1) / 2) + abs(y - (y1 + y2) / 2) / ((y2 - y1) / 2) <= 1")
def points_in_diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.points_in_shapes(points(spark, sf_dir), _shapes(spark, sf_dir, g.diamond), 0.1).select("box", "id")


@plans.add(f"""WITH {_PB}, j AS (SELECT box, label FROM p JOIN b ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2) SELECT box, round(avg(label), 6) AS label_mean, round(median(label), 6) AS label_median, sum(label)::DOUBLE AS label_sum,
  round(100.0 * count(*) FILTER (label > 0) / nullif(count(*) FILTER (label > 0) + count(*) FILTER (label < 0), 0), 6) AS label_positive_percentage, count(*) AS entity_count FROM j GROUP BY box""")
def zone_statistics_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of the points in each zone from one spatial join; zones without points drop out."""
    pairs = spatial.points_in_shapes(points(spark, sf_dir), _shapes(spark, sf_dir), 0.1).withColumn("label", F.col("label").cast("double"))
    return _rounded(rollup.grouped(pairs, ["box"], {"label": ["mean", "median", "sum", "positive_percentage"]}))


_GRID = "gr AS (SELECT i * 6 + j AS cell, -0.45 + i * 0.15 AS a1, -0.45 + j * 0.15 AS b1 FROM range(6) AS t(i), range(6) AS u(j))"


@plans.add(f"WITH {_PB}, {_GRID} SELECT cell, box FROM gr JOIN b ON x1 <= a1 + 0.15 AND a1 <= x2 AND y1 <= b1 + 0.15 AND b1 <= y2")
def boxes_to_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spatial.grid(spark, -0.45, -0.45, 0.45, 0.45, 0.15)
    return spatial.shapes_to_shapes(grid, _shapes(spark, sf_dir).withColumnRenamed("rings", "other_rings"), 0.2).select("cell", "box")


@plans.add(f"WITH {_PB}, q AS (SELECT *, (x2 - x1) * (y2 - y1) AS area FROM b), pr AS (SELECT a.box, c.box AS other, c.area FROM q a JOIN q c ON a.box <> c.box AND a.x1 <= c.x2 AND c.x1 <= a.x2 AND a.y1 <= c.y2 AND c.y1 <= a.y2) SELECT box, other, round(area, 9) AS area FROM pr QUALIFY row_number() OVER (PARTITION BY box ORDER BY area DESC, other) = 1")
def largest_intersecting_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shapes(spark, sf_dir)
    other = s.select(F.col("box").alias("other"), F.col("rings").alias("other_rings"), g.area(F.col("rings")).alias("area"))
    pairs = spatial.shapes_to_shapes(s, other, 0.2).where("box != other").select("box", "other", "area")
    return _rounded(spatial.largest_match(pairs, "box", "area", "other"), 9)


_HOLDS = "(CASE WHEN o.diamond THEN abs({x} - (o.x1 + o.x2) / 2) / ((o.x2 - o.x1) / 2) + abs({y} - (o.y1 + o.y2) / 2) / ((o.y2 - o.y1) / 2) <= 1 ELSE {x} BETWEEN o.x1 AND o.x2 AND {y} BETWEEN o.y1 AND o.y2 END)"
_SHAPES = f"""sh AS (SELECT box AS id, false AS diamond, * EXCLUDE (box), [x1, x2, x2, x1] AS vx, [y1, y1, y2, y2] AS vy FROM b UNION ALL SELECT box + 100, true, * EXCLUDE (box), [(x1 + x2) / 2, x2, (x1 + x2) / 2, x1], [y1, (y1 + y2) / 2, y2, (y1 + y2) / 2] FROM b),
wi AS (SELECT s.id, o.id AS other, {' AND '.join(_HOLDS.format(x=f's.vx[{k}]', y=f's.vy[{k}]') for k in range(1, 5))} AS within, {_HOLDS.format(x='((s.x1 + s.x2) / 2)', y='((s.y1 + s.y2) / 2)')} AS held FROM sh s JOIN sh o ON s.id <> o.id)"""


@plans.add(f"WITH {_PB}, {_SHAPES} SELECT id FROM sh WHERE id NOT IN (SELECT a.id FROM wi a JOIN wi c ON c.id = a.other AND c.other = a.id WHERE (a.within AND NOT (c.within AND a.other > a.id)) OR (a.held AND a.other < a.id))")
def outermost_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and their diamonds: the diamonds lie within."""
    s = _shapes(spark, sf_dir).select(F.col("box").alias("id"), "rings")
    d = _shapes(spark, sf_dir, g.diamond).select((F.col("box") + 100).alias("id"), "rings")
    return spatial.outermost(s.unionByName(d), 0.2).select("id")


@plans.add(f"WITH {POINTS_SQL}, j AS (SELECT a.id, c.id AS target, sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2)) AS dd FROM p a JOIN p c ON a.label < 5 AND c.label >= 5) SELECT id, target, round(dd, 9) AS distance FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY dd, target) = 1")
def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return _rounded(spatial.nearest(p.where("label < 5"), p.where("label >= 5").withColumnRenamed("id", "target"), 0.05), 9)


@plans.add(f"WITH {POINTS_SQL} SELECT id, (greatest(0, ceil((x + 0.5) / 0.1) - 1) * 10 + greatest(0, ceil((y + 0.5) / 0.1) - 1))::BIGINT AS cell FROM p")
def points_to_processing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", spatial.cell_of(F.col("x"), F.col("y"), -0.5, -0.5, 0.1, 10).cast("long").alias("cell"))


@plans.add(f"WITH {_PB} SELECT id, box, round(sqrt(pow(greatest(x1 - x, 0, x - x2), 2) + pow(greatest(y1 - y, 0, y - y2), 2)), 9) AS distance FROM p JOIN b ON label = box")
def distances_to_own_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a buffer of any size holds, as distances."""
    rows = points(spark, sf_dir).join(_shapes(spark, sf_dir), F.col("label") == F.col("box"))
    return _rounded(rows.select("id", "box", g.distance_to(F.col("rings"), F.col("x"), F.col("y")).alias("distance")), 9)


@plans.add()
def shapes_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Octagons with points on their sides, thinned to what a tolerance needs."""
    b = boxes(spark, sf_dir)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    r = F.array(g.ring((x1, y1), ((x1 + x2) / 2, y1 - 0.001), (x2, y1), (x2, y2), ((x1 + x2) / 2, y2 + 0.05), (x1, y2)))
    out = spatial.simplified(b.select("box", r.alias("rings")), 0.01)
    return _rounded(out.select("box", F.size(F.col("rings")[0]).alias("corners"), g.area(F.col("rings")).alias("area")), 9)


@plans.add(f"WITH {POINTS_SQL} SELECT label, round(2 * sum(0.02 * 0.01), 9) AS area, (count(*) * 2)::INTEGER AS parts FROM p GROUP BY label")
def parts_dissolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    part = lambda dx: p.select("label", F.col("id"), g.box(F.col("x") + dx, F.col("y"), F.col("x") + dx + 0.02, F.col("y") + 0.01).alias("rings"))
    merged = spatial.dissolved(part(0.0).unionByName(part(5.0)), "label", order="id")
    each = F.aggregate(F.transform("rings", lambda r: F.abs(g.ring_area(r))), F.lit(0.0), lambda s, a: s + a)
    return _rounded(merged.select("label", each.alias("area"), F.size("rings").alias("parts")), 9)


@plans.add(f"WITH {POINTS_SQL}, q AS (SELECT id, 180 + x * 20 AS a, 180 + x * 20 + 5 AS z, y FROM p) SELECT id, (CASE WHEN a < 180 THEN 1 ELSE 0 END + CASE WHEN z > 180 THEN 1 ELSE 0 END)::INTEGER AS parts, 10.0 AS area FROM q")
def antimeridian_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    x = 180 + F.col("x") * 20
    rows = p.select("id", g.split_antimeridian(g.box(x, F.col("y"), x + 5, F.col("y") + 2)[0]).alias("parts"))
    each = F.aggregate(F.transform("parts", lambda r: F.abs(g.ring_area(r))), F.lit(0.0), lambda s, a: s + a)
    return _rounded(rows.select("id", F.size("parts").alias("parts"), each.alias("area")), 6)


def _projected_sql() -> str:
    """Both projections about 0 and 30 degrees, with standard parallels at 20 and 40."""
    e2 = g.FLATTENING * (2 - g.FLATTENING)
    e = math.sqrt(e2)
    q = lambda s: f"({1 - e2!r} * (({s}) / (1 - {e2!r} * ({s}) * ({s})) - {1 / (2 * e)!r} * ln((1 - {e!r} * ({s})) / (1 + {e!r} * ({s})))))"
    qn = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - 1 / (2 * e) * math.log((1 - e * s) / (1 + e * s)))
    lat0 = math.radians(30)
    qp, b0 = qn(1.0), math.asin(qn(math.sin(lat0)) / qn(1.0))
    rq = g.SEMI_MAJOR * math.sqrt(qp / 2)
    d = g.SEMI_MAJOR * math.cos(lat0) / math.sqrt(1 - e2 * math.sin(lat0) ** 2) / (rq * math.cos(b0))
    m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p1, p2 = math.radians(20), math.radians(40)
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    rho0 = g.SEMI_MAJOR * f * t(lat0) ** n
    return f"""WITH {POINTS_SQL}, r AS (SELECT id, radians(x * 50) AS lon, radians(y * 50 + 30) AS lat FROM p), s AS (SELECT *, asin({q('sin(lat)')} / {qp!r}) AS b FROM r),
k AS (SELECT *, {rq!r} * sqrt(2 / (1 + {math.sin(b0)!r} * sin(b) + {math.cos(b0)!r} * cos(b) * cos(lon))) AS bb, {g.SEMI_MAJOR * f!r} * pow(tan({math.pi / 4!r} - lat / 2) / pow((1 - {e!r} * sin(lat)) / (1 + {e!r} * sin(lat)), {e / 2!r}), {n!r}) AS rho FROM s)
SELECT id, round(bb * {d!r} * cos(b) * sin(lon), 3) + 0.0 AS ax, round(bb / {d!r} * ({math.cos(b0)!r} * sin(b) - {math.sin(b0)!r} * cos(b) * cos(lon)), 3) + 0.0 AS ay, round(rho * sin({n!r} * lon), 3) + 0.0 AS cx, round({rho0!r} - rho * cos({n!r} * lon), 3) + 0.0 AS cy FROM k"""


@plans.add(_projected_sql())
def points_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-area and conformal coordinates in metres of points read as degrees."""
    p = points(spark, sf_dir).select("id", (F.col("x") * 50).alias("lon"), (F.col("y") * 50 + 30).alias("lat"))
    out = p.select("id", g.laea(F.col("lon"), F.col("lat"), 0.0, 30.0).alias("a"), g.lcc(F.col("lon"), F.col("lat"), 0.0, 30.0, 20.0, 40.0).alias("c"))
    return _rounded(out.select("id", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy")), 3)


# ---- rasters


def _zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.zoned(raster.centres(pixels(spark, sf_dir), GT), _zones(spark), 480.0)


@plans.add(f"WITH {_PZ} SELECT zone, period, sum(CASE WHEN class = 1 THEN 900.0 ELSE 0 END)::DOUBLE AS area FROM pz WHERE zone <> -1 GROUP BY 1, 2 UNION ALL SELECT z, NULL, 0.0 FROM range(1, 6) AS r(z) WHERE z NOT IN (SELECT zone FROM pz)")
def zone_water_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly water area of every zone; the last drawn zone has the pixel; a zone without pixels has 0."""
    return raster.zone_areas(_zones(spark), _zoned(spark, sf_dir), F.col("class") == 1, raster.pixel_area(GT), by=["period"])


@plans.add(f"WITH {_PZ} SELECT zone, round(avg(class), 6) AS class_mean, sum(class) * 900.0::DOUBLE AS class_volume FROM pz WHERE zone <> -1 GROUP BY 1")
def zone_climate_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster.zone_means(_zoned(spark, sf_dir), ["class"], raster.pixel_area(GT)))


@plans.add(f"""WITH {PIXELS_SQL} SELECT period, count(*) FILTER (class <> 0) * 900.0 AS class_valid, count(*) FILTER (class = 0) * 900.0 AS class_missing, count(*) FILTER (other <> 0) * 900.0 AS other_valid, count(*) FILTER (other = 0) * 900.0 AS other_missing,
  count(*) FILTER (class = 2) * 900.0 AS class_other_class_water, count(*) FILTER (class <> 0 AND other = 2) * 900.0 AS class_other_other_water FROM px GROUP BY period""")
def comasked_water_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.comasked_areas(pixels(spark, sf_dir), ["class", "other"], 900.0, ["period"])


@plans.add(f"WITH {PIXELS_SQL} SELECT row::INTEGER AS row, col::INTEGER AS col, period, CASE WHEN class = 2 OR other = 2 THEN 1 WHEN class <> 0 OR other <> 0 THEN 0 ELSE -1 END AS fused FROM px")
def products_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return raster.fused(px.select("row", "col", "period", "class"), px.select("row", "col", "period", "other"), "class", "other", ["period"])


@plans.add(f"WITH {PIXELS_SQL} SELECT row::INTEGER AS row, col::INTEGER AS col, arg_max(class, period) AS class FROM px GROUP BY 1, 2")
def tiles_mosaicked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.mosaic(pixels(spark, sf_dir), "period", "class")


@plans.add(f"WITH {PIXELS_SQL}, a AS (SELECT year(period)::INTEGER AS year, row, col, max(CASE WHEN month(period) <= 4 THEN class END) AS m, max(CASE WHEN month(period) BETWEEN 5 AND 8 THEN class END) AS r, max(CASE WHEN month(period) > 8 THEN class END) AS d FROM px GROUP BY 1, 2, 3) SELECT year, row::INTEGER AS row, col::INTEGER AS col, coalesce(m > 1.5, r > 1.5, d > 1.5, false)::INTEGER AS filled FROM a")
def gaps_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.month("period")
    px = pixels(spark, sf_dir)
    parts = px.groupBy(F.year("period").alias("year"), "row", "col").agg(F.max(F.when(m <= 4, F.col("class"))).alias("m"), F.max(F.when(m.between(5, 8), F.col("class"))).alias("r"), F.max(F.when(m > 8, F.col("class"))).alias("d"))
    return raster.gap_filled(parts, "m", "r", "d", threshold=1.5).select("year", "row", "col", "filled")


@plans.add(f"WITH {PIXELS_SQL} SELECT row::INTEGER AS row, col::INTEGER AS col, period, class = 1 AND other = 2 AS water FROM px")
def constrained_to_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = raster.binarised(pixels(spark, sf_dir), "class").withColumn("extent", F.col("other") == 2)
    return raster.constrained(px, "water", "extent").select("row", "col", "period", "water")


@plans.add(f"WITH {PIXELS_SQL} SELECT row::INTEGER AS row, col::INTEGER AS col, " + ", ".join(f"max(CASE WHEN period = DATE '{y}-{m:02d}-01' THEN class END) AS \"water_{y}-{m:02d}-01\"" for y in range(1995, 2002) for m in range(1, 13)) + " FROM px GROUP BY 1, 2")
def months_as_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.months_as_bands(pixels(spark, sf_dir), "class", [f"{y}-{m:02d}-01" for y in range(1995, 2002) for m in range(1, 13)])


@plans.add(f"WITH {PIXELS_SQL} SELECT period, row::INTEGER AS row, col::INTEGER AS col, class FROM px WHERE col BETWEEN 10 AND 19 AND row BETWEEN 4 AND 13")
def raster_cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.cropped(pixels(spark, sf_dir), GT, 300.0, 1500.0, 600.0, 1800.0).select("period", "row", "col", "class")


_OBS = "ob AS (SELECT user_id % 50 AS row, user_id // 50 % 50 AS col, ts::DATE AS day, event_id, value FROM events)"


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select((u % 50).alias("row"), (F.floor(u / 50) % 50).alias("col"), F.to_date("ts").alias("day"), (F.col("event_id") % 8).alias("qa"), "value")


@plans.add(f"WITH {_OBS} SELECT row, col, date_trunc('month', day)::DATE AS period, round(coalesce(median(value) FILTER (event_id % 8 = 0), 0), 6) AS value, count(*) FILTER (event_id % 8 = 0) > 0 AS coverage FROM ob GROUP BY 1, 2, 3")
def clear_sky_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster.monthly_composite(_observations(spark, sf_dir), ["value"], "qa"))


@plans.add(f"WITH {PIXELS_SQL}, a AS (SELECT row, col, avg(class) AS a, count(*)::DOUBLE AS n FROM px GROUP BY 1, 2) SELECT row::INTEGER AS row, col::INTEGER AS col, round(4 * (a - n) - (0.25 * a + 2.75 * n), 6) AS awei FROM a")
def water_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).groupBy("row", "col").agg(F.avg("class").alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    return _rounded(raster.with_index(px, "a", "a", "n", "n").select("row", "col", "awei"))


def _mean_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy("row", "col").agg(F.avg("class").alias("v"))


@plans.add(f"WITH {PIXELS_SQL}, a AS (SELECT row, col, avg(class) AS v FROM px GROUP BY 1, 2), o AS (SELECT unnest(range(0, 49, 8)) AS off), w AS (SELECT o1.off AS yoff, o2.off AS xoff, a.* FROM o o1, o o2, a WHERE row >= o1.off AND row < o1.off + 16 AND col >= o2.off AND col < o2.off + 16) SELECT xoff::INTEGER AS xoff, yoff::INTEGER AS yoff, count(*) AS n, round(sum(v), 6) AS total FROM w GROUP BY 1, 2")
def overlapping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = raster.windows(_mean_raster(spark, sf_dir), 64, 64, 16, 8, ["v"])
    return _rounded(w.groupBy("xoff", "yoff").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")))


@plans.add(f"WITH {PIXELS_SQL} SELECT row::INTEGER AS row, col::INTEGER AS col, round(avg(class), 6) AS v FROM px GROUP BY 1, 2")
def windows_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that nothing changed give the raster back."""
    px = _mean_raster(spark, sf_dir)
    return _rounded(raster.reassembled(raster.windows(px, 64, 64, 16, 8, ["v"]), px, "v"))


@plans.add(f"""WITH {PIXELS_SQL}, a AS (SELECT row, col, avg(class) AS v FROM px GROUP BY 1, 2), o AS (SELECT unnest(range(0, 57, 8)) AS off), w AS (SELECT o1.off AS yoff, o2.off AS xoff, a.* FROM o o1, o o2, a WHERE row >= o1.off AND row < o1.off + 8 AND col >= o2.off AND col < o2.off + 8)
SELECT xoff::INTEGER AS xoff, yoff::INTEGER AS yoff, count(*) FILTER (v > 1) AS water FROM w GROUP BY 1, 2 HAVING count(*) = 64""")
def patches_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model over whole patches, here the share of a class."""
    cells = raster.windows(_mean_raster(spark, sf_dir), 64, 64, 8, 0, ["v"])
    p = raster.valid_patches(raster.patches(cells, "v").where(F.size(F.flatten("v")) == 64), "v")
    out = raster.scored_patches(p, lambda x: x / 2, "v")
    return out.select("xoff", "yoff", F.size(F.filter(F.flatten("mask"), lambda x: x == 1)).cast("long").alias("water"))


@plans.add(f"WITH {PIXELS_SQL}, a AS (SELECT row, col, avg(class) AS v FROM px GROUP BY 1, 2), k AS (SELECT * FROM (SELECT row AS r0, col AS c0 FROM a WHERE row % 10 = 5 AND col % 10 = 5)), n AS (SELECT r0, c0, v FROM k JOIN a ON abs(row - r0) <= 1 AND abs(col - c0) <= 1) SELECT r0::INTEGER AS r0, c0::INTEGER AS c0, count(*) AS n, round(sum(v), 6) AS total FROM n GROUP BY 1, 2")
def neighbourhoods_of_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _mean_raster(spark, sf_dir)
    found = raster.neighbourhoods(px, px.where("row % 10 = 5 and col % 10 = 5"), 3, ["v"])
    total = F.aggregate("window", F.lit(0.0), lambda s, w: s + w["v"])
    return _rounded(found.select("r0", "c0", F.size("window").cast("long").alias("n"), total.alias("total")))


@plans.add()
def samples_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty pixels of each class in each month, by hashed position: a sampling operator."""
    return raster.drawn(pixels(spark, sf_dir), 20, 7, ["period", "class"]).select("period", "class", "row", "col")


@plans.add(f"WITH {PIXELS_SQL}, a AS (SELECT row, col, avg(class) AS v FROM px GROUP BY 1, 2), t AS (SELECT i, j, ((j + 0.5) * 45 / 30) AS fc, ((i + 0.5) * 45 / 30) AS fr FROM range(42) AS q(i), range(42) AS z(j)) SELECT i::INTEGER AS row, j::INTEGER AS col, round(v, 6) AS v FROM t LEFT JOIN a ON a.row = floor(fr) AND a.col = floor(fc)")
def resampled_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster.resampled(_mean_raster(spark, sf_dir), GT, _target(spark), (0.0, 45.0, 0.0, 1920.0, 0.0, -45.0), "v"))


def _target(spark: SparkSession) -> DataFrame:
    return spark.range(42 * 42).select(F.floor(F.col("id") / 42).cast("int").alias("row"), (F.col("id") % 42).cast("int").alias("col"))


@plans.add(f"""WITH {PIXELS_SQL}, a AS (SELECT row, col, avg(class) AS v FROM px GROUP BY 1, 2), t AS (SELECT i, j, ((j + 0.5) * 45 / 30) - 0.5 AS fc, ((i + 0.5) * 45 / 30) - 0.5 AS fr FROM range(42) AS q(i), range(42) AS z(j)),
n AS (SELECT i, j, (1 - abs(fr - (floor(fr) + dr))) * (1 - abs(fc - (floor(fc) + dc))) AS w, floor(fr) + dr AS sr, floor(fc) + dc AS sc FROM t, range(2) AS d1(dr), range(2) AS d2(dc))
SELECT i::INTEGER AS row, j::INTEGER AS col, round(sum(w * v) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0), 9) AS v FROM n LEFT JOIN a ON a.row = sr AND a.col = sc GROUP BY 1, 2""")
def resampled_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster.resampled(_mean_raster(spark, sf_dir), GT, _target(spark), (0.0, 45.0, 0.0, 1920.0, 0.0, -45.0), "v", "bilinear"), 9)


def _water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).withColumn("water", F.col("class") > 0)


@plans.add()
def water_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.bodies(_water(spark, sf_dir), F.col("water"), 64, 900.0, ["period"])


@plans.add()
def body_areas_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.body_areas(water_bodies(spark, sf_dir), _zones(spark), GT, 480.0, by=["period"], zeros=True)


@plans.add(f"WITH {SUPPLIERS_SQL}, c AS (SELECT zone, date_trunc('month', l_shipdate)::DATE AS period, l_tax AS runoff, l_discount AS evaporation, l_quantity AS precipitation, kind FROM lineitem JOIN sup ON l_suppkey = id) SELECT zone, period, round(sum(runoff) * 123.9, 4) AS runoff, round(sum(evaporation) * 123.9, 4) AS evaporation, round(sum(precipitation) * 123.9, 4) AS precipitation, round(count(*) FILTER (kind = 1) * 123.9, 4) AS natural_area FROM c GROUP BY 1, 2")
def basin_water_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.trunc("l_shipdate", "MM").alias("period"), F.col("l_tax").alias("runoff"), F.col("l_discount").alias("evaporation"), F.col("l_quantity").alias("precipitation"))
    cells = lines.join(suppliers(spark, sf_dir).select("id", "zone", "kind"), "id")
    return _rounded(raster.basin_balance(cells, "zone", 123.9, flags={"natural_area": F.col("kind") == 1}), 4)


# ---- other coordinate systems, runs of pixels, unions


def _between_sql() -> tuple[str, str]:
    """(columns of the conic's inverse over x, y as lon, lat; of the equal-area forward form over lon, lat as x, y), in stages; both about 0 and 30 degrees."""
    e2 = g.FLATTENING * (2 - g.FLATTENING)
    e = math.sqrt(e2)
    qn = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - 1 / (2 * e) * math.log((1 - e * s) / (1 + e * s)))
    lat0, p1, p2 = (math.radians(v) for v in (30, 20, 40))
    qp, b0 = qn(1.0), math.asin(qn(math.sin(lat0)) / qn(1.0))
    rq = g.SEMI_MAJOR * math.sqrt(qp / 2)
    d = g.SEMI_MAJOR * math.cos(lat0) / math.sqrt(1 - e2 * math.sin(lat0) ** 2) / (rq * math.cos(b0))
    m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = g.SEMI_MAJOR * m(p1) / (n * t(p1) ** n)
    rho0 = f * t(lat0) ** n
    inverse = f"""c1 AS (SELECT *, pow(sqrt(x * x + ({rho0!r} - y) * ({rho0!r} - y)) / {f!r}, {1 / n!r}) AS tt, atan2(x, {rho0!r} - y) / {n!r} AS lon FROM c0),
c2 AS (SELECT *, list_reduce(list_prepend({math.pi / 2!r} - 2 * atan(tt), range(8)::DOUBLE[]), lambda p, i: {math.pi / 2!r} - 2 * atan(tt * pow((1 - {e!r} * sin(p)) / (1 + {e!r} * sin(p)), {e / 2!r}))) AS lat FROM c1)"""
    forward = f"""c3 AS (SELECT *, asin({1 - e2!r} * (sin(lat) / (1 - {e2!r} * sin(lat) * sin(lat)) - {1 / (2 * e)!r} * ln((1 - {e!r} * sin(lat)) / (1 + {e!r} * sin(lat)))) / {qp!r}) AS b FROM c2),
c4 AS (SELECT *, {rq!r} * sqrt(2 / (1 + {math.sin(b0)!r} * sin(b) + {math.cos(b0)!r} * cos(b) * cos(lon))) AS bb FROM c3),
c5 AS (SELECT * EXCLUDE (bb), bb * {d!r} * cos(b) * sin(lon) AS px, bb / {d!r} * ({math.cos(b0)!r} * sin(b) - {math.sin(b0)!r} * cos(b) * cos(lon)) AS py FROM c4)"""
    return inverse, forward


_INVERSE_SQL, _FORWARD_SQL = _between_sql()
_LAEA = lambda lon, lat: g.laea(lon, lat, 0.0, 30.0)
_CONIC_TO_LAEA = g.between(lambda x, y: g.lcc_inverse(x, y, 0.0, 30.0, 20.0, 40.0), _LAEA)
_TARGET_GT = (0.0, 45.0, 0.0, 1920.0, 0.0, -45.0)
_WARP_SQL = f"WITH {PIXELS_SQL}, a AS (SELECT row, col, avg(class) AS v FROM px GROUP BY 1, 2), c0 AS (SELECT i, j, (j + 0.5) * 45 AS x, 1920 - (i + 0.5) * 45 AS y FROM range(42) AS q(i), range(42) AS z(j)), {_INVERSE_SQL}, {_FORWARD_SQL}, w AS (SELECT i, j, px / 30 AS fc, (1920 - py) / 30 AS fr FROM c5)"


@plans.add(f"{_WARP_SQL} SELECT i::INTEGER AS row, j::INTEGER AS col, round(v, 6) AS v FROM w LEFT JOIN a ON a.row = floor(fr) AND a.col = floor(fc)")
def warped_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equal-area raster at the pixels of a conic lattice."""
    return _rounded(raster.resampled(_mean_raster(spark, sf_dir), GT, _target(spark), _TARGET_GT, "v", to_source=_CONIC_TO_LAEA))


@plans.add(f"""{_WARP_SQL}, n AS (SELECT i, j, (1 - abs(fr - 0.5 - (floor(fr - 0.5) + dr))) * (1 - abs(fc - 0.5 - (floor(fc - 0.5) + dc))) AS wt, floor(fr - 0.5) + dr AS sr, floor(fc - 0.5) + dc AS sc FROM w, range(2) AS d1(dr), range(2) AS d2(dc))
SELECT i::INTEGER AS row, j::INTEGER AS col, round(sum(wt * v) / nullif(sum(CASE WHEN v IS NOT NULL THEN wt END), 0), 5) AS v FROM n LEFT JOIN a ON a.row = sr AND a.col = sc GROUP BY 1, 2""")
def warped_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster.resampled(_mean_raster(spark, sf_dir), GT, _target(spark), _TARGET_GT, "v", "bilinear", _CONIC_TO_LAEA), 5)


@plans.add(f"""WITH {_PB}, k AS (SELECT box, i, radians(CASE WHEN i IN (1, 2) THEN x2 ELSE x1 END * 50) AS lon, radians(CASE WHEN i IN (2, 3) THEN y2 ELSE y1 END * 50 + 30) AS lat FROM b, range(4) AS r(i)), c2 AS (SELECT * FROM k), {_FORWARD_SQL},
n AS (SELECT box, px, py, coalesce(lead(px) OVER w, first_value(px) OVER w) AS qx, coalesce(lead(py) OVER w, first_value(py) OVER w) AS qy FROM c5 WINDOW w AS (PARTITION BY box ORDER BY i))
SELECT box, count(DISTINCT id) AS points, round(area / 1e6, 4) AS area FROM (SELECT box, abs(sum(px * qy - qx * py)) / 2 AS area FROM n GROUP BY box) JOIN p ON p.label = box GROUP BY ALL""")
def areas_reprojected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each label with the square kilometres of its shape, whose degrees become metres on the way."""
    degrees = boxes(spark, sf_dir).select("box", g.box(F.col("x1") * 50, F.col("y1") * 50 + 30, F.col("x2") * 50, F.col("y2") * 50 + 30).alias("rings"))
    counted = points(spark, sf_dir).groupBy(F.col("label").alias("box")).agg(F.count_distinct("id").alias("points"))
    out = spatial.with_shapes(counted, degrees, "box", "box", to=_LAEA)
    return _rounded(out.select("box", "points", (g.area(F.col("rings")) / 1e6).alias("area")), 4)


@plans.add(plans.sql["zone_water_areas"])
def zone_water_areas_by_scanline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As zone_water_areas, by runs of columns."""
    return raster.zone_areas(_zones(spark), raster.scanned(pixels(spark, sf_dir), _zones(spark), GT), F.col("class") == 1, raster.pixel_area(GT), by=["period"])


_TRIANGLES_SQL = """tri AS (SELECT box AS zone, [x1 * 3000 + 960, x2 * 3000 + 960, x2 * 3000 + 960] AS xs, [y1 * 3000 + 960, y1 * 3000 + 960, y2 * 3000 + 960] AS ys FROM b),
s AS (SELECT zone, xs[i] / 30 AS ax, (ys[i] - 1920) / -30 AS ay, xs[i % 3 + 1] / 30 AS ex, (ys[i % 3 + 1] - 1920) / -30 AS ey FROM tri, range(1, 4) AS r(i)),
cells AS (SELECT DISTINCT row, col FROM px),
side AS (SELECT zone, row, col, (ex - ax) * (row + 0.5 - ay) - (ey - ay) * (col + 0.5 - ax) AS turn,
  least(ax, ex) < col + 1 AND greatest(ax, ex) > col AND least(ay, ey) < row + 1 AND greatest(ay, ey) > row
  AND least((ex - ax) * (row - ay) - (ey - ay) * (col - ax), (ex - ax) * (row - ay) - (ey - ay) * (col + 1 - ax), (ex - ax) * (row + 1 - ay) - (ey - ay) * (col - ax), (ex - ax) * (row + 1 - ay) - (ey - ay) * (col + 1 - ax)) < 0
  AND greatest((ex - ax) * (row - ay) - (ey - ay) * (col - ax), (ex - ax) * (row - ay) - (ey - ay) * (col + 1 - ax), (ex - ax) * (row + 1 - ay) - (ey - ay) * (col - ax), (ex - ax) * (row + 1 - ay) - (ey - ay) * (col + 1 - ax)) > 0 AS through
  FROM s, cells),
held AS (SELECT zone, row, col FROM side GROUP BY ALL HAVING bool_or(through) OR min(turn) >= 0 OR max(turn) <= 0),
pz AS (SELECT px.*, h.zone FROM px JOIN (SELECT row, col, max(zone) AS zone FROM held GROUP BY 1, 2) h USING (row, col))"""


@plans.add(f"""WITH {_PB}, {PIXELS_SQL}, {_TRIANGLES_SQL} SELECT zone, period, sum(CASE WHEN class = 1 THEN 900.0 ELSE 0 END)::DOUBLE AS area FROM pz GROUP BY 1, 2 UNION ALL SELECT box, NULL, 0.0 FROM b WHERE box NOT IN (SELECT zone FROM pz)""")
def triangle_water_areas_all_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly water area of half of each label's box, with every pixel that its sides pass through; the highest label has a pixel."""
    at = lambda c: F.col(c) * 3000 + 960
    corners = F.array(g.ring((at("x1"), at("y1")), (at("x2"), at("y1")), (at("x2"), at("y2"))))
    triangles = boxes(spark, sf_dir).select(F.col("box").alias("zone"), F.col("box").alias("draw_order"), corners.alias("rings"))
    return raster.zone_areas(triangles, raster.scanned(pixels(spark, sf_dir), triangles, GT, all_touched=True), F.col("class") == 1, raster.pixel_area(GT), by=["period"])


@plans.add(f"""WITH {POINTS_SQL}, q AS (SELECT label, x AS x1, y AS y1, x + 0.02 AS x2, y + 0.01 AS y2 FROM p), e AS (SELECT DISTINCT label, x1 AS x FROM q UNION SELECT DISTINCT label, x2 FROM q),
s AS (SELECT label, x AS a, lead(x) OVER (PARTITION BY label ORDER BY x) AS z FROM e), h AS (SELECT s.label, a, z, y1, y2, max(y2) OVER (PARTITION BY s.label, a ORDER BY y1, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s JOIN q ON q.label = s.label AND x1 <= a AND x2 >= z)
SELECT label, round(sum((z - a) * greatest(0, y2 - greatest(y1, coalesce(top, y1)))), 9) AS area FROM h GROUP BY label""")
def parts_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the union of each label's boxes, overlaps once."""
    parts = points(spark, sf_dir).select("label", g.box(F.col("x"), F.col("y"), F.col("x") + 0.02, F.col("y") + 0.01).alias("rings"))
    return _rounded(union.united_areas(union.boundary(parts, "label", 0.1), "label"), 9)


@plans.add(f"""WITH {_PB}, w AS (SELECT box, x1, x2, y1, y2 FROM b UNION ALL SELECT 1000 + box, x1 - 50 * box, x2 + 50 * box, y1 - box, y2 + box FROM b) SELECT box, id FROM p JOIN w ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2""")
def points_in_shapes_of_all_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in each label's box and in boxes up to ten thousand times as wide, over a quadtree."""
    b = boxes(spark, sf_dir)
    large = b.select((F.col("box") + 1000).alias("box"), (F.col("x1") - 50 * F.col("box")).alias("x1"), (F.col("x2") + 50 * F.col("box")).alias("x2"), (F.col("y1") - F.col("box")).alias("y1"), (F.col("y2") + F.col("box")).alias("y2"))
    shapes = b.unionByName(large).select("box", g.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("rings"))
    return quadtree.points_in_shapes(points(spark, sf_dir), shapes, 0.05).select("box", "id")


@plans.add(f"""WITH {_PB}, w AS (SELECT box, x1, x2, y1, y2 FROM b UNION ALL SELECT 1000 + box, x1 - 50 * box, x2 + 50 * box, y1 - box, y2 + box FROM b) SELECT w.box, id FROM p JOIN w ON x + 0.01 >= x1 AND x <= x2 AND y + 0.01 >= y1 AND y <= y2""")
def squares_meeting_shapes_of_all_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small squares at the points with the boxes, small and large, that they meet."""
    b = boxes(spark, sf_dir)
    large = b.select((F.col("box") + 1000).alias("box"), (F.col("x1") - 50 * F.col("box")).alias("x1"), (F.col("x2") + 50 * F.col("box")).alias("x2"), (F.col("y1") - F.col("box")).alias("y1"), (F.col("y2") + F.col("box")).alias("y2"))
    shapes = b.unionByName(large).select("box", g.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("rings"))
    squares = points(spark, sf_dir).select("id", g.box(F.col("x"), F.col("y"), F.col("x") + 0.01, F.col("y") + 0.01).alias("other_rings"))
    return quadtree.shapes_to_shapes(shapes, squares, 0.05).select("box", "id")
