"""Whole jobs made of the operators: area tables to statistics, and two products compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scalars
from ..operators import fill, raster, rollup, series, spatial, validate
from ..operators.graph import settled
from . import Plans
from .proxies import BOXES_SQL, DENSE_SQL, MONTHS_SQL, PIXELS_SQL, POINTS_SQL, SUPPLIERS_SQL, YEARLY_SQL, YEARS, boxes, dense_months, months, pixels, points, suppliers
from .series_plans import _CARRIED, _EVEN, _LINEAR_SQL, _STATS, _mk_sql, _pettitt_sql, _rounded
from .spatial_plans import GT, _PZ, _zones

plans = Plans()


def analysed(rows: DataFrame, years: int, cloud: float, ice: float) -> DataFrame:
    """Cloud masking, freeze masking, all statistics and the tests of the annual mean, one row for each entity.

    rows: dense months (id, period, value, cloud, ice, year_idx, position, month_idx). The masked months are kept once.
    """
    clear = fill.cloud_masked(rows.drop("masked"), threshold=cloud)
    ready = settled(fill.freeze_masked(clear, threshold=ice))
    out = series.statistics(ready, years)
    out = rollup.expanded(out, series.analyse(ready, "mk_of_annual_mean", years), "id", "mk")
    return rollup.expanded(out, series.analyse(ready, "pettitt_of_annual_mean", years), "id", "pettitt")


_READY = (
    DENSE_SQL.replace("\nd AS (", "\nd0 AS (")
    + f""", ev AS (SELECT *, {_EVEN} AS even FROM d0), x AS (SELECT *, CASE WHEN even OR NOT coalesce(cloud > 0.5, false) THEN value END AS v FROM ev), {_LINEAR_SQL},
oz AS (SELECT * REPLACE (coalesce(ice > 0.65, false) AS masked), CASE WHEN NOT coalesce(ice > 0.65, false) THEN CASE WHEN even THEN value ELSE filled END END AS kept FROM o),
d AS (SELECT id, period, masked, month_idx, year_idx, position, {_CARRIED('kept')} AS value FROM oz)"""
    + YEARLY_SQL[len(DENSE_SQL) :]
)
_INNER = lambda sql: "WITH " + sql[sql.index(YEARLY_SQL) + len(YEARLY_SQL) :].lstrip(",\n")
_TESTED = {"mk": (_mk_sql("mean", 0.05, 1.959963984540054), ("s", "slope", "z", "p", "trend")), "pettitt": (_pettitt_sql("mean"), ("k", "cp", "p"))}


@plans.add(
    f"WITH {_READY}, st AS (SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in _STATS.items()) + " FROM y GROUP BY id), wh AS (SELECT id, CASE WHEN count(value) = count(*) THEN avg(value) END AS mean_value, CASE WHEN count(value) = count(*) THEN regr_slope(value, month_idx) * 13 END AS trend_per_period FROM d GROUP BY id) SELECT st.id, "
    + ", ".join(f"round({k}, 6) + 0.0 AS {k}" for k in ("mean_value", "trend_per_period", *_STATS))
    + "".join(f", {t}.{c} AS {t}_{c}" for t, (_, cs) in _TESTED.items() for c in cs) + "".join(f", {t}.p < 0.05 AS {t}_significant" for t in _TESTED)
    + " FROM st JOIN wh USING (id)" + "".join(f" LEFT JOIN ({_INNER(sql)}) {t} ON {t}.id = st.id" for t, (sql, _) in _TESTED.items())
)
def area_table_analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analysed(dense_months(spark, sf_dir), YEARS, 0.5, 0.65))


@plans.add(f"""WITH {DENSE_SQL}, {SUPPLIERS_SQL}, x AS (SELECT *, CASE WHEN cloud <= 0.5 OR cloud IS NULL THEN value END AS v FROM d), {_LINEAR_SQL},
fz AS (SELECT o.*, CASE WHEN NOT coalesce(ice > 0.65, false) THEN filled END AS kept FROM o),
fy AS (SELECT id, year_idx, avg(kept) AS mean FROM fz GROUP BY 1, 2),
ft AS (SELECT id, CASE WHEN count(mean) = count(*) THEN regr_slope(mean, year_idx) END AS trend FROM fy GROUP BY 1)
SELECT zone, count(*) AS entity_count, round(avg(trend), 6) AS trend_of_annual_mean_mean, count(*) FILTER (trend > 0) AS trend_of_annual_mean_pos_count FROM ft JOIN sup USING (id) GROUP BY zone""")
def analysed_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks, fills, yearly trends, zones: from area table to map."""
    clear = fill.cloud_masked(dense_months(spark, sf_dir).drop("masked"), threshold=0.5)
    stats = series.statistics(fill.freeze_masked(clear, threshold=0.65), YEARS).join(suppliers(spark, sf_dir), "id")
    return _rounded(rollup.grouped(stats, ["zone"], {"trend_of_annual_mean": ["mean", "pos_count"]}))


@plans.add(f"""WITH {_PZ}, ar AS (SELECT zone, period, sum(CASE WHEN class = 2 THEN 900.0 ELSE 0 END)::DOUBLE AS t, sum(CASE WHEN other = 2 THEN 900.0 ELSE 0 END)::DOUBLE AS p FROM pz WHERE zone <> -1 AND class <> 0 GROUP BY 1, 2)
SELECT zone, count(*) AS n, round(1 - sum((t - p) * (t - p)) / nullif(var_pop(t) * count(t), 0), 6) AS r2, round(sqrt(avg((t - p) * (t - p))), 4) AS rmse FROM ar GROUP BY zone HAVING count(*) >= 12""")
def products_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Our product masked by the other's missing pixels, both overlaid with zones, and their monthly areas compared."""
    rows = pixels(spark, sf_dir).where("class != 0")
    zoned = raster.zoned(raster.centres(rows, GT), _zones(spark), 480.0).where("zone != -1")
    water = lambda c: F.sum(F.when(F.col(c) == 2, raster.pixel_area(GT)).otherwise(0.0))
    pairs = zoned.groupBy("zone", "period").agg(water("class").alias("t"), water("other").alias("p"))
    out = validate.metrics(pairs, "t", "p", ["zone"], 12)
    return out.select("zone", "n", F.round("r2", 6).alias("r2"), F.round("rmse", 4).alias("rmse"))


@plans.add(f"""WITH {MONTHS_SQL}, {POINTS_SQL}, q AS (SELECT m.id, m.period, CASE WHEN m.id % 4 <> 0 THEN m.ice END AS ice, p.x, p.y FROM m JOIN p ON p.id = m.id),
h AS (SELECT id, any_value(x) AS x, any_value(y) AS y, count(ice) AS n FROM q GROUP BY id),
nn AS (SELECT a.id, b.id AS donor FROM h a JOIN h b ON a.n = 0 AND b.n > 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.id) = 1)
SELECT q.id, q.period, nn.donor, round(coalesce(q.ice, l.ice), 6) AS ice FROM q LEFT JOIN nn ON nn.id = q.id LEFT JOIN q l ON l.id = nn.donor AND l.period = q.period""")
def ice_borrowed_from_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = points(spark, sf_dir).select("id", "x", "y")
    rows = months(spark, sf_dir).join(places.select("id"), "id", "left_semi").withColumn("ice", F.when(F.col("id") % 4 != 0, F.col("ice")))
    own = places.join(rows.select("id").distinct(), "id", "left_semi")
    return _rounded(fill.repaired_from_nearest(rows, own, 0.05).select("id", "period", "donor", "ice"))


@plans.add(f"""WITH {POINTS_SQL}, {BOXES_SQL} SELECT box, id FROM p JOIN b ON sqrt(pow(greatest(x1 - x, 0, x - x2), 2) + pow(greatest(y1 - y, 0, y - y2), 2)) <= 0.02 + box * 0.002""")
def points_within_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = boxes(spark, sf_dir).select("box", (F.lit(0.02) + F.col("box") * 0.002).alias("r"), g.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("rings"))
    return spatial.within_distance(points(spark, sf_dir), shapes, "r", 0.1, 0.05).select("box", "id")


@plans.add(f"""WITH {POINTS_SQL}, {BOXES_SQL}, gr AS (SELECT i * 10 + j AS tile, -0.5 + i * 0.1 AS a1, -0.5 + j * 0.1 AS b1 FROM range(10) AS t(i), range(10) AS u(j)) SELECT DISTINCT tile FROM gr JOIN b ON x1 <= a1 + 0.1 AND a1 <= x2 AND y1 <= b1 + 0.1 AND b1 <= y2""")
def tiles_touching_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = spatial.grid(spark, -0.5, -0.5, 0.5, 0.5, 0.1).withColumnRenamed("cell", "tile")
    land = boxes(spark, sf_dir).select(g.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("rings"))
    return spatial.touching(tiles, land, 0.1).select("tile")


@plans.add(f"""WITH {YEARLY_SQL}, s AS (SELECT id, avg(std) AS a, stddev_pop(mean) AS b, CASE WHEN count(mean) = count(*) THEN regr_slope(mean, year_idx) END AS t FROM y GROUP BY id)
SELECT id, round(a / (a + b) * 100, 6) AS seasonality, round(b / (abs(t) * 6 + abs(b)) * 100, 6) AS low_share, round(b / (abs(t) * 6 + abs(b) + a) * 100, 6) AS low_share_of_all, round((a + b + t) / 3, 6) AS mean, CASE WHEN a * 1.05 * 0.01 > 0.65 THEN 'humid' ELSE 'arid' END AS humidity FROM s""")
def derived_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = series.yearly(dense_months(spark, sf_dir)).groupBy("id").agg(F.avg("std").alias("a"), F.stddev_pop("mean").alias("b"), scalars.guarded_slope("mean", "year_idx").alias("t"))
    return _rounded(y.select("id", scalars.seasonality_share("a", "b").alias("seasonality"), scalars.low_water_share("b", "t", 6).alias("low_share"), scalars.low_water_share("b", "t", 6, "a").alias("low_share_of_all"), scalars.row_mean("a", "b", "t").alias("mean"), scalars.humidity_class(F.col("a") * 1.05).alias("humidity")))


@plans.add(f"WITH {MONTHS_SQL} SELECT m.id, m.period, round(m.cloud * m.value / t.size, 6) AS cloud FROM m JOIN (SELECT id, max(value) AS size FROM m GROUP BY id) t USING (id)")
def cloud_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = months(spark, sf_dir)
    shapes = rows.groupBy("id").agg(F.max("value").alias("area"))
    found = fill.cloud_ratios(rows.select("id", "period", (F.col("cloud") * F.col("value")).alias("cloudy_area")), shapes)
    return _rounded(found.select("id", "period", "cloud"))


@plans.add(f"WITH {PIXELS_SQL} SELECT (month(period) + year(period) - 1995) % 3 AS fold, count(*) AS n FROM px GROUP BY 1")
def samples_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.month("period") + F.year("period") - 1995, F.lit(3)).cast("long")
    return pixels(spark, sf_dir).groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("n"))
