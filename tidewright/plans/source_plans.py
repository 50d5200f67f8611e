"""Queries over files: written from the given tables into the shared folder by the writers, and read again by the readers.

Each call uses a folder of its own. SQL says what must come back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import fill, raster, records, resampling, reshape, rollup, series, spatial, validate
from ..operators.graph import settled
from ..sources import rasters, readers, writers
from . import Plans
from .proxies import BOXES_SQL, DENSE_SQL, MONTHS_SQL, PIXELS_SQL, POINTS_SQL, SUPPLIERS_SQL, YEARLY_SQL, YEARS, boxes, dense_months, months, pixels, points, suppliers, table
from .rollup_plans import _METRICS, _pairs, _PAIRS
from .series_plans import _STATS, PERIODS, _rounded
from .spatial_plans import _PB

plans = Plans()


def _folder(spark: SparkSession, name: str) -> str:
    settled(spark.range(1))  # sets the shared folder where none is
    return f"{spark.sparkContext.getCheckpointDir()}/files/{name}-{uuid.uuid4().hex}"


# ---- S1-S5, S8-S10, S12, S14, R3, A25, F11


@plans.add(f"WITH {DENSE_SQL} SELECT id, period, value FROM d")
def wide_csv_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table as CSV, in as many parts as it was written in."""
    path = _folder(spark, "wide")
    reshape.to_wide(months(spark, sf_dir), "id", PERIODS).write.csv(path, header=True)
    return readers.wide_csv(spark, path, "id", PERIODS)


@plans.add(f"WITH {MONTHS_SQL}, {SUPPLIERS_SQL} SELECT zone::BIGINT AS basin, period AS start, (period + INTERVAL 1 MONTH)::DATE AS end, id, value AS area FROM m JOIN sup USING (id)")
def monthly_csvs_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each basin and month, whose name tells both."""
    path = _folder(spark, "monthly")
    rows = months(spark, sf_dir).join(suppliers(spark, sf_dir).select("id", "zone"), "id")
    name = F.format_string("%d_%s_%s_area.csv", "zone", F.date_format("period", "yyyy-MM-dd"), F.date_format(F.add_months("period", 1), "yyyy-MM-dd"))
    lines = rows.select(name.alias("name"), F.concat_ws(",", "id", F.col("value").cast("string")).alias("line"), "id", F.lit("id,area").alias("head"))
    writers.named_files(lines, path, "name", "line", "id", "head").write.format("noop").mode("overwrite").save()
    return readers.monthly_csvs(spark, path)


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that have a point, as stations with daily levels."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("day")).agg(F.avg("l_quantity").alias("level"))
    places = points(spark, sf_dir).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    return lines.join(places, "id")


_STATIONS = f"{POINTS_SQL}, dl AS (SELECT l_suppkey AS id, l_shipdate::DATE AS day, avg(l_quantity) AS level FROM lineitem GROUP BY 1, 2), sn AS (SELECT dl.*, round(x, 6) AS x, round(y, 6) AS y FROM dl JOIN p USING (id))"


def _level_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed-layout file for each station, read again: file, lat, lon, day, level."""
    path = _folder(spark, "levels")
    head = F.concat_ws("\n", F.array_repeat(F.lit("header"), 30), F.format_string("Latitude and longitude %.6f %.6f", "y", "x"), F.array_repeat(F.lit("header"), 19))
    line = lambda level: F.concat_ws(" ", F.date_format("day", "yyyyMMdd"), level, F.array_repeat(F.lit("1"), 14))
    both = F.concat_ws("\n", line(F.format_string("%.6f", "level")), line(F.lit("9999.99")))
    writers.named_files(_stations(spark, sf_dir), path, F.concat(F.col("id").cast("string"), F.lit(".txt")), both, "day", head).write.format("noop").mode("overwrite").save()
    found = readers.level_files(spark, path)
    return found.select(F.regexp_extract("file", r"^(\d+)\.", 1).cast("long").alias("id"), "lat", "lon", F.to_date(F.col("f0").cast("long").cast("string"), "yyyyMMdd").alias("day"), F.col("f1").alias("level"))


@plans.add(f"WITH {_STATIONS} SELECT id, y AS lat, x AS lon, date_trunc('month', day)::DATE AS period, round(avg(round(level, 6)), 4) AS level, count(*) AS days FROM sn GROUP BY 1, 2, 3, 4")
def level_files_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly means of irregular observations from fixed-layout files; rows of sentinels drop out."""
    rows = _level_rows(spark, sf_dir)
    return _rounded(rows.groupBy("id", "lat", "lon", F.trunc("day", "MM").alias("period")).agg(F.round(F.avg("level"), 4).alias("level"), F.count(F.lit(1)).alias("days")))


@plans.add(f"""WITH {_STATIONS}, {BOXES_SQL}, {SUPPLIERS_SQL}, lv AS (SELECT id, x, y, date_trunc('month', day)::DATE AS period, avg(round(level, 6)) AS level FROM sn GROUP BY 1, 2, 3, 4),
fb AS (SELECT lv.id, min(box) AS box FROM lv JOIN b ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2 GROUP BY 1), {MONTHS_SQL}
SELECT fb.box, lv.id, lv.period, round(lv.level, 4) AS level, m.value AS area FROM lv JOIN fb USING (id) JOIN m ON m.id = lv.id AND m.period = lv.period""")
def matched_level_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a level and an area for the stations that lie in a shape, in the months that both have."""
    monthly = settled(_level_rows(spark, sf_dir).groupBy("id", "lat", "lon", F.trunc("day", "MM").alias("period")).agg(F.avg("level").alias("level")))
    shapes = boxes(spark, sf_dir).select("box", g.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("rings"))
    places = monthly.select("id", F.col("lon").alias("x"), F.col("lat").alias("y")).distinct()
    found = spatial.points_in_shapes(places, shapes, 0.1).groupBy("id").agg(F.min("box").alias("box"))
    pairs = monthly.join(found, "id").join(months(spark, sf_dir).select("id", "period", F.col("value").alias("area")), ["id", "period"])
    return pairs.select("box", "id", "period", F.round("level", 4).alias("level"), "area")


@plans.add("SELECT date_trunc('month', ts)::DATE AS period, round(avg(value), 4) AS value FROM events GROUP BY 1")
def tab_series_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "tab")
    table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), "value").write.csv(path, sep="\t", header=True)
    found = readers.tab_series(spark, path, "date", "value")
    return found.select("period", F.round("value", 4).alias("value"))


@plans.add(f"WITH {PIXELS_SQL}, f AS (SELECT period, row, col, row_number() OVER (PARTITION BY period ORDER BY row, col) - 1 AS number FROM px WHERE class = 2) SELECT strftime(period, '%Y-%m') AS raster, number::INTEGER AS number, col::INTEGER AS xoff, row::INTEGER AS yoff FROM f")
def patch_positions_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "positions")
    px = pixels(spark, sf_dir).where("class = 2").groupBy(F.date_format("period", "yyyy-MM").alias("raster")).agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "col"))), lambda s: F.array(s["col"], s["row"])).alias("places"))
    px.select(F.to_json(F.create_map("raster", "places")).alias("value")).repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.patch_positions(spark, path)


@plans.add(f"WITH {SUPPLIERS_SQL} SELECT zone::INTEGER AS zone, count(*) AS entities, round(sum(slope), 4) AS slope FROM sup GROUP BY 1")
def basin_parts_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by basin, read as one table of all parts."""
    path = _folder(spark, "basins")
    writers.by_basin(suppliers(spark, sf_dir), path, "zone")
    return spark.read.parquet(path).groupBy("zone").agg(F.count(F.lit(1)).alias("entities"), F.round(F.sum("slope"), 4).alias("slope"))


@plans.add(f"WITH {SUPPLIERS_SQL} SELECT id, zone, NULL::DOUBLE AS slope FROM sup WHERE kind = 1 UNION ALL SELECT id, zone, slope FROM sup WHERE kind <> 1")
def regional_parts_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = suppliers(spark, sf_dir)
    return readers.parts(s.where("kind = 1").select("id", "zone"), s.where("kind != 1").select("id", "zone", "slope"))


@plans.add(f"WITH {_PB} SELECT box AS shape, round((x2 - x1) * (y2 - y1), 9) AS size FROM b")
def attributes_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed properties without geometry; the CSV copy beside the full table is what is read back."""
    shapes = boxes(spark, sf_dir).select("box", g.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("rings"))
    full = shapes.withColumn("area", g.area(F.col("rings")))
    path = writers.written(full, f"{_folder(spark, 'shapes')}.parquet", "rings")
    back = spark.read.csv(f"{path}.attributes.csv", header=True, schema="box int, area double")
    return _rounded(writers.exported(back, {"box": "shape", "area": "size", "rings": "rings"}), 9)


@plans.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def record_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of the largest key, as one row."""
    orders = table(spark, sf_dir, "orders")
    row = records.looked_up(orders, "o_orderkey", orders.agg(F.max("o_orderkey")).first()[0], ["o_orderkey", "o_orderstatus"])
    return spark.createDataFrame([tuple(row)] if row else [], orders.select("o_orderkey", "o_orderstatus").schema)


# ---- R3, R5, R6, R23, W9, W12, J1, J6, T40


@plans.add(f"WITH {MONTHS_SQL} SELECT id % 10 AS id, " + ", ".join(f"round(avg(CASE WHEN period = DATE '{p}' THEN value END), 6) AS \"{p}\"" for p in PERIODS) + " FROM m GROUP BY 1")
def mean_months_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reshape.to_wide(months(spark, sf_dir).withColumn("id", F.col("id") % 10), "id", PERIODS, how="avg"))


@plans.add(f"WITH {MONTHS_SQL}, a AS (SELECT * FROM m WHERE cloud > 0), b AS (SELECT * FROM m WHERE ice > 0), s AS (SELECT period FROM a INTERSECT SELECT period FROM b) SELECT a.id, a.period, a.value AS ours_value, b.value AS other_value FROM a JOIN b USING (id, period) JOIN s USING (period)")
def shared_months_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = months(spark, sf_dir)
    a, b = (reshape.prefixed(m.where(f"{c} > 0").select("id", "period", "value"), p, ["value"]) for c, p in (("cloud", "ours_"), ("ice", "other_")))
    return a.join(b, ["id", "period"]).join(reshape.shared_periods(a, b), "period").select("id", "period", "ours_value", "other_value")


@plans.add(f"WITH {SUPPLIERS_SQL} SELECT zone, count(*) AS entity_count, count(*) FILTER (slope > 0) AS significant_rising, round(count(*) FILTER (slope > 0) / count(*)::DOUBLE, 6) AS significant_rising_ratio FROM sup GROUP BY 1")
def significance_ratios_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = suppliers(spark, sf_dir).groupBy("zone").agg(F.count(F.lit(1)).alias("entity_count"), F.count_if(F.col("slope") > 0).alias("significant_rising"))
    return _rounded(rollup.significance_ratios(cells))


@plans.add("SELECT l_suppkey AS id, date_trunc('month', l_shipdate)::DATE AS period, round(count(*) FILTER (l_discount = 0) / count(*)::DOUBLE, 6) AS ice FROM lineitem GROUP BY 1, 2")
def ice_from_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("day"), F.col("l_discount").alias("temperature"))
    return _rounded(fill.ice_ratio_from_temperature(days))


@plans.add(f"WITH {YEARLY_SQL} SELECT d.id, d.period, round(y.mean, 6) AS mean, round(d.value - y.mean, 6) + 0.0 AS anomaly FROM d JOIN y USING (id, year_idx)")
def months_about_their_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly mean repeated to its months, and the months less it."""
    rows = settled(dense_months(spark, sf_dir))
    both = fill.yearly_to_months(series.yearly(rows), rows, "mean")
    return _rounded(both.select("id", "period", "mean", (F.col("value") - F.col("mean")).alias("anomaly")))


@plans.add(f"WITH {_PB}, a AS (SELECT label AS id, count(*) AS n FROM p GROUP BY 1) SELECT a.id, n, round((x1 + x2) / 2, 9) + 0.0 AS x, round((y1 + y2) / 2, 9) + 0.0 AS y FROM a JOIN b ON a.id = box")
def areas_with_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = points(spark, sf_dir).groupBy(F.col("label").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    shapes = boxes(spark, sf_dir).select("box", g.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("rings"))
    return _rounded(spatial.with_shapes(counts, shapes, "id", "box", to_centroid=True), 9)


@plans.add(f"WITH {MONTHS_SQL}, k AS (SELECT id, period, median(l_quantity) AS md FROM (SELECT l_suppkey AS id, date_trunc('month', l_shipdate)::DATE AS period, l_quantity FROM lineitem) GROUP BY 1, 2) SELECT m.id, m.period, m.value, k.md FROM m JOIN k USING (id, period) WHERE m.cloud <= 0.5")
def corrected_keys_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that both tables have, where the first is corrected."""
    m = months(spark, sf_dir).select("id", "period", "value", (F.col("cloud") <= 0.5).alias("corrected"))
    k = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.trunc("l_shipdate", "MM").alias("period")).agg(F.median("l_quantity").alias("md"))
    return records.covered_by_all(m, k, keys=["id", "period"], corrected="corrected").select("id", "period", "value", "md")


_ZONE_YEARLY = (
    DENSE_SQL.replace("\nd AS (", "\nd1 AS (")
    + f", {SUPPLIERS_SQL}, d AS (SELECT zone AS id, period, sum(value) AS value, false AS masked, month_idx, year_idx, position FROM d1 JOIN sup USING (id) GROUP BY ALL)"
    + YEARLY_SQL[len(DENSE_SQL) :]
)


@plans.add(
    f"WITH {_ZONE_YEARLY}, s AS (SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in _STATS.items()) + " FROM y GROUP BY id) SELECT id AS zone, " + ", ".join(f"round({k}, 5) + 0.0 AS {k}" for k in _STATS) + " FROM s"
)
def zone_series_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of each zone's summed series, unmasked."""
    rows = dense_months(spark, sf_dir).join(suppliers(spark, sf_dir).select("id", "zone"), "id")
    summed = rows.groupBy("zone", "period", "month_idx", "year_idx", "position").agg(F.sum("value").alias("value")).withColumn("masked", F.lit(False))
    return _rounded(series.statistics(summed, YEARS, "zone").drop("mean_value", "trend_per_period"), 5)


# ---- V10, V12, A32, A35, R27


_ANOMALY = f"""{_PAIRS.replace('l_partkey AS id', 'l_suppkey AS id')}, o AS (SELECT id, period, t, p FROM pr WHERE n > 1),
an AS (SELECT id, round(t - avg(t) OVER (PARTITION BY id), 9) AS t, round(p - avg(p) OVER (PARTITION BY id), 9) AS p FROM o),
rk AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY t) + (count(*) OVER (PARTITION BY id, t) - 1) / 2.0 AS a, rank() OVER (PARTITION BY id ORDER BY p) + (count(*) OVER (PARTITION BY id, p) - 1) / 2.0 AS b FROM an)"""


@plans.add(f"WITH {_ANOMALY} SELECT id, count(*) AS n, round(sqrt(avg((t - p) * (t - p))), 5) AS rmse, round(corr(a, b), 5) AS spearman FROM rk GROUP BY id")
def levels_compared_as_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two level series as anomalies about their means, without the months that count as frozen."""
    rows = _pairs(spark, sf_dir, "l_suppkey").withColumn("frozen", F.col("n") <= 1)
    return _rounded(validate.compared_anomalies(rows, "t", "p", frozen="frozen"), 5)


@plans.add(f"""WITH {_PAIRS}, mt AS (SELECT id, {_METRICS} FROM pr GROUP BY id HAVING count(t) >= 12), z AS (SELECT p_partkey AS id, p_size AS size FROM part),
c AS (SELECT CASE WHEN size > 0 AND size <= 10 THEN 'small' WHEN size > 10 AND size <= 30 THEN 'middle' WHEN size > 30 AND size <= 1000 THEN 'large' END AS class, rmse FROM mt JOIN z USING (id)),
q AS (SELECT class, quantile_cont(rmse, 0.25) AS q1, quantile_cont(rmse, 0.5) AS md, quantile_cont(rmse, 0.75) AS q3, avg(rmse) AS mean, min(rmse) AS lo, max(rmse) AS hi FROM c GROUP BY 1)
SELECT class, round(q1, 5) AS q1, round(md, 5) AS median, round(q3, 5) AS q3, round(mean, 5) AS mean, round(greatest(least(q1 - 1.5 * (q3 - q1), q1), lo), 5) AS lower, round(least(greatest(q3 + 1.5 * (q3 - q1), q3), hi), 5) AS upper FROM q""")
def metrics_by_size_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _rounded(validate.metrics(_pairs(spark, sf_dir), "t", "p", ["id"], 12))
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return _rounded(validate.by_class(found, sizes, "id", "size", [0, 10, 30, 1000], ["small", "middle", "large"], "rmse"), 5)


@plans.add("""WITH c AS (SELECT l_linestatus AS fold, (l_returnflag = 'R')::INTEGER AS t, l_discount * 10 AS p FROM lineitem), a AS (SELECT fold, sum(t * p) AS i, sum(t) AS y, sum(p) AS p, count(*) FILTER (t = 0 AND p <= 0.5) AS n00, count(*) FILTER (t = 0 AND p > 0.5) AS n01, count(*) FILTER (t = 1 AND p <= 0.5) AS n10, count(*) FILTER (t = 1 AND p > 0.5) AS n11 FROM c GROUP BY fold),
h AS (SELECT l_linestatus AS fold, round(avg(l_tax), 6) AS loss FROM lineitem WHERE l_linenumber = CASE WHEN l_linestatus = 'O' THEN 3 ELSE 5 END GROUP BY 1)
SELECT fold, round((i + 1) / (y + p - i + 1), 6) AS test_iou, round((2 * i + 1) / (y + p + 1), 6) AS test_dice, round((n00 + n11) / (n00 + n01 + n10 + n11)::DOUBLE, 6) AS test_accuracy, round((n00 / (n00 + n01 + n10)::DOUBLE + n11 / (n11 + n01 + n10)::DOUBLE) / 2, 6) AS test_mean_iou, loss FROM a JOIN h USING (fold)""")
def models_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's model: test metrics, and its history's loss (a JSON side file) at the record's chosen epoch."""
    lines = table(spark, sf_dir, "lineitem")
    path = _folder(spark, "history")
    losses = lines.groupBy(F.col("l_linestatus").alias("fold"), "l_linenumber").agg(F.round(F.avg("l_tax"), 6).alias("loss"))
    lists = losses.groupBy("fold").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "loss"))), lambda s: s["loss"]).alias("loss"))
    named = lists.select(F.concat("fold", F.lit(".json")).alias("name"), F.to_json(F.struct("loss")).alias("line"), F.lit(0).alias("order"))
    writers.named_files(named, path, "name", "line", "order").write.format("noop").mode("overwrite").save()
    folds = lines.select(F.col("l_linestatus").alias("fold")).distinct()
    history = None
    for r in folds.collect():  # one row a model
        own = readers.history_json(spark, f"{path}/{r['fold']}.json").withColumn("fold", F.lit(r["fold"]))
        history = own if history is None else history.unionByName(own)
    chosen = folds.withColumn("epoch", F.when(F.col("fold") == "O", 2).otherwise(4))
    scored = lines.select(F.col("l_linestatus").alias("fold"), (F.col("l_returnflag") == "R").cast("int").alias("t"), (F.col("l_discount") * 10).alias("p"))
    out = validate.evaluated(chosen, scored, history, "fold", "t", "p", "epoch")
    return _rounded(out.select("fold", "test_iou", "test_dice", "test_accuracy", "test_mean_iou", F.get_json_object("history", "$.loss").cast("double").alias("loss")))


_SPLITS = f"{PIXELS_SQL}, sp AS (SELECT ['train', 'eval', 'test'][((month(period) + year(period) - 1995) % 3) + 1] AS split, period, row // 8 * 8 AS yoff, col // 8 * 8 AS xoff, class FROM px), wn AS (SELECT split, period, yoff, xoff, sum(class) AS total FROM sp GROUP BY ALL)"


def _split_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalars import split_of

    px = pixels(spark, sf_dir).withColumns({"split": split_of("period", 1995), "v": F.col("class").cast("double")})
    return raster.patches(raster.windows(px, 64, 64, 8, 0, ["v"], ["split", "period"]), "v", ["split", "period"])


@plans.add(f"WITH {_SPLITS} SELECT split, count(*) AS patches FROM wn WHERE total < 60 GROUP BY 1")
def valid_patches_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.split_counts(_split_patches(spark, sf_dir), "split", "v", 60)


@plans.add()
def patches_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the valid patches, by the hash of their place: a sampling operator."""
    return raster.thinned(raster.valid_patches(_split_patches(spark, sf_dir), "v", 60), 0.25).select("split", "period", "xoff", "yoff")


@plans.add()
def one_sided_ks_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = suppliers(spark, sf_dir)
    rows = months(spark, sf_dir).join(s.select("id", "zone"), "id").groupBy("zone", "id").agg(F.avg("value").alias("a"), F.max("value").alias("b"))
    return _rounded(resampling.bootstrap_ks(rows, "zone", "a", "b", side="above"))


@plans.add(f"WITH {PIXELS_SQL} SELECT period, row::INTEGER AS row, col::INTEGER AS col, class FROM px WHERE row BETWEEN 20 AND 39 AND col BETWEEN 10 AND 24")
def raster_cropped_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map extent of a raster table in Morton order, of which only the row groups near it are read."""
    path = _folder(spark, "raster")
    rasters.write(pixels(spark, sf_dir).select("period", "row", "col", "class"), path, parts=8)
    return rasters.crop(spark, path, (0.0, 30.0, 0.0, 1920.0, 0.0, -30.0), 300.0, 720.0, 750.0, 1320.0)


_LAYERS = [
    ([[[[1.0] * 3] * 3], [[[-1.0, -1.0, -1.0], [-1.0, 8.0, -1.0], [-1.0, -1.0, -1.0]]]], [-100.0, 0.0]),
    ([[[[1.0]], [[-2.0]]]], [0.5]),
]


@plans.add(f"""WITH {PIXELS_SQL}, s AS (SELECT row, col, sum(class) AS v FROM px GROUP BY 1, 2), a AS (SELECT i AS row, j AS col, coalesce(v, 0) AS v FROM range(64) AS q(i) CROSS JOIN range(64) AS z(j) LEFT JOIN s ON s.row = i AND s.col = j),
n AS (SELECT a.row, a.col, a.v, sum(b.v) AS around FROM a JOIN a b ON b.row // 16 = a.row // 16 AND b.col // 16 = a.col // 16 AND abs(b.row - a.row) <= 1 AND abs(b.col - a.col) <= 1 GROUP BY ALL),
m AS (SELECT (col // 16 * 16)::INTEGER AS xoff, (row // 16 * 16)::INTEGER AS yoff, row % 16 - 2 AS r, col % 16 - 2 AS c, greatest(around - 100, 0) - 2 * greatest(9 * v - around, 0) + 0.5 > 0 AS wet FROM n WHERE row % 16 BETWEEN 2 AND 13 AND col % 16 BETWEEN 2 AND 13)
SELECT xoff, yoff, count(*) FILTER (wet) AS water, coalesce(sum(r * 12 + c) FILTER (wet), 0)::BIGINT AS places FROM m GROUP BY 1, 2""")
def patches_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored two-layer convolution over patches of class sums, two pixels of border cut off."""
    path = _folder(spark, "model")
    raster.store_model(spark, _LAYERS, path)
    lattice = spark.range(64 * 64).select(F.floor(F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"))
    sums = pixels(spark, sf_dir).groupBy("row", "col").agg(F.sum("class").cast("double").alias("v"))
    p = raster.patches(raster.windows(lattice.join(sums, ["row", "col"], "left").fillna(0.0, ["v"]), 64, 64, 16, 0, ["v"]), "v")
    out = raster.predicted_patches(p, raster.loaded_model(spark, path), "v", 16, 16, border=2)
    wet = F.filter(F.transform(F.flatten("mask"), lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    return out.select("xoff", "yoff", F.size(wet).cast("long").alias("water"), F.aggregate(wet, F.lit(0).cast("long"), lambda s, i: s + i).alias("places"))
