"""Entity series, attributes, points, polygons and pixels taken from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reshape, series

START, END, YEARS = "1995-01-01", "2002-01-01", 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, period, value, cloud, ice): monthly sums of quantity by supplier."""
    lines = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= START) & (F.col("l_shipdate") < END))
    share = lambda c, v: F.sum(F.when(F.col(c) == v, F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")
    return lines.groupBy(F.col("l_suppkey").alias("id"), F.trunc("l_shipdate", "MM").alias("period")).agg(
        F.sum("l_quantity").alias("value"), share("l_returnflag", "R").alias("cloud"), share("l_linestatus", "O").alias("ice")
    )


MONTHS_SQL = """m AS (
  SELECT l_suppkey AS id, date_trunc('month', l_shipdate)::DATE AS period, sum(l_quantity) AS value,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS cloud,
         sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS ice
  FROM lineitem WHERE l_shipdate >= '1995-01-01' AND l_shipdate < '2002-01-01' GROUP BY 1, 2)"""


def dense_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All months of all entities, with masked, year_idx and position."""
    out = reshape.dense(months(spark, sf_dir), "id", START, END)
    out = out.withColumn("masked", F.coalesce(F.col("ice") > 0.65, F.lit(False)))
    return series.with_year(out, START)


DENSE_SQL = (
    MONTHS_SQL
    + """,
c AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS period),
e AS (SELECT DISTINCT id FROM m),
d AS (SELECT e.id, c.period, m.value, m.cloud, m.ice, coalesce(m.ice > 0.65, false) AS masked,
             (year(c.period) - 1995) * 12 + month(c.period) - 1 AS month_idx, (year(c.period) - 1995) AS year_idx, month(c.period) - 1 AS position
      FROM e CROSS JOIN c LEFT JOIN m ON m.id = e.id AND m.period = c.period)"""
)

YEARLY_SQL = (
    DENSE_SQL
    + """,
dv AS (SELECT *, CASE WHEN NOT masked THEN value END AS v FROM d),
dc AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY id, year_idx ORDER BY position)) AS dm FROM dv),
y0 AS (SELECT id, year_idx, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std, sum(v) AS total,
              sum(CASE WHEN v > 0 THEN v * ln(v) WHEN v = 0 THEN 0 END) AS vlv, avg(dm) AS monthly_change FROM dc GROUP BY 1, 2),
y AS (SELECT *, CASE WHEN coalesce(total, 0) = 0 THEN 0 WHEN n > 1 THEN (ln(total) - vlv / total) / ln(n) END AS entropy,
             mean - lag(mean) OVER (PARTITION BY id ORDER BY year_idx) AS change FROM y0)"""
)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with type, zone and slope."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 5000, 1).otherwise(2).alias("kind"), F.col("n_name").alias("country"), F.col("n_regionkey").alias("zone"), F.col("s_acctbal").alias("slope")
    )


SUPPLIERS_SQL = """sup AS (SELECT s_suppkey AS id, CASE WHEN s_acctbal > 5000 THEN 1 ELSE 2 END AS kind, n_name AS country, n_regionkey AS zone, s_acctbal AS slope
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, label) from the first two components of vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


POINTS_SQL = "p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(box, x1, x2, y1, y2): the quartiles of each label's points."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    return points(spark, sf_dir).groupBy(F.col("label").alias("box")).agg(q("x", 0.25).alias("x1"), q("x", 0.75).alias("x2"), q("y", 0.25).alias("y1"), q("y", 0.75).alias("y2"))


BOXES_SQL = """b AS (SELECT label AS box, quantile_cont(x, 0.25) AS x1, quantile_cont(x, 0.75) AS x2, quantile_cont(y, 0.25) AS y1, quantile_cont(y, 0.75) AS y2 FROM p GROUP BY 1)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(period, row, col, class, other): two class rasters a month."""
    lines = table(spark, sf_dir, "lineitem")
    last = F.max_by(F.struct("l_returnflag", "l_linestatus"), F.struct("l_orderkey", "l_linenumber"))
    out = lines.groupBy(F.trunc("l_shipdate", "MM").alias("period"), (F.col("l_partkey") % 64).cast("int").alias("row"), (F.col("l_suppkey") % 64).cast("int").alias("col")).agg(last.alias("z"))
    code = F.when(F.col("z.l_returnflag") == "N", 0).when(F.col("z.l_returnflag") == "A", 1).otherwise(2)
    return out.select("period", "row", "col", code.alias("class"), F.when(F.col("z.l_linestatus") == "O", 2).otherwise(1).alias("other"))


PIXELS_SQL = """px AS (
  SELECT period, row, col, CASE f WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS class, CASE s WHEN 'O' THEN 2 ELSE 1 END AS other FROM (
    SELECT date_trunc('month', l_shipdate)::DATE AS period, l_partkey % 64 AS row, l_suppkey % 64 AS col, l_returnflag AS f, l_linestatus AS s,
           row_number() OVER (PARTITION BY date_trunc('month', l_shipdate), l_partkey % 64, l_suppkey % 64 ORDER BY l_orderkey DESC, l_linenumber DESC) AS k FROM lineitem) WHERE k = 1)"""
