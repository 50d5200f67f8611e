"""Queries of roll-ups, shares, summaries, decomposition, resampling, validation, records and arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import records, resampling, reshape, rollup, series, stl, validate
from ..streaming import arrivals
from . import Plans
from .proxies import DENSE_SQL, END, MONTHS_SQL, POINTS_SQL, START, SUPPLIERS_SQL, YEARLY_SQL, YEARS, dense_months, months, points, suppliers, table
from .series_plans import _rounded

plans = Plans()
#: Statistics by entity with type and zone, the base of most roll-ups.
_T = f"""{YEARLY_SQL}, {SUPPLIERS_SQL},
st AS (SELECT id, avg(std) AS std, CASE WHEN count(mean) = count(*) THEN regr_slope(mean, year_idx) END AS trend, avg(mean) AS size FROM y GROUP BY id),
t AS (SELECT * FROM st JOIN sup USING (id))"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = series.yearly(dense_months(spark, sf_dir)).groupBy("id").agg(F.avg("std").alias("std"), scalars.guarded_slope("mean", "year_idx").alias("trend"), F.avg("mean").alias("size"))
    return y.join(suppliers(spark, sf_dir), "id")


@plans.add(f"""WITH {_T} SELECT zone, round(avg(trend), 6) AS trend_mean, round(median(trend), 6) AS trend_median, round(sum(trend), 6) AS trend_sum, count(trend) AS trend_count,
  round(coalesce(sum(trend) FILTER (trend > 0), 0), 6) AS trend_sum_positive, round(coalesce(sum(trend) FILTER (trend < 0), 0), 6) AS trend_sum_negative, round(avg(trend) FILTER (trend > 0), 6) AS trend_mean_positive,
  round(avg(trend) FILTER (trend < 0), 6) AS trend_mean_negative, count(*) FILTER (trend > 0) AS trend_pos_count, count(*) FILTER (trend < 0) AS trend_neg_count,
  round(100.0 * count(*) FILTER (trend > 0) / nullif(count(*) FILTER (trend > 0) + count(*) FILTER (trend < 0), 0), 6) AS trend_positive_percentage, count(*) AS entity_count FROM t GROUP BY zone""")
def zone_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["mean", "median", "sum", "count", "sum_positive", "sum_negative", "mean_positive", "mean_negative", "pos_count", "neg_count", "positive_percentage"]
    return _rounded(rollup.grouped(_entities(spark, sf_dir), ["zone"], {"trend": wanted}))


@plans.add(f"WITH {SUPPLIERS_SQL}, c AS (SELECT zone, kind, count(*) AS n FROM sup GROUP BY 1, 2) SELECT zone, kind AS kind_mode FROM c QUALIFY row_number() OVER (PARTITION BY zone ORDER BY n DESC, kind) = 1")
def zone_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.grouped(suppliers(spark, sf_dir), ["zone"], {"kind": "mode"}, None)


@plans.add(f"WITH {_T} SELECT n_nationkey AS cell, coalesce(count(t.id), 0) AS entity_count, round(sum(std), 6) AS std_sum FROM nation LEFT JOIN t ON n_name = country AND kind = 1 GROUP BY 1")
def statistics_onto_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = rollup.grouped(_entities(spark, sf_dir).where("kind = 1"), ["country"], {"std": "sum"})
    grid = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell"), F.col("n_name").alias("country"))
    return _rounded(rollup.onto_grid(grid, agg, "country", ["entity_count"]).drop("country"))


@plans.add(f"WITH {POINTS_SQL}, r AS (SELECT *, greatest(1, ceil((x - (SELECT min(x) FROM p)) / 0.1)) AS bin FROM p) SELECT bin::BIGINT AS bin, round((SELECT min(x) FROM p) + (bin - 0.5) * 0.1, 6) AS centre, round(avg(y), 6) AS y_mean, count(y) AS y_count FROM r GROUP BY bin")
def statistics_along_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rollup.binned_along(points(spark, sf_dir), "x", 0.1, "y", ["mean", "count"]))


@plans.add(f"WITH {_T} SELECT zone, round(100 * coalesce(sum(coalesce(size, 0)) FILTER (kind <> 1), 0) / nullif(sum(coalesce(size, 0)), 0), 6) AS managed_share, count(*) FILTER (kind <> 1) AS managed_count FROM t GROUP BY zone")
def reservoir_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rollup.reservoir_share(_entities(spark, sf_dir), "zone", "size", "kind"))


_CLASS = "CASE WHEN size > 0 AND size <= 170 THEN 'small' WHEN size > 170 AND size <= 185 THEN 'middle' WHEN size > 185 AND size <= 1e9 THEN 'large' END"


def _classed(df: DataFrame) -> DataFrame:
    return df.withColumn("class", scalars.binned("size", [0, 170, 185, 1e9], ["small", "middle", "large"]))


@plans.add(f"WITH {_T} SELECT {_CLASS} AS class, round(100.0 * count(*) FILTER (trend > 0) / count(*), 6) AS rising, round(100.0 * count(*) FILTER (trend < 0) / count(*), 6) AS falling, count(*) AS entities FROM t GROUP BY 1")
def trend_shares_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rollup.trend_shares(_classed(_entities(spark, sf_dir)), "trend", ["class"]))


@plans.add(f"""WITH {_T}, k AS (SELECT unnest(['small', 'middle', 'large', 'giant']) AS class), g AS (SELECT {_CLASS} AS class, count(*) FILTER (trend > 0 AND std > 65) AS a, count(*) FILTER (trend > 0 AND std <= 65) AS b, count(*) FILTER (trend < 0 AND std > 65) AS c, count(*) FILTER (trend < 0 AND std <= 65) AS d FROM t WHERE trend IS NOT NULL GROUP BY 1)
SELECT class, coalesce(round(100.0 * a / nullif(a + b + c + d, 0), 6), 0) AS sig_rising, coalesce(round(100.0 * b / nullif(a + b + c + d, 0), 6), 0) AS rising, coalesce(round(100.0 * c / nullif(a + b + c + d, 0), 6), 0) AS sig_falling, coalesce(round(100.0 * d / nullif(a + b + c + d, 0), 6), 0) AS falling FROM k LEFT JOIN g USING (class)""")
def signed_shares_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classed(_entities(spark, sf_dir)).withColumn("sure", F.col("std") > 65)
    classes = spark.createDataFrame([(c,) for c in ("small", "middle", "large", "giant")], "class string")
    return _rounded(rollup.signed_shares(rows, "trend", "sure", "class", classes))


@plans.add(f"""WITH {_T}, s AS (SELECT country, count(*) FILTER (trend > 0) AS u, count(*) FILTER (trend < 0) AS w FROM t GROUP BY 1 HAVING count(*) >= 3), q AS (SELECT country, round(100.0 * u / nullif(u + w, 0), 6) AS increase, round(100.0 * w / nullif(u + w, 0), 6) AS decrease FROM s)
(SELECT *, 'top' AS side FROM q ORDER BY increase DESC, country, decrease LIMIT 5) UNION ALL (SELECT *, 'low' FROM q ORDER BY increase, country, decrease LIMIT 5)""")
def top_and_bottom_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rollup.top_by_country(_entities(spark, sf_dir), "country", "trend", 3, 5))


@plans.add(f"""WITH {_T}, a AS (SELECT {_CLASS} AS class, std FROM t UNION ALL SELECT 'All', std FROM t) SELECT class, round(avg(std), 6) AS std_mean, round(median(std), 6) AS std_median, round(stddev_samp(std), 6) AS std_std, round(sum(std), 6) AS std_sum, count(*) AS entity_count FROM a GROUP BY 1""")
def class_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classed(_entities(spark, sf_dir))
    both = rows.unionByName(rows.withColumn("class", F.lit("All")))
    return _rounded(rollup.grouped(both, ["class"], {"std": ["mean", "median", "std", "sum"]}))


@plans.add(f"WITH {SUPPLIERS_SQL}, k AS (SELECT unnest([1, 2, 3]) AS kind), c AS (SELECT kind, count(*) AS n FROM sup GROUP BY 1) SELECT kind, n, round(100.0 * n / (SELECT sum(n) FROM c), 6) AS share FROM k LEFT JOIN c USING (kind)")
def category_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rollup.category_counts(suppliers(spark, sf_dir), "kind", spark.createDataFrame([(1,), (2,), (3,)], "kind int")))


@plans.add("""WITH q AS (SELECT l_returnflag AS flag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS md, quantile_cont(l_extendedprice, 0.75) AS q3, avg(l_extendedprice) AS mean, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1)
SELECT flag, round(q1, 6) AS q1, round(md, 6) AS median, round(q3, 6) AS q3, round(mean, 2) AS mean, round(greatest(least(q1 - 1.5 * (q3 - q1), q1), lo), 6) AS lower, round(least(greatest(q3 + 1.5 * (q3 - q1), q3), hi), 6) AS upper FROM q""")
def box_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return _rounded(rollup.box_statistics(rows, ["flag"], "l_extendedprice")).withColumn("mean", F.round("mean", 2))


@plans.add("""WITH k AS (SELECT l_returnflag AS flag, (CASE WHEN l_quantity = 50 THEN 9 ELSE floor(l_quantity / 5) END)::INTEGER AS bin FROM lineitem), c AS (SELECT flag, bin, count(*) AS n FROM k WHERE bin BETWEEN 0 AND 9 GROUP BY 1, 2)
SELECT flag, bin, n, round(n / (sum(n) OVER (PARTITION BY flag) * 5.0), 6) AS density FROM c""")
def histogram_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return _rounded(rollup.histogram(rows, ["flag"], "l_quantity", 0.0, 5.0, 10))


@plans.add("""WITH n AS (SELECT c_nationkey * 4.0 AS share, round(sum(c_acctbal), 2) AS w FROM customer GROUP BY c_nationkey), g AS (SELECT unnest(range(0, 201)) * 0.5 AS threshold)
SELECT threshold::DOUBLE AS threshold, round(coalesce((SELECT sum(w) FROM n WHERE share < threshold), 0), 4) AS total FROM g""")
def population_below_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") * 4.0).alias("share")).agg(F.round(F.sum("c_acctbal"), 2).alias("w"))
    return rollup.below_thresholds(rows, "share", "w").withColumn("total", F.round("total", 4))


@plans.add(f"""WITH {_T} SELECT count(*) AS entities, round(sum(size), 6) AS total_size, round(100.0 * count(*) FILTER (trend > 0) / count(*), 6) AS rising, round(median(std), 6) AS median_std, count(*) FILTER (std > 60 AND kind = 1) AS dominated,
  round(sum(size) FILTER (kind <> 1), 6) AS managed_size, round(median(100 * abs(trend) * 6 / (abs(trend) * 6 + std)), 6) AS median_trend_share FROM t""")
def global_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.abs("trend") * 6
    return _rounded(
        _entities(spark, sf_dir).agg(
            F.count(F.lit(1)).alias("entities"), F.sum("size").alias("total_size"), (F.count_if(F.col("trend") > 0) / F.count(F.lit(1)) * 100).alias("rising"), F.median("std").alias("median_std"),
            F.count_if((F.col("std") > 60) & (F.col("kind") == 1)).alias("dominated"), F.sum(F.when(F.col("kind") != 1, F.col("size"))).alias("managed_size"), F.median(100 * t / (t + F.col("std"))).alias("median_trend_share"),
        )
    )


@plans.add("SELECT l_partkey AS key, count(*) AS n, list_sort(list(l_quantity)) AS values FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.duplicate_keys(table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "key"), "key", "l_quantity")


@plans.add("SELECT l_partkey AS key, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS value FROM lineitem GROUP BY 1")
def last_part_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return rollup.last_wins(rows, ["key"], "value", "o")


@plans.add(f"WITH {SUPPLIERS_SQL} SELECT zone, id, slope FROM sup QUALIFY row_number() OVER (PARTITION BY zone ORDER BY slope DESC, id) = 1")
def largest_of_each_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.largest_row(suppliers(spark, sf_dir).select("zone", "id", "slope"), "zone", "slope", "id")


@plans.add("""WITH c AS (SELECT l_linestatus AS fold, (l_returnflag = 'R')::INTEGER AS t, l_discount * 10 AS p FROM lineitem), a AS (SELECT fold, sum(t * p) AS i, sum(t) AS y, sum(p) AS p, count(*) FILTER (t = 0 AND p <= 0.5) AS n00, count(*) FILTER (t = 0 AND p > 0.5) AS n01, count(*) FILTER (t = 1 AND p <= 0.5) AS n10, count(*) FILTER (t = 1 AND p > 0.5) AS n11 FROM c GROUP BY fold)
SELECT fold, round((i + 1) / (y + p - i + 1), 6) AS iou, round((2 * i + 1) / (y + p + 1), 6) AS dice, round((n00 + n11) / (n00 + n01 + n10 + n11)::DOUBLE, 6) AS accuracy, round((n00 / (n00 + n01 + n10)::DOUBLE + n11 / (n11 + n01 + n10)::DOUBLE) / 2, 6) AS mean_iou FROM a""")
def segmentation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("fold"), (F.col("l_returnflag") == "R").cast("int").alias("t"), (F.col("l_discount") * 10).alias("p"))
    return _rounded(rollup.segmentation_metrics(rows, ["fold"], "t", "p"))


@plans.add()
def permutation_test_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural against managed values of each zone, 1,000 shuffles."""
    rows = months(spark, sf_dir).join(suppliers(spark, sf_dir), "id")
    return _rounded(resampling.permutation_test(reshape.split_by_type(rows, "value", "kind").groupBy("zone", "period").agg(F.avg("value_natural").alias("a"), F.avg("value_managed").alias("b")), "zone", "a", "b"))


@plans.add()
def bootstrap_medians_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(resampling.bootstrap(_entities(spark, sf_dir), "zone", "std"))


@plans.add()
def bootstrap_ks_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(resampling.bootstrap_ks(_entities(spark, sf_dir).withColumn("trend", F.col("trend") * 10 + 60), "zone", "std", "trend"))


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.dense(months(spark, sf_dir), "id", START, END).fillna(0.0, ["value"])


@plans.add()
def stl_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stl.stl(_filled(spark, sf_dir)))


@plans.add()
def stl_trend_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend slopes, deviations and seasonal ranges, with tests of the trend, in one pass over each entity."""
    return _rounded(stl.trend_statistics(_filled(spark, sf_dir)))


@plans.add()
def trend_directions_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's trend and deviation by size class and direction: counts and sums."""
    stats = stl.trend_statistics(_filled(spark, sf_dir)).join(_entities(spark, sf_dir).select("id", "size", "std"), "id")
    rows = _classed(stats).withColumn("direction", F.when(F.col("trend_per_period") >= 0, "Positive").otherwise("Negative"))
    return _rounded(rows.groupBy("class", "direction").agg(F.count(F.lit(1)).alias("entities"), F.sum("trend_per_period").alias("trend_sum"), F.sum("std").alias("std_sum"), F.sum("mean_seasonal_range").alias("range_sum")))


@plans.add()
def stl_of_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonal range of the total series of each type, by year."""
    totals = months(spark, sf_dir).join(suppliers(spark, sf_dir), "id").groupBy("kind", "period").agg(F.sum("value").alias("value"))
    parts = stl.stl(totals, "kind", period=12, robust=False)
    return _rounded(parts.groupBy("kind", F.year("period").alias("year")).agg((F.max("seasonal") - F.min("seasonal")).alias("seasonal_range")))


# ---- validation

_PAIRS = "pr AS (SELECT l_partkey AS id, date_trunc('month', l_shipdate)::DATE AS period, sum(l_quantity) AS t, sum(l_quantity * (1 - l_discount)) AS p, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, median(l_quantity) AS md, avg(l_quantity) AS est FROM lineitem GROUP BY 1, 2)"


def _pairs(spark: SparkSession, sf_dir: str, key: str = "l_partkey") -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.col(key).alias("id"), F.trunc("l_shipdate", "MM").alias("period")).agg(
        F.sum(q).alias("t"), F.sum(q * (1 - F.col("l_discount"))).alias("p"), F.count(F.lit(1)).alias("n"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.median(q).alias("md"), F.avg(q).alias("est")
    )


_METRICS = "count(t) AS n, round(1 - sum((t - p) * (t - p)) / nullif(var_pop(t) * count(t), 0), 6) AS r2, round(sqrt(avg((t - p) * (t - p))), 6) AS rmse, round(sqrt(avg((t - p) * (t - p))) / nullif(max(t) - min(t), 0) * 100, 6) AS nrmse_range, round(sqrt(avg((t - p) * (t - p))) / avg(t) * 100, 6) AS nrmse_mean, round(100 * avg(2 * abs(p - t) / nullif(abs(t) + abs(p), 0)), 6) AS smape, round(corr(t, p), 6) AS pearson, round(regr_slope(p, t), 6) AS slope, round(regr_intercept(p, t), 6) AS intercept, round(sqrt(avg((t - p) * (t - p))) / nullif(stddev_pop(t), 0), 6) AS rsr, round(sum(p - t) / sum(t) * 100, 6) AS pbias"


@plans.add(f"WITH {_PAIRS} SELECT id, {_METRICS} FROM pr GROUP BY id HAVING count(t) >= 12")
def entity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(validate.metrics(_pairs(spark, sf_dir), "t", "p", ["id"], 12))


@plans.add(f"WITH {_PAIRS}, q AS (SELECT id, {_METRICS} FROM pr GROUP BY id HAVING count(t) >= 12) SELECT round(median(r2), 5) AS r2, round(median(rmse), 5) AS rmse, round(median(nrmse_range), 5) AS nrmse_range, round(median(rsr), 5) AS rsr, count(*) AS entities FROM q WHERE nrmse_range < 200")
def median_entity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _rounded(validate.metrics(_pairs(spark, sf_dir), "t", "p", ["id"], 12))
    return _rounded(validate.medians(found, ["r2", "rmse", "nrmse_range", "rsr"]), 5)


@plans.add(f"WITH {_PAIRS}, e AS (SELECT id, nullif(avg(t), 0) AS t, nullif(avg(p), 0) AS p FROM pr GROUP BY id), c AS (SELECT CASE WHEN t > 0 AND t <= 30 THEN 'small' WHEN t > 30 AND t <= 1000 THEN 'large' END AS class, t, p FROM e) SELECT class, {_METRICS} FROM c GROUP BY class")
def class_metrics_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = validate.entity_means(_pairs(spark, sf_dir), "id", ["t", "p"])
    return _rounded(validate.metrics(means.withColumn("class", scalars.binned("t", [0, 30, 1000], ["small", "large"])), "t", "p", ["class"]))


@plans.add(f"WITH {_PAIRS}, r AS (SELECT id, rank() OVER (PARTITION BY id ORDER BY t) + (count(*) OVER (PARTITION BY id, t) - 1) / 2.0 AS a, rank() OVER (PARTITION BY id ORDER BY p) + (count(*) OVER (PARTITION BY id, p) - 1) / 2.0 AS b FROM pr) SELECT id, round(corr(a, b), 6) AS spearman FROM r GROUP BY id")
def rank_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.spearman(_pairs(spark, sf_dir), "t", "p", ["id"])
    return _rounded(out)


@plans.add(f"WITH {_PAIRS} SELECT round(median((p - t) / nullif(t, 0) * 100), 6) AS pbias, round(median(abs((p - t) / nullif(t, 0) * 100)), 6) AS absolute_pbias FROM pr")
def bias_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(validate.bias_medians(_pairs(spark, sf_dir), "t", "p"))


@plans.add(f"""WITH {_PAIRS.replace('l_partkey AS id', 'l_suppkey AS id')}, a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, period) AS k FROM pr), z AS (SELECT id, est AS e0, md AS m0, lo AS l0, hi AS h0 FROM a WHERE k = 1),
s AS (SELECT pr.id, est - e0 AS e, md - m0 AS m, lo - h0 AS lo, hi - l0 AS hi, n FROM pr JOIN z USING (id))
SELECT id, count(*) AS n, round(100 * avg((e BETWEEN lo AND hi)::INTEGER), 6) AS within, round(100.0 * sum(CASE WHEN e BETWEEN lo AND hi THEN n ELSE 0 END) / sum(n), 6) AS weighted,
  round(100 * avg(CASE WHEN e BETWEEN lo AND hi THEN 1.0 WHEN e BETWEEN lo - (hi - lo) / 2 AND hi + (hi - lo) / 2 THEN 0.5 ELSE 0.0 END), 6) AS half, round(sqrt(avg((m - e) * (m - e))), 6) AS rmse, round(corr(m, e), 6) AS pearson FROM s GROUP BY id HAVING count(*) >= 5""")
def share_within_observed_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(validate.within_observed(_pairs(spark, sf_dir, "l_suppkey"), "id", "est", "md", "lo", "hi", "n"))


# ---- joins on keys, records, arrivals


@plans.add(f"""WITH {MONTHS_SQL}, a AS (SELECT id, period, value FROM m WHERE cloud <= 0.5) SELECT m.id, m.period, coalesce(a.value * 2, m.value) AS value FROM m LEFT JOIN a USING (id, period)""")
def values_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = months(spark, sf_dir).select("id", "period", "value", "cloud")
    new = base.where("cloud <= 0.5").select("id", "period", (F.col("value") * 2).alias("value"))
    return records.overwritten(base.drop("cloud"), new, ["id", "period"], ["value"])


@plans.add("""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality + 10 END AS quality, 'seen' AS state FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id + 1000000, 5, 'new' FROM labels WHERE doc_id < 50)
SELECT coalesce(l.doc_id, n.doc_id) AS doc_id, coalesce(n.quality, l.quality) AS quality, l.toxic, n.state FROM labels l FULL JOIN n ON l.doc_id = n.doc_id""")
def records_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "labels")
    changes = old.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("quality") + 10).alias("quality"), F.lit("seen").alias("state"))
    changes = changes.union(old.where("doc_id < 50").select(F.col("doc_id") + 1000000, F.lit(5), F.lit("new")))
    return records.upserted(old, changes, "doc_id")


@plans.add("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def keys_without_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.discovered(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@plans.add("SELECT user_id, event_type, date_trunc('day', ts)::DATE AS day, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2, 3")
def arrivals_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream of files, merged by (user, type, day); the last event wins."""
    from ..operators.graph import settled as _settled

    _settled(spark.range(1))  # sets the shared folder where none is
    root = arrivals.new_name(f"{spark.sparkContext.getCheckpointDir()}/arrivals")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select("user_id", "event_type", F.to_date("ts").alias("day"), "value", "event_id")
    arrivals.ingest(rows, f"{root}/table", f"{root}/log", ["user_id", "event_type", "day"], ["event_id"])
    return arrivals.current(spark, f"{root}/log").select("user_id", "event_type", "day", "value")


# ---- scalar functions

_BITS = lambda v, a, b: f"(({v} >> {a}) & {(1 << (b - a + 1)) - 1})"


@plans.add(f"SELECT event_id, {_BITS('event_id', 2, 5)} AS bits, {_BITS('event_id', 0, 1)} = 0 AND {_BITS('event_id', 2, 2)} = 0 AND {_BITS('event_id', 8, 9)} = 0 AS clear, CASE WHEN event_id % 3 = 0 THEN 999999 ELSE event_id % 3 - 1 END AS class FROM events")
def quality_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scalars.bit_field("event_id", 2, 5).alias("bits"), scalars.is_clear("event_id").alias("clear"), scalars.recode_class(F.col("event_id") % 3).cast("long").alias("class"))


def _depth_sql(a: str, s: str) -> str:
    case = lambda c: f"pow(10, {c[1]} + {c[2]} * log10({a}) + {c[3]} * log10({s}) + {c[4]})"
    whens = " ".join(f"WHEN {a} < {c[0]} THEN {case(c)}" for c in scalars.DEPTH_CLASSES[:-1])
    return f"CASE WHEN {a} = 0 THEN 0 {whens} ELSE {case(scalars.DEPTH_CLASSES[-1])} END"


_SLOPED = "v AS (SELECT p_partkey AS id, p_size * p_size / 8.0 - 0.125 AS a, p_retailprice / 300 AS s FROM part)"


@plans.add(f"WITH {_SLOPED} SELECT id, round({_depth_sql('a', 's')}, 6) AS depth, round(({_depth_sql('a', 's')}) * a, 5) AS volume, round(pow(a * 2 / s, 1 / 1.5), 6) AS level FROM v")
def depths_and_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * F.col("p_size") / 8.0 - 0.125).alias("a"), (F.col("p_retailprice") / 300).alias("s"))
    return v.select("id", F.round(scalars.mean_depth("a", "s"), 6).alias("depth"), F.round(scalars.volume("a", "s"), 5).alias("volume"), F.round(scalars.level("a", F.col("s"), F.lit(1.5), 2.0), 6).alias("level"))


@plans.add(f"""WITH {SUPPLIERS_SQL}, r AS (SELECT *, min(slope) OVER (PARTITION BY zone) AS lo, max(slope) OVER (PARTITION BY zone) AS hi FROM sup)
SELECT id, round((90 + least(1.0, greatest(0.0, (id - 10.0) / 70.0)) * 2160) * (1 + CASE WHEN slope = -1 THEN 0.5 ELSE (hi - slope) / nullif(hi - lo, 0) END), 5) AS distance FROM r""")
def buffer_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("zone")
    d = scalars.buffer_distance("id", "slope", (10.0, 80.0), F.min("slope").over(w), F.max("slope").over(w))
    return suppliers(spark, sf_dir).select("id", F.round(d, 5).alias("distance"))


@plans.add("SELECT event_id, CASE WHEN event_id % 360 > 180 THEN event_id % 360 - 360 ELSE event_id % 360 END AS lon, date_trunc('month', ts)::DATE AS period, ['train', 'eval', 'test'][((month(ts) + year(ts) - 2001) % 3) + 1] AS split, CASE WHEN value > 0 AND value <= 10 THEN 'low' WHEN value > 10 AND value <= 1e6 THEN 'high' END AS class, map {'click': 'C', 'view': 'V'}[event_type] AS code FROM events")
def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.longitude(F.col("event_id") % 360).alias("lon"), scalars.month_of("ts").alias("period"), scalars.split_of("ts", 2001).alias("split"),
        scalars.binned("value", [0, 10, 1e6], ["low", "high"]).alias("class"), scalars.mapped("event_type", {"click": "C", "view": "V"}).alias("code"),
    )


@plans.add(f"""WITH {POINTS_SQL}, q AS (SELECT *, (1 - CASE WHEN y >= 0 THEN 1 ELSE 0 END) * 3 + greatest(0, (x >= -0.5)::INTEGER + (x >= -0.1)::INTEGER + (x >= 0.1)::INTEGER - 1) AS cell,
  CASE WHEN x > 0 AND y > 0 THEN 'ur' WHEN x > 0 AND y < 0 THEN 'lr' WHEN x < 0 AND y > 0 THEN 'ul' WHEN x < 0 AND y < 0 THEN 'll' END AS quadrant FROM p) SELECT cell, quadrant, count(*) AS n FROM q GROUP BY 1, 2""")
def colour_cells_and_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select(scalars.cell_index("x", "y", [-0.5, -0.1, 0.1], [-1.0, 0.0]).alias("cell"), scalars.quadrant("x", "y", F.lit(0.0), F.lit(0.0)).alias("quadrant"))
    return rows.groupBy("cell", "quadrant").agg(F.count(F.lit(1)).alias("n"))


@plans.add(f"WITH {DENSE_SQL} SELECT id, round(avg(value) FILTER (year_idx = 0), 6) AS first_year, round(avg(value) FILTER (year_idx = 6), 6) AS last_year, count(value) AS known FROM d GROUP BY id")
def first_and_last_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dense_months(spark, sf_dir)
    at = lambda k: F.avg(F.when(F.col("year_idx") == k, F.col("value")))
    return _rounded(d.groupBy("id").agg(at(0).alias("first_year"), at(YEARS - 1).alias("last_year"), F.count("value").alias("known")))
