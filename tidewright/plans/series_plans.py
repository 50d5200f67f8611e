"""Queries of reshaping, yearly statistics, tests, masks and fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import TWO_SIDED_P_SQL
from ..operators import fill, reshape, series
from . import Plans
from .proxies import DENSE_SQL, MONTHS_SQL, SUPPLIERS_SQL, YEARLY_SQL, YEARS, dense_months, months, suppliers

plans = Plans()
PERIODS = [f"{y}-{m:02d}-01" for y in range(1995, 2002) for m in range(1, 13)]


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n.split('.')[-1]}" for n in names)


@plans.add(f"""WITH {YEARLY_SQL}, {SUPPLIERS_SQL},
t AS (SELECT id, avg(std) AS s, CASE WHEN count(std) = count(*) THEN regr_slope(std, year_idx) END AS st, CASE WHEN count(mean) = count(*) THEN regr_slope(mean, year_idx) END AS mt FROM y GROUP BY id)
SELECT zone, kind, count(*) AS entities, round(avg(s), 6) AS mean_std, round(median(s), 6) AS median_std, round(stddev_samp(s), 6) AS std_of_std,
  round(sum(st), 6) AS sum_trend_of_std, round(coalesce(sum(CASE WHEN mt > 0 THEN mt END), 0), 6) AS positive_trend, round(coalesce(sum(CASE WHEN mt < 0 THEN mt END), 0), 6) AS negative_trend
FROM t JOIN sup USING (id) GROUP BY 1, 2""")
def entity_year_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: months to years to trends of each entity, rolled up to zones and kinds."""
    stats = series.statistics(dense_months(spark, sf_dir), YEARS).join(suppliers(spark, sf_dir), "id")
    m = F.col("trend_of_annual_mean")
    return _rounded(
        stats.groupBy("zone", "kind").agg(
            F.count(F.lit(1)).alias("entities"), F.avg("mean_annual_std").alias("mean_std"), F.median("mean_annual_std").alias("median_std"), F.stddev_samp("mean_annual_std").alias("std_of_std"),
            F.sum("trend_of_std").alias("sum_trend_of_std"), F.coalesce(F.sum(F.when(m > 0, m)), F.lit(0.0)).alias("positive_trend"), F.coalesce(F.sum(F.when(m < 0, m)), F.lit(0.0)).alias("negative_trend"),
        )
    )


_G = lambda y, x="year_idx": f"CASE WHEN count({y}) = count(*) THEN regr_slope({y}, {x}) END"
_IN = lambda f, x, a, b: f"{f}(CASE WHEN year_idx BETWEEN {a} AND {b} THEN {x} END)"
_ENT = lambda a, b: f"(CASE WHEN {_IN('sum', 'total', a, b)} = 0 THEN 0 WHEN {_IN('sum', 'n', a, b)} > 1 THEN (ln({_IN('sum', 'total', a, b)}) - {_IN('sum', 'vlv', a, b)} / {_IN('sum', 'total', a, b)}) / ln({_IN('sum', 'n', a, b)}) END)"
_REL = lambda a, b: f"CASE WHEN {a} > 1e-5 AND {b} > 1e-5 THEN 2 * ({b} - {a}) / ({a} + {b}) * 100 END"
_SH = lambda a, b: f"{a} / nullif({a} + {b}, 0) * 100"
_CH = "CASE WHEN count(CASE WHEN year_idx > 0 THEN change END) = count(CASE WHEN year_idx > 0 THEN 1 END) THEN regr_slope(abs(change), year_idx) END"
_SA, _SB = _IN("avg", "std", 0, 2), _IN("avg", "std", 4, 6)
_DA, _DB = _IN("stddev_pop", "change", 1, 2), _IN("stddev_pop", "change", 5, 6)
_MA, _MB = _IN("avg", "abs(change)", 1, 2), _IN("avg", "abs(change)", 5, 6)
_AA, _AB = _IN("avg", "mean", 0, 2), _IN("avg", "mean", 4, 6)
_STATS = {
    "mean_annual_std": "avg(std)", "mean_annual_std_percentage": "avg(std) / (sum(total) / sum(n))", "mean_annual_first_difference": "avg(abs(change))",
    "mean_annual_first_difference_percentage": "avg(abs(change)) / avg(CASE WHEN year_idx < 6 THEN mean END)", "mean_apportion_entropy": "avg(entropy)",
    "trend_of_std": _G("std"), "trend_of_std_share": f"({_G('std')}) / avg(std) * 100", "trend_of_annual_mean": _G("mean"), "trend_of_annual_mean_share": f"({_G('mean')}) / avg(mean) * 100",
    "trend_of_first_difference": _CH, "trend_of_first_difference_share": f"({_CH}) / avg(abs(change)) * 100", "trend_of_entropy": _G("entropy"),
    "difference_in_annual_mean_std": f"{_IN('stddev_pop', 'mean', 4, 6)} - {_IN('stddev_pop', 'mean', 0, 2)}", "difference_in_entropy": f"{_ENT(4, 6)} - {_ENT(0, 2)}",
    "difference_in_annual_std": f"{_SB} - {_SA}", "relative_difference_in_annual_std": _REL(_SA, _SB), "difference_in_first_difference_std": f"{_DB} - {_DA}",
    "relative_difference_in_first_difference_std": _REL(_DA, _DB), "difference_in_monthly_change": f"{_IN('avg', 'monthly_change', 4, 6)} - {_IN('avg', 'monthly_change', 0, 2)}",
    "std_percentage_of_first": _SH(_SA, _SB), "std_percentage_of_second": _SH(_SB, _SA), "first_difference_percentage_of_first": _SH(_MA, _MB), "first_difference_percentage_of_second": _SH(_MB, _MA),
    "mean_percentage_of_first": _SH(_AA, _AB), "mean_percentage_of_second": _SH(_AB, _AA), "annual_means_std": "stddev_pop(mean)",
}


@plans.add(
    f"WITH {YEARLY_SQL}, s AS (SELECT id, "
    + ", ".join(f"{v} AS {k}" for k, v in _STATS.items())
    + " FROM y GROUP BY id), w AS (SELECT id, CASE WHEN count(value) = count(*) THEN avg(value) END AS mean_value, CASE WHEN count(value) = count(*) THEN regr_slope(value, month_idx) * 13 END AS trend_per_period FROM d GROUP BY id) SELECT id, "
    + ", ".join(f"round({k}, 6) + 0.0 AS {k}" for k in ("mean_value", "trend_per_period", *_STATS))
    + " FROM s JOIN w USING (id)"
)
def series_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics without decomposition, one row for each entity."""
    return _rounded(series.statistics(dense_months(spark, sf_dir), YEARS))


@plans.add(f"WITH {YEARLY_SQL} SELECT id, year_idx::INTEGER AS year_idx, round(std, 6) AS std, round(abs(change), 6) AS first_difference FROM y")
def annual_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.annual_vectors(dense_months(spark, sf_dir))
    return out.select("id", "year_idx", F.round("std", 6).alias("std"), F.round("first_difference", 6).alias("first_difference"))


def _mk_sql(x: str, alpha: float, bound: float) -> str:
    p = TWO_SIDED_P_SQL.format(z="z")
    return f"""WITH {YEARLY_SQL},
x AS (SELECT id, year_idx AS t, {x} AS x FROM y WHERE {x} IS NOT NULL),
i AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) AS i, count(*) OVER (PARTITION BY id) AS n FROM x),
tr AS (SELECT a.id, sum(sign(b.x - a.x))::DOUBLE AS s, median((b.x - a.x) / (b.i - a.i)) AS slope, any_value(a.n) AS n FROM i a JOIN i b ON a.id = b.id AND a.i < b.i GROUP BY a.id),
ti AS (SELECT id, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT id, x, count(*) AS c FROM i GROUP BY 1, 2) GROUP BY id),
f AS (SELECT i.id, i.i, i.n, round(i.x - tr.slope * i.i, 9) AS d FROM i JOIN tr USING (id)),
r AS (SELECT id, i, n, rank() OVER (PARTITION BY id ORDER BY d) + (count(*) OVER (PARTITION BY id, d) - 1) / 2.0 - (n + 1) / 2.0 AS r FROM f),
co AS (SELECT a.id, b.i - a.i AS lag, sum(a.r * b.r) AS c, any_value(a.n) AS n FROM r a JOIN r b ON a.id = b.id AND b.i > a.i GROUP BY 1, 2),
w AS (SELECT id, sum(r * r) AS power FROM r GROUP BY id),
ex AS (SELECT co.id, sum((n - lag) * (n - lag - 1) * (n - lag - 2) * c / nullif(power, 0)) AS extra FROM co JOIN w USING (id) WHERE abs(c / nullif(power, 0)) >= {bound} / sqrt(n) GROUP BY co.id),
va AS (SELECT tr.id, s, slope, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 * (1 + 2 * coalesce(extra, 0) / (n * (n - 1.0) * (n - 2))) AS var FROM tr JOIN ti USING (id) LEFT JOIN ex USING (id)),
z AS (SELECT *, CASE WHEN s = 0 THEN 0.0 WHEN var > 0 THEN (s - sign(s)) / sqrt(var) END AS z FROM va),
q AS (SELECT *, {p} AS p FROM z)
SELECT id, s, round(slope, 6) + 0.0 AS slope, round(z, 6) + 0.0 AS z, round(p, 6) + 0.0 AS p, CASE WHEN p < {alpha} AND z > 0 THEN 'increasing' WHEN p < {alpha} AND z < 0 THEN 'decreasing' WHEN z IS NOT NULL THEN 'no trend' END AS trend, p < 0.05 AS significant FROM q"""


@plans.add(_mk_sql("mean", 0.05, 1.959963984540054))
def mann_kendall_of_annual_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.analyse(dense_months(spark, sf_dir), "mk_of_annual_mean", YEARS))


@plans.add(_mk_sql("std", 0.1, 1.6448536269514722))
def mann_kendall_of_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.analyse(dense_months(spark, sf_dir), "mk_of_std", YEARS))


@plans.add(_mk_sql("abs(change)", 0.1, 1.6448536269514722))
def mann_kendall_of_first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.analyse(dense_months(spark, sf_dir), "mk_of_first_difference", YEARS))


_OVERALL = "(sum(total) OVER (PARTITION BY id) / sum(n) OVER (PARTITION BY id))"
_SHARED = YEARLY_SQL + f", yo AS (SELECT *, std / nullif({_OVERALL}, 0) AS std_share, abs(change) / nullif({_OVERALL}, 0) AS change_share FROM y)"


@plans.add(_mk_sql("std_share", 0.1, 1.6448536269514722).replace(YEARLY_SQL, _SHARED).replace("FROM y WHERE", "FROM yo WHERE"))
def mann_kendall_of_std_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.analyse(dense_months(spark, sf_dir), "mk_of_std_percentage", YEARS))


@plans.add(_mk_sql("change_share", 0.1, 1.6448536269514722).replace(YEARLY_SQL, _SHARED).replace("FROM y WHERE", "FROM yo WHERE"))
def mann_kendall_of_first_difference_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.analyse(dense_months(spark, sf_dir), "mk_of_first_difference_percentage", YEARS))


@plans.add(f"WITH {YEARLY_SQL} SELECT id, round({_STATS['trend_of_std']}, 6) + 0.0 AS trend_of_std FROM y GROUP BY id")
def named_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.analyse(dense_months(spark, sf_dir), "trend_of_std", YEARS))


@plans.add(_mk_sql("entropy", 0.1, 1.6448536269514722))
def mann_kendall_of_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.analyse(dense_months(spark, sf_dir), "mk_of_entropy", YEARS))


def _pettitt_sql(x: str) -> str:
    return f"""WITH {YEARLY_SQL},
x AS (SELECT id, year_idx, {x} AS x, count(*) OVER (PARTITION BY id) AS n FROM y WHERE {x} IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY x) + (count(*) OVER (PARTITION BY id, x) - 1) / 2.0 AS r, row_number() OVER (PARTITION BY id ORDER BY year_idx) AS i FROM x),
u AS (SELECT *, abs(2 * sum(r) OVER (PARTITION BY id ORDER BY year_idx) - i * (n + 1)) AS u FROM r),
k AS (SELECT id, u AS k, year_idx AS cp, n FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY u DESC, i) = 1)
SELECT id, k::DOUBLE AS k, cp::INTEGER AS cp, round(least(1.0, 2 * exp(-6 * k * k / (n * n * n + n * n)::DOUBLE)), 6) AS p, least(1.0, 2 * exp(-6 * k * k / (n * n * n + n * n)::DOUBLE)) < 0.05 AS significant FROM k"""


@plans.add(_pettitt_sql("mean"))
def pettitt_of_annual_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.analyse(dense_months(spark, sf_dir), "pettitt_of_annual_mean", YEARS))


@plans.add(_pettitt_sql("std"))
def pettitt_of_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.analyse(dense_months(spark, sf_dir), "pettitt_of_std", YEARS))


@plans.add(_pettitt_sql("abs(change)"))
def pettitt_of_first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.analyse(dense_months(spark, sf_dir), "pettitt_of_first_difference", YEARS))


_FLAGS_SQL = f"""{DENSE_SQL},
v AS (SELECT *, CASE WHEN NOT masked THEN value END AS x, avg(CASE WHEN NOT masked THEN value END) OVER (PARTITION BY id, year_idx) AS annual FROM d),
l AS (SELECT id, position, quantile_cont(x, 0.25) AS lim, count(x) AS known FROM v GROUP BY 1, 2),
f AS (SELECT v.*, coalesce(x < lim AND known >= 4, false) AS low FROM v JOIN l USING (id, position))"""


@plans.add(f"WITH {_FLAGS_SQL} SELECT id, period, low FROM f WHERE low")
def low_value_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.low_flags(dense_months(spark, sf_dir), threshold=0.25).where("low").select("id", "period", "low")


@plans.add(f"""WITH {_FLAGS_SQL}, fc AS (SELECT id, count(*) FILTER (low AND NOT masked AND year_idx <= 2)::DOUBLE AS x1, count(*) FILTER (NOT masked AND year_idx <= 2)::DOUBLE AS n1,
  count(*) FILTER (low AND NOT masked AND year_idx >= 4)::DOUBLE AS x2, count(*) FILTER (NOT masked AND year_idx >= 4)::DOUBLE AS n2 FROM f GROUP BY id),
z AS (SELECT *, (x2 / n2 - x1 / n1) / nullif(sqrt((x1 + x2) / (n1 + n2) * (1 - (x1 + x2) / (n1 + n2)) * (1 / n1 + 1 / n2)), 0) AS z FROM fc)
SELECT id, round(x2 / n2 - x1 / n1, 6) + 0.0 AS increase, round({TWO_SIDED_P_SQL.format(z='z')}, 6) + 0.0 AS p FROM z""")
def low_value_frequency_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.low_flag_change(series.low_flags(dense_months(spark, sf_dir), threshold=0.25), YEARS))


@plans.add(f"""WITH {_FLAGS_SQL}, g AS (SELECT id, CASE WHEN low AND NOT masked AND year_idx <= 2 THEN value - annual END AS dv FROM f)
SELECT id, round(avg(dv), 6) + 0.0 AS mean_deviation, round(max(dv), 6) + 0.0 AS max_deviation, round(min(dv), 6) + 0.0 AS min_deviation FROM g GROUP BY id""")
def low_value_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.low_deviations(series.low_flags(dense_months(spark, sf_dir), threshold=0.25), (0, 2)))


# ---- reshape


@plans.add(f"WITH {MONTHS_SQL} SELECT id, " + ", ".join(f"sum(CASE WHEN period = DATE '{p}' THEN value END) AS \"{p}\"" for p in PERIODS) + " FROM m GROUP BY id")
def months_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.to_wide(months(spark, sf_dir), "id", PERIODS)


@plans.add(f"WITH {DENSE_SQL} SELECT id, period, value FROM d")
def wide_to_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide and back: a row for every month."""
    return reshape.to_long(reshape.to_wide(months(spark, sf_dir), "id", PERIODS), "id", PERIODS)


@plans.add(f"WITH {DENSE_SQL}, t AS (SELECT id, period, value / 2 AS a, nullif(floor(cloud * 2), 0) AS b, masked FROM d) SELECT id, period, a, b FROM t WHERE a IS NOT NULL AND b IS NOT NULL AND NOT masked")
def valid_value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dense_months(spark, sf_dir).withColumn("b", F.floor(F.col("cloud") * 2).cast("double"))
    return reshape.valid_pairs(reshape.scaled(rows.withColumn("a", F.col("value")), "a", 0.5), "a", "b", "masked").select("id", "period", "a", "b")


@plans.add(f"WITH {SUPPLIERS_SQL} SELECT id, t AS type, v AS value, CASE WHEN v >= 0 THEN 'Positive' WHEN v IS NULL THEN 'Negative' ELSE 'Negative' END AS direction FROM (SELECT id, 'slope_natural' AS t, CASE WHEN kind = 1 THEN slope * 10 END AS v FROM sup UNION ALL SELECT id, 'slope_managed', CASE WHEN kind <> 1 THEN slope * 10 END FROM sup)")
def measures_stacked_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = reshape.split_by_type(suppliers(spark, sf_dir), "slope", "kind", factor=10.0)
    return reshape.stacked(split, ["id"], ["slope_natural", "slope_managed"])


@plans.add(f"WITH {SUPPLIERS_SQL} SELECT id, zone, ntile(3) OVER (PARTITION BY zone ORDER BY id)::INTEGER AS part, row_number() OVER (PARTITION BY zone ORDER BY id)::INTEGER AS number FROM sup")
def numbered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reshape.contiguous_parts(suppliers(spark, sf_dir), "id", 3, ["zone"])
    return reshape.numbered_in_group(rows, F.col("zone"), "id").select("id", "zone", "part", "number")


# ---- fills


@plans.add(f"""WITH {DENSE_SQL}, x AS (SELECT *, CASE WHEN NOT masked THEN value END AS v FROM d)
SELECT id, period, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY id ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM x""")
def fill_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dense_months(spark, sf_dir).withColumn("value", reshape.masked_to_null())
    return fill.carried(rows).select("id", "period", "value")


_LINEAR_SQL = """n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY period) AS i FROM x),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ia, last_value(v IGNORE NULLS) OVER a AS va, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ib, first_value(v IGNORE NULLS) OVER b AS vb
  FROM n WINDOW a AS (PARTITION BY id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY id ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
o AS (SELECT *, CASE WHEN v IS NOT NULL THEN v WHEN ia IS NULL AND ib IS NULL THEN 0 WHEN ia IS NULL THEN vb WHEN ib IS NULL THEN va ELSE va + (vb - va) * (i - ia) / (ib - ia) END AS filled FROM k)"""


@plans.add(f"WITH {DENSE_SQL}, x AS (SELECT *, CASE WHEN cloud <= 0.5 OR cloud IS NULL THEN value END AS v FROM d), {_LINEAR_SQL} SELECT id, period, round(filled, 6) AS value FROM o")
def cloud_masked_and_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fill.cloud_masked(dense_months(spark, sf_dir), threshold=0.5).select("id", "period", "value"))


@plans.add(f"""WITH {DENSE_SQL}, x AS (SELECT *, coalesce(ice > 0.65, false) AS fr FROM d), v AS (SELECT *, CASE WHEN NOT fr THEN value END AS v FROM x)
SELECT id, period, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY id ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value, fr AS masked FROM v""")
def freeze_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.freeze_masked(dense_months(spark, sf_dir).drop("masked"), threshold=0.65).select("id", "period", "value", "masked")


_LOF_SQL = """sc AS (SELECT id, period, row_number() OVER w AS i, 5.0 * (row_number() OVER w - 1) / (count(*) OVER (PARTITION BY id) - 1) AS x, (val - min(val) OVER (PARTITION BY id)) / nullif(max(val) OVER (PARTITION BY id) - min(val) OVER (PARTITION BY id), 0) AS yy FROM src WINDOW w AS (PARTITION BY id ORDER BY period)),
pr AS (SELECT a.id, a.i, b.i AS j, sqrt(pow(a.x - b.x, 2) + pow(a.yy - b.yy, 2)) AS dd FROM sc a JOIN sc b ON a.id = b.id AND a.i <> b.i AND a.yy IS NOT NULL AND b.yy IS NOT NULL),
ne AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY id, i ORDER BY round(dd, 9), j) <= 12),
kd AS (SELECT id, i, max(dd) AS kd FROM ne GROUP BY 1, 2),
lr AS (SELECT ne.id, ne.i, 1 / (avg(greatest(dd, kd)) + 1e-10) AS lrd FROM ne JOIN kd ON kd.id = ne.id AND kd.i = ne.j GROUP BY 1, 2),
lo AS (SELECT ne.id, ne.i, avg(lr.lrd) AS l FROM ne JOIN lr ON lr.id = ne.id AND lr.i = ne.j GROUP BY 1, 2),
lf AS (SELECT sc.id, sc.period, l / lrd AS lof FROM lo JOIN lr USING (id, i) JOIN sc USING (id, i))"""


@plans.add(f"WITH {MONTHS_SQL}, src AS (SELECT id, period, value AS val FROM m), {_LOF_SQL} SELECT id, period, round(lof, 5) AS lof, lof > 1.5 AS outlier FROM lf")
def local_outlier_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill.outlier_factors(months(spark, sf_dir))
    return found.select("id", "period", F.round("lof", 5).alias("lof"), (F.col("lof") > 1.5).alias("outlier"))


_CARRIED = lambda v: f"coalesce(last_value({v} IGNORE NULLS) OVER (PARTITION BY id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({v} IGNORE NULLS) OVER (PARTITION BY id ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
_EVEN = "coalesce(min(value) OVER (PARTITION BY id) = max(value) OVER (PARTITION BY id), false)"


@plans.add(f"""WITH {DENSE_SQL}, ca AS (SELECT * REPLACE ({_CARRIED('value')} AS value) FROM d), ev AS (SELECT *, {_EVEN} AS even FROM ca), src AS (SELECT id, period, value AS val FROM ca), {_LOF_SQL},
x AS (SELECT ev.*, CASE WHEN even OR NOT coalesce(cloud > 0.5 OR (lof > 1.5 AND cloud > 0.1), false) THEN value END AS v FROM ev LEFT JOIN lf USING (id, period)), {_LINEAR_SQL}
SELECT id, period, round(CASE WHEN even THEN value ELSE filled END, 6) AS value FROM o""")
def cloud_masked_with_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fill.cloud_masked(fill.carried(dense_months(spark, sf_dir)), threshold=0.5, outliers=True, outlier_ratio=0.1).select("id", "period", "value"))


@plans.add(f"""WITH {DENSE_SQL}, ca AS (SELECT * REPLACE ({_CARRIED('value')} AS value) FROM d), fr AS (SELECT *, {_EVEN} AS even, coalesce(ice > 0.65, false) AS frozen FROM ca),
md AS (SELECT id, year_idx, quantile_cont(value, 0.5) FILTER (NOT frozen) AS middle FROM fr GROUP BY 1, 2),
se AS (SELECT fr.*, CASE WHEN frozen THEN middle ELSE value END AS seen, row_number() OVER (PARTITION BY id, year_idx, frozen ORDER BY period) AS a, row_number() OVER (PARTITION BY id, year_idx, frozen ORDER BY period DESC) AS z, count(*) FILTER (NOT frozen) OVER (PARTITION BY id, year_idx) AS open FROM fr JOIN md USING (id, year_idx)),
src AS (SELECT id, period, seen AS val FROM se), {_LOF_SQL},
mk AS (SELECT se.*, NOT even AND (frozen OR coalesce(lof > 1.5 AND NOT frozen AND (a = 1 OR z = 1 OR (open > 2 AND (a = 2 OR z = 2))), false)) AS mask FROM se LEFT JOIN lf USING (id, period)),
vv AS (SELECT *, CASE WHEN NOT mask THEN value END AS v FROM mk)
SELECT id, period, round({_CARRIED('v')}, 6) AS value, mask AS masked FROM vv""")
def freeze_masked_with_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill.carried(dense_months(spark, sf_dir).drop("masked"))
    return _rounded(fill.freeze_masked_with_outliers(rows, threshold=0.65).select("id", "period", "value", "masked"))


_DAYS = """dy AS (SELECT l_suppkey AS id, l_shipdate::DATE AS day, quantile_cont(l_quantity - 25, 0.5) AS h FROM lineitem GROUP BY 1, 2),
ic AS (SELECT id, date_trunc('month', day)::DATE AS period, count(*) FILTER (h > 0) / count(h)::DOUBLE AS ice FROM dy GROUP BY 1, 2)"""


@plans.add(f"WITH {_DAYS} SELECT id, period, round(ice, 6) AS ice FROM ic")
def monthly_ice_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fill.monthly_ice_ratio(_ice_days(spark, sf_dir)))


def _ice_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("day"), (F.col("l_quantity") - 25).alias("ice_height"))


@plans.add(f"""WITH {_DAYS}, la AS (SELECT id, max(period) AS last FROM ic GROUP BY 1),
mo AS (SELECT id, month(period) AS m, avg(ice) AS ice FROM ic JOIN la USING (id) WHERE period > last - INTERVAL 60 MONTH GROUP BY 1, 2),
ta AS (SELECT id, unnest(generate_series(last + INTERVAL 1 MONTH, DATE '2002-12-01', INTERVAL 1 MONTH))::DATE AS period FROM la)
SELECT id, period, round(ice, 6) AS ice FROM ic UNION ALL SELECT ta.id, ta.period, round(mo.ice, 6) FROM ta JOIN mo ON mo.id = ta.id AND mo.m = month(ta.period)""")
def ice_ratio_with_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fill.extended_by_climatology(fill.monthly_ice_ratio(_ice_days(spark, sf_dir)), "id", "2003-01-01"))


@plans.add(f"""WITH RECURSIVE {MONTHS_SQL}, n AS (SELECT id, period, value, row_number() OVER (PARTITION BY id ORDER BY period) AS i FROM m),
r AS (SELECT id, period, value, i, value AS smoothed, [value] AS past FROM n WHERE i = 1
  UNION ALL SELECT n.id, n.period, n.value, n.i, CASE WHEN n.i <= 3 THEN n.value ELSE (list_sum(past) + n.value) / 4 END, list_append(past, CASE WHEN n.i <= 3 THEN n.value ELSE (list_sum(past) + n.value) / 4 END)[-3:] FROM r JOIN n ON n.id = r.id AND n.i = r.i + 1)
SELECT id, period, round(value, 6) AS value, round(smoothed, 6) AS smoothed FROM r""")
def recursive_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fill.smoothed(months(spark, sf_dir), 3))


@plans.add(f"""WITH {MONTHS_SQL} SELECT id, period, round(value - avg(value) OVER (PARTITION BY id), 6) + 0.0 AS about_mean, value - first_value(value) OVER (PARTITION BY id ORDER BY period) AS about_first FROM m""")
def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill.anomaly(months(spark, sf_dir)).withColumnRenamed("anomaly", "about_mean")
    return _rounded(fill.anomaly(rows, about="first").select("id", "period", "about_mean", F.col("anomaly").alias("about_first")))


@plans.add(f"""WITH {MONTHS_SQL}, {SUPPLIERS_SQL}, t AS (SELECT kind, period, sum(value) AS total FROM m JOIN sup USING (id) GROUP BY 1, 2), a AS (SELECT *, total - avg(total) OVER (PARTITION BY kind) AS anomaly FROM t)
SELECT kind, period, total, round(anomaly, 6) + 0.0 AS anomaly, round(sum(anomaly) OVER (PARTITION BY period), 6) + 0.0 AS total_anomaly FROM a""")
def total_series_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = months(spark, sf_dir).join(suppliers(spark, sf_dir), "id").groupBy("kind", "period").agg(F.sum("value").alias("total"))
    rows = fill.anomaly(totals, key="kind", value="total")
    return _rounded(rows.withColumn("total_anomaly", F.sum("anomaly").over(Window.partitionBy("period"))))




@plans.add()
def pettitt_simulated_of_annual_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change points with a p from the simulated distribution of each series length, beside the closed form."""
    return _rounded(series.pettitt_simulated(series.yearly(dense_months(spark, sf_dir)), "mean"))
