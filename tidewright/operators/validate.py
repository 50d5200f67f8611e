"""Validation metrics over aligned pairs of an estimate and a truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import binned
from .fill import anomaly
from .records import upserted
from .rollup import box_statistics, segmentation_metrics


def _of(a: str, b: str) -> tuple[Column, Column]:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))


def r_squared(true: str, pred: str) -> Column:
    """1 - residual / total about the mean of the truth; null for one pair or none."""
    t, p = _of(true, pred)
    return F.when(F.count(t) > 1, 1 - F.try_divide(F.sum((t - p) * (t - p)), F.var_pop(t) * F.count(t)))


def rmse(true: str, pred: str) -> Column:
    t, p = _of(true, pred)
    return F.sqrt(F.avg((t - p) * (t - p)))


def nrmse(true: str, pred: str, by: str = "range") -> Column:
    """Percent of the truth's range or mean."""
    t, _ = _of(true, pred)
    return F.try_divide(rmse(true, pred), F.max(t) - F.min(t) if by == "range" else F.avg(t)) * 100


def smape(true: str, pred: str) -> Column:
    t, p = _of(true, pred)
    return 100 * F.avg(F.try_divide(2 * F.abs(p - t), F.abs(t) + F.abs(p)))


def nse(true: str, pred: str) -> Column:
    return r_squared(true, pred)


def metrics(df: DataFrame, true: str, pred: str, by: Sequence[str] = (), least: int = 1) -> DataFrame:
    """All metrics of each group with `least` pairs or more."""
    t, p = _of(true, pred)
    out = df.groupBy(*by).agg(
        F.count(t).alias("n"), r_squared(true, pred).alias("r2"), rmse(true, pred).alias("rmse"), nrmse(true, pred).alias("nrmse_range"), nrmse(true, pred, "mean").alias("nrmse_mean"),
        smape(true, pred).alias("smape"), F.corr(t, p).alias("pearson"), F.regr_slope(p, t).alias("slope"), F.regr_intercept(p, t).alias("intercept"),
        (F.try_divide(rmse(true, pred), F.stddev_pop(t))).alias("rsr"), (F.try_divide(F.sum(p - t), F.sum(t)) * 100).alias("pbias"),
    )
    return out.where(F.col("n") >= least)


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of average ranks."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    keys = [F.col(c) for c in by] or [F.lit(1)]
    rank = lambda c: F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2
    return rows.withColumns({"__a": rank(a), "__b": rank(b)}).groupBy(*by).agg(F.corr("__a", "__b").alias("spearman"))


def medians(found: DataFrame, columns: Sequence[str], by: Sequence[str] = (), worst_nrmse: float | None = 200.0) -> DataFrame:
    """Medians over entities, without those whose NRMSE is at or above a limit."""
    rows = found.where(F.col("nrmse_range") < worst_nrmse) if worst_nrmse is not None else found
    return rows.groupBy(*by).agg(*(F.median(c).alias(c) for c in columns), F.count(F.lit(1)).alias("entities"))


def bias_medians(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Medians over pairs of the percent bias and of its size."""
    bias = (F.col(pred) - F.col(true)) / F.nullif(F.col(true).cast("double"), F.lit(0.0)) * 100
    return df.agg(F.median(bias).alias("pbias"), F.median(F.abs(bias)).alias("absolute_pbias"))


def entity_means(df: DataFrame, key: str, columns: Sequence[str], mask: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Means over time of each entity, masked values as 0; then 0 is null."""
    value = lambda c: F.when(F.col(mask), 0.0).otherwise(F.col(c)) if mask else F.col(c)
    return df.groupBy(key, *by).agg(*(F.nullif(F.avg(value(c)), F.lit(0.0)).alias(c) for c in columns))


def within_observed(df: DataFrame, key: str, estimate: str, middle: str, low: str, high: str, count: str, at: str = "period", least: int = 5) -> DataFrame:
    """Share of estimates inside the observed band, as anomalies about the period with the most observations.

    The band is shifted crosswise: low less the anchor's high, high less the anchor's low. weighted counts observations;
    half gives half credit within half a band of it. Ties of the anchor go to the earliest period.
    """
    names = [estimate, middle, low, high, count]
    rows = df.dropna(subset=names)
    anchor = F.max_by(F.struct(*names), F.struct(F.col(count), -F.unix_date(at))).over(Window.partitionBy(key))
    rows = rows.withColumn("a", anchor)
    e, m = F.col(estimate) - F.col(f"a.{estimate}"), F.col(middle) - F.col(f"a.{middle}")
    rows = rows.withColumns({"__e": e, "__m": m, "__lo": F.col(low) - F.col(f"a.{high}"), "__hi": F.col(high) - F.col(f"a.{low}")})
    inside, half = F.col("__e").between(F.col("__lo"), F.col("__hi")), (F.col("__hi") - F.col("__lo")) / 2
    near = F.col("__e").between(F.col("__lo") - half, F.col("__hi") + half)
    credit = F.when(inside, 1.0).when(near, 0.5).otherwise(0.0)
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(inside.cast("double")) * 100).alias("within"), (F.try_divide(F.sum(F.when(inside, F.col(count)).otherwise(0)), F.sum(count)) * 100).alias("weighted"),
        (F.avg(credit) * 100).alias("half"), rmse("__m", "__e").alias("rmse"), F.corr("__m", "__e").alias("pearson"),
    ).where(F.col("n") >= least)


def compared_anomalies(df: DataFrame, true: str, pred: str, key: str = "id", at: str = "period", about: str = "mean", frozen: str | None = None) -> DataFrame:
    """(key, n, rmse, spearman) of two level series as anomalies about their mean or first value; frozen months do not count.

    Anomalies are rounded to 9 digits, so that equal levels are ties whatever their sums' last bits are.
    """
    rows = df.where(F.col(true).isNotNull() & F.col(pred).isNotNull())
    if frozen:
        rows = rows.where(~F.coalesce(F.col(frozen), F.lit(False)))
    for c in (true, pred):
        rows = anomaly(rows.drop("anomaly"), key, c, about, at).drop(c).withColumn(c, F.round("anomaly", 9)).drop("anomaly")
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), rmse(true, pred).alias("rmse"))
    return found.join(spearman(rows, true, pred, [key]), key)


def by_class(found: DataFrame, sizes: DataFrame, key: str, size: str, bins: Sequence[float], labels: Sequence[str], measure: str) -> DataFrame:
    """Quartiles and adjacent values of a metric within classes of the entities' size."""
    rows = found.join(sizes.select(key, size), key).withColumn("class", binned(size, bins, labels))
    return box_statistics(rows, ["class"], measure)


def evaluated(records: DataFrame, scored: DataFrame, history: DataFrame, key: str, truth: str, soft: str, epoch: str) -> DataFrame:
    """records with each model's test metrics and its history's values at the record's chosen epoch (counted from 0).

    scored: (key, truth, soft), a row for each test pixel; history: (key, metric, epoch, value).
    """
    tests = segmentation_metrics(scored, [key], truth, soft)
    tests = tests.withColumnsRenamed({c: f"test_{c}" for c in tests.columns if c != key})
    chosen = records.select(key, F.col(epoch).alias("__epoch"))
    at = history.join(chosen, key).where(F.col("epoch") == F.col("__epoch")).groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("history"))
    return upserted(upserted(records, tests, key), at.select(key, F.to_json("history").alias("history")), key)
