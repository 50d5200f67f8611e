"""Masking, filling and outliers of entity series, all by windows within an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import trend_tests


def _by(key: str, at: str = "period"):
    return Window.partitionBy(key).orderBy(at)


def carried(df: DataFrame, key: str = "id", value: str = "value", at: str = "period") -> DataFrame:
    """Last value forward, a leading gap backward; all null stays null."""
    before = F.last(value, True).over(_by(key, at).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, True).over(_by(key, at).rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(value, F.coalesce(before, after))


def interpolated(df: DataFrame, key: str = "id", value: str = "value", at: str = "period") -> DataFrame:
    """Linear by position; edges take the nearest value; all null becomes 0."""
    by = _by(key, at)
    rows = df.withColumn("__i", F.row_number().over(by))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(value).alias("v")))
    rows = rows.withColumns(
        {
            "__a": F.last(known, True).over(by.rowsBetween(Window.unboundedPreceding, 0)),
            "__b": F.first(known, True).over(by.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    a, b, i = F.col("__a"), F.col("__b"), F.col("__i")
    between = a["v"] + (b["v"] - a["v"]) * (i - a["i"]) / (b["i"] - a["i"])
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(between)
    return rows.withColumn(value, filled).drop("__i", "__a", "__b")


def outlier_factors(df: DataFrame, key: str = "id", value: str = "value", at: str = "period", k: int = 12, stretch: float = 5.0) -> DataFrame:
    """df with lof: local outlier factors of (time * stretch, value), both scaled to [0, 1] within the entity.

    Neighbours are the k nearest other points, ties (to 9 digits) by time. Spark deals the entities; one series is held at
    a time, with its distances: its number of periods squared. Nulls have none; a constant series has nulls.
    """
    schema = T.StructType([*(f for f in df.schema if f.name != "lof"), T.StructField("lof", T.DoubleType())])

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by(at)
        found = trend_tests.outlier_factors(table.column(value).to_numpy().astype(float), k, stretch)
        return table.append_column("lof", pa.array(found, pa.float64(), mask=np.isnan(found)))

    return df.drop("lof").groupBy(key).applyInArrow(run, schema)


def _unusable(key: str, value: str) -> Column:
    """All zero or constant series."""
    all_ = Window.partitionBy(key)
    return F.min(value).over(all_) == F.max(value).over(all_)


def cloud_masked(df: DataFrame, key: str = "id", value: str = "value", ratio: str = "cloud", threshold: float = 0.05, outliers: bool = False, outlier_ratio: float = 0.001, lof: float = 1.5) -> DataFrame:
    """Null where the cloud ratio, or an outlier's, is above a threshold; then linear. Constant series are left alone."""
    rows = outlier_factors(df, key, value) if outliers else df.withColumn("lof", F.lit(None).cast("double"))
    cloudy = (F.col(ratio) > threshold) | ((F.col("lof") > lof) & (F.col(ratio) > outlier_ratio))
    rows = rows.withColumn("__skip", F.coalesce(_unusable(key, value), F.lit(False)))
    masked = rows.withColumn("__v", F.when(F.col("__skip") | ~F.coalesce(cloudy, F.lit(False)), F.col(value)))
    out = interpolated(masked, key, "__v")
    return out.withColumn(value, F.when(F.col("__skip"), F.col(value)).otherwise(F.col("__v"))).drop("__v", "__skip", "lof")


def freeze_masked(df: DataFrame, key: str = "id", value: str = "value", ratio: str = "ice", threshold: float = 0.1) -> DataFrame:
    """masked where the ice ratio is above the threshold; the value is carried over; no ice data, no mask."""
    rows = df.withColumn("masked", F.coalesce(F.col(ratio) > threshold, F.lit(False)))
    return carried(rows.withColumn(value, F.when(~F.col("masked"), F.col(value))), key, value)


def freeze_masked_with_outliers(df: DataFrame, key: str = "id", value: str = "value", ratio: str = "ice", threshold: float = 0.1, lof: float = 1.5) -> DataFrame:
    """As freeze_masked; outliers are masked too, in frozen months and at the two ends of a year's open water.

    Frozen months are judged as the yearly median of open water. An end's second month counts only with over two open
    months. Needs year_idx. Constant series are left alone.
    """
    rows = df.withColumn("frozen", F.coalesce(F.col(ratio) > threshold, F.lit(False))).withColumn("__skip", F.coalesce(_unusable(key, value), F.lit(False)))
    open_ = F.when(~F.col("frozen"), F.col(value))
    year = Window.partitionBy(key, "year_idx")
    medians = rows.groupBy(key, "year_idx").agg(F.percentile(open_, F.lit(0.5)).alias("__median"))
    rows = rows.join(medians, [key, "year_idx"]).withColumn("__seen", F.coalesce(open_, "__median"))
    ranked = Window.partitionBy(key, "year_idx", "frozen")
    first, last = F.row_number().over(ranked.orderBy("period")), F.row_number().over(ranked.orderBy(F.desc("period")))
    count = F.count_if(~F.col("frozen")).over(year)
    edge = ~F.col("frozen") & ((first == 1) | (last == 1) | ((count > 2) & ((first == 2) | (last == 2))))
    judged = outlier_factors(rows.withColumn("__edge", edge), key, "__seen")
    masked = F.col("frozen") | (F.coalesce(F.col("lof") > lof, F.lit(False)) & F.col("__edge"))
    out = judged.withColumn("masked", masked & ~F.col("__skip")).withColumn(value, F.when(F.col("__skip") | ~masked, F.col(value)))
    return carried(out, key, value).drop("frozen", "__seen", "__median", "__edge", "__skip", "lof")


def monthly_ice_ratio(days: DataFrame, key: str = "id", day: str = "day", height: str = "ice_height", how: str = "median") -> DataFrame:
    """Share of a month's days on which the min, median or max across models is above 0."""
    stat = {"min": F.min(height), "max": F.max(height), "median": F.percentile(height, F.lit(0.5))}[how]
    daily = days.groupBy(key, day).agg(stat.alias("h"))
    return daily.groupBy(key, F.trunc(day, "MM").cast("date").alias("period")).agg((F.count_if(F.col("h") > 0) / F.count("h")).alias("ice"))


def extended_by_climatology(df: DataFrame, key: str, end: str, value: str = "ice", months: int = 60) -> DataFrame:
    """Months after the last one, up to without end, take the calendar mean of the last `months` months."""
    last = df.groupBy(key).agg(F.max("period").alias("last"))
    recent = df.join(last, key).where(F.col("period") > F.add_months("last", -months))
    mean = recent.groupBy(key, F.month("period").alias("m")).agg(F.avg(value).alias(value))
    tail = last.where(F.add_months("last", 1) < F.lit(end).cast("date"))
    tail = tail.select(key, F.explode(F.expr(f"sequence(add_months(last, 1), add_months(date'{end}', -1), interval 1 month)")).alias("period"))
    tail = tail.withColumn("m", F.month("period")).join(mean, [key, "m"]).select(key, "period", value)
    return df.select(key, "period", value).unionByName(tail)


def ice_ratio_from_temperature(days: DataFrame, key: str = "id", day: str = "day", temperature: str = "temperature") -> DataFrame:
    """Share of a month's days with a surface temperature of 0."""
    rows = days.groupBy(key, F.trunc(day, "MM").cast("date").alias("period"))
    return rows.agg((F.count_if(F.col(temperature) == 0) / F.count(temperature)).alias("ice"))


def repaired_from_nearest(df: DataFrame, places: DataFrame, size: float, ratio: str = "ice", key: str = "id") -> DataFrame:
    """Entities without any ice ratio take the series of the nearest entity that has one. places: (key, x, y).

    The result has every row of df once, with donor where the ratio is borrowed.
    """
    from .spatial import nearest

    has = df.groupBy(key).agg(F.count(ratio).alias("n"))
    open_, known = has.where("n = 0").select(key), has.where("n > 0").select(key)
    donors = nearest(places.join(open_, key), places.join(known, key).withColumnRenamed(key, "donor"), size, key, "donor").select(key, "donor")
    lent = df.select(F.col(key).alias("donor"), "period", F.col(ratio).alias("__ice"))
    joined = df.join(donors, key, "left").join(lent, ["donor", "period"], "left")
    return joined.withColumn(ratio, F.coalesce(ratio, "__ice")).drop("__ice")


def cloud_ratios(cloudy: DataFrame, shapes: DataFrame, key: str = "id", area: str = "cloudy_area", shape_area: str = "area") -> DataFrame:
    """Cloudy area of each entity and month over the entity's area; of repeated shapes the first counts."""
    own = shapes.groupBy(key).agg(F.first(shape_area).alias("__area"))
    return cloudy.join(own, key).withColumn("cloud", F.try_divide(F.col(area), F.col("__area"))).drop("__area")


def smoothed(df: DataFrame, window: int, key: str = "id", value: str = "value", at: str = "period") -> DataFrame:
    """(key, at, value, smoothed): the first points as they are, then the mean of the point and the previous smoothed ones. A null makes what follows from it null."""
    schema = T.StructType([df.schema[key], df.schema[at], T.StructField(value, T.DoubleType()), T.StructField("smoothed", T.DoubleType())])

    def run(table):
        import pyarrow as pa

        table = table.sort_by(at)
        out: list[float | None] = []
        for x in table.column(value).to_pylist():
            past = out[-window:]
            out.append(x if len(out) < window else None if x is None or None in past else (sum(past) + x) / (window + 1))
        return table.append_column("smoothed", pa.array(out, pa.float64()))

    return df.select(key, at, F.col(value).cast("double").alias(value)).groupBy(key).applyInArrow(run, schema)


def anomaly(df: DataFrame, key: str = "id", value: str = "value", about: str = "mean", at: str = "period", weight: str = "n") -> DataFrame:
    """Values less the entity's mean, its first value, or its value of the largest weight."""
    all_ = Window.partitionBy(key)
    anchor = {"mean": F.avg(value).over(all_), "first": F.first(value).over(_by(key, at)), "heaviest": F.max_by(F.col(value), F.struct(F.col(weight) if about == "heaviest" else F.lit(0), -F.unix_date(at))).over(all_)}[about]
    return df.withColumn("anomaly", F.col(value) - anchor)


def minus_annual_mean(df: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    return df.withColumn("anomaly", F.col(value) - F.avg(value).over(Window.partitionBy(key, "year_idx")))


def yearly_to_months(yearly: DataFrame, months: DataFrame, value: str, key: str = "id") -> DataFrame:
    """A yearly value (key, year_idx, value) repeated to the months of its year."""
    return months.join(yearly.select(key, "year_idx", value), [key, "year_idx"], "left")
