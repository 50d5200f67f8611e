"""Long, wide and dense forms of entity series.

The canonical form is long: one row for each entity and period (a date, first of month).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import null_if_nan


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """The months from start up to, without, end."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', add_months(date'{end}', -1), interval 1 month)")).alias("period"))


def to_long(wide: DataFrame, key: str, periods: Sequence[str], value: str = "value") -> DataFrame:
    """Month columns to rows; NaN to null."""
    out = wide.unpivot(key, list(periods), "period", value)
    return out.select(key, F.to_date("period").alias("period"), null_if_nan(value).alias(value))


def to_wide(long: DataFrame, key: str, periods: Sequence[str], value: str = "value", how: str = "sum") -> DataFrame:
    """Months to columns named like 2001-01-01; duplicates are summed or averaged."""
    named = long.withColumn("__name", F.date_format("period", "yyyy-MM-dd"))
    return named.groupBy(key).pivot("__name", list(periods)).agg({"sum": F.sum, "avg": F.avg}[how](value))


def dense(long: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """One row for each entity and month; missing months have nulls."""
    grid = long.select(key).distinct().withColumn("period", F.explode(F.expr(f"sequence(date'{start}', add_months(date'{end}', -1), interval 1 month)")))
    return grid.join(long, [key, "period"], "left")


def shared_periods(left: DataFrame, right: DataFrame) -> DataFrame:
    """Periods that both have."""
    return left.select("period").distinct().join(right.select("period").distinct(), "period")


def prefixed(df: DataFrame, prefix: str, columns: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in columns})


def scaled(df: DataFrame, column: str, factor: float) -> DataFrame:
    return df.withColumn(column, F.col(column) * factor)


def masked_to_null(value: str = "value", mask: str = "masked") -> Column:
    return F.when(~F.col(mask), F.col(value))


def valid_pairs(df: DataFrame, a: str, b: str, mask: str | None = None) -> DataFrame:
    """Rows in which both values are there, not zero and not masked."""
    out = df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in (a, b)})
    out = out.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return out.where(~F.col(mask)) if mask else out


def stacked(df: DataFrame, keys: Sequence[str], measures: Sequence[str], name: str = "type", value: str = "value") -> DataFrame:
    """Measures to rows of (type, value, direction)."""
    out = df.unpivot(list(keys), list(measures), name, value)
    return out.withColumn("direction", F.when(F.col(value) >= 0, "Positive").otherwise("Negative"))


def split_by_type(df: DataFrame, measure: str, kind: str, natural: int = 1, factor: float = 1.0) -> DataFrame:
    """A measure as a natural and a managed column."""
    own = F.col(measure) * factor
    return df.withColumns({f"{measure}_natural": F.when(F.col(kind) == natural, own), f"{measure}_managed": F.when(F.col(kind) != natural, own)})


def contiguous_parts(df: DataFrame, order: str, parts: int, by: Sequence[str]) -> DataFrame:
    """Parts of near-equal size within each group, in order."""
    from pyspark.sql import Window

    return df.withColumn("part", F.ntile(parts).over(Window.partitionBy(*by).orderBy(order)))


def numbered_in_group(df: DataFrame, group: Column, order: str, name: str = "number") -> DataFrame:
    """Running number within a group, such as entities of a region."""
    from pyspark.sql import Window

    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)))
