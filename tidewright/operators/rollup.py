"""Roll-ups of entities to cells, zones and classes; summaries, shares, histograms."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Stat = Callable[[str], Column]


def steady_sum(x: Column) -> Column:
    """The sum of doubles, the same in whatever order rows and parts come: whole multiples of 2^-20 add up without rounding (below 2^33 in all), and what is left of each is small."""
    whole = F.rint(x * 2.0**20) / 2.0**20
    rest = F.when(F.abs(x) < 2.0**33, x - whole).otherwise(0.0)
    return F.sum(F.when(F.abs(x) < 2.0**33, whole).otherwise(x)) + F.sum(rest)


def _steady_mean(x: Column) -> Column:
    return F.try_divide(steady_sum(x), F.count(x))


#: Aggregates by name.
STATS: dict[str, Stat] = {
    "mean": F.avg,
    "median": F.median,
    "sum": F.sum,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "mode": lambda c: F.mode(c, True),
    "sum_positive": lambda c: F.coalesce(F.sum(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0)),
    "sum_negative": lambda c: F.coalesce(F.sum(F.when(F.col(c) < 0, F.col(c))), F.lit(0.0)),
    "mean_positive": lambda c: F.avg(F.when(F.col(c) > 0, F.col(c))),
    "mean_negative": lambda c: F.avg(F.when(F.col(c) < 0, F.col(c))),
    "pos_count": lambda c: F.count_if(F.col(c) > 0),
    "neg_count": lambda c: F.count_if(F.col(c) < 0),
    "positive_percentage": lambda c: F.try_divide(F.count_if(F.col(c) > 0), F.count_if(F.col(c) > 0) + F.count_if(F.col(c) < 0)) * 100,
}

#: Those of doubles that do not depend on the order of rows.
STEADY: dict[str, Stat] = {
    "mean": lambda c: _steady_mean(F.col(c)),
    "sum": lambda c: steady_sum(F.col(c)),
    "sum_positive": lambda c: F.coalesce(steady_sum(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0)),
    "sum_negative": lambda c: F.coalesce(steady_sum(F.when(F.col(c) < 0, F.col(c))), F.lit(0.0)),
    "mean_positive": lambda c: _steady_mean(F.when(F.col(c) > 0, F.col(c))),
    "mean_negative": lambda c: _steady_mean(F.when(F.col(c) < 0, F.col(c))),
}


def _stat(name: str | Stat) -> tuple[str, Stat]:
    if callable(name):
        return getattr(name, "__name__", "custom"), name
    if name not in STATS:
        raise ValueError(f"{name!r} is none of {sorted(STATS)}")
    return name, STATS[name]


def grouped(df: DataFrame, by: Sequence[str], wanted: Mapping[str, str | Stat | Sequence[str | Stat]], count: str | None = "entity_count") -> DataFrame:
    """A column col_stat for each entry; several statistics of a column in one pass."""
    out, kinds = [], dict(df.dtypes)
    for column, stats in wanted.items():
        for s in [stats] if isinstance(stats, str) or callable(stats) else stats:
            name, f = _stat(s)
            if isinstance(s, str) and kinds.get(column) == "double":
                f = STEADY.get(s, f)
            out.append(f(column).alias(f"{column}_{name}"))
    if count:
        out.append(F.count(F.lit(1)).alias(count))
    return df.groupBy(*by).agg(*out)


def onto_grid(grid: DataFrame, agg: DataFrame, key: str, zero: Sequence[str]) -> DataFrame:
    """All cells; listed columns are 0 where a cell has no members, others stay null."""
    return grid.join(agg, key, "left").fillna(0, subset=list(zero))


def binned_along(df: DataFrame, axis: str, step: float, measure: str, stats: Sequence[str] = ("mean",)) -> DataFrame:
    """Statistics by equal, right-closed bins of a coordinate from its minimum; bin centres.

    The first bin holds the minimum, which is found first.
    """
    low = F.lit(df.agg(F.min(axis)).first()[0]).cast("double")
    rows = df.withColumn("bin", F.greatest(F.lit(1), F.ceil((F.col(axis) - low) / step)))
    rows = rows.withColumn("centre", low + (F.col("bin") - 0.5) * step)
    return grouped(rows, ["bin", "centre"], {measure: list(stats)}, None)


def reservoir_share(df: DataFrame, by: str, measure: str, kind: str, natural: int = 1) -> DataFrame:
    """Percent of the sum in other than natural entities, and their number; no total, null."""
    v, other = F.coalesce(F.col(measure), F.lit(0.0)), F.col(kind) != natural
    return df.groupBy(by).agg(
        (F.try_divide(F.coalesce(F.sum(F.when(other, v)), F.lit(0.0)), F.nullif(F.sum(v), F.lit(0.0))) * 100).alias("managed_share"), F.count_if(other).alias("managed_count")
    )


def trend_shares(df: DataFrame, measure: str, by: Sequence[str] = (), label: str | None = None) -> DataFrame:
    """Percent rising and falling of all rows, nulls in the denominator; by sign, or by a test's label."""
    c = F.col(label or measure)
    up, down = (c == "increasing", c == "decreasing") if label else (c > 0, c < 0)
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg((F.count_if(up) / n * 100).alias("rising"), (F.count_if(down) / n * 100).alias("falling"), n.alias("entities"))


def signed_shares(df: DataFrame, measure: str, significant: str, category: str, categories: DataFrame) -> DataFrame:
    """Rows with a measure, split to rising and falling by significance, in percent of those that move; empty categories are 0."""
    rows = df.where(F.col(measure).isNotNull())
    up, down, sure = F.col(measure) > 0, F.col(measure) < 0, F.coalesce(F.col(significant), F.lit(False))
    parts = {"sig_rising": up & sure, "rising": up & ~sure, "sig_falling": down & sure, "falling": down & ~sure}
    agg = rows.groupBy(category).agg(*(F.count_if(c).alias(n) for n, c in parts.items()))
    total = sum((F.col(n) for n in parts), F.lit(0))
    shares = agg.select(category, *((F.try_divide(F.col(n), total) * 100).alias(n) for n in parts))
    return categories.join(shares, category, "left").fillna(0.0, subset=list(parts))


def extremes(df: DataFrame, order: str, n: int) -> DataFrame:
    """The n largest and the n smallest rows, marked by side."""
    top = df.orderBy(F.desc(order), *sorted(c for c in df.columns if c != order)).limit(n).withColumn("side", F.lit("top"))
    low = df.orderBy(F.asc(order), *sorted(c for c in df.columns if c != order)).limit(n).withColumn("side", F.lit("low"))
    return top.unionByName(low)


def top_by_country(df: DataFrame, country: str, measure: str, least: int, n: int) -> DataFrame:
    shares = trend_shares(df, measure, [country]).where(F.col("entities") >= least)
    both = F.nullif(F.col("rising") + F.col("falling"), F.lit(0.0))
    return extremes(shares.select(country, (F.col("rising") / both * 100).alias("increase"), (F.col("falling") / both * 100).alias("decrease")), "increase", n)


def category_counts(df: DataFrame, category: str, categories: DataFrame) -> DataFrame:
    """Counts in the order of categories (missing ones null), and shares in percent."""
    agg = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    out = categories.join(agg, category, "left")
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))) * 100)


def box_statistics(df: DataFrame, by: Sequence[str], measure: str) -> DataFrame:
    """Quartiles, mean, and the adjacent values within 1.5 interquartile ranges."""
    q = F.percentile(measure, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    agg = df.groupBy(*by).agg(q.alias("q"), F.avg(measure).alias("mean"), F.min(measure).alias("low"), F.max(measure).alias("high"))
    q1, q3 = F.col("q")[0], F.col("q")[2]
    upper = F.least(F.greatest(q3 + 1.5 * (q3 - q1), q3), F.col("high"))
    lower = F.greatest(F.least(q1 - 1.5 * (q3 - q1), q1), F.col("low"))
    return agg.select(*by, q1.alias("q1"), F.col("q")[1].alias("median"), q3.alias("q3"), "mean", lower.alias("lower"), upper.alias("upper"))


def histogram(df: DataFrame, by: Sequence[str], measure: str, low: float, width: float, bins: int) -> DataFrame:
    """Counts and densities; the last bin is closed on the right."""
    k = F.when(F.col(measure) == low + width * bins, bins - 1).otherwise(F.floor((F.col(measure) - low) / width))
    rows = df.withColumn("bin", k.cast("int")).where(F.col("bin").between(0, bins - 1))
    agg = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    return agg.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(*by)) * width))


def below_thresholds(df: DataFrame, share: str, weight: str, step: float = 0.5, top: float = 100.0) -> DataFrame:
    """(threshold, total): sum of the weights of rows strictly below each threshold 0, step, ..., top.

    Rows are first summed to the first threshold above them, so no more rows than thresholds are ordered.
    """
    n = int(round(top / step))
    sums = df.groupBy(F.greatest(F.lit(0), F.floor(F.col(share) / step) + 1).alias("k")).agg(F.sum(weight).alias("w"))
    grid = df.sparkSession.range(n + 1).withColumnRenamed("id", "k")
    at = grid.join(sums, "k", "left")
    return at.select((F.col("k") * step).alias("threshold"), F.coalesce(F.sum("w").over(Window.orderBy("k")), F.lit(0.0)).alias("total"))


def duplicate_keys(parts: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that occur more than once, with their sorted values."""
    counts = parts.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return parts.join(counts, key).groupBy(key, "n").agg(F.sort_array(F.collect_list(value)).alias("values"))


def last_wins(parts: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    return parts.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def largest_row(df: DataFrame, by: str, order: str, tie: str) -> DataFrame:
    """The row of each group with the largest order, of ties that with the smallest tie key."""
    own = F.max_by(F.struct(*df.columns), F.struct(F.col(order), -F.col(tie)))
    return df.groupBy(F.col(by).alias("__by")).agg(own.alias("r")).select("r.*")


def significance_ratios(df: DataFrame, count: str = "entity_count") -> DataFrame:
    """A ratio to the cell's entities beside every column whose name has "significant"."""
    return df.withColumns({f"{c}_ratio": F.try_divide(F.col(c), F.col(count)) for c in df.columns if "significant" in c})


def expanded(df: DataFrame, test: DataFrame, key: str, prefix: str, level: float = 0.05) -> DataFrame:
    """df with a test's columns under a prefix and prefix_significant by its p."""
    named = test.select(key, *(F.col(c).alias(f"{prefix}_{c}") for c in test.columns if c not in (key, "significant")))
    return df.join(named.withColumn(f"{prefix}_significant", F.col(f"{prefix}_p") < level), key, "left")


def split_counts(patches: DataFrame, split: str, band: str, limit: float = 99_999) -> DataFrame:
    """Valid patches of each split."""
    from .raster import valid_patches

    return valid_patches(patches, band, limit).groupBy(split).agg(F.count(F.lit(1)).alias("patches"))


# ---- segmentation metrics


def segmentation_metrics(df: DataFrame, by: Sequence[str], truth: str, soft: str, threshold: float = 0.5) -> DataFrame:
    """IoU and Dice with +1 smoothing on soft values, accuracy, and the mean IoU over both labels."""
    y, p = F.col(truth).cast("double"), F.col(soft).cast("double")
    hard = (p > threshold).cast("int")
    count = lambda a, b: F.count_if((F.col(truth) == a) & (hard == b))
    agg = df.groupBy(*by).agg(F.sum(y * p).alias("i"), F.sum(y).alias("y"), F.sum(p).alias("p"), *(count(a, b).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)))
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    iou = lambda k: F.try_divide(F.col(f"n{k}{k}"), F.col("n01") + F.col("n10") + F.col(f"n{k}{k}"))
    return agg.select(
        *by, ((F.col("i") + 1) / (F.col("y") + F.col("p") - F.col("i") + 1)).alias("iou"), ((2 * F.col("i") + 1) / (F.col("y") + F.col("p") + 1)).alias("dice"),
        ((F.col("n00") + F.col("n11")) / n).alias("accuracy"), ((iou(0) + iou(1)) / 2).alias("mean_iou"),
    )
