"""Yearly and whole-series statistics of entity series, all from one pass over the months.

Input: long rows (key, period, value, masked), one for each month. Years are positional from the first period; masked
months do not count except where a statistic says so. In-year deviations are of the population. Slopes are null where a
year has no value. Two periods leave out the middle year of an odd number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import guarded_slope, two_sided_p
from .graph import settled
from .trend_tests import TIED


def with_year(df: DataFrame, start: str, period_length: int = 12) -> DataFrame:
    """year_idx from 0 and position within the year."""
    months = F.months_between("period", F.lit(start).cast("date")).cast("int")
    return df.withColumns({"month_idx": months, "year_idx": (months / period_length).cast("int"), "position": months % period_length})


def yearly(df: DataFrame, key: str = "id") -> DataFrame:
    """The table that all yearly statistics share: n, mean, std, total, entropy, monthly change."""
    v = F.when(~F.coalesce(F.col("masked"), F.lit(False)), F.col("value"))
    step = Window.partitionBy(key, "year_idx").orderBy("position")
    rows = df.withColumn("v", v)
    rows = rows.withColumns({"change": F.abs(F.col("v") - F.lag("v").over(step)), "v_log_v": F.when(F.col("v") > 0, F.col("v") * F.ln("v")).otherwise(F.when(F.col("v") == 0, 0.0))})
    out = rows.groupBy(key, "year_idx").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.sum("v").alias("total"), F.sum("v_log_v").alias("v_log_v"), F.avg("change").alias("monthly_change")
    )
    entropy = F.when(F.coalesce("total", F.lit(0.0)) == 0, 0.0).when(F.col("n") > 1, (F.ln("total") - F.col("v_log_v") / F.col("total")) / F.ln("n"))
    by = Window.partitionBy(key).orderBy("year_idx")
    return out.withColumns({"entropy": entropy, "change": F.col("mean") - F.lag("mean").over(by)})


def two_periods(years: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """Index ranges of the halves, without the middle year of an odd number."""
    half = years // 2
    return (0, half - 1), (years - half, years - 1)


def statistics(df: DataFrame, years: int, key: str = "id", stl_period: int = 13) -> DataFrame:
    """One row for each entity with every statistic that needs no decomposition."""
    y = yearly(df, key)
    a, b = two_periods(years)
    inside = lambda r: F.col("year_idx").between(*r)
    # A period's own first differences start at its second year.
    moved = lambda r: F.col("year_idx").between(r[0] + 1, r[1])
    of = lambda f, x, r: f(F.when(inside(r), x))
    change = F.abs("change")
    entropy_of = {}
    for name, r in (("a", a), ("b", b)):
        n, total, vlv = (F.sum(F.when(inside(r), F.col(c))) for c in ("n", "total", "v_log_v"))
        entropy_of[name] = F.when(total == 0, 0.0).when(n > 1, (F.ln(total) - vlv / total) / F.ln(n))
    std_a, std_b = of(F.avg, F.col("std"), a), of(F.avg, F.col("std"), b)
    d_a, d_b = F.stddev_pop(F.when(moved(a), F.col("change"))), F.stddev_pop(F.when(moved(b), F.col("change")))
    m_a, m_b = F.avg(F.when(moved(a), change)), F.avg(F.when(moved(b), change))
    mean_a, mean_b = of(F.avg, F.col("mean"), a), of(F.avg, F.col("mean"), b)
    relative = lambda x, z: F.when((x > 1e-5) & (z > 1e-5), 2 * (z - x) / (x + z) * 100)
    share = lambda x, z: F.try_divide(x, x + z) * 100
    overall = F.try_divide(F.sum("total"), F.sum("n"))
    last = years - 1
    changes_known = F.count(F.when(F.col("year_idx") > 0, F.col("change"))) == F.count(F.when(F.col("year_idx") > 0, 1))
    change_slope = F.when(changes_known, F.regr_slope(change, F.col("year_idx")))
    by_year = y.groupBy(key).agg(
        F.avg("std").alias("mean_annual_std"),
        F.try_divide(F.avg("std"), overall).alias("mean_annual_std_percentage"),
        F.avg(change).alias("mean_annual_first_difference"),
        F.try_divide(F.avg(change), F.avg(F.when(F.col("year_idx") < last, F.col("mean")))).alias("mean_annual_first_difference_percentage"),
        F.avg("entropy").alias("mean_apportion_entropy"),
        guarded_slope("std", "year_idx").alias("trend_of_std"),
        F.try_divide(guarded_slope("std", "year_idx"), F.avg("std")).alias("trend_of_std_share"),
        guarded_slope("mean", "year_idx").alias("trend_of_annual_mean"),
        F.try_divide(guarded_slope("mean", "year_idx"), F.avg("mean")).alias("trend_of_annual_mean_share"),
        change_slope.alias("trend_of_first_difference"),
        F.try_divide(change_slope, F.avg(change)).alias("trend_of_first_difference_share"),
        guarded_slope("entropy", "year_idx").alias("trend_of_entropy"),
        (of(F.stddev_pop, F.col("mean"), b) - of(F.stddev_pop, F.col("mean"), a)).alias("difference_in_annual_mean_std"),
        (entropy_of["b"] - entropy_of["a"]).alias("difference_in_entropy"),
        (std_b - std_a).alias("difference_in_annual_std"),
        relative(std_a, std_b).alias("relative_difference_in_annual_std"),
        (d_b - d_a).alias("difference_in_first_difference_std"),
        relative(d_a, d_b).alias("relative_difference_in_first_difference_std"),
        (of(F.avg, F.col("monthly_change"), b) - of(F.avg, F.col("monthly_change"), a)).alias("difference_in_monthly_change"),
        share(std_a, std_b).alias("std_percentage_of_first"), share(std_b, std_a).alias("std_percentage_of_second"),
        share(m_a, m_b).alias("first_difference_percentage_of_first"), share(m_b, m_a).alias("first_difference_percentage_of_second"),
        share(mean_a, mean_b).alias("mean_percentage_of_first"), share(mean_b, mean_a).alias("mean_percentage_of_second"),
        F.stddev_pop("mean").alias("annual_means_std"),
    )
    percent = [c for c in by_year.columns if c.endswith("_share")]
    by_year = by_year.withColumns({c: F.col(c) * 100 for c in percent})
    by_month = df.groupBy(key).agg(
        F.when(F.count("value") == F.count(F.lit(1)), F.avg("value")).alias("mean_value"),
        (guarded_slope("value", "month_idx") * stl_period).alias("trend_per_period"),
    )
    return by_month.join(by_year, key)


def annual_vectors(df: DataFrame, key: str = "id") -> DataFrame:
    """In-year deviations and absolute changes of annual means as rows."""
    return yearly(df, key).select(key, "year_idx", "std", F.abs("change").alias("first_difference"))


# ---- tests


def mann_kendall(rows: DataFrame, value: Column | str, key: str = "id", at: str = "year_idx", alpha: float = 0.05) -> DataFrame:
    """(key, s, slope, z, p, trend, significant): Hamed-Rao modified Mann-Kendall with Sen's slope.

    Nulls are skipped. Pairs are joined within an entity; a year series is short, so they are bounded by its length squared.
    """
    by = Window.partitionBy(key).orderBy("t")
    x = rows.select(key, F.col(at).alias("t"), (F.col(value) if isinstance(value, str) else value).alias("x")).where("x is not null")
    x = x.withColumns({"i": F.row_number().over(by), "n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    later = x.select(key, F.col("i").alias("j"), F.col("x").alias("y"))
    pairs = x.join(later, key).where("i < j")
    trend = pairs.groupBy(key).agg(
        F.sum(F.signum(F.col("y") - F.col("x"))).alias("s"), F.expr("percentile((y - x) / (j - i), 0.5)").alias("slope"), F.first("n").alias("n")
    )
    ties = x.groupBy(key, "x").agg(F.count(F.lit(1)).alias("c")).groupBy(key).agg(F.sum(F.expr("c * (c - 1) * (2 * c + 5)")).alias("ties"))
    # The values whose slope is the median are tied without their trend: they are told by their gap, as rounding parts them where
    # it has an edge between them.
    flat = x.join(trend.select(key, "slope"), key).withColumn("d", F.col("x") - F.col("slope") * F.col("i"))
    rising = Window.partitionBy(key).orderBy("d")
    flat = flat.withColumn("gap", F.col("d") - F.lag("d").over(rising)).withColumn("d", F.count_if(F.col("gap") > TIED).over(rising))
    same = Window.partitionBy(key, "d")
    ranked = flat.withColumn("r", F.rank().over(rising) + (F.count(F.lit(1)).over(same) - 1) / 2)
    ranked = ranked.withColumn("r", F.col("r") - (F.col("n") + 1) / 2).select(key, "i", "n", "r")
    lagged = ranked.join(ranked.select(key, F.col("i").alias("j"), F.col("r").alias("q")), key).where("j > i").withColumn("lag", F.col("j") - F.col("i"))
    power = ranked.groupBy(key).agg(F.sum(F.col("r") * F.col("r")).alias("power"))
    corr = lagged.groupBy(key, "lag").agg(F.sum(F.col("r") * F.col("q")).alias("c"), F.first("n").alias("n")).join(power, key)
    bound = {0.05: 1.959963984540054, 0.1: 1.6448536269514722, 0.01: 2.5758293035489004}[alpha]
    corr = corr.withColumn("c", F.try_divide("c", "power")).where(F.abs("c") >= bound / F.sqrt("n"))
    extra = corr.groupBy(key).agg(F.sum(F.expr("(n - lag) * (n - lag - 1) * (n - lag - 2) * c")).alias("extra"))
    out = trend.join(ties, key).join(extra, key, "left")
    variance = F.expr("(n * (n - 1) * (2 * n + 5) - ties) / 18D") * (1 + 2 * F.coalesce("extra", F.lit(0.0)) / F.expr("n * (n - 1D) * (n - 2)"))
    out = out.withColumn("z", F.when(F.col("s") == 0, 0.0).when(variance > 0, (F.col("s") - F.signum("s")) / F.sqrt(variance)))
    out = out.withColumn("p", two_sided_p("z"))
    label = F.when((F.col("p") < alpha) & (F.col("z") > 0), "increasing").when((F.col("p") < alpha) & (F.col("z") < 0), "decreasing").when(F.col("z").isNotNull(), "no trend")
    return out.select(key, "s", "slope", "z", "p", label.alias("trend"), (F.col("p") < 0.05).alias("significant"))


def _pettitt_top(rows: DataFrame, value: str, key: str, at: str) -> DataFrame:
    """(key, k, n, cp) of Pettitt's statistic."""
    everything = Window.partitionBy(key)
    x = rows.select(key, at, F.col(value).alias("x")).where("x is not null").withColumn("n", F.count(F.lit(1)).over(everything))
    rank = F.rank().over(everything.orderBy("x")) + (F.count(F.lit(1)).over(Window.partitionBy(key, "x")) - 1) / 2
    by = everything.orderBy(at)
    x = x.withColumns({"r": rank, "i": F.row_number().over(by)})
    x = x.withColumn("u", F.abs(2 * F.sum("r").over(by) - F.col("i") * (F.col("n") + 1)))
    return x.groupBy(key).agg(F.max("u").alias("k"), F.first("n").alias("n"), F.max_by(F.col(at), F.struct("u", -F.col("i"))).alias("cp"))


def pettitt(rows: DataFrame, value: str, key: str = "id", at: str = "year_idx", alpha: float = 0.05) -> DataFrame:
    """(key, k, cp, p, significant): the change point where |2 * rank sum - k(n+1)| is largest, first of equals."""
    p = F.least(F.lit(1.0), 2 * F.exp(-6 * F.col("k") * F.col("k") / (F.pow("n", F.lit(3)) + F.pow("n", F.lit(2)))))
    return _pettitt_top(rows, value, key, at).select(key, "k", "cp", p.alias("p"), (p < alpha).alias("significant"))


def pettitt_null(lengths: DataFrame, simulations: int = 20_000, seed: int = 42) -> DataFrame:
    """(n, k, p): the share of random orders of n values whose statistic is k or more, for each length n and each whole k up to n^2 / 2 and 1 beyond.

    A length is drawn once, in blocks, from (seed, n): the distribution does not depend on the values, only on how many there are.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for n in batch.column(0).to_pylist():
                draw, top = np.random.default_rng([seed, n]), n * n // 2 + 1
                counts, block = np.zeros(top + 1, np.int64), max(1, 2_000_000 // max(n, 1))
                for first in range(0, simulations, block):
                    size = min(block, simulations - first)
                    ranks = draw.permuted(np.tile(np.arange(1, n + 1, dtype=np.int64), (size, 1)), axis=1)
                    k = np.abs(2 * np.cumsum(ranks, 1) - np.arange(1, n + 1) * (n + 1)).max(1)
                    counts += np.bincount(k, minlength=top + 1)
                reached = counts[::-1].cumsum()[::-1] / simulations
                yield pa.RecordBatch.from_arrays([pa.array([n] * (top + 1), pa.int64()), pa.array(np.arange(top + 1)), pa.array(reached)], ["n", "k", "p"])

    own = lengths.select(F.col(lengths.columns[0]).cast("long").alias("n")).where("n > 0").distinct()
    return own.repartition("n").mapInArrow(run, "n long, k long, p double")


def pettitt_simulated(rows: DataFrame, value: str, key: str = "id", at: str = "year_idx", alpha: float = 0.05, simulations: int = 20_000, seed: int = 42) -> DataFrame:
    """As `pettitt`, with p_simulated beside the closed form: one simulated distribution for each series length, joined by length and statistic.

    Ties make half ranks, so a statistic between two whole ones takes the upper one's share.
    """
    top = settled(_pettitt_top(rows, value, key, at))
    null = pettitt_null(top.select("n").distinct(), simulations, seed).select("n", F.col("k").alias("__k"), F.col("p").alias("p_simulated"))
    p = F.least(F.lit(1.0), 2 * F.exp(-6 * F.col("k") * F.col("k") / (F.pow("n", F.lit(3)) + F.pow("n", F.lit(2)))))
    out = top.withColumn("__k", F.ceil("k")).join(null, ["n", "__k"], "left")
    return out.select(key, "k", "cp", p.alias("p"), "p_simulated", (F.col("p_simulated") < alpha).alias("significant"))


def proportion_test(x1: Column, n1: Column, x2: Column, n2: Column) -> tuple[Column, Column]:
    """z and two-sided p of the pooled two-proportion test."""
    pooled = (x1 + x2) / (n1 + n2)
    z = F.try_divide(x1 / n1 - x2 / n2, F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2)))
    return z, two_sided_p(z)


# ---- low extremes


def low_flags(df: DataFrame, key: str = "id", threshold: float = 0.1, detrend: bool = False) -> DataFrame:
    """df with low: below the threshold percentile of its calendar month across years; false with too few years."""
    v = F.when(~F.col("masked"), F.col("value"))
    base = df.withColumn("annual", F.avg(v).over(Window.partitionBy(key, "year_idx")))
    base = base.withColumn("x", v - F.col("annual") if detrend else v)
    limits = base.groupBy(key, "position").agg(F.percentile("x", F.lit(threshold)).alias("limit"), F.count("x").alias("known"))
    enough = F.col("known") >= 1 / threshold
    return base.join(limits, [key, "position"]).withColumn("low", F.coalesce((F.col("x") < F.col("limit")) & enough, F.lit(False))).drop("x", "limit", "known")


def low_flag_change(flags: DataFrame, years: int, key: str = "id") -> DataFrame:
    """Change of the flags' frequency between the two periods, and its p-value, over unmasked months."""
    a, b = two_periods(years)
    use = lambda r: F.col("year_idx").between(*r) & ~F.col("masked")
    out = flags.groupBy(key).agg(*(F.count_if(use(r) & c).cast("double").alias(n) for r, c, n in ((a, F.col("low"), "x1"), (a, F.lit(True), "n1"), (b, F.col("low"), "x2"), (b, F.lit(True), "n2"))))
    both = (F.col("n1") > 0) & (F.col("n2") > 0)
    z, p = proportion_test(F.col("x2"), F.nullif("n2", F.lit(0.0)), F.col("x1"), F.nullif("n1", F.lit(0.0)))
    return out.select(key, F.when(both, F.try_divide("x2", "n2") - F.try_divide("x1", "n1")).alias("increase"), F.when(both, p).alias("p"))


def low_deviations(flags: DataFrame, period: tuple[int, int], key: str = "id") -> DataFrame:
    """Mean, largest and smallest deviation of flagged months from their annual mean within years."""
    d = F.when(F.col("low") & ~F.col("masked") & F.col("year_idx").between(*period), F.col("value") - F.col("annual"))
    return flags.groupBy(key).agg(F.avg(d).alias("mean_deviation"), F.max(d).alias("max_deviation"), F.min(d).alias("min_deviation"))


def _over(column: Column | str, by: str) -> Callable[[DataFrame], DataFrame]:
    """The yearly table with a column over the entity's overall mean, as `x`."""
    overall = lambda df: F.try_divide(F.sum("total").over(Window.partitionBy(by)), F.sum("n").over(Window.partitionBy(by)))
    return lambda df: df.withColumn("x", F.try_divide(F.col(column) if isinstance(column, str) else column, overall(df)))


#: Statistics that `analyse` also gives one at a time, under their column's name.
SINGLE = (
    "mean_value", "trend_per_period", "mean_annual_std", "mean_annual_std_percentage", "mean_annual_first_difference", "mean_annual_first_difference_percentage", "mean_apportion_entropy",
    "trend_of_std", "trend_of_std_share", "trend_of_annual_mean", "trend_of_annual_mean_share", "trend_of_first_difference", "trend_of_first_difference_share", "trend_of_entropy",
    "difference_in_annual_mean_std", "difference_in_entropy", "difference_in_annual_std", "relative_difference_in_annual_std", "difference_in_first_difference_std",
    "relative_difference_in_first_difference_std", "difference_in_monthly_change", "std_percentage_of_first", "std_percentage_of_second", "first_difference_percentage_of_first",
    "first_difference_percentage_of_second", "mean_percentage_of_first", "mean_percentage_of_second", "annual_means_std",
)


#: Analyses by name, each a function of the months and the number of years.
ANALYSES: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "statistics": lambda df, years: statistics(df, years),
    "annual_vectors": lambda df, years: annual_vectors(df),
    "mk_of_annual_mean": lambda df, years: mann_kendall(yearly(df), "mean"),
    "mk_of_std": lambda df, years: mann_kendall(yearly(df), "std", alpha=0.1),
    "mk_of_first_difference": lambda df, years: mann_kendall(yearly(df), F.abs("change"), alpha=0.1),
    "mk_of_entropy": lambda df, years: mann_kendall(yearly(df), "entropy", alpha=0.1),
    "mk_of_std_percentage": lambda df, years: mann_kendall(_over("std", "id")(yearly(df)), "x", alpha=0.1),
    "mk_of_first_difference_percentage": lambda df, years: mann_kendall(_over(F.abs("change"), "id")(yearly(df)), "x", alpha=0.1),
    "pettitt_of_annual_mean": lambda df, years: pettitt(yearly(df), "mean"),
    "pettitt_of_std": lambda df, years: pettitt(yearly(df), "std"),
    "pettitt_of_first_difference": lambda df, years: pettitt(yearly(df).withColumn("first_difference", F.abs("change")), "first_difference"),
}


def analyse(df: DataFrame, name: str, years: int) -> DataFrame:
    """An analysis of ANALYSES, or one statistic of SINGLE."""
    if name in SINGLE:
        return statistics(df, years).select("id", name)
    if name not in ANALYSES:
        raise ValueError(f"{name!r} is none of {sorted([*ANALYSES, *SINGLE])}")
    return ANALYSES[name](df, years)
