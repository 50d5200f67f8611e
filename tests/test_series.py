"""Series operators against worked values and plain numpy."""

from __future__ import annotations

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewright.functions.scalars import two_sided_p
from tidewright.operators import fill, reshape, series, stl, trend_tests


def months(values, start=1995):
    return [datetime.date(start + k // 12, k % 12 + 1, 1) for k in range(len(values))]


def frame(spark, series_of, masked=None):
    rows = [(i, p, None if v is None else float(v), bool(masked and masked(i, k))) for i, values in series_of.items() for k, (p, v) in enumerate(zip(months(values), values, strict=True))]
    return spark.createDataFrame(rows, "id long, period date, value double, masked boolean")


def values(df, column="value"):
    out = {}
    for r in df.orderBy("id", "period").collect():
        out.setdefault(r["id"], []).append(r[column])
    return out


def test_fills(spark):
    df = frame(spark, {1: [None, None, 3, None, 5, None], 2: [None] * 6})
    assert values(fill.carried(df)) == {1: [3, 3, 3, 3, 5, 5], 2: [None] * 6}
    assert values(fill.interpolated(df)) == {1: [3, 3, 3, 4, 5, 5], 2: [0] * 6}


def test_yearly_worked_values(spark):
    df = series.with_year(frame(spark, {1: [*range(1, 13), *range(2, 26, 2)], 2: [5.0] * 24, 3: [0.0] * 24}), "1995-01-01")
    y = {(r["id"], r["year_idx"]): r for r in series.yearly(df).collect()}
    assert y[1, 0]["std"] == pytest.approx(3.452053, abs=1e-6) and y[1, 1]["std"] == pytest.approx(6.904105, abs=1e-6)
    assert y[1, 1]["change"] == pytest.approx(6.5) and y[1, 0]["entropy"] < 1
    assert y[2, 0]["entropy"] == pytest.approx(1) and y[3, 0]["entropy"] == 0
    s = {r["id"]: r for r in series.statistics(df, 2).collect()}
    assert s[1]["trend_of_std"] == pytest.approx(3.452053, abs=1e-6)
    assert s[1]["mean_annual_first_difference"] == pytest.approx(6.5)


def test_two_periods_leave_the_middle_year_out():
    assert series.two_periods(23) == ((0, 10), (12, 22)) and series.two_periods(6) == ((0, 2), (3, 5))


def test_all_masked_entity_has_nulls(spark):
    df = series.with_year(frame(spark, {1: range(24)}, lambda i, k: True), "1995-01-01")
    r = series.statistics(df, 2).first()
    assert r["mean_annual_std"] is None and r["trend_of_annual_mean"] is None and r["mean_value"] == 11.5


def yearly_rows(spark, rows):
    return spark.createDataFrame([(i, k, float(v)) for i, xs in rows.items() for k, v in enumerate(xs)], "id long, year_idx int, v double")


def test_mann_kendall(spark):
    df = yearly_rows(spark, {1: range(10), 2: range(10, 0, -1), 3: [1] * 10, 4: [0, 1] * 5})
    got = {r["id"]: r for r in series.mann_kendall(df, "v").collect()}
    assert got[1]["s"] == 45 and got[1]["trend"] == "increasing" and got[1]["slope"] == 1
    assert got[2]["s"] == -45 and got[2]["trend"] == "decreasing"
    assert got[3]["s"] == 0 and got[3]["trend"] == "no trend"
    assert all(0 <= r["p"] <= 1 for r in got.values())


def test_mann_kendall_keeps_ties_on_a_rounding_edge(spark):
    """The values whose slope is the median are tied without their trend, also where nine digits would part them; a constant changes nothing."""
    x = [82.07761700050001, 54.99517400050001, 87.18863000050001, 29.72596100050001, 74.82110100050001, 53.11111900050001, 53.16950900050001]
    got = {r["id"]: r for r in series.mann_kendall(yearly_rows(spark, {1: x, 2: [v + 0.1234 for v in x]}), "v", alpha=0.1).collect()}
    assert got[1]["z"] == pytest.approx(got[2]["z"], abs=1e-9) and got[1]["trend"] == got[2]["trend"] == "no trend"
    for k, own in ((1, x), (2, [v + 0.1234 for v in x])):
        assert trend_tests.mann_kendall(np.array(own), 0.1)[2] == pytest.approx(got[k]["z"])


def test_mann_kendall_against_numpy(spark):
    draw = np.random.default_rng(1)
    rows = {k: draw.normal(size=12).round(1) + 0.1 * k * np.arange(12) for k in range(6)}
    got = {r["id"]: r for r in series.mann_kendall(yearly_rows(spark, rows), "v").collect()}
    for k, x in rows.items():
        n = len(x)
        i, j = np.triu_indices(n, 1)
        s = np.sign(x[j] - x[i]).sum()
        slope = np.median((x[j] - x[i]) / (j - i))
        _, ties = np.unique(x, return_counts=True)
        var = (n * (n - 1) * (2 * n + 5) - (ties * (ties - 1) * (2 * ties + 5)).sum()) / 18
        d = (x - slope * np.arange(1, n + 1)).round(9)
        rank = np.array([(d < v).sum() + ((d == v).sum() + 1) / 2 for v in d]) - (n + 1) / 2
        extra = 0.0
        for lag in range(1, n):
            c = (rank[:-lag] * rank[lag:]).sum() / (rank**2).sum()
            if abs(c) >= 1.959963984540054 / math.sqrt(n):
                extra += (n - lag) * (n - lag - 1) * (n - lag - 2) * c
        var *= 1 + 2 * extra / (n * (n - 1) * (n - 2))
        z = 0 if s == 0 else (s - np.sign(s)) / math.sqrt(var) if var > 0 else None
        assert got[k]["s"] == s and got[k]["slope"] == pytest.approx(slope)
        if z is None:
            assert got[k]["z"] is None
        else:
            assert got[k]["z"] == pytest.approx(z) and got[k]["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=2e-7)


def test_pettitt(spark):
    r = series.pettitt(yearly_rows(spark, {1: [0] * 5 + [10] * 5}), "v").first()
    assert r["k"] == 25 and r["cp"] == 4


def test_proportions(spark):
    z, p = series.proportion_test(F.lit(10.0), F.lit(50.0), F.lit(20.0), F.lit(50.0))
    r = spark.range(1).select(z.alias("z"), p.alias("p")).first()
    assert r["z"] == pytest.approx(-2.182179, abs=1e-6) and r["p"] == pytest.approx(0.0291, abs=1e-4)


def lof(x, y, k=12):
    d = np.hypot(x[:, None] - x, y[:, None] - y).round(9)
    n = len(x)
    near = [sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], j))[:k] for i in range(n)]
    kd = [d[i, near[i]].max() for i in range(n)]
    lrd = [1 / (np.mean([max(d[i, j], kd[j]) for j in near[i]]) + 1e-10) for i in range(n)]
    return [np.mean([lrd[j] for j in near[i]]) / lrd[i] for i in range(n)]


def test_outlier_factors(spark):
    v = np.arange(120.0)
    v[17] = 300
    got = values(fill.outlier_factors(frame(spark, {1: v})), "lof")[1]
    wanted = lof(5 * np.arange(120) / 119, (v - v.min()) / (v.max() - v.min()))
    assert got == pytest.approx(wanted, rel=1e-6) and [k for k, x in enumerate(got) if x > 1.5] == [17]


def test_masks(spark):
    rows = frame(spark, {1: range(1, 25), 2: [7] * 24}).withColumn("ice", F.when(F.month("period") <= 2, 0.9).otherwise(0.0)).withColumn("cloud", F.col("ice"))
    got = values(fill.freeze_masked(rows))
    assert got[1][:3] == [3, 3, 3] and got[1][12:15] == [12, 12, 15]
    clear = values(fill.cloud_masked(rows))
    assert clear[1][:3] == [3, 3, 3] and clear[1][12:14] == [13, 14] and clear[2] == [7] * 24
    out = fill.freeze_masked_with_outliers(series.with_year(rows, "1995-01-01"))
    assert values(out)[2] == [7] * 24 and values(out, "masked")[1][:2] == [True, True]


def test_stl_parts(spark):
    t = np.arange(130)
    y = 0.05 * t + np.sin(2 * np.pi * t / 13) + np.random.default_rng(3).normal(0, 0.05, 130)
    trend, season, rest = stl.decompose(y)
    assert np.polyfit(t, trend, 1)[0] == pytest.approx(0.05, abs=3e-3)
    assert np.abs(rest[13:-13]).max() < 0.3 and abs(season[13:26].sum()) < 0.5
    assert trend + season + rest == pytest.approx(y)
    got = stl.stl(frame(spark, {1: y, 2: [None, *y[1:]], 3: y[:10]}))
    found = values(got, "trend")
    assert found[1] == pytest.approx(list(trend)) and found[2] == [None] * 130 and found[3] == [None] * 10


def test_recursive_average(spark):
    got = values(fill.smoothed(frame(spark, {1: [1, 2, 3, 4]}), 2), "smoothed")[1]
    assert got == pytest.approx([1, 2, 2, (2 + 2 + 4) / 3])


def test_low_flags(spark):
    df = series.with_year(frame(spark, {1: [k // 12 * 10 + 5 for k in range(72)]}), "1995-01-01")
    assert series.low_flags(df, threshold=0.25).where("low").count() == 24
    assert series.low_flags(df, threshold=0.1).where("low").count() == 0


def test_wide_round_trip(spark):
    df = frame(spark, {1: [1, 2, None], 2: [4, 5, 6]}).drop("masked")
    periods = ["1995-01-01", "1995-02-01", "1995-03-01"]
    wide = reshape.to_wide(df, "id", periods)
    assert values(reshape.to_long(wide, "id", periods)) == {1: [1, 2, None], 2: [4, 5, 6]}


def test_analysis_names(spark):
    with pytest.raises(ValueError, match="none of"):
        series.analyse(None, "no such", 2)


def test_tail_is_exact(spark):
    z = [0.0, 0.1, 1.224744871391589, -1.959963984540054, 5.0, 7.07, 7.08, 12.0, 37.0]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(z)], "k int, z double").select("k", two_sided_p("z").alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(math.erfc(abs(z[r["k"]]) / math.sqrt(2)), rel=1e-7 if abs(z[r["k"]]) > 7 else 1e-12)


def test_numpy_tests_are_the_columns_tests(spark):
    draw = np.random.default_rng(5)
    rows = {k: draw.normal(size=20).round(1) + 0.05 * k * np.arange(20) for k in range(6)} | {7: np.ones(9), 8: np.arange(12.0)}
    yearly = yearly_rows(spark, rows)
    mk = {r["id"]: r for r in series.mann_kendall(yearly, "v").collect()}
    cp = {r["id"]: r for r in series.pettitt(yearly, "v").collect()}
    for k, x in rows.items():
        s, slope, z, p, trend = trend_tests.mann_kendall(np.asarray(x, float))
        assert (s, trend) == (mk[k]["s"], mk[k]["trend"]) and slope == pytest.approx(mk[k]["slope"])
        assert z == (None if mk[k]["z"] is None else pytest.approx(mk[k]["z"])) and p == (None if mk[k]["p"] is None else pytest.approx(mk[k]["p"]))
        u, at, p = trend_tests.pettitt(np.asarray(x, float))
        assert (u, at) == (cp[k]["k"], cp[k]["cp"]) and p == pytest.approx(cp[k]["p"])


def test_trend_statistics_in_one_pass(spark):
    draw = np.random.default_rng(6)
    y = 10 + 0.2 * np.arange(60) + 3 * np.sin(np.arange(60) * 2 * np.pi / 13) + draw.normal(size=60)
    r = {r["id"]: r for r in stl.trend_statistics(frame(spark, {1: y, 2: [None, *y[1:]], 3: y[:10]})).collect()}
    trend, seasonal, _ = stl.decompose(y)
    assert r[1]["trend_per_period"] == pytest.approx(np.polyfit(np.arange(60), trend, 1)[0] * 13) and r[1]["trend_std"] == pytest.approx(trend.std())
    assert (r[1]["mk_s"], r[1]["mk_trend"]) == (trend_tests.mann_kendall(trend)[0], "increasing") and r[1]["cp"] == trend_tests.pettitt(trend)[1]
    assert r[2]["trend_per_period"] is None and r[3]["mk_p"] is None


def test_names_of_single_statistics(spark):
    df = series.with_year(frame(spark, {1: [*range(1, 13), *range(2, 26, 2)]}), "1995-01-01")
    assert set(series.SINGLE) == set(series.statistics(df, 2).columns) - {"id"}
    assert series.analyse(df, "trend_of_std", 2).first()["trend_of_std"] == pytest.approx(3.452053, abs=1e-6)
