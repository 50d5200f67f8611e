"""Resampling by weights against numpy's resamples of rows, and Pettitt's simulated p."""

from __future__ import annotations

import numpy as np
import pytest
from tidewright.operators import resampling, series


def rows_of(draw, n: int, ties: bool):
    a, b = draw.normal(0.5, 1, n), draw.normal(0, 1, n)
    return (np.round(a, 1), np.round(b, 1)) if ties else (a, b)


@pytest.mark.parametrize(("chunk", "stat"), [(50_000, "median"), (7, "median"), (7, "mean"), (50_000, "sum")])
def test_bootstrap_is_distributed_as_numpys(spark, chunk, stat):
    draw = np.random.default_rng(3)
    x, _ = rows_of(draw, 61, True)
    df = spark.createDataFrame([("c", float(v)) for v in x] + [(None, 2.0), (None, 4.0), ("d", None), ("e", 5.0)], "g string, v double").repartition(4)
    got = resampling.bootstrap(df, "g", "v", stat, chunk=chunk).collect()
    by = {g: np.array([r["value"] for r in got if r["g"] == g]) for g in ("c", None, "e")}
    assert {g: len(v) for g, v in by.items()} == {"c": 1000, None: 1000, "e": 1000} and len(got) == 3000
    f = {"median": np.median, "mean": np.mean, "sum": np.sum}[stat]
    want = np.array([f(draw.choice(x, len(x))) for _ in range(4000)])
    assert by["c"].mean() == pytest.approx(want.mean(), abs=4 * want.std() / 1000**0.5) and by["c"].std() == pytest.approx(want.std(), rel=0.12)
    assert set(by["e"]) == {5.0} and set(np.round(by[None], 6)) == ({2.0, 3.0, 4.0} if stat != "sum" else {4.0, 6.0, 8.0})
    again = resampling.bootstrap(df.repartition(2), "g", "v", stat, chunk=chunk).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("chunk", [50_000, 9])
@pytest.mark.parametrize("side", ["both", "above", "below"])
def test_ks_against_resampled_rows(spark, chunk, side):
    draw = np.random.default_rng(5)
    a, b = rows_of(draw, 40, True)
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in zip(a, b)] + [(2, 1.0, None)], "g int, a double, b double").repartition(3)
    (r,) = resampling.bootstrap_ks(df, "g", "a", "b", side=side, chunk=chunk).collect()
    at = np.unique(np.r_[a, b])
    upto = lambda x: np.searchsorted(np.sort(x), at, "right") / len(x)
    fold = {"both": np.abs, "above": lambda d: d, "below": lambda d: -d}[side]
    far = lambda x, y: fold(upto(x) - upto(y)).max()
    pooled = np.r_[a, b]
    p = np.mean([far(draw.choice(pooled, 40), draw.choice(pooled, 40)) >= far(a, b) - 1e-12 for _ in range(4000)])
    assert r["d"] == pytest.approx(far(a, b)) and r["p"] == pytest.approx(p, abs=0.06)


@pytest.mark.parametrize("chunk", [50_000, 6])
def test_permutations_against_shuffled_rows(spark, chunk):
    draw = np.random.default_rng(8)
    a, b = rows_of(draw, 30, True)
    df = spark.createDataFrame([(None, float(x), float(y)) for x, y in zip(a, b)] + [(None, None, 3.0)], "g int, a double, b double").repartition(3)
    (r,) = resampling.permutation_test(df, "g", "a", "b", chunk=chunk).collect()
    u = sum((x > y) + (x == y) / 2 for x in a for y in b)
    ranks = np.array([(np.r_[a, b] < v).sum() + ((np.r_[a, b] == v).sum() + 1) / 2 for v in np.r_[a, b]])
    us = np.array([draw.permutation(ranks)[:30].sum() for _ in range(4000)]) - 30 * 31 / 2
    assert r["u"] == u and r["p_greater"] == pytest.approx((us >= u).mean(), abs=0.04) and r["p_less"] == pytest.approx((us <= u).mean(), abs=0.05)


def test_simulated_pettitt(spark):
    draw = np.random.default_rng(4)
    lists = {1: [*draw.normal(0, 1, 10), *draw.normal(3, 1, 10)], 2: draw.normal(0, 1, 20).tolist(), 3: [1.0, 1.0, 2.0, 2.0, 1.0, 3.0], 4: [5.0], 5: [None, None]}
    df = spark.createDataFrame([(k, j, None if v is None else float(v)) for k, x in lists.items() for j, v in enumerate(x)], "id int, year_idx int, v double")
    got = {r["id"]: r for r in series.pettitt_simulated(df, "v").collect()}
    plain = {r["id"]: r for r in series.pettitt(df, "v").collect()}
    assert {k: (r["k"], r["cp"], r["p"]) for k, r in got.items()} == {k: (r["k"], r["cp"], r["p"]) for k, r in plain.items()} and set(got) == {1, 2, 3, 4}
    for key in (1, 2, 3):
        n, k = len(lists[key]), got[key]["k"]
        order = np.array([draw.permutation(n) + 1 for _ in range(20_000)])
        p = (np.abs(2 * np.cumsum(order, 1) - np.arange(1, n + 1) * (n + 1)).max(1) >= k).mean()
        assert got[key]["p_simulated"] == pytest.approx(p, abs=0.015)
    assert got[1]["significant"] and not got[2]["significant"] and got[4]["p_simulated"] == 1
