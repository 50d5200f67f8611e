"""Whitening against whole-number arithmetic and numpy's eigenvectors."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from tidewright.llm import entry, whitening


def exact(vectors: list[list[float]]):
    """n, deviations and the covariance of the whole-number vectors, by Python's numbers."""
    dims = max((len(v) for v in vectors), default=0)
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in [*v, *[0.0] * (dims - len(v))]] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    y = [[n * a - s for a, s in zip(row, sums)] for row in x]
    cov = [[sum(r[i] * r[j] for r in y) / n**3 for j in range(dims)] for i in range(dims)]
    return n, [sum(v * v for v in r) for r in y], np.array(cov), np.array([[v / n for v in r] for r in y])


def held(rows) -> dict:
    out = defaultdict(dict)
    for r in rows:
        out[r["vec_id"]][r["component"]] = r
    return out


def check(spark, rows, components=32):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, whitened string").repartition(3)
    kept = [(k, v) for k, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, deviations, cov, centred = exact([v for _, v in kept])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = held(whitening.whitened(docs, components=components).collect())
    assert set(got) == {k for k, _ in kept}
    for j, (key, _) in enumerate(kept):
        own = got[key]
        assert sorted(own) == list(range(1, min(components, len(values)) + 1))
        for c, r in own.items():
            assert r["n"] == n and int(r["deviation"]) == deviations[j]
            assert abs(r["explained"] - values[c - 1] / np.trace(cov)) <= 1e-9
            assert r["identity_error"] < 1e-9
            if values[c - 1] > 1e-9 * values[0]:
                want = centred[j] @ vectors[:, c - 1] / math.sqrt(values[c - 1])
                assert abs(abs(r["whitened"]) - abs(want)) < 1e-7
            else:
                assert r["whitened"] is None
    return got


def test_against_whole_numbers(spark):
    draw = np.random.default_rng(5)
    mix = draw.normal(size=(9, 9)) * np.array([3, 2, 1.5, 1, 0.8, 0.5, 0.3, 0.2, 0.1])
    vectors = (draw.normal(size=(300, 9)) @ mix.T + draw.normal(size=9)).tolist()
    rows = [(k, v, "x", "y") for k, v in enumerate(vectors)]
    rows += [(900, None, "x", "y"), (901, [1.0, None] + [0.0] * 7, "x", "y"), (902, [float("nan")] * 9, "x", "y"), (903, [float("inf")] * 9, "x", "y")]
    check(spark, rows)
    check(spark, rows, components=4)


def test_large_entries_and_unequal_lengths(spark):
    """Squares beyond a long; short vectors are filled up with zeros."""
    draw = np.random.default_rng(6)
    rows = [(k, (draw.normal(size=4) * 10.0 ** draw.integers(0, 9)).tolist()[: 4 if k else 2], "x", "y") for k in range(50)]
    check(spark, rows)


def test_without_variance(spark):
    rows = [(k, [float(k % 3), 2.0 * (k % 3), 5.0], "x", "y") for k in range(30)]
    got = check(spark, rows)
    assert [got[0][c]["whitened"] is None for c in (1, 2, 3)] == [False, True, True]


def test_copies_only_and_empty(spark):
    docs = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    found = whitening.whitened(docs).collect()
    assert len(found) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in found)
    assert whitening.whitened(docs.where("false")).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [])], "vec_id long, embedding array<double>")).collect() == []


@pytest.mark.parametrize("block", [7, 4096])
def test_query(spark, block, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", block)
    folder = "/root/testdata/sf0.001"
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    keys = list(rows)
    n, deviations, cov, centred = exact([rows[k] for k in keys])
    values, vectors = np.linalg.eigh(cov)
    got = held(entry.op11_whitening(spark, folder).collect())
    w = np.array([[got[k][c]["whitened"] for c in range(1, 33)] for k in keys])
    want = centred @ vectors[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-7 and [got[k][1]["deviation"] for k in keys] == deviations
    assert np.abs(w.T @ w / n - np.eye(32)).max() < 1e-9
