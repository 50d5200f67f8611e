"""Seasonal-trend decomposition by LOESS, many entities at a time in Arrow batches.

The fit is iterative, so it is the one series operator that needs Python; Spark splits the entities and gathers each
one's series in a row, which is bounded by its number of periods. In a batch the series of one length are fitted
together, TOGETHER values at most at a time, as rows of a matrix: a robust round is a few numpy calls for all of them.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .trend_tests import mann_kendall, pettitt

TOGETHER = 30_000


@functools.lru_cache(maxsize=64)
def _windows(n: int, span: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the places first, first + 1, ...: the start of the nearest points' window, tricube weights, and the places."""
    q = min(span, n)
    at = np.arange(first, first + count, dtype=float)
    left = np.clip(at - (q - 1) // 2, 0, n - q).astype(int)
    index = left[:, None] + np.arange(q)
    d = np.abs(index - at[:, None])
    h = d.max(1, keepdims=True) + ((span - n) // 2 if span > n else 0)
    w = np.where(d <= 0.001 * h, 1.0, (1 - np.minimum(d / np.maximum(h, 1e-12), 1) ** 3) ** 3)
    return index, np.where(d <= 0.999 * h, w, 0.0), at


def loess(y: np.ndarray, span: int, first: int, count: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Local linear fits of y over 0, 1, ... at `count` places from `first`, tricube weights over the span nearest points.

    y may hold several series of one length, a row each, and weights likewise.
    """
    n = y.shape[-1]
    index, w, at = _windows(n, span, first, count)
    if weights is not None:
        w = w * weights[..., index]
    total = w.sum(-1, keepdims=True)
    w = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
    middle = (w * index).sum(-1, keepdims=True)
    off = index - middle
    spread = (w * off**2).sum(-1, keepdims=True)
    lean = np.sqrt(spread) > 0.001 * (n - 1)
    w = w * np.where(lean, 1 + (at[:, None] - middle) * off / np.where(lean, spread, 1), 1)
    return np.where(total[..., 0] > 0, (w * y[..., index]).sum(-1), np.nan)


def _moving(y: np.ndarray, n: int) -> np.ndarray:
    total = np.cumsum(np.concatenate([np.zeros_like(y[..., :1]), y], -1), -1)
    return (total[..., n:] - total[..., :-n]) / n


def decompose(y: np.ndarray, period: int = 13, seasonal: int = 7, robust: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, residual) of one series, or of several of one length, a row each; each is fitted by itself."""
    n, shape = y.shape[-1], y.shape
    y = y.reshape(-1, n)
    span = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    trend_span, low_span = span + (span % 2 == 0), period + (period % 2 == 0)
    trends, seasons = np.zeros(y.shape), np.zeros(y.shape)
    open_, weights = np.arange(len(y)), None
    for outer in range(16 if robust else 1):
        flat_y, trend = y[open_], trends[open_]
        for _ in range(2 if robust else 5):
            flat = flat_y - trend
            cycle = np.empty((len(flat), n + 2 * period))
            for s in range(period):
                own = flat[:, s::period]
                cycle[:, s::period] = loess(own, seasonal, -1, own.shape[1] + 2, None if weights is None else weights[:, s::period])
            low = loess(_moving(_moving(_moving(cycle, period), period), 3), low_span, 0, n)
            season = cycle[:, period : period + n] - low
            trend = loess(flat_y - season, trend_span, 0, n, weights)
        trends[open_], seasons[open_] = trend, season
        if robust:
            rest = np.abs(flat_y - trend - season)
            h = 6 * np.median(rest, -1, keepdims=True)
            # a series that fits exactly is done
            more = h[:, 0] > 0
            open_, u = open_[more], rest[more] / h[more]
            if not len(open_):
                break
            weights = np.where(u <= 0.001, 1.0, np.where(u < 0.999, (1 - u**2) ** 2, 0.0))
    return trends.reshape(shape), seasons.reshape(shape), (y - trends - seasons).reshape(shape)


def _fitted(values: list[np.ndarray], period: int, robust: bool):
    """(place, trend, seasonal, resid) of each series that has two periods and no gap, the series of one length fitted together."""
    by_length: dict[int, list[int]] = {}
    for k, y in enumerate(values):
        if len(y) >= 2 * period and np.isfinite(y).all():
            by_length.setdefault(len(y), []).append(k)
    for n, places in by_length.items():
        step = max(1, TOGETHER // n)
        for i in range(0, len(places), step):
            part = places[i : i + step]
            for k, *parts in zip(part, *decompose(np.stack([values[k] for k in part]), period, robust=robust), strict=True):
                yield k, *parts


def _series(df: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """(key, at, value) with a row an entity: its periods and values as arrays in order of time.

    The shuffle is by a stated number of partitions: fits cost far more than their bytes tell, so small ones must not be merged.
    """
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    held = F.sort_array(F.collect_list(F.struct(F.col(at).alias("t"), F.col(value).cast("double").alias("v"))))
    return df.groupBy(key).agg(held.alias("__s")).select(key, F.col("__s.t").alias(at), F.col("__s.v").alias(value))


def _arrays(column) -> list[np.ndarray]:
    """The rows of a column of lists of doubles, nulls as NaN."""
    import pyarrow as pa

    out = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        ends, flat = np.asarray(chunk.offsets), chunk.values.to_numpy(zero_copy_only=False).astype(float)
        out += [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def stl(df: DataFrame, key: str = "id", value: str = "value", at: str = "period", period: int = 13, robust: bool = True) -> DataFrame:
    """(key, at, value, trend, seasonal, resid) rows; a series with a null or of under two periods has nulls."""
    parts = ("trend", "seasonal", "resid")
    series = _series(df, key, value, at)
    schema = T.StructType([*series.schema.fields, *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in parts)])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = _arrays(batch.column(value))
            found = {k: rest for k, *rest in _fitted(values, period, robust)}
            sides = [pa.array([found[k][i] if k in found else [None] * len(y) for k, y in enumerate(values)], pa.list_(pa.float64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *sides], names=[*batch.schema.names, *parts])

    rows = series.mapInArrow(run, schema).select(key, F.explode(F.arrays_zip(F.col(at).alias("t"), F.col(value).alias("v"), *parts)).alias("r"))
    return rows.select(key, F.col("r.t").alias(at), *(F.nanvl(c, F.lit(None).cast("double")).alias(n) for c, n in (("r.v", value), *((f"r.{c}", c) for c in parts))))


def trend_statistics(df: DataFrame, key: str = "id", value: str = "value", at: str = "period", period: int = 13, robust: bool = True, alpha: float = 0.05) -> DataFrame:
    """Of each entity's trend: its slope per period and in percent, its deviation, Mann-Kendall and Pettitt tests; and the yearly seasonal range's slope and mean.

    Decomposition and tests take one pass over a batch of entities. cp counts from 0.
    """
    fields = ["trend_per_period", "trend_percentage", "trend_std", "seasonal_range_slope", "mean_seasonal_range", "mk_s", "mk_slope", "mk_z", "mk_p", "mk_trend", "pettitt_k", "cp", "pettitt_p"]
    kinds = {"mk_trend": T.StringType(), "cp": T.IntegerType()}
    schema = T.StructType([df.schema[key], *(T.StructField(f, kinds.get(f, T.DoubleType())) for f in fields)])

    def slope(y: np.ndarray) -> float | None:
        x = np.arange(len(y)) - (len(y) - 1) / 2
        return float((x * y).sum() / (x * x).sum()) if len(y) > 1 else None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = _arrays(batch.column(value))
            rows = [dict.fromkeys(fields) for _ in values]
            for k, trend, seasonal, _ in _fitted(values, period, robust):
                rise, mean = slope(trend), trend.mean()
                ranges = np.array([np.ptp(seasonal[i : i + period]) for i in range(0, len(trend), period)])
                rows[k] |= {"trend_per_period": rise * period, "trend_percentage": rise / mean * 100 if mean else None, "trend_std": float(trend.std()), "seasonal_range_slope": slope(ranges), "mean_seasonal_range": float(ranges.mean())}
                rows[k] |= dict(zip(("mk_s", "mk_slope", "mk_z", "mk_p", "mk_trend"), mann_kendall(trend, alpha), strict=True))
                rows[k] |= dict(zip(("pettitt_k", "cp", "pettitt_p"), pettitt(trend), strict=True))
            sides = [pa.array([r[f] for r in rows], pa.string() if f == "mk_trend" else pa.int32() if f == "cp" else pa.float64()) for f in fields]
            yield pa.RecordBatch.from_arrays([batch.column(key), *sides], names=[key, *fields])

    return _series(df, key, value, at).mapInArrow(run, schema)
