"""Embedding whitening by polarisation covariance.

An entry c becomes the whole number floor(64 c) + 1,000,000. One pass sums each dimension. A second pass sums exact squares,
of every dimension and of the sum of every two dimensions, centred on their means: the whole part of the mean is taken off
before squaring, and what its fraction adds follows exactly from the same pass's sums. Half the difference between the
variance of a sum and the variances of its parts is the covariance of the parts; these are whole numbers up to a common
divisor, rounded once to doubles for the eigenvectors. A third pass measures the covariance of the whitened values.

Tasks send sums, split into two longs: d (d + 1) / 2 rows for d dimensions, which is all that the driver gets. No row is shuffled.

Vectors that are null or hold null, NaN or infinite entries are dropped. A vector shorter than the longest one counts as
filled up with zeros. Entries must stay below 2^50, so that 64 c is a whole number that a long holds. Repeated rows count
each time; equal eigenvalues have any orthogonal vectors. A direction without variance, as with fewer vectors than
dimensions or with copies only, can't be scaled: its whitened value is null and does not count for the identity error, which
is null where no direction is left. An empty table gives no rows. Null keys are kept. Input columns named like a result are
replaced, others passed through, except the vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 64, 1_000_000
#: Rows of a block: squares up to 2^50 have sums in a long.
BLOCK = 4096
_HALF = 1 << 40
RESULT = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def usable(vector: Column | str) -> Column:
    of = F.col(vector) if isinstance(vector, str) else vector
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return of.isNotNull() & F.coalesce(F.forall(of, good), F.lit(False))


def _whole(column, dims: int) -> np.ndarray:
    """The vectors of an Arrow list column as whole numbers, one row each."""
    import pyarrow as pa

    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dims).all():
        return np.floor(SCALE * values.reshape(len(sizes), dims)).astype(np.int64) + SHIFT
    out = np.full((len(sizes), dims), SHIFT, np.int64)
    at = np.arange(dims) < sizes[:, None]
    out[at] = np.floor(SCALE * values).astype(np.int64) + SHIFT
    return out


def _blocks(batches: Iterator, dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            yield _whole(batch.slice(k, BLOCK).column(0), dims)


def _totals(rows: DataFrame, count: Callable[[Iterator], list[int]]) -> list[int]:
    """The sums over all tasks of the whole numbers that count(batches) gives, by their place."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = count(batches)
        columns = [pa.array(range(len(own)), pa.int32()), pa.array([x // _HALF for x in own], pa.int64()), pa.array([x % _HALF for x in own], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["place", "high", "low"])

    sent = rows.mapInArrow(run, "place int, high long, low long").groupBy("place").agg(F.sum(F.col("high").cast("decimal(28,0)")).alias("high"), F.sum("low").alias("low"))
    found = {r["place"]: int(r["high"]) * _HALF + r["low"] for r in sent.collect()}
    return [found[j] for j in range(len(found))]


def _squares(u: np.ndarray) -> np.ndarray:
    """Sums of squares down the columns; of Python's numbers where a long might overflow."""
    if u.size and max(int(u.max()), -int(u.min())) >= 1 << 25:
        u = u.astype(object)
        return (u * u).sum(0)
    return np.einsum("ij,ij->j", u, u)


def _pair_squares(means: list[int]) -> Callable[[Iterator], list[int]]:
    """Of batches: for every dimension the sum and the sum of squares of its centred values, then for every two dimensions the sum of squares of their sum."""
    dims = len(means)

    def count(batches: Iterator) -> list[int]:
        sums, squares = [0] * dims, [0] * (dims * (dims + 1) // 2)
        held = np.zeros(len(squares), np.int64)
        most = 0
        for x in _blocks(batches, dims):
            u = x - np.array(means, np.int64)
            sums = [a + b for a, b in zip(sums, u.sum(0, dtype=object if np.abs(u).max(initial=0) >= 1 << 50 else np.int64).tolist(), strict=True)]
            found = [_squares(u), *(_squares(u[:, i : i + 1] + u[:, i + 1 :]) for i in range(dims - 1))]
            own = np.concatenate(found) if dims else held
            if own.dtype == object or most + (top := int(own.max(initial=0))) >= 1 << 62:
                squares = [a + int(b) + int(c) for a, b, c in zip(squares, held, own, strict=True)]
                held, most = np.zeros(len(squares), np.int64), 0
            else:
                held, most = held + own, most + top
        return sums + [a + int(b) for a, b in zip(squares, held, strict=True)]

    return count


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums S; eigenvalues (falling) and eigenvectors (columns) of their covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def scaled(self, components: int) -> tuple[np.ndarray, np.ndarray]:
        """The columns that turn centred values into whitened ones, and which of them have a variance."""
        values = self.values[:components]
        some = values > len(self.values) * np.finfo(float).eps * max(self.trace, 0.0)
        return self.vectors[:, :components] / np.sqrt(np.where(some, values, 1.0)), some


def fitted(rows: DataFrame) -> Whitening:
    """Of usable vectors, the only column of `rows`."""
    name = rows.columns[0]
    n, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(name)), F.lit(0))).first()
    if not n:
        return Whitening(0, (), np.empty(0), np.empty((0, 0)), 0.0)

    def added(batches: Iterator) -> list[int]:
        out = [0] * dims
        for x in _blocks(batches, dims):
            dtype = object if np.abs(x).max(initial=0) >= 1 << 50 else np.int64
            out = [a + int(b) for a, b in zip(out, x.sum(0, dtype=dtype).tolist(), strict=True)]
        return out

    sums = _totals(rows, added)
    means = [s // n for s in sums]
    found = _totals(rows, _pair_squares(means))
    rest, squares = found[:dims], found[dims:]
    # n (x - mean) = n u - r with the whole part u and r = S - n mean: its squares sum to n^2 of u's squares less r^2 n.
    centred = lambda square, r: n * n * square - n * r * r
    own = [centred(squares[i], rest[i]) for i in range(dims)]
    covariance, at = np.empty((dims, dims)), dims
    for i in range(dims):
        covariance[i, i] = own[i] / n**3
        for j in range(i + 1, dims):
            both = centred(squares[at], rest[i] + rest[j])
            covariance[i, j] = covariance[j, i] = (both - own[i] - own[j]) / (2 * n**3)
            at += 1
    values, vectors = np.linalg.eigh(covariance) if dims else (np.empty(0), np.empty((0, 0)))
    return Whitening(n, tuple(sums), values[::-1].copy(), vectors[:, ::-1].copy(), sum(own) / n**3)


def _centred(x: np.ndarray, fit: Whitening) -> np.ndarray:
    """x - S/n in doubles: whole parts first, so that no digits are lost."""
    means = np.array([s // fit.n for s in fit.sums], np.int64)
    rest = np.array([(s % fit.n) / fit.n for s in fit.sums])
    return (x - means) - rest


def _deviations(x: np.ndarray, fit: Whitening) -> list[int]:
    """For each row, the sum over dimensions of (n x - S)^2, exactly."""
    means = np.array([s // fit.n for s in fit.sums], np.int64)
    rest = [s % fit.n for s in fit.sums]
    u, n = x - means, fit.n
    if max(n, 1) * (int(np.abs(u).max(initial=0)) + 1) >= 1 << 28:
        u = u.astype(object)
        return [sum(v * v for v in (n * row - np.array(rest, object))) for row in u]
    y = n * u - np.array(rest, np.int64)
    return np.einsum("ij,ij->i", y, y).tolist()


def identity_error(rows: DataFrame, fit: Whitening, components: int) -> float | None:
    """The largest absolute entry of the whitened values' covariance less the identity."""
    turn, some = fit.scaled(components)
    turn, dims = turn[:, some], len(fit.sums)
    if not fit.n or not some.any():
        return None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, mean, spread = 0, np.zeros(turn.shape[1]), np.zeros((turn.shape[1],) * 2)
        for x in _blocks(batches, dims):
            w = _centred(x, fit) @ turn
            own = w.mean(0)
            gap, total = own - mean, n + len(w)
            w -= own
            spread += w.T @ w + np.outer(gap, gap) * (n * len(w) / total)
            n, mean = total, mean + gap * (len(w) / total)
        if n:
            values = np.r_[n * mean, (spread + n * np.outer(mean, mean)).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["place", "value"])

    found = {r[0]: r[1] for r in rows.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value")).collect()}
    values = np.array([found[j] for j in range(len(found))]) / fit.n
    k = turn.shape[1]
    covariance = values[k:].reshape(k, k) - np.outer(values[:k], values[:k])
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(docs: DataFrame, vector: str = "embedding", components: int = 32) -> DataFrame:
    """For each usable row and each component up to `components`: component, n, deviation (38 digits), whitened, explained, identity_error."""
    kept = [c for c in docs.columns if c not in {vector, *RESULT}]
    rows = docs.where(usable(vector))
    fit = fitted(rows.select(vector))
    error = identity_error(rows.select(vector), fit, components)
    turn, some = fit.scaled(components)
    dims = len(fit.sums)
    shares = [float(v / fit.trace) if fit.trace else None for v in fit.values[:components]]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("__deviation", T.DecimalType(38, 0)), T.StructField("__whitened", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator) -> Iterator:
        import decimal

        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                x = _whole(part.column(vector), dims)
                w = _centred(x, fit) @ turn
                w[:, ~some] = np.nan
                deviation = pa.array([decimal.Decimal(int(d)) for d in _deviations(x, fit)], pa.decimal128(38, 0))
                ends = pa.array((np.arange(len(w) + 1) * w.shape[1]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(w.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), deviation, lists], schema.names)

    out = rows.select(*kept, vector).mapInArrow(run, schema)
    out = out.select(*kept, "__deviation", F.posexplode("__whitened").alias("__place", "__value"))
    explained = F.get(F.array(*[F.lit(s).cast("double") for s in shares]), F.col("__place")) if shares else F.lit(None).cast("double")
    return out.select(
        *kept, (F.col("__place") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), F.col("__deviation").alias("deviation"),
        F.col("__value").alias("whitened"), explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
