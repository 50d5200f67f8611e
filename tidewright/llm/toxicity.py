"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms. The score is the logistic of a bias, a weight for each term, and, for each pair
of terms, the product of their factor vectors, which learns what no sum of weights can: an insult that counts only
beside a group's name. Every term of `least_rows` rows or more has a weight and factors; what keeps them from noise is
regularisation, not a screen. First the weights: an L1 penalty picks them jointly, then they are fitted again almost
without penalty. Then the factors of all terms, by AdaGrad on what the weights leave. How large they start, how strongly they are
held to zero and for how many passes they are fitted, one at least, is told by the loss on a fifth of the rows held back;
a further pass must lower it by one standard error, a less careful start by two. The factors stay as they were when they were judged; the weights are
fitted on all rows. Every fitted machine has factors, small ones where pairs tell little
beyond the weights.

It is fitted on `train_rows` labelled rows at most, those with the smallest hashed ids; only a set of term numbers for
each of these comes to the driver. Scoring is one pass over all texts.

Null and empty texts have no terms and get the bias alone; a very long text is one set of at most 2^18 terms. Without
labelled rows every score is 0; without documents there are no scores. A document labelled twice is two training rows. Of
rows beyond `train_rows`, equal hashes are told apart by id, label and terms. Repeated documents are each scored. Other
columns are passed through but the text; input columns named like a result are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_bytes, words_of

BITS = 18
#: (standard deviation at the start, L2 penalty, rate) of the factors that are tried, the most careful first.
FACTOR_STARTS = ((0.002, 0.1, 0.02), (0.05, 0.01, 0.2))


def terms(text: bytes) -> np.ndarray:
    """The distinct hashed terms of a text."""
    words = set(words_of(text))
    return np.unique(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & np.uint32((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Machine:
    slot: np.ndarray  # of each hashed term, -1 if it was not learned
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, found: np.ndarray) -> float:
        own = self.slot[found]
        own = own[own >= 0]
        v = self.factor[own]
        total = self.bias + self.weight[own].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def _chances(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n).astype(np.float64)  # of nothing at all, bincount gives integers


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The terms of all rows, and the row of each."""
    return np.concatenate([*rows, np.empty(0, np.int64)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def _prior(labels: np.ndarray) -> float:
    return float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))


def _weights(term: np.ndarray, row: np.ndarray, labels: np.ndarray, n: int, l1: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Penalised logistic weights and bias by accelerated proximal steps, terms scaled by the root of their rows."""
    scale = 1 / np.sqrt(np.maximum(np.bincount(term, minlength=n), 1))
    value = scale[term]
    v, curve = np.ones(n), 1.0
    for _ in range(12):  # the largest curvature, by power iteration
        v = _sums(term, value * _sums(row, value * v[term], len(labels))[row], n)
        curve = float(np.linalg.norm(v)) or 1.0
        v /= curve
    curve = 0.3 * curve + l2
    bias, now, ahead, pace = _prior(labels), np.zeros(n), np.zeros(n), 1.0
    for _ in range(steps):
        error = _chances(bias + _sums(row, value * ahead[term], len(labels))) - labels
        moved = ahead - (_sums(term, value * error[row], n) + l2 * ahead) / curve
        moved = np.sign(moved) * np.maximum(np.abs(moved) - l1 * scale / curve, 0)
        if (ahead - moved) @ (moved - now) > 0:  # overshot: start again from here
            pace, ahead = 1.0, moved
        else:
            after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            ahead, pace = moved + (pace - 1) / after * (moved - now), after
        now = moved
        bias -= 4 * error.mean()
    return now * scale, float(bias)


def _linear(rows: list[np.ndarray], labels: np.ndarray, n: int, l1: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights picked under an L1 penalty and fitted again under a small L2 penalty."""
    term, row = _flat(rows)
    picked = np.flatnonzero(_weights(term, row, labels, n, l1, 0.0, steps)[0])
    slot = np.full(n, -1)
    slot[picked] = np.arange(len(picked))
    own = slot[term] >= 0
    weight = np.zeros(n)
    weight[picked], bias = _weights(slot[term[own]], row[own], labels, len(picked), 0.0, l2, 2 * steps)
    return weight, bias


def _pairwise(factor: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """The sum over pairs of terms of each row."""
    term, row = _flat(rows)
    v = factor[term]
    total = np.stack([_sums(row, v[:, f], len(rows)) for f in range(factor.shape[1])], 1)
    return 0.5 * ((total**2).sum(1) - _sums(row, (v**2).sum(1), len(rows)))


def _passes(rows: list[np.ndarray], labels: np.ndarray, base: np.ndarray, n: int, factors: int, rate: float, l2: float, start: float, batch: int, draw: np.random.Generator) -> Iterator[np.ndarray]:
    """The factors after each pass over the rows; base is what bias and weights give."""
    factor, past = draw.normal(0, start, (n, factors)), np.ones((n, factors))
    while True:
        order = draw.permutation(len(rows))
        for k in range(0, len(order), batch):
            picked = order[k : k + batch]
            term, row = _flat([rows[p] for p in picked])
            used, where = np.unique(term, return_inverse=True)
            has = np.zeros((len(picked), len(used)))
            has[row, where] = 1
            v = factor[used]
            total = has @ v
            error = _chances(base[picked] + 0.5 * ((total**2).sum(1) - has @ (v**2).sum(1))) - labels[picked]
            slope = has.T @ (error[:, None] * total) - (has.T @ error)[:, None] * v + l2 * len(picked) * v
            past[used] += slope**2
            factor[used] -= rate * slope / np.sqrt(past[used])
        yield factor


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = 4, least_rows: int = 3, l1: float = 2.0, l2: float = 0.01, steps: int = 150, most_passes: int = 30, patience: int = 4, batch: int = 64, seed: int = 5) -> Machine:
    """A machine over all terms of `least_rows` rows or more."""
    draw = np.random.default_rng(seed)
    told = np.bincount(_flat(rows)[0], minlength=1 << BITS) >= least_rows
    slot = np.where(told, np.cumsum(told) - 1, -1)
    n = int(told.sum())
    if not len(rows):
        return Machine(slot, -30.0, np.zeros(n), np.zeros((n, factors)))
    rows = [x[x >= 0] for x in (slot[r] for r in rows)]
    back = draw.random(len(rows)) < 0.2

    def started(which: np.ndarray):
        own = [rows[k] for k in np.flatnonzero(which)]
        weight, bias = _linear(own, labels[which], n, l1, l2, steps)
        base = lambda some: np.array([bias + weight[r].sum() for r in some])
        return own, weight, bias, base

    fitting = lambda own, y, base, start, l2, rate: _passes(own, y, base, n, factors, rate, l2, start, batch, np.random.default_rng(seed))
    chosen = None
    if back.any() and not back.all():
        own, _, _, base = started(~back)
        held, kept = [rows[k] for k in np.flatnonzero(back)], None
        alone, truth = base(held), np.where(labels[back] > 0, -1.0, 1.0)
        lower = lambda old, new, errors: old is None or (old - new).mean() > errors * (old - new).std() / np.sqrt(len(new))
        for how in FACTOR_STARTS:
            own_loss = None
            for k, factor in enumerate(fitting(own, labels[~back], base(own), *how), 1):
                loss = np.logaddexp(0, truth * (alone + _pairwise(factor, held)))
                if lower(own_loss, loss, 1):
                    last, own_loss, own_factor = k, loss, factor.copy()
                if k - last >= patience or k == most_passes:
                    break
            if lower(kept, own_loss, 2):
                kept, chosen = own_loss, own_factor
    own, weight, bias, base = started(np.ones(len(rows), bool))
    factor = chosen if chosen is not None else next(fitting(own, labels, base(own), *FACTOR_STARTS[0]))
    return Machine(slot, bias, weight, factor)


def in_fold(key: str, folds: int, fold: int) -> Column:
    return F.crc32(F.col(key).cast("string")) % folds == fold


def learned(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = 12_000, **how) -> Machine:
    """A machine from the labelled documents; the sample is taken from the labels, so only its texts are read into terms."""
    sample = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"))
    sample = sample.orderBy(F.xxhash64("key"), "key", "label").limit(train_rows)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, "text"):
            rows = [terms(x).astype(np.int32).tobytes() for x in text_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(rows, pa.binary())], ["key", "label", "terms"])

    joined = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key")
    found = joined.mapInArrow(run, T.StructType([joined.schema["key"], T.StructField("label", T.DoubleType()), T.StructField("terms", T.BinaryType())]))
    # An id that stands for several documents has several rows; the bound holds all the same.
    packed = found.orderBy(F.xxhash64("key"), "key", "label", "terms").limit(train_rows).toArrow()
    rows = [np.frombuffer(x, np.int32).astype(np.int64) for x in packed.column("terms").to_pylist()]
    return fit(rows, packed.column("label").to_numpy(), **how)


def scored(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """docs without the text, with score."""
    kept = [c for c in docs.columns if c not in (text, "score")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, text):
            out = [machine.score(terms(x)) for x in text_bytes(batch, text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.float64())], [*kept, "score"])

    return docs.select(*kept, text).mapInArrow(run, schema)
