"""Language-model scores from an Elias-Fano n-gram trie.

Words are numbered by the order of their 63-bit hashes. The trie has three levels, each cut into shards:

- words: hashes in order, with training counts; a word's number is its place.
- pairs: for each word a monotone pointer to its first successor; the successors' numbers, those of one word in order and
  each word's raised by where the word before ended, which makes a shard one monotone sequence; counts, and quantised
  smoothed log probabilities; and a back-off weight for each word.
- triples: the same with the pairs' places as contexts. A third word is named by its place among the successors of the
  second, a small number.

Pointers and successors are Elias-Fano sequences. A successor is searched for within the pointers of its context: its
number is raised by the value before the context's first successor, and the value's place is looked up by its high bits.

Probabilities are interpolated with absolute discounting: p(w|h) = (c(hw) - D) / c(h) + b(h) p(w|h'), where b(h) is what
is discounted (or left out, if `least_count` is above 1). The shortest is (c(w) + 1) / (N + V + 1).

Every text is turned into numbers once. Each task counts its n-grams and sends them to the shards of their contexts as
Elias-Fano sequences, which a shard merges and writes to the shared folder; a context of more tokens than a shard is cut by
its successors. Workers that score map the shards' files into memory. A pair is numbered within its shard, which is cut
where its contexts times all successors would pass 63 bits: no vocabulary is too large.

A text is its words (A-Z lower-cased) and one end token. Null and empty texts are the end token alone; a very long text is
counted and scored as a whole. Without training texts all tokens are unknown and score 0; an empty table gives no rows.
Repeated rows are all counted and scored; no choice depends on order, so there are no ties. A null key is not held out.
Other columns are passed through but the text; input columns named like a result are replaced.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, slices, stored, text_bytes
from .elias_fano import U64, from_bytes, prefixed, read_file, sequence, to_bytes, write_file

#: Quantisation steps in a unit of log10.
STEPS = 2048
#: Training tokens for which a level has a shard.
SHARD_TOKENS = 2_000_000
KEYS = (1 << 63) - 2  # a shard's contexts times the successors they may have are no more
#: Distinct n-grams that a task holds before it sends them on.
HELD = 1_500_000
#: Bytes whose running hashes are held at once.
BLOCK = 1 << 20
#: The end token's hash.
END = 1
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = np.random.default_rng(64).integers(0, 1 << 64, 256, np.uint64)


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-31)) * STEPS), 0, 65535).astype(np.uint16)


def distinct(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 to `most`) in order and each one's rank, as np.unique; places ride in the low bits, where there is room, so that a plain sort does."""
    bits = len(x).bit_length()
    if int(most).bit_length() + bits > 63:
        return np.unique(x, return_inverse=True)
    rows = (x.astype(np.int64) << bits) | np.arange(len(x))
    rows.sort()
    values = rows >> bits
    first = np.ones(len(x), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    rank = np.empty(len(x), np.int64)
    rank[rows & ((1 << bits) - 1)] = np.cumsum(first) - 1
    return values[first], rank


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, slice | np.ndarray]]:
    """Each shard asked for with its rows, which are cut once: a slice where rows stand in the order of shards, else places."""
    order = None
    if (shard[1:] < shard[:-1]).any():
        order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
        shard = shard[order]
    cuts = _runs(shard).tolist()
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(shard[a]), slice(a, b) if order is None else order[a:b]


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    power = lambda b: np.concatenate([[U64(1)], np.multiply.accumulate(np.full(n - 1, b, U64))])
    return power(U64(_BASE)), power(U64(pow(_BASE, -1, 1 << 64)))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all tokens (each text's words, A-Z lower-cased, then the end token), and where texts start.

    A word's hash is the sum of its bytes' random numbers times powers of a base, a difference of running sums, so words
    are hashed by whole blocks.
    """
    joined = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    space = _SPACE[joined]
    begin = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(space & ~np.r_[True, space[:-1]])
    hashes, k = np.empty(len(begin), U64), 0
    while k < len(begin):
        low = begin[k]
        stop = max(k + 1, int(np.searchsorted(end, low + BLOCK, "right")))
        power, inverse = _powers(max(BLOCK, 1 << int(end[stop - 1] - low).bit_length()) + 1)
        part = joined[low : end[stop - 1]]
        sums = np.concatenate([[U64(0)], np.cumsum(_BYTE[part] * power[: len(part)], dtype=U64)])
        a, b = begin[k:stop] - low, end[k:stop] - low
        hashes[k:stop] = (sums[b] - sums[a]) * inverse[a]
        k = stop
    hashes = (hashes ^ (hashes >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    hashes = (hashes ^ (hashes >> U64(32))) >> U64(1)
    words = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))  # up to each text's end
    starts = np.r_[0, words + np.arange(1, len(texts) + 1)].astype(np.int64)
    out = np.empty(int(starts[-1]), U64)
    last = np.zeros(len(out), bool)
    last[starts[1:] - 1] = True
    out[last], out[~last] = U64(END), hashes
    return out, starts


@dataclass(frozen=True)
class Bounds:
    """Where shards begin: at a context, or within it at a successor. `end` is behind the last context."""

    contexts: tuple[int, ...]
    successors: tuple[int, ...]
    end: int
    width: int = 1  # successors are below

    @staticmethod
    def of(starts: set[tuple[int, int]], end: int, width: int) -> Bounds:
        ordered = sorted({(0, 0), *starts})
        if width > 1:
            most = max(1, KEYS // width - 1)
            behind = [*(c for c, _ in ordered[1:]), end]
            ordered = sorted({*ordered, *((x, 0) for (c, _), b in zip(ordered, behind, strict=True) for x in range(c + most, b, most))})
        return Bounds(tuple(c for c, _ in ordered), tuple(s for _, s in ordered), end, width)

    @functools.cached_property
    def _arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        contexts, inside = np.array(self.contexts, np.int64), np.array(self.successors, np.int64)
        return contexts, inside, np.unique(contexts[inside > 0])

    def route(self, c: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The shard of each successor of a context."""
        contexts, inside, cut = self._arrays
        shard = np.searchsorted(contexts, c, "right") - 1
        if len(cut):
            for x in np.unique(c[np.isin(c, cut)]).tolist():
                own = c == x
                a, b = np.searchsorted(contexts, [x, x + 1])
                shard[own] = a - (inside[a] > 0) + np.searchsorted(inside[a:b], s[own], "right") - (inside[a] == 0)
        return shard

    def first(self, shard: int) -> int:
        return self.contexts[shard]

    def behind(self, shard: int) -> int:
        """The context behind the last one that has a part in the shard."""
        if shard + 1 == len(self.contexts):
            return self.end
        return self.contexts[shard + 1] + (self.successors[shard + 1] > 0)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed counts."""
    if len(parts) == 1:
        return parts[0]
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n[:0]


def _counts(n: np.ndarray) -> dict:
    """Counts in a byte each, larger ones aside."""
    large = np.flatnonzero(n >= 255)
    return {"count": np.minimum(n, 255).astype(np.uint8), "large_at": large, "large": n[large].astype(np.int64)}


def _counts_at(x: dict, places: np.ndarray) -> np.ndarray:
    out = x["count"][places].astype(np.int64)
    large = np.flatnonzero(out == 255)
    if len(large):
        out[large] = x["large"][np.searchsorted(x["large_at"], places[large])]
    return out


def _sent(rows: DataFrame, column: str, grams: Callable, bounds: Bounds) -> DataFrame:
    """(shard, block): the n-grams (context, successor) that grams(batch) finds, counted by each task for each shard."""
    held_most = HELD

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, list] = {}

        def blocks():
            shards = sorted(held)
            blocks = []
            for k in shards:
                keys, n = _merged(held[k])
                blocks.append(to_bytes(prefixed("key", keys) | _counts(n)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(blocks, pa.binary())], ["shard", "block"])

        size, first = 0, bounds._arrays[0]
        for batch in slices(batches, column, 2_000_000):
            c, s = grams(batch)
            shard = bounds.route(c, s)
            key = ((c - first[shard]) * bounds.width + s).astype(U64)
            for k, own in _by_shard(shard, len(first)):
                found = np.unique(key[own], return_counts=True)
                held.setdefault(k, []).append(found)
                size += len(found[0])
            if size > held_most:
                yield blocks()
                size = 0
        if held:
            yield blocks()

    return rows.select(column).mapInArrow(run, "shard long, block binary")


_STATS = "shard long, n long, tokens long, widest long, wide_first long, wide_last long, mass_first double, mass_last double, cuts array<long>, hot array<long>, hot_n array<long>, path string"


def _built(sent: DataFrame, bounds: Bounds, path: str, least: int, discount: float) -> list:
    """Merges the blocks of each shard into its file; a row of figures for each."""
    per_shard = SHARD_TOKENS

    def run(key, table):
        import pyarrow as pa

        shard = key[0].as_py()
        parts = []
        for block in table.column("block").to_pylist():
            x = from_bytes(np.frombuffer(block, np.uint8))
            keys = sequence(x, "key").values()
            parts.append((keys, _counts_at(x, np.arange(len(keys)))))
        keys, n = _merged(parts)
        if least > 1:
            keys, n = keys[n >= least], n[n >= least]
        c, s = (keys // U64(bounds.width)).astype(np.int64), (keys % U64(bounds.width)).astype(np.int64)
        wide, mass = np.zeros(2, np.int64), np.zeros(2)
        arrays = _counts(n)
        if bounds.width == 1:
            arrays |= prefixed("key", keys)
            widest = 1
        else:
            pointer = np.searchsorted(c, np.arange(bounds.behind(shard) - bounds.first(shard) + 1))
            full = np.flatnonzero(np.diff(pointer))
            last = np.zeros(len(pointer), np.int64)
            last[full + 1] = s[pointer[full + 1] - 1] + 1
            raised = np.cumsum(last)[c] + s + 1
            arrays |= prefixed("pointer", pointer.astype(U64)) | prefixed("successor", raised.astype(U64))
            sums = np.r_[0.0, np.cumsum(n - discount)]
            widest = int(np.diff(pointer).max())
            wide = np.diff(pointer)[[0, -1]]
            mass = np.diff(sums[pointer])[[0, -1]]
        to = f"{path}-{shard:08d}.level"
        write_file(to, arrays)
        before = np.cumsum(n) - n
        cuts = np.flatnonzero(np.diff(before // per_shard)) + 1
        hot = np.flatnonzero(n > per_shard)
        row = [shard, len(n), int(n.sum()), widest, *wide.tolist(), *mass.tolist(), cuts.tolist(), hot.tolist(), n[hot].tolist(), to]
        return pa.table({f.split()[0]: [x] for f, x in zip(_STATS.split(", "), row, strict=True)}, schema=pa.schema([(f.split()[0], _ARROW[f.split()[1]]()) for f in _STATS.split(", ")]))

    return sent.groupBy("shard").applyInArrow(run, _STATS).collect()


def _arrow_types():
    import pyarrow as pa

    return {"long": pa.int64, "double": pa.float64, "string": pa.string, "array<long>": lambda: pa.list_(pa.int64())}


_ARROW = _arrow_types()


def _next_bounds(stats: list, starts: np.ndarray, end: int, width: int) -> Bounds:
    """Shards of about SHARD_TOKENS tokens each over the entries of a level as contexts; larger contexts are cut by successors."""
    found = set()
    for r in stats:
        base = int(starts[r["shard"]])
        found |= {(base, 0), *((base + k, 0) for k in r["cuts"])}
        for k, n in zip(r["hot"], r["hot_n"], strict=True):
            parts = min(-(-n // SHARD_TOKENS), width)
            found |= {(base + k, j * width // parts) for j in range(parts)} | {(base + k + 1, 0)}
    return Bounds.of({x for x in found if x[0] < end}, end, width)


@functools.lru_cache(maxsize=4096)
def _opened(path: str):
    x = read_file(path)
    return x, {name: sequence(x, name) for name in ("key", "pointer", "successor") if f"{name}_n" in x}


@dataclass(frozen=True)
class Words:
    bounds: Bounds
    n: tuple[int, ...]
    paths: tuple[str, ...]

    @functools.cached_property
    def starts(self) -> np.ndarray:
        return np.r_[0, np.cumsum(self.n, dtype=np.int64)].astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of sorted hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        shard = self.bounds.route(hashes.astype(np.int64), np.zeros(len(hashes), np.int64))
        for k, own in _by_shard(shard, len(self.n)):
            if self.n[k]:
                place = _opened(self.paths[k])[1]["key"].find(hashes[own] - U64(self.bounds.first(k)))
                out[own] = np.where(place >= 0, place + self.starts[k], -1)
        return out

    def count(self, numbers: np.ndarray) -> np.ndarray:
        """The training counts of known words."""
        out = np.zeros(len(numbers), np.int64)
        for k, own in _by_shard(np.searchsorted(self.starts, numbers, "right") - 1, len(self.n)):
            out[own] = _counts_at(_opened(self.paths[k])[0], numbers[own] - self.starts[k])
        return out


@dataclass(frozen=True)
class Level:
    """Successors of contexts. Places are numbered through all shards."""

    bounds: Bounds
    n: tuple[int, ...]
    paths: tuple[str, ...]
    scores: tuple[str, ...] = ()  # files of probabilities and back-off weights

    @functools.cached_property
    def starts(self) -> np.ndarray:
        return np.r_[0, np.cumsum(self.n, dtype=np.int64)].astype(np.int64)

    @property
    def size(self) -> int:
        return int(self.starts[-1])

    def find(self, c: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The place of each successor among those of its context, -1 if it has none; fast in order of contexts, then successors."""
        out = np.full(len(c), -1, np.int64)
        for k, own in _by_shard(self.bounds.route(c, s), len(self.n)):
            if not self.n[k]:
                continue
            x = _opened(self.paths[k])[1]
            context = c[own] - self.bounds.first(k)
            runs = _runs(context)
            which = np.repeat(np.arange(len(runs) - 1), np.diff(runs))
            contexts = context[runs[:-1]]
            a, b = x["pointer"].get(contexts).astype(np.int64), x["pointer"].get(contexts + 1).astype(np.int64)
            raise_by = np.where(a > 0, x["successor"].get(np.maximum(a - 1, 0)), U64(0))
            place = x["successor"].find(raise_by[which] + s[own].astype(U64) + U64(1))
            inside = (place >= a[which]) & (place < b[which])
            out[own] = np.where(inside, place + self.starts[k], -1)
        return out

    def begin(self, c: np.ndarray) -> np.ndarray:
        """The place of each context's first successor."""
        out = np.zeros(len(c), np.int64)
        shard = self.bounds.route(c, np.zeros(len(c), np.int64))
        for k, own in _by_shard(shard, len(self.n)):
            at = _opened(self.paths[k])[1]["pointer"].get(c[own] - self.bounds.first(k)).astype(np.int64) if self.n[k] else 0
            out[own] = at + self.starts[k]
        return out

    def second(self, a: int, b: int) -> np.ndarray:
        """The successors at places a up to b."""
        out = []
        for k in range(int(np.searchsorted(self.starts, a, "right")) - 1, len(self.n)):
            low, high = max(a - int(self.starts[k]), 0), min(b - int(self.starts[k]), self.n[k])
            if low >= high:
                if self.starts[k] >= b:
                    break
                continue
            x = _opened(self.paths[k])[1]
            pointer = x["pointer"].values().astype(np.int64)
            begin = pointer[np.searchsorted(pointer, np.arange(low, high), "right") - 1]
            raised = x["successor"].range(low, high)
            before = np.where(begin > 0, x["successor"].get(np.maximum(begin - 1, 0)), U64(0))
            out.append((raised - before - U64(1)).astype(np.int64))
        return np.concatenate([*out, np.empty(0, np.int64)])

    def _take(self, places: np.ndarray, read: Callable, kind) -> np.ndarray:
        out = np.zeros(len(places), kind)
        for k, own in _by_shard(np.searchsorted(self.starts, places, "right") - 1, len(self.n)):
            out[own] = read(k, places[own] - self.starts[k])
        return out

    def count(self, places: np.ndarray) -> np.ndarray:
        return self._take(places, lambda k, at: _counts_at(_opened(self.paths[k])[0], at), np.int64)

    def log_prob(self, places: np.ndarray) -> np.ndarray:
        return self._take(places, lambda k, at: read_file(self.scores[k])["prob"][at], np.float64) / -STEPS

    def log_weight(self, c: np.ndarray) -> np.ndarray:
        """What backing off from each context adds, 0 for one without successors."""
        out = np.zeros(len(c))
        shard = self.bounds.route(c, np.zeros(len(c), np.int64))
        for k, own in _by_shard(shard, len(self.n)):
            if self.n[k]:
                out[own] = read_file(self.scores[k])["weight"][c[own] - self.bounds.first(k)]
        return out / -STEPS


def _level(stats: list, bounds: Bounds) -> Level:
    n, paths = [0] * len(bounds.contexts), [""] * len(bounds.contexts)
    for r in stats:
        n[r["shard"]], paths[r["shard"]] = r["n"], r["path"]
    return Level(bounds, tuple(n), tuple(paths))


def _whole(stats: list, bounds: Bounds, what: str) -> dict[int, float]:
    """For contexts that are cut, the sum of a figure over their shards."""
    out: dict[int, float] = {}
    for r in stats:
        k = r["shard"]
        first, last = bounds.first(k), bounds.behind(k) - 1
        out[first] = out.get(first, 0) + r[f"{what}_first"]
        if last != first:
            out[last] = out.get(last, 0) + r[f"{what}_last"]
    return out


def _with_scores(spark, level: Level, mass: dict[int, float], total: Callable, shorter: Callable, discount: float) -> Level:
    """The level with probabilities and weights. total(contexts) counts contexts a up to b; shorter(a, b, context, successor) is p(w|h')."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in batch.column("shard").to_pylist():
                arrays, x = _opened(level.paths[k])
                a, b = level.bounds.first(k), level.bounds.behind(k)
                pointer = x["pointer"].values().astype(np.int64)
                n = _counts_at(arrays, np.arange(level.n[k]))
                own = np.diff(np.r_[0.0, np.cumsum(n - discount)][pointer])
                for edge in {a, b - 1} & mass.keys():
                    own[edge - a] = mass[edge]
                of = total(a, b)
                weight = quantised(np.where(own > 0, 1 - own / np.maximum(of, 1), 1.0))
                back = 10 ** (weight / -STEPS)
                sizes = np.diff(pointer)
                c = np.repeat(np.arange(b - a), sizes)
                raised = x["successor"].values()
                before = np.where(pointer[:-1] > 0, raised[np.maximum(pointer[:-1] - 1, 0)], U64(0))
                s = (raised - np.repeat(before, sizes) - U64(1)).astype(np.int64)
                p = (n - discount) / of[c] + back[c] * shorter(a, b, c, s)
                path = level.paths[k].removesuffix(".level") + ".scores"
                write_file(path, {"prob": quantised(p), "weight": weight})
            yield pa.RecordBatch.from_arrays([batch.column("shard")], ["shard"])

    shards = [k for k, n in enumerate(level.n) if n]
    if shards:
        spark.createDataFrame([(k,) for k in shards], "shard long").repartition(len(shards), "shard").mapInArrow(run, "shard long").write.format("noop").mode("overwrite").save()
    return Level(level.bounds, level.n, level.paths, tuple(p.removesuffix(".level") + ".scores" if p else "" for p in level.paths))


@dataclass(frozen=True)
class SlicePairs:
    """The words and pairs of some texts, each looked up once."""

    own: np.ndarray  # distinct tokens in order; the first `seen` are known
    rank: np.ndarray  # of each token, among these
    seen: int
    pair: np.ndarray  # rank of the pair that ends at each token, -1 where a text starts
    place: np.ndarray  # of each distinct pair, -1 if it has none; one -1 more
    relative: np.ndarray  # where it has one, its place counted from its first word's first pair


@dataclass(frozen=True)
class Model:
    tokens: int  # N
    words: Words
    discount: float = 0.75
    pairs: Level | None = None
    triples: Level | None = None

    @functools.cached_property
    def distinct(self) -> int:
        return int(self.words.starts[-1])

    @property
    def unknown(self) -> float:
        return self.tokens + self.distinct + 1

    # Numbers of words; `distinct` stands for the unknown.

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        import pyarrow as pa

        found = pa.array(hashes).dictionary_encode()  # all 63 bits are used, so places can't ride along in a sort
        own = found.dictionary.to_numpy()
        order = np.argsort(own)
        place = np.empty(len(own), np.int64)
        place[order] = self.words.find(own[order])
        place[place < 0] = self.distinct
        return place[found.indices.to_numpy()]

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        seen = np.flatnonzero(numbers < self.distinct)
        out[seen] = self.words.count(numbers[seen])
        return out

    def slice_pairs(self, tokens: np.ndarray, starts: np.ndarray) -> SlicePairs:
        """Distinct words and pairs have their places looked up once, in the order that the levels have."""
        own, rank = distinct(tokens, self.distinct)
        keys, which = distinct(rank[:-1] * len(own) + rank[1:], len(own) ** 2)
        pair = np.full(len(tokens), -1, np.int64)
        pair[1:] = which
        pair[starts[:-1]] = -1
        first, second = keys // max(len(own), 1), keys % max(len(own), 1)
        place, begin = np.full(len(keys) + 1, -1, np.int64), np.zeros(len(own), np.int64)
        seen = int(np.searchsorted(own, self.distinct))  # the unknown comes last
        if self.pairs is not None:
            known = np.flatnonzero((first < seen) & (second < seen))
            place[known] = self.pairs.find(own[first[known]], own[second[known]])
            begin[:seen] = self.pairs.begin(own[:seen])
        return SlicePairs(own, rank, seen, pair, place, place[:-1] - begin[first])

    def scores(self, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known tokens, base score, score."""
        x = self.slice_pairs(tokens, starts)
        count = self.counts(x.own)
        known = (count > 0)[x.rank]
        base = (np.log10(count + 1) - np.log10(self.unknown))[x.rank]
        value = base.copy()
        found = x.place[x.pair] >= 0
        if self.pairs is not None:
            weight = np.zeros(len(x.own))
            weight[: x.seen] = self.pairs.log_weight(x.own[: x.seen])
            value[1:] += weight[x.rank[:-1]]
            value[starts[:-1]] = base[starts[:-1]]
            there = np.flatnonzero(x.place >= 0)
            prob = np.zeros(len(x.place))
            prob[there] = self.pairs.log_prob(x.place[there])
            value = np.where(found, prob[x.pair], value)
        if self.triples is not None:
            # A token whose two predecessors are a known pair backs off from it, or has a known trigram.
            follows = np.r_[False, found[:-1]][: len(tokens)]
            follows[starts[:-1]] = False
            at = np.flatnonzero(follows)
            # Pairs and places have one order, so triples by their pairs' ranks stand as their level has them; 0: no second pair.
            width = len(x.place)
            keys, which = distinct(x.pair[at - 1] * width + np.where(found[at], x.pair[at] + 1, 0), width**2)
            context, second = x.place[keys // width], keys % width - 1
            runs = _runs(context)
            value_of = np.repeat(self.triples.log_weight(context[runs[:-1]]), np.diff(runs))
            asked = np.flatnonzero(second >= 0)
            place = self.triples.find(context[asked], x.relative[second[asked]])
            hit = np.zeros(len(keys), bool)
            hit[asked] = place >= 0
            value_of[hit] = self.triples.log_prob(place[place >= 0])
            value[at] = np.where(hit[which], 0, value[at]) + value_of[which]
        total = lambda x: np.add.reduceat(x, starts[:-1]) if len(starts) > 1 else x[:0]
        return np.diff(starts), total(known.astype(np.int64)), total(base), total(value)


def numbered(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with tokens: the numbers of its tokens as binary."""
    kept = [c for c in docs.columns if c not in (text, "tokens")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("tokens", T.BinaryType())])
    kind = np.int32 if model.distinct < 2**31 - 1 else np.int64

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, text):
            hashes, starts = word_hashes(text_bytes(batch, text))
            tokens = model.numbers(hashes).astype(kind)
            cut = [tokens[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(cut, pa.binary())], schema.names)

    return docs.select(*kept, text).mapInArrow(run, schema)


def _flat(batch, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all tokens of a batch, and where texts start."""
    kind = np.dtype(np.int32 if model.distinct < 2**31 - 1 else np.int64)
    data = batch.column("tokens").to_pylist()
    starts = np.r_[0, np.cumsum([len(x) // kind.itemsize for x in data], dtype=np.int64)].astype(np.int64)
    return np.frombuffer(b"".join(data), kind).astype(np.int64), starts


def vocabulary(docs: DataFrame, text: str = "text", discount: float = 0.75) -> tuple[Model, list]:
    """The first level, words of docs with their counts, and the figures of its shards."""
    folder = f"{shared_dir(docs.sparkSession)}/ngrams/{uuid.uuid4().hex}"
    rows = docs.select(F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // (12 * SHARD_TOKENS)))
    bounds = Bounds.of({(k * (1 << 63) // shards, 0) for k in range(shards)}, (1 << 63) - 1, 1)

    def words(batch):
        hashes = word_hashes(text_bytes(batch, "text"))[0].astype(np.int64)
        return hashes, np.zeros(len(hashes), np.int64)

    stats = _built(_sent(rows, "text", words, bounds), bounds, f"{folder}/words", 1, discount)
    level = _level(stats, bounds)
    model = Model(sum(r["tokens"] for r in stats), Words(bounds, level.n, level.paths), discount)
    return model, stats


def train(docs: DataFrame, text: str = "text", least_count: int = 1, discount: float = 0.75) -> Model:
    """A trie of the texts of docs."""
    model, stats = vocabulary(docs, text, discount)
    return grown(stored(numbered(docs.select(text), model, text)), model, stats, least_count)


def grown(rows: DataFrame, model: Model, stats: list, least_count: int = 1) -> Model:
    """The model with the levels of pairs and triples, from the training texts' tokens."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/ngrams/{uuid.uuid4().hex}"
    if not model.tokens:
        return model

    def pairs(batch, model=model):
        flat, starts = _flat(batch, model)
        keep = np.ones(len(flat), bool)
        keep[starts[1:] - 1] = False
        at = np.flatnonzero(keep)
        return flat[at], flat[at + 1]

    bounds = _next_bounds(stats, model.words.starts, model.distinct, model.distinct)
    stats = _built(_sent(rows, "tokens", pairs, bounds), bounds, f"{folder}/pairs", least_count, model.discount)
    if not stats or not any(r["n"] for r in stats):
        return model

    def shorter(a, b, c, s, model=model):
        own, which = distinct(s, model.distinct)
        return ((model.words.count(own) + 1) / model.unknown)[which]

    total = lambda a, b, model=model: model.words.count(np.arange(a, b))
    level = _with_scores(spark, _level(stats, bounds), _whole(stats, bounds, "mass"), total, shorter, model.discount)
    model = replace(model, pairs=level)
    width = 1 + int(max(*(r["widest"] for r in stats), *_whole(stats, bounds, "wide").values()))

    def triples(batch, model=model):
        x = model.slice_pairs(*_flat(batch, model))
        found = x.place[x.pair] >= 0
        at = np.flatnonzero(found[1:] & found[:-1]) + 1
        return x.place[x.pair[at - 1]], x.relative[x.pair[at]]

    bounds = _next_bounds(stats, level.starts, level.size, width)
    stats = _built(_sent(rows, "tokens", triples, bounds), bounds, f"{folder}/triples", least_count, model.discount)
    if not stats or not any(r["n"] for r in stats):
        return model

    def from_pairs(a, b, c, s, model=model):
        middle, which = distinct(model.pairs.second(a, b), model.distinct)
        begin = np.zeros(len(middle), np.int64)
        begin[:] = model.pairs.begin(middle)
        return 10 ** model.pairs.log_prob(begin[which][c] + s)

    total = lambda a, b, model=model: model.pairs.count(np.arange(a, b))
    level = _with_scores(spark, _level(stats, bounds), _whole(stats, bounds, "mass"), total, from_pairs, model.discount)
    return replace(model, triples=level)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, n_known, base_score and score."""
    return scored_tokens(numbered(docs.drop("n_tokens", "n_known", "base_score", "score"), model, text), model)


def scored_tokens(rows: DataFrame, model: Model) -> DataFrame:
    """As scored, from tokens."""
    new = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    kept = [c for c in rows.columns if c not in {"tokens", *(n for n, _ in new)}]
    schema = T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(n, t) for n, t in new)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, "tokens", 2_000_000):
            found = model.scores(*_flat(batch, model))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x) for x in found)], schema.names)

    return rows.select(*kept, "tokens").mapInArrow(run, schema)


def trained_and_scored(docs: DataFrame, held_out: str, text: str = "text", least_count: int = 1) -> tuple[DataFrame, Model]:
    """Scores of all docs by a model of those that are not held out; every text is split into tokens once."""
    model, stats = vocabulary(docs.where(~F.col(held_out)), text)
    rows = stored(numbered(docs, model, text))
    model = grown(rows.where(~F.col(held_out)), model, stats, least_count)
    return scored_tokens(rows, model), model
