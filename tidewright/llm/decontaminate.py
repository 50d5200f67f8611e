"""Benchmark decontamination by an FM-index for each training shard.

A shard is a slice of a partition of documents. Its words are numbered by the words of the test phrases; a word that no
phrase has cuts the text, and pieces shorter than the shortest phrase can't hold one. What is left is indexed, every
phrase (10 consecutive words of an item, or a whole shorter item) is found by backward search, its occurrences are
located from sampled suffix positions, and overlapping ones merge to removal spans. Nothing is shuffled.

Items are dealt into blocks of about `block_bytes` of text, each a pass over its predecessor's stored result, so no more than
a block is on the driver or in a task at once. Null and empty texts have no words; a very long text is a shard of its own.
Items without words have no phrase. An item without id marks words but is not listed. Items with equal windows, and
windows that overlap, all count: there are no ties to break. Repeated rows are each searched. Without items nothing is
hit; without documents there are no rows. Input columns named like a result are replaced, others passed through;
`cleaned` gives rows back with their own columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LETTERS, set_aside, slices, stored, text_bytes, words_of
from .fm_index import FMIndex

WINDOW = 10
RESULT = ("n_words", "n_hit", "items", "removal_spans")


class Phrases:
    """The distinct windows of some items, by length, in word numbers from 2 up."""

    def __init__(self, items: list[tuple], window: int):
        number: dict[bytes, int] = {}
        ids: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            codes = [number.setdefault(w, len(number) + 2) for w in words_of((text or "").encode())]
            for k in range(max(1, len(codes) - window + 1) if codes else 0):
                ids.setdefault(tuple(codes[k : k + window]), set()).update([] if item_id is None else [str(item_id)])
        self.number, self.top = number, len(number) + 1
        self.by_length: dict[int, np.ndarray] = {}
        self.items: dict[int, list[list[str]]] = {}
        for length in sorted({len(x) for x in ids}):
            own = [x for x in ids if len(x) == length]
            self.by_length[length] = np.array(own, np.int64)
            self.items[length] = [sorted(ids[x]) for x in own]


def shard_hits(shard: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Which words of the shard's documents (a false one behind each) are hit, where documents start, items of each."""
    lookup = dict(phrases.number)
    get = lookup.get
    starts = np.r_[0, np.cumsum([len(words) + 1 for words in shard], dtype=np.int64)]
    codes = np.ones(int(starts[-1]), np.int64)
    for at, words in zip(starts.tolist(), shard):
        if words:
            codes[at : at + len(words)] = np.fromiter((get(w, 1) for w in words), np.int64, len(words))
    hit, found = np.zeros(len(codes), bool), [set() for _ in shard]
    known = codes > 1
    edge = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    if not phrases.by_length:
        return hit, starts, found
    long = b - a >= min(phrases.by_length)
    a, b = a[long], b[long] + 1  # each piece with the cut behind it
    if not len(a):
        return hit, starts, found
    sizes = b - a
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(a, sizes)
    index = FMIndex(codes[place], phrases.top)
    change = np.zeros(len(codes) + 1, np.int64)
    for length, own in phrases.by_length.items():
        which, at = index.occurrences(own)
        at = place[at]
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
        of = np.searchsorted(starts, at, "right") - 1
        for doc, phrase in set(zip(of.tolist(), which.tolist(), strict=True)):
            found[doc].update(phrases.items[length][phrase])
    return np.cumsum(change[:-1]) > 0, starts, found


def byte_spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Merged runs of hit words as byte positions."""
    letters = np.frombuffer(text.translate(LETTERS), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[False, letters, False].astype(np.int8)))
    runs = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return [(int(edge[2 * x]), int(edge[2 * y - 1])) for x, y in zip(runs[::2], runs[1::2], strict=True)]


def blocks(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> Iterator[tuple[int, int, Phrases]]:
    """(number, of, phrases): the phrases of all items, one block of items after another."""
    rows = benchmark.select(F.col(item).alias("id"), F.col(text).alias("text"))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    for k in range(n):
        yield k, n, Phrases([tuple(r) for r in (rows.where(part == k) if n > 1 else rows).toLocalIterator()], window)


def searched(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = 8_000_000) -> DataFrame:
    """docs with n_words, n_hit, items (ids as sorted strings) and removal_spans (code points, end exclusive)."""
    new = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("removal_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        ]
    )
    kept = [c for c in docs.columns if c not in new.names]
    schema = T.StructType([*(docs.schema[c] for c in kept), *new])

    def one(phrases: Phrases, again: bool):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            for batch in slices(batches, text):
                texts = text_bytes(batch, text)
                shard = [words_of(x) for x in texts]
                hit, starts, found = shard_hits(shard, phrases)
                n_hit, items, spans = [], [], []
                before = batch.column("removal_spans").to_pylist() if again else [[]] * len(texts)
                old = batch.column("items").to_pylist() if again else [[]] * len(texts)
                for k, x in enumerate(texts):
                    own = hit[starts[k] : starts[k + 1] - 1]
                    if before[k]:
                        own = own | _marked(x, before[k])
                    merged = byte_spans(x, own) if own.any() else []
                    n_hit.append(int(own.sum()))
                    items.append(sorted(found[k].union(old[k])))
                    point = np.cumsum((np.frombuffer(x, np.uint8) & 0xC0) != 0x80) if merged else ()  # code points up to each byte
                    spans.append([{"start": int(point[a]) - 1, "end": int(point[b - 1])} for a, b in merged])
                columns = [pa.array([len(w) for w in shard], pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], schema.names)

        return run

    out = docs.select(*kept)
    for k, n, phrases in blocks(benchmark, item, item_text, window, block_bytes):
        out = out.mapInArrow(one(phrases, k > 0), schema)
        out = stored(out) if k + 1 < n else out
    return out


def _marked(text: bytes, spans: list[dict]) -> np.ndarray:
    """The words inside spans of code points."""
    letters = np.frombuffer(text.translate(LETTERS), np.uint8) != 32
    start = np.flatnonzero(np.diff(np.r_[False, letters].astype(np.int8)) > 0)
    point = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
    at = point[start]
    out = np.zeros(len(start), bool)
    for s in spans:
        out |= (at >= s["start"]) & (at < s["end"])
    return out


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs without the removal spans in their texts; a document that has no word left goes, others stay."""
    own, restored = set_aside(docs, RESULT)
    found = searched(own, benchmark, text, **how)
    step = lambda acc, s: F.struct(
        F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).alias("out"), s["end"].alias("at")
    )
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text)))
    cut = F.aggregate("removal_spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, rest)
    out = found.withColumn(text, F.when(F.size("removal_spans") > 0, cut).otherwise(F.col(text)))
    return restored(out.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words"))))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    items = F.col("items")
    return found.select(
        key, "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
