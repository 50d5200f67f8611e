"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles. Fingerprints link at up to four
differing bits. Of four differences, one 32-bit half holds two at most; two halves at two differences meet in a
variant one bit from each. So every distinct fingerprint emits, for each half, all variants of that half within
half of its radius (33), which are shuffled; colliding fingerprints are then verified on all 64 bits. (The same on the
whole 64 bits at radius two takes 2,081 variants a fingerprint instead of 66.) In a bucket, links become a star for each
group, so no bucket emits all its pairs; a bucket of over `most_in_bucket` fingerprints is not compared but its
members take the whole 64-bit ball, where a collision needs no comparison and a bucket can't exceed 2,081 members.

Texts without words (null, empty, blank) have fingerprint zero and link like any other. A very long text is hashed as a
whole. Keys may be of any type that has an order. Repeated rows stay separate rows of one group, and so do rows of one key
with different texts; a group is named by its smallest key, so there are no ties. A null doc_id gets its fingerprint and
its group's smallest doc_id, null if there is none. An empty table gives no rows. Other columns take no part, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected
from .common import joined, keys_of, slices, stored, text_bytes

RADIUS = 4


def _fingerprint(words: list[bytes], shingle: int, seed: int) -> int:
    import numpy as np
    import xxhash

    n, digest = len(words), xxhash.xxh64_intdigest
    if not n:
        return 0
    text = b" ".join(words)
    if n <= shingle:
        return digest(text, seed)
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts = [0, *(gaps[: n - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(text)]
    hashes = np.array([digest(text[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[k : k + 65_536].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(key, fp): the fingerprint of every row as a signed long."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, "text"):
            found = [_fingerprint(x.lower().split(), shingle, seed) for x in text_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.array(found, np.uint64).view(np.int64))], ["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["key"], T.StructField("fp", T.LongType())])).withColumnRenamed("key", key)


def half_variants(fps: DataFrame) -> DataFrame:
    """(bucket, fp): for each half, its 33 variants within one bit."""
    j = F.explode(F.sequence(F.lit(0), F.lit(65))).alias("j")
    half, bit = F.floor(F.col("j") / 33).cast("int"), F.col("j") % 33
    turned = F.when(bit == 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, cast(j % 33 - 1 + 32 * (j div 33) as int))")))
    low, high = turned.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(turned, 32) + F.lit(1 << 32)
    return fps.select("fp", j).select(F.when(half == 0, low).otherwise(high).alias("bucket"), "fp")


def _stars(values) -> Iterator[tuple]:
    """Links that hold together what is linked among the sorted distinct values: (root, other) arrays."""
    import numpy as np

    rest = values
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        edge = [root]
        while edge and len(rest):
            near = np.bitwise_count(rest ^ edge.pop()) <= RADIUS
            if near.any():
                found, rest = rest[near], rest[~near]
                yield np.full(len(found), root), found
                edge.extend(found)


def _bucket_links(most: int):
    """Over rows sorted by (bucket, fp): links within buckets, and (fp, null) for the members of too large ones."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def out(pairs: list, hot: list):
            a = np.concatenate([*(x for x, _ in pairs), *hot, np.empty(0, np.uint64)]).astype(np.uint64)
            b = np.concatenate([*(x for _, x in pairs), np.empty(0, np.uint64)]).astype(np.uint64)
            none = len(a) - len(b)
            column = pa.concat_arrays([pa.array(b.view(np.int64)), pa.nulls(none, pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), column], ["u", "v"])

        def linked(keys, values) -> list:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            two = starts[sizes == 2]
            near = two[np.bitwise_count(values[two] ^ values[two + 1]) <= RADIUS]
            pairs = [(values[near], values[near + 1])]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                pairs.extend(_stars(values[s : s + n]))
            return pairs

        keys, values, over = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            v = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            hot = []
            if over is not None:  # the bucket that was too large goes on
                same = int(np.searchsorted(k, over, "right"))
                hot.append(v[:same])
                k, v = k[same:], v[same:]
                if not len(k):
                    yield out([], hot)
                    continue
                over = None
            keys, values = np.r_[keys, k], np.r_[values, v]
            last = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
            pairs = []
            done_k, done_v, keys, values = keys[:last], values[:last], keys[last:], values[last:]
            if len(done_k):
                starts = np.flatnonzero(np.r_[True, done_k[1:] != done_k[:-1]])
                sizes = np.diff(np.r_[starts, len(done_k)])
                large = np.repeat(sizes > most, sizes)
                hot.append(done_v[large])
                if not large.all():
                    pairs = linked(done_k[~large], done_v[~large])
            if len(keys) > most:
                over = keys[0]
                hot.append(values)
                keys, values = keys[:0], values[:0]
            yield out(pairs, hot)
        if len(keys):
            yield out(linked(keys, values), [])

    return run


def whole_ball_links(fps: DataFrame) -> DataFrame:
    """(u, v): links of fingerprints that share a variant within two bits of each; a bucket holds 2,081 at most."""
    i, j = F.col("i"), F.col("j")
    bit = lambda x: f"(case when {x} = 64 then 0L else shiftleft(1L, {x}) end)"
    variants = (
        fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
        .select("fp", "i", F.explode(F.sequence(i, F.lit(64))).alias("j"))
        .where((i != j) | (i == 64))
        .select("fp", F.expr(f"fp ^ {bit('i')} ^ {bit('j')}").alias("variant"))
    )
    met = variants.groupBy("variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u != v").distinct()


def links(fps: DataFrame, most_in_bucket: int = 4096) -> DataFrame:
    """(u, v): links among the distinct fingerprints `fp` that leave the components as all links would."""
    dealt = half_variants(fps).repartition("bucket").sortWithinPartitions("bucket", "fp")
    found = stored(dealt.mapInArrow(_bucket_links(most_in_bucket), "u long, v long").distinct())
    near, hot = found.where("v is not null"), found.where("v is null").select(F.col("u").alias("fp")).distinct()
    return near.union(whole_ball_links(hot)) if hot.take(1) else near


SALTS = 16


def in_groups(own: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, fp, component_id, first) of rows (key, fp), from the distinct fps (fp, least, copies) and the components (node, root) of those with links.

    The members of a large component are salted before they meet its name, and `joined` takes care of texts with very
    many copies, so neither a component nor a text meets in one task.
    """
    name = lambda least, fp: F.min(F.struct(least.isNull().alias("none"), least.alias("least"), fp.alias("fp")))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "least", "copies", "root", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt"))
    names = linked.groupBy("root").agg(name(F.col("least"), F.col("fp")).alias("of")).select("root", "of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    named = linked.join(names, ["root", "salt"]).select("fp", "copies", F.col("of.least").alias("component_id"), F.col("of.fp").alias("first_fp"))
    alone = nodes.join(roots.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", "copies", F.col("least").alias("component_id"), F.col("fp").alias("first_fp"))
    named = stored(named.union(alone))
    found = joined(own, named, "fp", "copies")
    first = F.col("key").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("first_fp"))
    return found.select("key", "fp", "component_id", first.alias("first"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", most_in_bucket: int = 4096, **kind) -> DataFrame:
    """(key, fp, component_id, first): component_id is the smallest key among all rows reachable by links; first marks the rows that stand for a group."""
    own = stored(fingerprints(docs, key, text, **kind))
    nodes = stored(own.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("copies")))
    roots = stored(connected(links(nodes.select("fp"), most_in_bucket), keep=stored))
    return in_groups(own.select(F.col(key).alias("key"), "fp"), nodes, roots).withColumnRenamed("key", key)


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42, **kind) -> DataFrame:
    """One row of each group: that with the smallest key, once where rows repeat."""
    of = lambda x: signed(_fingerprint(x.lower().split(), shingle, seed))
    return one_of_each(docs, near_duplicates(docs, key, text, shingle=shingle, seed=seed, **kind), of, key, text)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def one_of_each(docs: DataFrame, groups: DataFrame, of: Callable[[bytes], int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of given groups (key, fp, component_id, first), the row that stands for each; of(text) is a row's fp.

    A key that one row has decides alone. Rows whose key is null or stands for several rows are told apart by key and fp;
    of rows that share both, any one stays.
    """
    found = stored(groups)
    keys = found.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("any"))
    keys = stored(keys.where("n > 1 or not any"))
    kept = docs.where(F.col(key).isNotNull()).join(keys_of(keys.select(key)), key, "left_anti").select(*docs.columns)
    several = found.where(F.col(key).isNull() & F.col("first")).select(key, "fp").distinct()
    several = stored(several.union(found.where("first").join(keys.where("any").select(key), key, "left_semi").select(key, "fp").distinct()))
    if not several.take(1):
        return kept
    mine = docs.where(F.col(key).isNull()).unionByName(docs.join(keys_of(keys.where("any").select(key)), key, "left_semi").select(*docs.columns))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, text):
            yield batch.append_column("__fp", pa.array([of(x) for x in text_bytes(batch, text)], pa.int64()))

    marked = mine.mapInArrow(run, T.StructType([*mine.schema, T.StructField("__fp", T.LongType())]))
    wanted = several.select(F.col(key).alias("__key"), F.col("fp").alias("__wanted"))
    same = (F.col("__fp") == F.col("__wanted")) & F.col(key).eqNullSafe(F.col("__key"))
    once = marked.join(wanted, same, "left_semi").dropDuplicates([key, "__fp"]).select(*docs.columns)
    return kept.unionByName(once)


def hex_fingerprint(fp: Column | str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
