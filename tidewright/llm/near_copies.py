"""Near-duplicates at a Jaccard similarity of word shingles, by SimHash and meet-in-the-middle ball hashing.

A text is the set of XXH64 values of its five-word shingles (A-Z lower-cased; all its words where there are fewer). Its
wide fingerprint is the bitwise majority of 372 bits for each of them: 11 blocks of 28 and 64 more. Of every block, each
fingerprint emits all variants within one bit, so two that differ in two bits of a block or less meet in a bucket: sets
of similarity 0.8 with probability 0.89, of 0.85 with 0.97, of 0.9 with 0.998 (blocks taken as independent). A member of
a bucket counts only if it has another one there within `CHECK_BITS` of the 64 more bits, so texts that meet by chance, whose
number grows with the square of the corpus, stay behind in the shard. Colliding pairs within `most_bits` differing bits (0.8 is beyond that once in a hundred) are verified on the sets themselves:
links have `similarity` or more.

Equal sets are one node, so copies are never compared. In a bucket each member names the closest other one; the `NEAREST` closest
that it names in all are verified and joined to components. Where a bucket's members are then still apart, the pairs between components are looked at
once more, each in the first bucket where it meets: by a fingerprint of `SHARP_BITS` bits, in which a similarity of 0.8 differs
in 310 bits (beyond the limit of 348 once in a hundred), one of 0.7 in 393 (within it once in two hundred). What passes
is verified. So neither mutual near copies nor groups that stay well under the similarity emit their pairs; a group
whose members all are just under it (0.7 to 0.8) and link with none emits a share of them, a tenth at 0.71.

Texts without words (null, empty, blank) are one set. A very long text is one set as a whole. Repeated rows stay separate
rows of one group; the group is named by its smallest key, so ties don't arise. Rows without a key are grouped like all
others. An empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected
from .common import keys_of, slices, stored, text_bytes
from .elias_fano import from_bytes, prefixed, sequence, to_bytes
from .simhash import in_groups

BLOCKS, BLOCK_BITS = 11, 28
#: 372 differing bits are binomial with a mean of 56.4 at a similarity of 0.8, and a standard deviation of 6.9; 64 with 9.7 and 2.9.
MOST_BITS, CHECK_BITS = 73, 17
NEAREST = 4
#: 2048 differing bits at a similarity of 0.8: a mean of 310 and a standard deviation of 16; the limit is 2.33 of these above.
SHARP_BITS, MOST_SHARP_BITS = 2048, 348
#: Variants to a shard.
SHARD_ROWS = 1_000_000


def shingled(words: list[bytes], shingle: int, seed: int):
    """The sorted distinct hashes of the shingles."""
    import numpy as np
    import xxhash

    n, digest = len(words), xxhash.xxh64_intdigest
    if not n:
        return np.empty(0, np.uint64)
    text = b" ".join(words)
    if n <= shingle:
        return np.array([digest(text, seed)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts = [0, *(gaps[: n - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(text)]
    return np.unique(np.array([digest(text[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64))


def majority(values, bits: int, seed: int):
    """Whether each of so many bits is set in over half of the values: a value gives a mixed word for every 64 of them."""
    import numpy as np

    words = -(-bits // 64)
    factor = np.random.default_rng(seed).integers(0, 1 << 63, words, np.uint64) * np.uint64(2) + np.uint64(1)
    ones = np.zeros(64 * words, np.int64)
    step = max(64, 524_288 // bits)
    for k in range(0, len(values), step):
        x = values[k : k + step, None] * factor
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8)).reshape(len(x), -1).sum(0, dtype=np.uint16)
    return (2 * ones > len(values))[:bits]


def wide_fingerprint(values, seed: int):
    """The blocks of a set's fingerprint, and its 64 more bits."""
    import numpy as np

    bits = majority(values, BLOCKS * BLOCK_BITS + 64, seed)
    blocks = bits[:-64].reshape(BLOCKS, BLOCK_BITS) @ (1 << np.arange(BLOCK_BITS, dtype=np.int64))
    return np.r_[blocks, np.packbits(bits[-64:]).view(np.int64)]


def differing(rows, one):
    """The number of bits in which each row differs from one."""
    import numpy as np

    return np.bitwise_count((rows ^ one).view(np.uint64)).sum(-1, dtype=np.int64)


def sharp_fingerprint(values, seed: int):
    import numpy as np

    return np.packbits(majority(values, SHARP_BITS, seed)).view(np.int64)


def set_hash(text: bytes, shingle: int = 5, seed: int = 42) -> int:
    """Names the set of a text, as a signed long."""
    import xxhash

    x = xxhash.xxh64_intdigest(shingled(text.lower().split(), shingle, seed).tobytes(), seed)
    return x - (1 << 64) if x >> 63 else x


def _mapped(rows: DataFrame, what: str, shingle: int, seed: int) -> DataFrame:
    """(key, fp, n, values) of rows (key, text): fp names the set, n is its size, values are its fingerprint's blocks, its sharp fingerprint or its members."""

    of = {"blocks": wide_fingerprint, "sharp": sharp_fingerprint, "members": lambda values, _: values}[what]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in slices(batches, "text"):
            fps, sizes, found = [], [], []
            for x in text_bytes(batch, "text"):
                values = shingled(x.lower().split(), shingle, seed)
                fps.append(xxhash.xxh64_intdigest(values.tobytes(), seed))
                sizes.append(len(values))
                found.append((of(values, seed) if len(values) else values).view(np.int64))
            ends = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), lists], ["key", "fp", "n", "values"])

    new = [T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("values", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(run, T.StructType([rows.schema["key"], *new]))


def _variants(shards: int):
    """Of nodes (fp, values): (shard, block) with every block of a fingerprint and all that differ from it in one bit, sorted
    and packed. A bucket is a block's number and its value; a shard has a range of them."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        masks = np.r_[0, 1 << np.arange(BLOCK_BITS, dtype=np.int64)]
        width = -(-(BLOCKS << BLOCK_BITS) // shards)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                fps = part.column("fp").to_numpy()
                values = part.column("values").flatten().to_numpy().reshape(-1, BLOCKS + 1)
                bucket = (values[:, :BLOCKS] + (np.arange(BLOCKS) << BLOCK_BITS))[:, :, None] ^ masks
                node = np.repeat(np.arange(len(fps), dtype=np.uint16), BLOCKS * len(masks))
                order = np.argsort(bucket.ravel())
                bucket, node = bucket.ravel()[order], node[order]
                cuts = np.searchsorted(bucket, np.arange(shards + 1) * width)
                found, blocks = [], []
                for shard in np.flatnonzero(np.diff(cuts)).tolist():
                    low, high = cuts[shard], cuts[shard + 1]
                    own, which = np.unique(node[low:high], return_inverse=True)
                    found.append(shard)
                    blocks.append(to_bytes(prefixed("bucket", (bucket[low:high] - shard * width).astype(np.uint64)) | {"node": which.astype(np.uint16), "fp": fps[own], "check": values[own, BLOCKS]}))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(blocks, pa.binary())], ["shard", "block"])

    return run


def _met(bucket, check):
    """Of rows sorted by bucket: which have another one in theirs that is close by its check."""
    import numpy as np

    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(bucket)])
    out = np.zeros(len(bucket), bool)
    two = starts[sizes == 2]
    two = two[np.bitwise_count((check[two] ^ check[two + 1]).view(np.uint64)) <= CHECK_BITS]
    out[two] = out[two + 1] = True
    for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        own = check[a : a + n]
        for k in range(n):
            out[a + k] = out[a + k] or np.count_nonzero(np.bitwise_count((own ^ own[k]).view(np.uint64)) <= CHECK_BITS) > 1
    return out


def _shared(shards: int):
    """Of a shard's blocks, (bucket, fp) of those that are not alone in a bucket."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        buckets, fps, checks = [], [], []
        for block in table.column("block").to_pylist():
            x = from_bytes(np.frombuffer(block, np.uint8))
            buckets.append(sequence(x, "bucket").values().astype(np.int64))
            fps.append(x["fp"][x["node"]])
            checks.append(x["check"][x["node"]])
        bucket, fp, check = np.concatenate(buckets), np.concatenate(fps), np.concatenate(checks)
        order = np.argsort(bucket)
        bucket = bucket[order]
        same = np.r_[False, bucket[1:] == bucket[:-1]]
        several = np.flatnonzero(same | np.r_[same[1:], False])
        several = several[_met(bucket[several], check[order[several]])]
        low = key[0].as_py() * -(-(BLOCKS << BLOCK_BITS) // shards)
        return pa.table({"bucket": bucket[several] + low, "fp": fp[order[several]]})

    return run


def _first_met(bucket: int, own, others):
    """Of fingerprints that meet `own` in a bucket, those that do so first there: in no block before, and in no smaller bucket of this one.

    Equal blocks meet in all variants and count in their own value's bucket; others meet in two, the values themselves or
    those between them.
    """
    import numpy as np

    block, value = bucket >> BLOCK_BITS, bucket & ((1 << BLOCK_BITS) - 1)
    gap = others ^ own
    before = (np.bitwise_count(gap[:, :block]) <= 2).any(1)
    here = gap[:, block]
    low = here & -here
    least = np.where(np.bitwise_count(here) == 2, np.minimum(own[block] ^ low, own[block] ^ (here ^ low)), np.minimum(own[block], others[:, block]))
    return ~before & (least == value)


def _nearest(similarity: float, most_bits: int):
    """Of a bucket: each member with the closest other one that may be similar, and their differing bits."""

    def of(bucket, fp, n, blocks):
        import numpy as np

        found = []
        for k in range(len(fp)):
            gap = differing(blocks, blocks[k])
            gap[(gap > most_bits) | (np.minimum(n, n[k]) + 1e-9 < similarity * np.maximum(n, n[k]))] = most_bits + 1
            gap[k] = most_bits + 1
            at = int(gap.argmin())
            if gap[at] <= most_bits:
                found.append((int(fp[k]), int(fp[at]), int(gap[at])))
        return found

    return of


def _apart(similarity: float, most_bits: int):
    """Of a bucket: for each member the later ones of other components that may be similar and meet it here first."""

    def of(bucket, fp, n, blocks, label):
        import numpy as np

        for k in range(len(fp) - 1) if (label != label[0]).any() else ():
            at = k + 1 + np.flatnonzero(label[k + 1 :] != label[k])
            at = at[np.minimum(n[at], n[k]) + 1e-9 >= similarity * np.maximum(n[at], n[k])]
            at = at[differing(blocks[at], blocks[k]) <= most_bits]
            yield k, at[_first_met(bucket, blocks[k], blocks[at])]

    return of


def _open(similarity: float, most_bits: int):
    """Of a bucket: which members have such a one."""
    apart = _apart(similarity, most_bits)

    def of(*rows):
        import numpy as np

        out = np.zeros(len(rows[1]), bool)
        for k, at in apart(*rows):
            out[at] = True
            out[k] |= len(at) > 0
        return out

    return of


def _sharp_pairs(similarity: float, most_bits: int):
    """Of a bucket: those pairs whose sharp fingerprints are close."""
    apart = _apart(similarity, most_bits)

    def of(bucket, fp, n, blocks, label, sharp):
        found = []
        for k, at in apart(bucket, fp, n, blocks, label):
            at = at[differing(sharp[at], sharp[k]) <= MOST_SHARP_BITS]
            found.extend((int(fp[k]), v, 0) for v in fp[at].tolist())
        return found

    return of


def _in_buckets(of, *columns: str, filtering: bool = False):
    """Over rows sorted by bucket, of(bucket, fp, n, values, *columns) of each bucket: pairs (u, v, gap), or which rows stay; lists are rows of a matrix."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def array(table, name):
            x = table.column(name).combine_chunks()
            return x.flatten().to_numpy().reshape(len(x), -1) if pa.types.is_list(x.type) else x.to_numpy()

        def found(table):
            bucket, *parts = (array(table, c) for c in ("bucket", "fp", "n", "values", *columns))
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist()
            spans = zip(starts, [*starts[1:], len(bucket)])
            if filtering:
                yield from table.filter(pa.array(np.concatenate([of(int(bucket[a]), *(x[a:b] for x in parts)) for a, b in spans]))).to_batches()
                return
            out = sorted({x for a, b in spans if b > a + 1 for x in of(int(bucket[a]), *(x[a:b] for x in parts))})
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], ["u", "v", "gap"])

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            last = int(np.searchsorted(bucket, bucket[-1]))
            if last:
                yield from found(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif held and held[0].column("bucket")[0].as_py() != bucket[0]:
                yield from found(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from found(pa.Table.from_batches(held))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    side = lambda c: sets.select(F.col("fp").alias(c), F.col("values").alias(f"{c}_values"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").withColumn("common", F.size(F.array_intersect("u_values", "v_values")))
    return both.where(F.col("common") + 1e-9 >= similarity * (F.size("u_values") + F.size("v_values") - F.col("common"))).select("u", "v")


def colliding(nodes: DataFrame, count: int) -> DataFrame:
    """(bucket, fp) of the nodes (fp, values) that meet another one in a bucket; variants travel in packed blocks, about SHARD_ROWS to a shard."""
    shards = max(1, -(-count * BLOCKS * (BLOCK_BITS + 1) // SHARD_ROWS))
    sent = nodes.select("fp", "values").mapInArrow(_variants(shards), "shard long, block binary")
    return sent.groupBy("shard").applyInArrow(_shared(shards), "bucket long, fp long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, seed: int = 42, most_bits: int = MOST_BITS) -> DataFrame:
    """(key, fp, component_id, first): component_id is the smallest key among all rows reachable by links; first marks the rows that stand for a group."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    own = stored(_mapped(rows, "blocks", shingle, seed))
    nodes = stored(own.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("values").alias("values")))
    with_words = nodes.where("n > 0")
    by_bucket = lambda df: df.repartition("bucket").sortWithinPartitions("bucket", "fp")
    shared = colliding(with_words, with_words.count())
    placed = stored(shared.join(nodes.select("fp", "n", "values"), "fp").select("bucket", "fp", "n", "values"))
    named = by_bucket(placed).mapInArrow(_in_buckets(_nearest(similarity, most_bits)), "u long, v long, gap long")
    # A member is in no more buckets than it has variants, so what it names is a short list.
    named = named.groupBy("u").agg(F.slice(F.array_sort(F.collect_set(F.struct("gap", "v"))), 1, NEAREST).alias("of")).select("u", F.explode("of.v").alias("v"))
    tried = stored(named.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())

    def made_of(fps: DataFrame, what: str) -> DataFrame:
        """(fp, values): the sets, or what is made of them, of texts, each read from one of its rows."""
        wanted = stored(fps.distinct().join(nodes.select("fp", "least"), "fp"))
        texts = rows.join(keys_of(stored(wanted.where("least is not null").select(F.col("least").alias("key")).distinct())), "key", "left_semi")
        if wanted.where("least is null").take(1):  # texts that only rows without a key have
            texts = texts.union(rows.where("key is null"))
        found = _mapped(texts, what, shingle, seed).join(keys_of(wanted.select("fp")), "fp", "left_semi")
        return stored(found.select("fp", "values").dropDuplicates(["fp"]))

    ends = lambda pairs: pairs.select(F.col("u").alias("fp")).union(pairs.select(F.col("v").alias("fp")))
    links = stored(_verified(tried, made_of(ends(tried), "members"), similarity))
    roots = stored(connected(links, keep=stored))
    labelled = placed.join(roots.select(F.col("node").alias("fp"), F.col("root").alias("label")), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    apart = by_bucket(labelled.select("bucket", "fp", "n", "values", "label"))
    apart = stored(apart.mapInArrow(_in_buckets(_open(similarity, most_bits), "label", filtering=True), apart.schema))
    if apart.take(1):
        sharp = made_of(apart.select("fp"), "sharp").withColumnRenamed("values", "sharp")
        pairs = by_bucket(apart.join(sharp, "fp")).mapInArrow(_in_buckets(_sharp_pairs(similarity, most_bits), "label", "sharp"), "u long, v long, gap long").select("u", "v").distinct()
        pairs = stored(pairs.join(tried, ["u", "v"], "left_anti"))
        more = stored(_verified(pairs, made_of(ends(pairs), "members"), similarity))
        if more.take(1):
            roots = stored(connected(links.union(more), keep=stored))
    return in_groups(own.select("key", "fp"), nodes, roots).withColumnRenamed("key", key)
