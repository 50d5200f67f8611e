"""Document fingerprints by winnowing, in Spark expressions only.

A text's words are its runs of up to 12 code points without white space. A word's code is its CRC-32; the rolling hash of k
consecutive words is the polynomial of their codes, taken at every position. Of every window of `window` consecutive hashes the smallest is selected, the rightmost one where several are
smallest. The selected hashes with their positions are the fingerprint: two texts that share `window + k - 1` consecutive
words share a selected hash, and the positions say where. Hash and position travel in one long, the position complemented,
so that the minimum of a window is its rightmost smallest hash. All steps work on whole arrays of a text; nothing is exploded.

A text of fewer than k words, but not none, is one k-gram; one of fewer than `window` k-grams is one window. Null texts count as
empty; a text without words has an empty fingerprint. The likeness of two fingerprints is the Jaccard similarity of their
hashes, 1 where both are empty. A text may be as long as a Spark string; positions have 31 bits. Repeated rows are each
fingerprinted. An empty table gives no rows. Input columns named like a result are replaced, others passed through.

`followed` pairs each row with the next one in descending order of the key: null keys come last, rows of one key in the order
of their texts, and the first row follows the last. Texts are shuffled once, into ranges of keys whose first keys are
actual keys, so that the first rows of a range can be sent to the range before as well. Of the ranges, the driver holds
one key for each `range_bytes` of text. Keys are meant to be nearly unique: the rows of one key share a range.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW = 4, 4
WORD = r"[^\x20\x09-\x0D]{1,12}"
#: A prime modulus below 2^31, so that products of two remainders fit a long, and the polynomial's base.
MODULUS, BASE = (1 << 31) - 1, 1_000_003
_PLACE = (1 << 31) - 1


def winnowed(rows: DataFrame, text: str, to: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """rows with `to`: the selected (hash, complemented position) longs of the non-null column `text`, in order of position."""
    codes, grams = f"__{to}_codes", f"__{to}_grams"
    add = lambda x, y: (x * F.lit(BASE) + y) % F.lit(MODULUS)
    packed = lambda x, i: F.shiftleft(x, 31).bitwiseOR(F.lit(_PLACE) - i)
    after = lambda of, i, size: [F.get(of, i + j) for j in range(1, size)]
    # A column would be looked up anew for each element; as the variable of an outer function it is not.
    bound = lambda values, f: F.get(F.transform(F.array(values), lambda of: F.transform(of, lambda x, i: f(of, x, i))), F.lit(0))
    up_to = lambda values, size: F.slice(values, 1, F.greatest(size, F.lit(0)))
    n, g = F.size(codes), F.size(grams)
    out = rows.withColumn(codes, F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.crc32(w) % F.lit(MODULUS)))
    hashed = bound(codes, lambda of, x, i: packed(functools.reduce(add, after(of, i, k), x), i))
    whole = F.array(packed(F.aggregate(codes, F.lit(0).cast("long"), add), F.lit(0)))
    out = out.withColumn(grams, F.when(n >= k, up_to(hashed, n - (k - 1))).when(n > 0, whole).otherwise(F.array().cast("array<long>")))
    least = bound(grams, lambda of, x, i: F.least(x, *after(of, i, window))) if window > 1 else F.col(grams)
    single = F.when(g > 0, F.array(F.array_min(grams))).otherwise(F.col(grams))
    return out.withColumn(to, F.when(g < window, single).otherwise(F.array_distinct(up_to(least, g - (window - 1))))).drop(codes, grams)


def hashes(selected: Column | str) -> Column:
    """The distinct hashes of a fingerprint."""
    of = F.col(selected) if isinstance(selected, str) else selected
    return F.array_distinct(F.transform(of, lambda x: F.shiftright(x, 31)))


def positions(selected: Column | str) -> Column:
    of = F.col(selected) if isinstance(selected, str) else selected
    return F.transform(of, lambda x: (F.lit(_PLACE) - x.bitwiseAND(F.lit(_PLACE))).cast("int"))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of two fingerprints' distinct hashes."""
    size = lambda x: F.size(x) if isinstance(x, Column) else F.size(F.col(x))
    common = F.size(F.array_intersect(a, b))
    return F.when(size(a) + size(b) == 0, F.lit(1.0)).otherwise(F.get(F.transform(F.array(common), lambda c: c / (size(a) + size(b) - c)), F.lit(0)))


def as_text(selected: Column | str) -> Column:
    """position:hash of each selected k-gram, by position (the number of its first word)."""
    of = F.col(selected) if isinstance(selected, str) else selected
    one = lambda x: F.concat((F.lit(_PLACE) - x.bitwiseAND(F.lit(_PLACE))).cast("string"), F.lit(":"), F.lower(F.hex(F.shiftright(x, 31))))
    return F.array_join(F.transform(of, one), " ")


def fingerprinted(docs: DataFrame, text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """docs with n_chars and fingerprint, an array of (position, hash) in order of position."""
    kept = [c for c in docs.columns if c not in ("n_chars", "fingerprint")]
    out = winnowed(docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__body")), "__body", "__selected", k, window)
    pairs = F.arrays_zip(positions("__selected").alias("position"), F.transform("__selected", lambda x: F.shiftright(x, 31)).alias("hash"))
    return out.select(*kept, F.length("__body").cast("long").alias("n_chars"), pairs.cast("array<struct<position:int,hash:bigint>>").alias("fingerprint"))


def _ranges(rows: DataFrame, range_bytes: int) -> list:
    """The first keys, in descending order, of ranges of about equal numbers of rows; every one is a key of some row."""
    spark = rows.sparkSession
    n, total, top = rows.agg(F.count("__key"), F.sum(F.octet_length("__body")), F.max("__key")).first()
    if not n:
        return []
    least = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(n // 20, max(least, math.ceil((total or 0) / range_bytes))))
    if parts == 1:
        return [top]
    shares = [j / parts for j in range(1, parts)]
    found = rows.agg(F.percentile_approx("__key", F.lit(shares), F.lit(20 * parts))).first()[0]
    return sorted({top, *found}, reverse=True)


def followed(docs: DataFrame, key: str, text: str, k: int, window: int, range_bytes: int) -> DataFrame:
    """(__key, __body, __own, __next): each row's text and fingerprint, and those of the row that follows it."""
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__body"))
    firsts = _ranges(rows, range_bytes)
    if firsts:
        # A key's range is found among every `wide`-th first key, then among those between.
        wide = max(1, math.isqrt(len(firsts)))
        top, every = F.lit(firsts[::wide]), F.lit(firsts)
        block = F.size(F.filter(top, lambda b: b >= F.col("__key"))) - 1
        place = block * wide + F.size(F.filter(F.slice(every, block * wide + 1, wide), lambda b: b >= F.col("__key"))) - 1
        last = len(firsts) - 1
        placed = rows.withColumn("__range", F.when(F.col("__key").isNull(), F.lit(last)).otherwise(place))
        is_first = F.get(every, F.col("__range")) == F.col("__key")
        before = F.struct(F.when(F.col("__range") == 0, F.lit(last)).otherwise(F.col("__range") - 1).alias("range"), F.lit(True).alias("guest"))
        own = F.struct(F.col("__range").alias("range"), F.lit(False).alias("guest"))
        placed = placed.select("__key", "__body", F.explode(F.when(is_first, F.array(own, before)).otherwise(F.array(own))).alias("__at"))
        placed = placed.select("__key", "__body", F.col("__at.range").alias("__range"), F.col("__at.guest").alias("__guest"))
    else:
        placed = rows.select("*", F.lit(0).alias("__range"), F.lit(False).alias("__guest"))
    dealt = winnowed(placed.repartition("__range"), "__body", "__own", k, window)
    order = Window.partitionBy("__range").orderBy("__guest", F.desc_nulls_last("__key"), "__body")
    both = F.struct("__body", "__own")
    following = F.lead(both).over(order)
    if not firsts:  # no row has a key: one range, whose first row follows its last
        following = F.coalesce(following, F.first(both).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return dealt.withColumn("__next", following).where(~F.col("__guest")).select("__key", "__body", "__own", "__next")


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW, range_bytes: int = 32_000_000) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last third replaced by the beginning of the next document, in descending order of the key.
    """
    pairs = followed(docs, key, text, k, window, range_bytes)
    n = F.length("__body")
    third = F.floor(n / 3).cast("int")
    changed = F.concat(F.substring(F.col("__body"), F.lit(1), n - third), F.substring(F.col("__next.__body"), F.lit(1), third))
    out = pairs.select("__key", n.cast("long").alias("n_chars"), changed.alias("__edited"), "__own", F.col("__next.__own").alias("__after"))
    out = winnowed(out, "__edited", "__new", k, window)
    out = out.withColumns({"__a": hashes("__own"), "__b": hashes("__new"), "__c": hashes("__after")})
    return out.select(
        F.col("__key").alias(key), "n_chars", F.sha2("__edited", 256).alias("edited_sha256"), as_text("__own").alias("fingerprint"), as_text("__new").alias("edited_fingerprint"),
        likeness("__a", "__b").alias("near_edited"), likeness("__a", "__c").alias("near_next"),
    )
