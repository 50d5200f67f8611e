"""What the training-data operators share: tables, shared storage, byte-level words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the white space between words.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. One is made only in local mode, where none need be set."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def stored(df: DataFrame) -> DataFrame:
    """df, written once as a table in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def set_aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns of these names under private ones, and what gives a result the columns of docs back."""
    taken = {n.lower() for n in names}
    private = {c: f"__own_{c}" for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed(private), lambda out: out.select(*[F.col(private.get(c, c)).alias(c) for c in docs.columns])


#: From this share of the rows on, a key's rows are joined by a broadcast: there are no more such keys than its inverse.
HOT_SHARE = 1 / 2000


#: Up to so many rows of one key each a stored table is broadcast, so that texts need not be shuffled to meet it.
MOST_BROADCAST = 1_000_000


def keys_of(stored_keys: DataFrame) -> DataFrame:
    """Keys to join texts with: broadcast if they were counted to be few, else shuffled."""
    return F.broadcast(stored_keys) if stored_keys.count() <= MOST_BROADCAST else stored_keys


def joined(rows: DataFrame, named: DataFrame, key: str, copies: str, how: str = "inner") -> DataFrame:
    """rows joined with the stored table `named`, one row for each key, whose column `copies` counts the rows of the key.

    Keys of very many rows are joined by a broadcast of at most 1 / HOT_SHARE of them, so no key meets in one task.
    """
    total = named.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
    hot = named.where(F.col(copies) > max(10_000, int(total * HOT_SHARE)))
    if not hot.take(1):
        return rows.join(named.drop(copies), key, how)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rest.join(named.drop(copies), key, how).unionByName(rows.join(F.broadcast(hot.drop(copies)), key))


def text_bytes(batch, column: str) -> list[bytes]:
    """The texts of an Arrow batch as UTF-8; null is empty."""
    import pyarrow as pa

    texts = batch.column(column)
    return [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator, column: str, most: int = 4_000_000) -> Iterator:
    """Arrow batches cut so that each holds about `most` bytes of `column`, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


#: Bytes of words stay (A-Z lower-cased), all others turn into spaces.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()
