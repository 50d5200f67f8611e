"""Monthly files that arrive in any order, each ingested once; the last file of an entity and month wins.

What wins is kept state of a streaming aggregation, one row a key in RocksDB under the checkpoint: a trigger looks up and
writes the keys of its own rows only, however many came before, and the table is read from that state without ranking.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def kept(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, nulls first; rows that tie are told apart by their other columns, the larger wins."""
    rest = [c for c in stream.columns if c not in {*keys, *order}]
    return stream.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__last")).select(*keys, "__last.*")


def ingest(stream: DataFrame, table: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Merges what has arrived since the last call; gives the ended query, whose progress tells what each trigger did.

    The keys that a trigger met go, with the row that wins, to table/batch=n, a log of changes for whoever follows the
    table. A repeated batch overwrites its own folder and finds its rows in the state: each file counts once.
    """
    spark = stream.sparkSession

    def log(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        out = kept(stream, keys, order).writeStream.outputMode("update").foreachBatch(log)
        query = out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return query


def current(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The table as of the last trigger, a row a key, read from the state that ingest keeps. Raises where nothing was ingested yet."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.*", f"value.{state.schema['value'].dataType.names[0]}.*")


def compacted(spark: SparkSession, checkpoint: str, to: str) -> None:
    """The table as Parquet files, for readers without the checkpoint."""
    current(spark, checkpoint).write.mode("errorifexists").parquet(to)


def windowed(stream: DataFrame, at: str, length: str, delay: str, by: list[str], value: str) -> DataFrame:
    """Sums and counts by event-time window; rows later than delay are left out."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, length), *by).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def new_name(root: str) -> str:
    return f"{root}/{uuid.uuid4().hex}"
