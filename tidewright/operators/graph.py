"""Connected components by alternating large-star and small-star rounds over links of longs, or of structs that sort."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def settled(df: DataFrame) -> DataFrame:
    """df computed once into the session's shared checkpoint folder. One is made only in local mode, where none need be set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def connected(links: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 60, keep: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    A round is two grouped minima joined back to the links, so no node's links meet in one row, list or task beyond what
    a skewed join can split. keep cuts the lineage after each. Self links and null ends are ignored; an empty input
    gives an empty result. Nodes may be structs, whose null fields equal each other. Raises if a fixpoint is not reached in `most_rounds` rounds (a path of n nodes takes about log2(n)).
    """
    links = links.select(F.col(u).alias("u"), F.col(v).alias("v"))
    if not isinstance(links.schema["u"].dataType, T.StructType):
        links = links.select(F.col("u").cast("long"), F.col("v").cast("long"))
    links = links.where("u != v")
    links = keep(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(links)
    for _ in range(most_rounds):
        links = keep(_small_star(_large_star(links)))
        before, state = state, _state(links)
        if before == state:
            break
    else:
        raise RuntimeError(f"no fixpoint after {most_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
