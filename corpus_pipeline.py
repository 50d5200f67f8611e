"""A training corpus in five stages, each written as Parquet and reread by the next.

Every stage takes the columns of documents and any others, of whatever names, and all but the last give them back as they
were. Null and empty texts have no words, so the quality rules reject them; a stage that is given them by itself keeps them as one
near-duplicate group and packs them as an end id alone. Very long texts are one row throughout. Repeated rows are judged,
counted and packed each, and near-dedup leaves one of them; a group's row is that with the smallest doc_id, and of
rows with one id and one text any. A null source is a source of its own; rows without an id are told apart by their texts. An
empty table gives no rows.

ORACLE_SQL is None: fingerprints and subword tokens are beyond SQL; tests/llm compares the stages with brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, line_dedup, near_copies, packing, quality_rules, simhash
from tidewright.llm.common import set_aside, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.passing(docs)


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that their source repeats on more than one in a hundred of its different texts, five at least.

    A document that would lose more than half of its lines stays whole: it is a copy, which the next stage sees to.
    """
    own, restored = set_aside(docs, ("n_lines", "n_dropped"))
    return restored(line_dedup.deduplicated(own, min_pages=5, count_texts=True, most_dropped=0.5))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a Jaccard similarity of 0.8 or more over five words, that with the smallest doc_id; candidates by SimHash."""
    return simhash.one_of_each(docs, near_copies.near_duplicates(docs), near_copies.set_hash)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; one that has no other word goes."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and place."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality), ("line_dedup", site_lines), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
