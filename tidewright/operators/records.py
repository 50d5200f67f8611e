"""Keyed record tables: upsert, lookup, discovery of new keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_each(changes: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """changes with one row for each key: that with the largest order; without an order, the largest of each column."""
    rest = [c for c in changes.columns if c not in keys]
    pick = (lambda c: F.max_by(c, order)) if order else F.max
    return changes.groupBy(*keys).agg(*(pick(c).alias(c) for c in rest)) if rest else changes.distinct()


def upserted(records: DataFrame | None, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Records with the non-null fields of changes; new keys and columns are added. Of changes that share a key, `one_each` counts."""
    changes = one_each(changes, [key], order)
    if records is None:
        return changes
    new = [c for c in changes.columns if c != key]
    old = [c for c in records.columns if c != key]
    joined = records.join(changes.select(key, *(F.col(c).alias(f"__new_{c}") for c in new)), key, "full")
    value = lambda c: F.coalesce(f"__new_{c}", c) if c in new and c in old else F.col(f"__new_{c}") if c in new else F.col(c)
    return joined.select(key, *(value(c).alias(c) for c in [*old, *(c for c in new if c not in old)]))


def looked_up(records: DataFrame, key: str, value, columns: Sequence[str]):
    """The first record's columns as a row, None if the key is absent."""
    return records.where(F.col(key) == value).select(*columns).first()


def discovered(found: DataFrame, records: DataFrame, key: str, existing: bool = False) -> DataFrame:
    """Keys that the records have not, or have."""
    return found.select(key).distinct().join(records.select(key), key, "left_semi" if existing else "left_anti")


def overwritten(base: DataFrame, other: DataFrame, key: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """base with the non-null values of other where keys match; of others that share a key, `one_each` counts."""
    keys = [key] if isinstance(key, str) else list(key)
    other = one_each(other.select(*keys, *columns), keys)
    joined = base.join(other.select(*keys, *(F.col(c).alias(f"__o_{c}") for c in columns)), keys, "left")
    return joined.select(*(F.coalesce(f"__o_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def covered_by_all(*tables: DataFrame, keys: Sequence[str], corrected: str | None = None) -> DataFrame:
    """Rows whose keys all tables have; with `corrected`, those only in which no table's flag of that name is false or null."""
    flagged = [t.where(F.col(corrected)).drop(corrected) if corrected and corrected in t.columns else t for t in tables]
    out = flagged[0]
    for t in flagged[1:]:
        out = out.join(t, list(keys))
    return out
