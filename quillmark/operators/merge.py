"""Merges into stored tables as DataFrame algebra (J3, J4, S19-S21); the store writes the result as a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_scoped(current: DataFrame, new: DataFrame, scope: DataFrame, key: str = "id", by: str = "source_id") -> DataFrame:
    """Rows of new replace those with the same key and are added otherwise; rows of current within the scope
    (distinct ``by`` values) that are not in new go. An empty scope is a no-op, an empty new a pure delete."""
    ids = scope.select(by).distinct()
    arriving = new.join(ids, by, "left_semi")
    return current.join(ids, by, "left_anti").join(arriving.select(key), key, "left_anti").select(*current.columns).unionByName(arriving.select(*current.columns))


def upsert(current: DataFrame, new: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows of new replace those with the same key and are added otherwise; nothing is deleted."""
    return current.join(new.select(key).distinct(), key, "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def delete_keys(current: DataFrame, keys: DataFrame, key: str = "source_id") -> DataFrame:
    return current.join(keys.select(key).distinct(), key, "left_anti").select(*current.columns)


def latest_entries(manifest: DataFrame) -> DataFrame:
    """Of a manifest with history the latest row of each source by instant, then hash."""
    from quillmark.functions.columns import instant

    rest = [c for c in manifest.columns if c != "source_id"]
    newest = manifest.groupBy("source_id").agg(F.max(F.struct(instant(F.col("indexed_at")).alias("_ts"), "content_hash", *[c for c in rest if c != "content_hash"])).alias("m"))
    return newest.select("source_id", *(F.col(f"m.{c}").alias(c) for c in rest)).select(*manifest.columns)
