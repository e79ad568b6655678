"""Change detection and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.columns import is_excluded, is_indexable


def detect_changes(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """files (source_id, content_hash) with ``state``: new, changed or unchanged against the manifest's latest."""
    known = manifest.select("source_id", F.col("content_hash").alias("known_hash"))
    state = F.when(F.col("known_hash").isNull(), "new").when(F.lit(force) | ~F.col("known_hash").eqNullSafe(F.col("content_hash")), "changed").otherwise("unchanged")
    return files.join(known, "source_id", "left").select("source_id", "content_hash", state.alias("state"))


def orphans(manifest: DataFrame, on_disk: DataFrame, labels: DataFrame) -> DataFrame:
    """(source_id) of manifest rows of the given roots (label) whose file is gone."""
    label = F.substring_index("source_id", ":", 1)
    mine = manifest.select("source_id").distinct().join(F.broadcast(labels.select(F.col("label").alias("_l"))), label == F.col("_l"), "left_semi")
    return mine.join(on_disk.select("source_id"), "source_id", "left_anti")


def sweep_targets(on_disk: DataFrame, gone: DataFrame) -> DataFrame:
    """(source_id, present): files to look at and files to prune."""
    return on_disk.select("source_id").distinct().withColumn("present", F.lit(True)).unionByName(gone.select("source_id").withColumn("present", F.lit(False)))


def manifest_counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, n_chunks) for every file; a file without chunks has 0."""
    counts = chunks.groupBy("source_id").agg(F.count("*").alias("n"))
    return files.select("source_id").distinct().join(counts, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).cast("int").alias("n_chunks"))


def root_counts(roots: DataFrame, chunks: DataFrame) -> DataFrame:
    """(label, rows) for every configured root, from one grouped count."""
    counts = chunks.groupBy(F.col("source_type").alias("label")).agg(F.count("*").alias("n"))
    return F.broadcast(roots.select("label")).join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("rows"))


def route_to_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths (path) with label and rel_path of the first root, in configured order, whose directory holds it by
    whole components; null label where none does. Roots are configuration: a few rows, broadcast."""
    r = roots.select("label", "dir", "ord")
    inside = F.startswith(F.col("path"), F.concat("dir", F.lit("/")))
    found = paths.join(F.broadcast(r), inside, "left").groupBy("path").agg(F.min_by(F.struct("label", "dir"), "ord").alias("root"))
    rel = F.when(F.col("root").isNotNull(), F.expr("substring(path, length(root.dir) + 2)"))
    return found.select("path", F.col("root.label").alias("label"), rel.alias("rel_path"))


def watchable(paths: DataFrame) -> DataFrame:
    """Paths a watcher passes on: indexable and not excluded."""
    return paths.where(is_indexable(F.col("path")) & ~is_excluded(F.col("path")))


def debounce(events: DataFrame, seconds: int, key: str = "path", ts: str = "ts") -> DataFrame:
    """(key, first_ts, last_ts, events): bursts of one key; a pause of ``seconds`` or more starts a new burst."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))
    started = events.withColumn("_new", F.when(gap.isNull() | (gap >= seconds * 1_000_000), 1).otherwise(0))
    burst = started.withColumn("_burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return burst.groupBy(key, "_burst").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events")).drop("_burst")


def stats_rollup(stats: DataFrame) -> DataFrame:
    """Counters summed over roots; index lines prefixed with the root's label, in label order (A5)."""
    sums = [F.sum(c).alias(c) for c in ("scanned", "changed", "removed", "chunks_written")]
    lines = F.transform(F.col("indexes"), lambda x: F.concat(F.col("label"), F.lit(": "), x))
    return stats.withColumn("_lines", F.struct("label", lines.alias("l"))).agg(*sums, F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list("_lines")), lambda s: s["l"])), "; ").alias("indexes"))
