"""Indexing plans (3.3): scan, detect changes, chunk, embed, merge, record (M4, M5, M8)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.config import ANN_THRESHOLD_ROWS
from quillmark.functions.columns import chunk_id, content_hash, file_stem, source_id
from quillmark.operators import ann, changes, lexical
from quillmark.operators.embedders import Embedder, with_vectors
from quillmark.operators.segment import _expand
from quillmark.session import cut
from quillmark.sources.store import TABLES, SegmentStore


@dataclass
class IndexStats:
    """What one run did; added over roots."""

    scanned: int = 0
    changed: int = 0
    removed: int = 0
    chunks_written: int = 0
    indexes: list[str] = field(default_factory=list)

    def __add__(self, other: IndexStats) -> IndexStats:
        return IndexStats(
            self.scanned + other.scanned, self.changed + other.changed, self.removed + other.removed,
            self.chunks_written + other.chunks_written, self.indexes + other.indexes,
        )


def hashed_files(files: DataFrame) -> DataFrame:
    """files (label, rel_path, content) with source_id and content_hash."""
    return files.withColumn("source_id", source_id(F.col("label"), F.col("rel_path"))).withColumn("content_hash", content_hash(F.col("content")))


def chunk_files(files: DataFrame, embedder: Embedder) -> DataFrame:
    """Rows of the chunks table from files (label, rel_path, source_id, content, content_hash). Bytes that are
    not UTF-8 become replacement characters (S4)."""
    import pyarrow as pa

    from quillmark.functions.text import parse_note

    def rows_of(title: str, content: bytes):
        front, found = parse_note(title, content.decode("utf-8", "replace"))
        for c in found:
            yield c.text, c.heading_path, c.ix, c.entities, front.note_type, front.captured, front.tags

    named = files.withColumn("title", file_stem(F.col("rel_path")))
    strings = pa.list_(pa.string())
    chunks = _expand(
        named.withColumn("title_key", F.col("title")), ["label", "rel_path", "source_id", "content_hash", "title"], ["title_key", "content"],
        "text string, heading_path string, chunk_ix int, entities array<string>, note_type string, captured string, tags array<string>",
        [pa.string(), pa.string(), pa.int32(), strings, pa.string(), pa.string(), strings], rows_of,
    )
    chunks = chunks.withColumn("id", chunk_id(F.col("source_id"), F.col("chunk_ix"))).withColumnRenamed("label", "source_type")
    sized = with_vectors(chunks, "text", embedder)
    checked = F.when(F.size("vector") == embedder.dim, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("vector of unexpected length in chunk "), F.col("id"))))
    return sized.withColumn("vector", checked).withColumn("len", F.size(lexical.tokens(F.col("text")))).select(
        "id", "text", "vector", "source_type", "source_id", "title", "heading_path", "rel_path", "note_type", "captured", "tags", "entities", "content_hash", "chunk_ix", "len"
    )


#: Sources whose rows are looked up by a list in the scan's filter; more are found by a join.
LISTED_SOURCES = 1000


def _of_sources(rows: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    """Rows of some sources. Stored rows are in source order, so that a short list skips nearly all files."""
    if count <= LISTED_SOURCES:
        return rows.where(F.col("source_id").isin([r.source_id for r in sources.collect()]))
    return rows.join(sources.hint("merge"), "source_id", "left_semi")


def apply_changes(store: SegmentStore, files: DataFrame, gone: DataFrame, embedder: Embedder, at: str, force: bool = False, labels: tuple[str, ...] = (), ann_threshold: int = ANN_THRESHOLD_ROWS) -> IndexStats:
    """Indexes the files (label, rel_path, content) whose content is new and drops those gone (source_id): one
    commit of all tables together. What is written follows from what changed; only where the rows have doubled
    since the cells were fitted, or a merge of segments is due, is more written."""
    hashed = hashed_files(files)
    manifest = store.read("manifest")
    state = changes.detect_changes(hashed.select("source_id", "content_hash"), manifest, force)
    todo = cut(hashed.join(state.where("state <> 'unchanged'").select("source_id", "state"), "source_id"))
    gone = cut(gone.select("source_id").distinct())
    stats = IndexStats(scanned=state.count(), changed=todo.count(), removed=gone.count())
    if not (stats.changed or stats.removed):
        return stats
    new = cut(chunk_files(todo, embedder))
    stats.chunks_written = new.count()
    # only what was there before has rows that are dead now
    dead = cut(todo.where("state = 'changed'").select("source_id").unionByName(gone.join(manifest.select("source_id"), "source_id", "left_semi")))
    n_dead = dead.count()
    counted = lambda rows: rows.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    old_docs, old_words = counted(_of_sources(store.read("chunks").select("source_id", "len"), dead, n_dead)) if n_dead else (0, 0)
    new_docs, new_words = counted(new)
    facts = store.facts()
    docs, words = facts.get("docs", 0) + new_docs - old_docs, facts.get("words", 0) + new_words - old_words
    counts = changes.manifest_counts(todo, new)
    entries = todo.join(counts, "source_id").select("source_id", F.col("label").alias("source_type"), "content_hash", "n_chunks", F.lit(at).alias("indexed_at"))
    entities = new.select("source_id", "id", F.explode("entities").alias("entity"))
    replace, added, drop, fitted, how = vector_index(store, new, dead, docs, ann_threshold)
    if stats.chunks_written:
        added |= {"chunks": new, "postings": lexical.postings_of(new, ["source_id"]), "entities": entities}
    store.commit(dead if n_dead else None, {"docs": docs, "words": words, "fitted_rows": fitted}, drop, replace, manifest=entries, **added)
    lines = ["postings", "partitions by source_type", how]
    stats.indexes = [f"{label}: {line}" for label in labels for line in lines] if labels else lines
    return stats


def vector_index(store: SegmentStore, new: DataFrame, dead: DataFrame, docs: int, threshold: int) -> tuple[dict, dict, tuple[str, ...], int, str]:
    """(tables to replace, rows to add, tables to drop, rows the cells were fitted on, what was made): vectors by cell
    from ``threshold`` rows on. New rows go to the cells there are; cells are fitted anew where rows have doubled."""
    fitted = store.facts().get("fitted_rows", 0)
    if docs < threshold:
        return {}, {}, ("cells", "centroids", "spans"), 0, "flat scan"
    columns = ["source_id", "id", "vector"]
    if store.exists("centroids") and docs < 2 * max(fitted, 1):
        cells = stored_cells(store)
        celled = ann.with_cells(new.select(*columns), cells).where("cell is not null").select(*columns, "cell").repartition("cell")
        return {}, {"cells": celled, "spans": _span_rows(store, ann.spans(new, cells.centroids, "vector"))}, (), fitted, f"{len(cells.centroids)} cells"
    left = store.read("chunks").select(*columns).join(dead.hint("merge"), "source_id", "left_anti")
    rows = left.unionByName(new.select(*columns))
    cells = ann.fit_cells(rows)
    if cells is None:
        return {}, {}, ("cells", "centroids", "spans"), 0, "flat scan"
    centroids = store.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cells.centroids)], TABLES["centroids"])
    celled = ann.with_cells(rows, cells).where("cell is not null").select(*columns, "cell").repartition("cell")
    return {"cells": celled, "centroids": centroids, "spans": _span_rows(store, cells.span)}, {}, (), docs, f"{len(cells.centroids)} cells"


def _span_rows(store: SegmentStore, span) -> DataFrame:
    """The spans of the cells that have rows."""
    return store.spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(span) if a == a], TABLES["spans"])


def stored_cells(store: SegmentStore, at: dict | None = None) -> ann.Cells:
    """Centroids and spans; the spans of several commits add up, those of rows now dead only widen them."""
    import numpy as np

    centroids = np.stack(store.read("centroids", at).orderBy("cell").toPandas()["centroid"].to_numpy())
    span = np.full((len(centroids), 2), np.nan)
    for r in store.read("spans", at).groupBy("cell").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect():
        span[r.cell] = r.least, r.most
    return ann.Cells(centroids, span)
