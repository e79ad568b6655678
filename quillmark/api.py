"""The engine: index trees of notes, search them, recall what bears on a prompt, tell what is there."""

from __future__ import annotations

import os
import re
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import schemas
from quillmark.config import (
    ANN_THRESHOLD_ROWS, COSINE_GATE, DEFAULT_K, ENVELOPE_PREFIXES, MAX_K, RECALL_DEPTH_FACTOR, RECALL_HITS, RECALL_MAX_UNITS, SEARCH_MAX_UNITS, Root, root_of_path,
)
from quillmark.functions.columns import cosine
from quillmark.functions.text import WHITE_SPACE, is_blank
from quillmark.operators import ann, changes, fusion, lexical, render, vector
from quillmark.operators.embedders import Embedder, HashEmbedder, with_vectors
from quillmark.plans.indexing import IndexStats, apply_changes, stored_cells
from quillmark.plans.search import apply_filter, hybrid_ranks, unit_rows
from quillmark.session import cut
from quillmark.sources import markdown
from quillmark.sources.injection_log import append_log, read_log
from quillmark.sources.store import SegmentStore

HIT = ["score", "cosine", "title", "rel_path", "heading_path", "captured", "source_type", "text"]
HITS = "unit_ix int, rank int, score double, cosine double, title string, rel_path string, heading_path string, captured string, source_type string, text string"


@dataclass
class Recall:
    """pointers (place and the pointer's columns) and the best cosine before the gate, null without hits."""

    pointers: DataFrame
    top_cosine: float | None


def clamp_k(k: object) -> int:
    """A requested k, 3 where there is none or it is no whole number, within 1 to 10."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        k = DEFAULT_K
    return max(1, min(MAX_K, k))


class Engine:
    """One warehouse over configured roots."""

    def __init__(self, spark: SparkSession, roots: list[Root], warehouse: str, embedder: Embedder | None = None, log_directory: str | None = None, ann_threshold: int = ANN_THRESHOLD_ROWS):
        self.ann_threshold = ann_threshold
        self.spark, self.roots, self.embedder = spark, roots, embedder or HashEmbedder()
        self.store = SegmentStore(spark, warehouse)
        self.log_directory = log_directory
        self._writing = threading.Lock()  # sweeps, watched changes and purges of one process take turns
        markdown.register(spark)

    # ---- indexing

    def _spec(self, roots: list[Root]) -> str:
        return ":".join(f"{r.label}={r.dir}" for r in roots)

    def index(self, full: bool = False) -> IndexStats:
        """Sweeps every root in one commit: new and changed files in, vanished ones out. ``full`` indexes all files
        anew."""
        return self._sweep(self.roots, full)

    def index_root(self, root: Root, full: bool = False) -> IndexStats:
        return self._sweep([root], full)

    def _sweep(self, roots: list[Root], full: bool) -> IndexStats:
        if not roots:
            return IndexStats()
        files = self.spark.read.format("quillmark_notes").option("roots", self._spec(roots)).load()
        labels = self.spark.createDataFrame([(r.label,) for r in roots], "label string")
        on_disk = files.select(F.concat("label", F.lit(":"), "rel_path").alias("source_id"))
        with self._writing:
            gone = changes.orphans(self.store.read("manifest"), on_disk, labels)
            return self._apply(files, gone, full, tuple(r.label for r in roots))

    def _apply(self, files: DataFrame, gone: DataFrame, full: bool = False, labels: tuple[str, ...] = ()) -> IndexStats:
        return apply_changes(self.store, files, gone, self.embedder, _now(), full, labels, self.ann_threshold)

    def index_paths(self, paths: list[str], full: bool = False) -> IndexStats:
        """Indexes exactly these paths, each under the first root that holds it; those that are gone are dropped,
        those that are no notes ignored."""
        return self.index_frame(self.spark.createDataFrame([(p,) for p in paths], "path string"), full)

    def index_frame(self, paths: DataFrame, full: bool = False) -> IndexStats:
        """The same for any number of rows (path). Paths are matched with roots and files read by tasks; all is one
        commit."""
        roots = self.roots
        with self._writing:
            read = paths.select("path").distinct().mapInArrow(lambda batches: _read_files(roots, batches), schemas.FILES)
            read = cut(read.dropDuplicates(["label", "rel_path"]))  # two ways to one file are one source
            gone = read.where("content is null").select(F.concat("label", F.lit(":"), "rel_path").alias("source_id"))
            return self._apply(read.where("content is not null"), gone, full)

    def purge_root(self, label: str) -> IndexStats:
        """Drops all rows of a root, configured or not; a sweep never does that for roots taken from the configuration."""
        with self._writing:
            gone = self.store.read("manifest").where(F.col("source_type") == label).select("source_id")
            return self._apply(self.spark.createDataFrame([], schemas.FILES), gone)

    # ---- search

    def _unit_hits(self, query: str, max_units: int, limit: int, predicate: str | None) -> DataFrame | None:
        """Hits of every unit of a query, each unit's at most ``limit`` by rank fusion."""
        units = unit_rows(self.spark, query, max_units)
        if units is None:
            return None
        at = self.store.state()  # all tables as of one commit
        kept = apply_filter(self.store.read("chunks", at), predicate)
        asked = with_vectors(units, "query", self.embedder, "query_vector", query=True)
        near = self._near(kept, asked, limit, predicate is not None, at)
        # only the query's terms are read: postings are stored in term order, so the scan skips the rest
        asked_terms = sorted({w for r in units.collect() for w in words_of(r.query)})
        postings = self.store.read("postings", at).where(F.col("term").isin(asked_terms))
        facts = self.store.facts(at)
        corpus = self.spark.createDataFrame([(facts.get("docs", 0), facts.get("words", 0) / max(facts.get("docs", 0), 1))], "docs bigint, avg_len double")
        index = lexical.LexicalIndex(postings.drop("source_id"), postings.groupBy("term").agg(F.count("*").alias("df")), corpus)
        words = lexical.bm25_scores(index, units, kept if predicate else None)
        ranked = hybrid_ranks(near, words, limit)
        # few rows are left: their chunks come by join, their cosine exactly
        full = kept.join(F.broadcast(ranked.select("unit", "id", "rank", "score")), "id").join(F.broadcast(asked.select("unit", "query_vector")), "unit")
        measured = F.coalesce(cosine(F.col("vector"), F.col("query_vector")), F.lit(0.0))
        return full.select(
            F.col("unit").alias("unit_ix"), "rank", "score", measured.alias("cosine"), "id",
            *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "rel_path", "heading_path", "captured", "source_type", "text")),
        )

    def _near(self, kept: DataFrame, asked: DataFrame, limit: int, filtered: bool, at: dict) -> DataFrame:
        """The vector leg: through the cells where there are any, else over all rows. A filter decides which
        rows count before any are ranked; with one, all that is left is compared exactly."""
        if filtered or not self.store.exists("cells", at):
            return vector.nearest(kept, asked, limit)
        return ann.probed(self.store.read("cells", at), stored_cells(self.store, at), asked, limit)

    def search(self, query: str, k: int = DEFAULT_K, predicate: str | None = None) -> DataFrame:
        """The k best hits, by cosine, however many are asked for; only the tool of ``serving`` limits k. A long
        query is searched piece by piece; a blank one, or a k of 0, finds nothing."""
        hits = self._unit_hits(query, SEARCH_MAX_UNITS, k, predicate) if k > 0 else None
        if hits is None:
            return self.spark.createDataFrame([], HITS)
        best = fusion.best_k(hits.withColumn("_q", F.lit(0)), k, ["source_type", "rel_path", "text"], ["_q"], ["unit_ix", "rank", "id"])
        return best.orderBy("place").select("unit_ix", "rank", *HIT)

    def recall(self, prompt: str) -> Recall:
        """At most three pointers to notes that bear on a prompt, taken in turns from the collections."""
        hits = self._unit_hits(prompt, RECALL_MAX_UNITS, RECALL_HITS * RECALL_DEPTH_FACTOR, None)
        if hits is None:
            return Recall(self.spark.createDataFrame([], f"place int, {schemas.POINTER}"), None)
        hits = self.spark.createDataFrame(hits.collect(), hits.schema)  # RECALL_MAX_UNITS times a dozen rows at most
        top = hits.agg(F.max("cosine")).first()[0]
        dirs = self.spark.createDataFrame([(r.label, r.dir) for r in self.roots], "source_type string, _dir string")
        placed = hits.join(F.broadcast(dirs), "source_type", "left").withColumn("path", F.coalesce(F.concat("_dir", F.lit("/"), "rel_path"), F.col("rel_path")))
        files = fusion.consolidate(placed.withColumn("_q", F.lit(0)), ["_q"], ["unit_ix", "rank", "id"], COSINE_GATE)
        picked = fusion.round_robin(files, RECALL_HITS, ["_q"])
        return Recall(picked.orderBy("place").select("place", "title", "source_type", "path", "rel_path", "heading_path", "captured", "cosine"), top)

    def hook(self, prompt: str, deadline_ms: int | None = None) -> str:
        """The text block for a prompt, empty where there is nothing to say; every call is logged with its outcome:
        skipped (a tool's message), unavailable (failed or too late), miss or injected. Never raises."""
        began = time.monotonic()
        outcome, rows, top, block = "miss", [], None, ""
        if prompt.lstrip(WHITE_SPACE).startswith(ENVELOPE_PREFIXES):
            outcome = "skipped"
        else:
            try:
                found = self.recall(prompt)
                rows, top = [r.asDict() for r in found.pointers.collect()], found.top_cosine
                if deadline_ms is not None and (time.monotonic() - began) * 1000 > deadline_ms:
                    outcome, rows = "unavailable", []
                elif rows:
                    outcome = "injected"
                    block = self.render(self.spark.createDataFrame([tuple(r.values()) for r in rows], f"place int, {schemas.POINTER}"))
            except Exception:  # noqa: BLE001  a prompt must go on whatever happens here
                outcome, rows = "unavailable", []
        if self.log_directory:
            pointers = [{k: v for k, v in r.items() if k != "place"} for r in rows]
            entry = [(_now(), prompt, outcome, int((time.monotonic() - began) * 1000), top, pointers)]
            append_log(self.spark.createDataFrame(entry, schemas.INJECTIONS).coalesce(1), self.log_directory)
        return block

    def render(self, pointers: DataFrame) -> str:
        """Pointers as one block of text, grouped by what they are."""
        found = render.pointer_block(pointers.withColumn("_q", F.lit(0)), ["_q"], "place").first()
        return found["block"] if found else ""

    def markdown(self, hits: DataFrame) -> str:
        """Hits as markdown sections."""
        lines = [r[0] for r in hits.select(render.hit_markdown()).collect()]
        return "\n\n---\n\n".join(lines) if lines else render.NO_HITS

    def mentions(self, entity: str) -> DataFrame:
        """(id, source_id) of the chunks that link to an entity, from the stored index."""
        return self.store.read("entities").where(F.col("entity") == entity).select("id", "source_id")

    def log(self) -> DataFrame:
        return read_log(self.spark, self.log_directory)

    # ---- state

    def status(self) -> DataFrame:
        """(label, rows, error) of every configured root."""
        return self.spark.createDataFrame(self.store.rows_by_root([r.label for r in self.roots]), "label string, rows bigint, error string")

    def access_path(self) -> str:
        """How vectors are searched: all of them up to a number of rows, beyond it by cells."""
        return "cells" if self.store.exists("cells") else "flat scan"


def rel_path(root: Root, path: str) -> str:
    """A path relative to its root; one that lies there only once links are resolved is resolved; else itself."""
    for candidate in (path, os.path.realpath(path)):
        if candidate.startswith(root.dir + "/"):
            return candidate[len(root.dir) + 1 :]
    return path


def _read_files(roots: list[Root], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, rel_path, path, content) of the paths that are notes of a root; no content where there is no file."""
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            root = root_of_path(roots, path) if path and markdown.is_indexable(path) and not markdown.is_excluded(path) else None
            if root is None:
                continue
            try:
                with open(path, "rb") as f:
                    content = f.read()
            except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
                content = None
            rows.append((root.label, rel_path(root, path), path, content))
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)], names=["label", "rel_path", "path", "content"])


def words_of(text: str) -> list[str]:
    """What ``lexical.tokens`` gives for a text."""
    return re.findall(r"[^\W_]+", text.lower())


def _now() -> str:
    return datetime.now(UTC).astimezone().isoformat()
