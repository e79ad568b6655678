"""Ingest, change detection, merges and maintenance on the engine's tables, each with its SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.config import Root
from quillmark.functions.columns import chunk_id, content_hash, file_stem, is_excluded, is_indexable
from quillmark.operators import changes, merge
from quillmark.operators.segment import chunk_notes, frontmatter_fields, query_units, section_rows
from quillmark.plans import text_sql
from quillmark.session import checkpoint_folder, table

S = SparkSession


def _files(spark: S, d: str) -> DataFrame:
    """The notes waiting for a sweep, each source's latest version, with the digest of its bytes."""
    notes = table(spark, d, "notes")
    latest = notes.groupBy("source_id").agg(F.max(F.struct("seen_at", "raw_text", "source_type", "rel_path", "title")).alias("n"))
    return latest.select("n.source_type", "source_id", "n.rel_path", "n.title", "n.raw_text", content_hash(F.col("n.raw_text")).alias("content_hash"))


def q_content_hash(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))


def q_source_chunk_ids(spark: S, d: str) -> DataFrame:
    n = table(spark, d, "notes").select("source_type", "rel_path").distinct()
    sid = F.concat("source_type", F.lit(":"), "rel_path")
    return n.select(sid.alias("source_id"), file_stem(F.col("rel_path")).alias("title"), chunk_id(sid, F.lit(0)).alias("chunk_id"))


def _paths(spark: S, d: str) -> DataFrame:
    rel = table(spark, d, "notes").select("rel_path").distinct()
    variants = F.array(
        F.concat(F.lit("/srv/kb/"), "rel_path"), F.concat(F.lit("/srv/kb/.git/"), "rel_path"), F.concat(F.lit("/srv/kb/.obsidian-copy/"), "rel_path"),
        F.regexp_replace("rel_path", r"\.md$", ".MD"), F.regexp_replace("rel_path", r"[^/]*\.md$", ".md"), F.concat("rel_path", F.lit(".txt")),
    )
    return rel.select(F.explode(variants).alias("path")).distinct()


def q_indexable_paths(spark: S, d: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, d).select("path", is_indexable(p).alias("indexable"), is_excluded(p).alias("excluded"))


def _known(spark: S, d: str) -> DataFrame:
    return merge.latest_entries(table(spark, d, "manifest"))


def q_change_detection(spark: S, d: str) -> DataFrame:
    return changes.detect_changes(_files(spark, d), _known(spark, d))


def _present(spark: S, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("source_id").distinct()


def q_orphan_prune(spark: S, d: str) -> DataFrame:
    return changes.orphans(table(spark, d, "manifest"), _present(spark, d), table(spark, d, "roots"))


def q_sweep_targets(spark: S, d: str) -> DataFrame:
    files = table(spark, d, "notes").select("source_id")
    return changes.sweep_targets(files, changes.orphans(table(spark, d, "manifest"), files, table(spark, d, "roots")))


def _slim(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "source_id", F.md5(F.col("text").cast("binary")).alias("digest")).distinct()


def q_merge_chunks_scoped(spark: S, d: str) -> DataFrame:
    new = _files(spark, d).select(chunk_id(F.col("source_id"), F.lit(0)).alias("id"), "source_id", F.md5(F.col("raw_text").cast("binary")).alias("digest"))
    return merge.merge_scoped(_slim(table(spark, d, "chunks")), new, new)


def _removed(spark: S, d: str) -> DataFrame:
    return table(spark, d, "changes").where("change_kind = 'removed'").select("source_id")


def q_merge_delete_only(spark: S, d: str) -> DataFrame:
    chunks = _slim(table(spark, d, "chunks"))
    return merge.merge_scoped(chunks, chunks.limit(0), _removed(spark, d))


def q_merge_manifest(spark: S, d: str) -> DataFrame:
    new = _files(spark, d).select("source_id", "source_type", "content_hash", F.lit(1).alias("n_chunks"), F.lit("2026-07-01T00:00:00+00:00").alias("indexed_at"))
    return merge.upsert(_known(spark, d), new)


def q_manifest_delete(spark: S, d: str) -> DataFrame:
    return merge.delete_keys(_known(spark, d), _removed(spark, d)).select("source_id", "content_hash")


def q_manifest_counts(spark: S, d: str) -> DataFrame:
    return changes.manifest_counts(table(spark, d, "manifest"), table(spark, d, "chunks").select("id", "source_id").distinct())


def q_root_row_counts(spark: S, d: str) -> DataFrame:
    extra = spark.createDataFrame([("empty", "/srv/kb/empty", 9)], "label string, dir string, ord int")
    return changes.root_counts(table(spark, d, "roots").unionByName(extra), table(spark, d, "chunks"))


def q_user_filter(spark: S, d: str) -> DataFrame:
    from quillmark.plans.search import apply_filter

    hits = apply_filter(table(spark, d, "chunks"), "rel_path LIKE 'projects/%' AND note_type = 'meeting' AND NOT array_has(tags, 'log')")
    return hits.select("id", "rel_path", "note_type").distinct()


def q_label_membership(spark: S, d: str) -> DataFrame:
    return table(spark, d, "chunks").where(F.array_contains("entities", "Glossary") | F.array_contains("tags", "infra")).select("id", "source_id").distinct()


#: A note around each document, written with the same expression in both engines.
_WRAPPED = """concat('---',chr(10),'type: ',coalesce(lang,'none'),chr(10),'captured: 2024-01-',lpad(cast(doc_id%28+1 as {s}),2,'0'),chr(10),
  'tags: [',coalesce(lang,'none'),', ',coalesce(source,'none'),']',chr(10),'---',chr(10),chr(10),'# Doc ',cast(doc_id as {s}),chr(10),chr(10),coalesce(text,''),chr(10),chr(10),
  '## Links',chr(10),chr(10),'See [[',coalesce(source,'none'),'|s]] and [[lang-',coalesce(lang,'none'),'#x]].',chr(10))"""


def q_frontmatter_fields(spark: S, d: str) -> DataFrame:
    notes = table(spark, d, "documents").select("doc_id", F.expr(_WRAPPED.format(s="string")).alias("raw"))
    return frontmatter_fields(notes, "raw").select("doc_id", "note_type", "captured", F.array_join("tags", ",").alias("tags"))


def q_note_frontmatter(spark: S, d: str) -> DataFrame:
    return frontmatter_fields(table(spark, d, "notes").select("source_id", "raw_text").distinct(), "raw_text").select("source_id", "note_type", "captured", F.array_join("tags", ",").alias("tags"))


def q_wikilinks(spark: S, d: str) -> DataFrame:
    """Sorted distinct link targets of every note (A9, X2), without leaving the JVM."""
    from quillmark.operators.segment import wikilink_targets

    notes = table(spark, d, "notes").select("source_id", "raw_text").distinct()
    return notes.select("source_id", F.md5(F.col("raw_text").cast("binary")).alias("version"), F.array_join(wikilink_targets(F.col("raw_text")), ",").alias("targets"))


def q_fence_parity(spark: S, d: str) -> DataFrame:
    """Lines of notes by whether they stand inside a fence (W5): a running count of fence lines, modulo 2."""
    notes = table(spark, d, "notes").select("source_id", "raw_text").distinct()
    lines = notes.select("source_id", F.md5(F.col("raw_text").cast("binary")).alias("version"), F.posexplode(F.split("raw_text", "\n")).alias("line_no", "line"))
    fence = F.col("line").rlike(r"^\s*(```|~~~)").cast("int")
    running = F.sum(fence).over(Window.partitionBy("source_id", "version").orderBy("line_no"))
    inside = lines.withColumn("inside", (running - fence) % 2).withColumn("fence", fence)
    return inside.groupBy("source_id", "version").agg(F.sum("fence").alias("fence_lines"), F.sum((F.col("inside") == 1).cast("int")).alias("inside_lines"), F.count("*").alias("all_lines"))


def q_heading_sections(spark: S, d: str) -> DataFrame:
    notes = table(spark, d, "notes").select("source_id", "raw_text").distinct()
    return section_rows(notes, "raw_text").select("source_id", "ix", "heading_path", F.length("body").alias("chars"), F.md5(F.col("body").cast("binary")).alias("digest"))


def q_split_body_chunks(spark: S, d: str) -> DataFrame:
    notes = table(spark, d, "notes").select("source_id", "title", "raw_text").distinct()
    return chunk_notes(notes).select(chunk_id(F.col("source_id"), F.col("chunk_ix")).alias("id"), "source_id", "chunk_ix", "heading_path", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def q_paragraph_units(spark: S, d: str) -> DataFrame:
    """Paragraphs of every section, long ones packed line by line."""
    from quillmark.operators.segment import paragraph_units

    notes = table(spark, d, "notes").select("source_id", "raw_text").distinct()
    return paragraph_units(section_rows(notes, "raw_text").select("source_id", "ix", "body"), "body").select("source_id", "ix", "unit_ix", F.length("unit").alias("chars"), F.md5(F.col("unit").cast("binary")).alias("digest"))


def _tree(spark: S, d: str) -> list[Root]:
    """The notes as files below the session's shared folder, one tree a collection, written by tasks; beside them
    what no scan may report."""
    base = f"{checkpoint_folder(spark).removeprefix('file:')}/tree-{uuid.uuid4().hex[:12]}"
    others = [".git/kept.md", ".obsidian/app.md", "plain.txt", "UPPER.MD", ".trash/old.md"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for label, rel, text in zip(labels, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for name, content in [(rel, text or "")] + [(o, "none of the notes") for o in others]:
                    path = f"{base}/{label}/{name}"
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(path, "w", encoding="utf-8", newline="") as f:
                        f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string())], names=["label"])

    written = _files(spark, d).select("source_type", "rel_path", "raw_text").mapInArrow(write, "label string")
    return [Root(r.label, f"{base}/{r.label}") for r in written.distinct().orderBy("label").collect()]


def q_md_scan(spark: S, d: str) -> DataFrame:
    """A scan of a tree of notes (S1): every note's bytes, and nothing else that lies there."""
    from quillmark.sources import markdown

    markdown.register(spark)
    roots = ":".join(f"{r.label}={r.dir}" for r in _tree(spark, d))
    return spark.read.format("quillmark_notes").option("roots", roots).load().select("label", "rel_path", F.md5("content").alias("digest"))


def q_watch_stream_ingest(spark: S, d: str) -> DataFrame:
    """The chunks a watching engine has stored once all files of a tree were reported to it."""
    from quillmark.api import Engine
    from quillmark.streaming.watch import watch

    roots = _tree(spark, d)
    folder = f"{os.path.dirname(roots[0].dir)}-state" if roots else checkpoint_folder(spark)
    engine = Engine(spark, roots, f"{folder}/warehouse")
    if roots:
        watch(engine, f"{folder}/watch", once=True, replay=True).awaitTermination()
    return engine.store.read("chunks").select("id", "source_id", "chunk_ix", "heading_path", F.md5(F.col("text").cast("binary")).alias("digest"))


def q_hard_split(spark: S, d: str) -> DataFrame:
    """Slices of 2000 characters of every document."""
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    at = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 2000).cast("int"))
    cut = docs.select("doc_id", "text", F.explode(at).alias("slice"))
    return cut.select("doc_id", "slice", F.md5(F.substring(F.col("text"), F.col("slice") * 2000 + 1, F.lit(2000)).cast("binary")).alias("digest"))


def q_split_query_cap(spark: S, d: str) -> DataFrame:
    """Units of every prompt under the hook's and the search's cap."""
    prompts = table(spark, d, "injections").select("log_id", "prompt").dropDuplicates(["log_id"])
    return query_units(prompts, "prompt", (5, 8)).select("log_id", "cap", "unit_ix", F.length("unit").alias("chars"), F.md5(F.col("unit").cast("binary")).alias("digest"))


def q_path_to_root(spark: S, d: str) -> DataFrame:
    roots = table(spark, d, "roots")
    rel = table(spark, d, "notes").select("rel_path").distinct()
    nested = spark.createDataFrame([("all", "/srv/kb", 7)], "label string, dir string, ord int")
    dirs = roots.select("dir").unionByName(spark.createDataFrame([("/srv/kb/other",), ("/srv/elsewhere",), ("/srv/kb/notesX",)], "dir string"))
    paths = rel.crossJoin(F.broadcast(dirs)).select(F.concat("dir", F.lit("/"), "rel_path").alias("path"))
    return changes.route_to_roots(paths, roots.unionByName(nested))


def q_root_batches(spark: S, d: str) -> DataFrame:
    """Watched paths of a batch by root (A7, M3): how many each root gets."""
    return q_path_to_root(spark, d).groupBy("label").agg(F.count("*").alias("paths"), F.countDistinct("rel_path").alias("distinct_paths"))


def q_debounce_batches(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "changes").select(F.col("source_id").alias("path"), F.col("happened_at").alias("ts")).where("path is not null and ts is not null")
    return changes.debounce(e, 24 * 3600).select("path", F.unix_seconds("first_ts").alias("first_s"), F.unix_seconds("last_ts").alias("last_s"), "events")


def q_index_stats_rollup(spark: S, d: str) -> DataFrame:
    m = table(spark, d, "manifest").groupBy(F.col("source_type").alias("label")).agg(
        F.count("*").alias("scanned"), F.countDistinct("source_id").alias("changed"), F.sum((F.col("n_chunks") == 0).cast("int")).alias("removed"), F.sum("n_chunks").alias("chunks_written")
    )
    stats = m.withColumn("indexes", F.array(F.concat(F.lit("rows "), F.col("chunks_written").cast("string")), F.lit("text")))
    return changes.stats_rollup(stats)


def q_full_vs_incremental(spark: S, d: str) -> DataFrame:
    """A forced sweep and an incremental one leave the same chunks (M5, M8): counts of ids only one of them has."""
    files = _files(spark, d)
    current = _slim(table(spark, d, "chunks"))
    todo = changes.detect_changes(files, _known(spark, d)).where("state <> 'unchanged'").select("source_id")
    chunked = chunk_notes(files.select("source_id", "title", "raw_text")).select(chunk_id(F.col("source_id"), F.col("chunk_ix")).alias("id"), "source_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    full = merge.merge_scoped(current, chunked, files.select("source_id"))
    part = merge.merge_scoped(current, chunked.join(todo, "source_id", "left_semi"), todo)
    both = full.select("id", "digest", F.lit(1).alias("f"), F.lit(0).alias("p")).unionByName(part.select("id", "digest", F.lit(0).alias("f"), F.lit(1).alias("p")))
    return both.groupBy("id", "digest").agg(F.sum("f").alias("f"), F.sum("p").alias("p")).agg(
        F.count_if((F.col("f") > 0) & (F.col("p") > 0)).alias("in_both"), F.count_if(F.col("p") == 0).alias("only_full"), F.count_if(F.col("f") == 0).alias("only_incremental")
    )


_HASH = "sha256('\\x01\\x00\\x00\\x00'::blob || encode({}))"
_LATEST = "select source_id, unnest(max({'seen_at': seen_at, 'raw_text': raw_text, 'source_type': source_type, 'rel_path': rel_path, 'title': title})) from notes group by 1"
_FILES = f"(select source_type, source_id, rel_path, title, raw_text, {_HASH.format('raw_text')} content_hash from ({_LATEST}))"
_KNOWN = """(select source_id, m.h content_hash, m.t source_type, m.n n_chunks, m.i indexed_at from
  (select source_id, max({'ts': indexed_at::timestamptz, 'h': content_hash, 't': source_type, 'n': n_chunks, 'i': indexed_at}) m from manifest group by 1))"""
_LABEL = "split_part(source_id, ':', 1)"
_SLIM = "(select distinct id, source_id, md5(text) digest from chunks)"
_REMOVED = "(select source_id from changes where change_kind = 'removed' and source_id is not null)"
_PATH_SQL = """(select distinct p as path from (select unnest(['/srv/kb/' || rel_path, '/srv/kb/.git/' || rel_path, '/srv/kb/.obsidian-copy/' || rel_path,
  regexp_replace(rel_path, '\\.md$', '.MD'), regexp_replace(rel_path, '[^/]*\\.md$', '.md'), rel_path || '.txt']) p from notes))"""
_ROUTED = """(with r as (select label, dir, ord from roots union all select 'all', '/srv/kb', 7),
  p as (select distinct dir || '/' || rel_path path from notes, (select dir from roots union all select unnest(['/srv/kb/other', '/srv/elsewhere', '/srv/kb/notesX'])) x(dir)),
  b as (select path, min_by(label, ord) label, min_by(dir, ord) dir from p left join r on starts_with(path, dir || '/') group by 1)
  select path, label, case when dir is not null then substr(path, length(dir) + 2) end rel_path from b)"""

_CHUNKED = text_sql.chunks_of("notes_ as (select distinct source_id, md5(raw_text) version, title, raw_text from notes where raw_text is not null)")
_CHUNKED_FILES = text_sql.chunks_of(f"notes_ as (select source_id, md5(raw_text) version, title, raw_text from ({_LATEST}) where raw_text is not null)")
_CHUNKED_STEMS = text_sql.chunks_of(f"""notes_ as (select source_type || ':' || rel_path source_id, md5(raw_text) version, raw_text,
  regexp_replace(split_part(rel_path, '/', -1), '(.)\\.[^.]*$', '\\1') title from ({_LATEST}) where raw_text is not null)""")

QUERIES = {
    name: globals()[f"q_{name}"]
    for name in (
        "content_hash source_chunk_ids indexable_paths change_detection orphan_prune sweep_targets merge_chunks_scoped merge_delete_only merge_manifest "
        "manifest_delete manifest_counts root_row_counts user_filter label_membership frontmatter_fields note_frontmatter wikilinks fence_parity "
        "md_scan watch_stream_ingest heading_sections paragraph_units split_body_chunks hard_split split_query_cap path_to_root root_batches debounce_batches index_stats_rollup full_vs_incremental"
    ).split()
}
SQL = {
    "content_hash": f"select doc_id, {_HASH.format('text')} content_hash from documents",
    "source_chunk_ids": """select distinct source_type || ':' || rel_path source_id, regexp_replace(split_part(rel_path, '/', -1), '(.)\\.[^.]*$', '\\1') title,
      substr(sha256(source_type || ':' || rel_path || ':0'), 1, 16) chunk_id from notes""",
    "indexable_paths": f"""select path, regexp_matches(path, '[^/]\\.md$') indexable,
      len(list_intersect(string_split(path, '/'), ['.obsidian', '.git', '.trash', '.DS_Store'])) > 0 excluded from {_PATH_SQL}""",
    "change_detection": f"""select f.source_id, f.content_hash, case when k.content_hash is null then 'new' when k.content_hash <> f.content_hash then 'changed' else 'unchanged' end state
      from {_FILES} f left join {_KNOWN} k using (source_id)""",
    "orphan_prune": f"select distinct source_id from manifest where {_LABEL} in (select label from roots) and source_id not in (select source_id from chunks)",
    "sweep_targets": f"""select distinct source_id, true present from notes union all
      select distinct source_id, false from manifest where {_LABEL} in (select label from roots) and source_id not in (select source_id from notes)""",
    "merge_chunks_scoped": f"""select * from {_SLIM} where source_id not in (select source_id from notes)
      and id not in (select substr(sha256(source_id || ':0'), 1, 16) from notes)
      union all select substr(sha256(source_id || ':0'), 1, 16), source_id, md5(raw_text) from {_FILES}""",
    "merge_delete_only": f"select * from {_SLIM} where source_id not in {_REMOVED}",
    "merge_manifest": f"""select source_id, source_type, content_hash, n_chunks, indexed_at from {_KNOWN} where source_id not in (select source_id from notes)
      union all select source_id, source_type, content_hash, 1, '2026-07-01T00:00:00+00:00' from {_FILES}""",
    "manifest_delete": f"select source_id, content_hash from {_KNOWN} where source_id not in {_REMOVED}",
    "manifest_counts": "select source_id, count(distinct c.id)::int n_chunks from (select distinct source_id from manifest) left join chunks c using (source_id) group by 1",
    "root_row_counts": "select label, count(c.id)::bigint as rows from (select label from roots union all select 'empty') r left join chunks c on c.source_type = r.label group by 1",
    "user_filter": "select distinct id, rel_path, note_type from chunks where rel_path like 'projects/%' and note_type = 'meeting' and not list_contains(tags, 'log')",
    "label_membership": "select distinct id, source_id from chunks where list_contains(entities, 'Glossary') or list_contains(tags, 'infra')",
    "frontmatter_fields": f"""with n as (select doc_id, {_WRAPPED.format(s='varchar')} raw from documents)
      select doc_id, regexp_extract(raw, 'type: ([^\\n]*)', 1) note_type, regexp_extract(raw, 'captured: ([^\\n]*)', 1) captured,
      array_to_string(list_filter(string_split(regexp_extract(raw, 'tags: \\[([^\\n]*)\\]', 1), ', '), lambda x: x <> ''), ',') tags from n""",
    "wikilinks": """select distinct source_id, md5(raw_text) version, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(
      regexp_extract_all(raw_text, '(?s)\\[\\[(.*?)\\]\\]', 1), lambda x: trim(regexp_replace(x, '(?s)[|#].*$', ''), chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> ''))), ','), '') targets from notes""",
    "fence_parity": """with n as (select distinct source_id, raw_text from notes),
      l as (select source_id, md5(raw_text) version, unnest(string_split(raw_text, chr(10))) line, generate_subscripts(string_split(raw_text, chr(10)), 1) i from n),
      f as (select *, regexp_matches(line, '^\\s*(```|~~~)')::int fence from l),
      w as (select *, (sum(fence) over (partition by source_id, version order by i) - fence) % 2 inside from f)
      select source_id, version, sum(fence)::bigint fence_lines, sum((inside = 1)::int)::bigint inside_lines, count(*)::bigint all_lines from w group by 1, 2""",
    "hard_split": "select doc_id, s::int slice, md5(substr(text, s::int * 2000 + 1, 2000)) digest from documents, unnest(range(0, (length(text) + 1999) // 2000)) t(s) where length(text) > 0",
    "path_to_root": f"select * from {_ROUTED}",
    "root_batches": f"select label, count(*)::bigint paths, count(distinct rel_path)::bigint distinct_paths from {_ROUTED} group by 1",
    "debounce_batches": """with e as (select source_id path, happened_at ts from changes where source_id is not null and happened_at is not null),
      g as (select *, case when ts - lag(ts) over w < interval 24 hours then 0 else 1 end n from e window w as (partition by path order by ts)),
      b as (select *, sum(n) over (partition by path order by ts rows unbounded preceding) k from g)
      select path, floor(epoch(min(ts)))::bigint first_s, floor(epoch(max(ts)))::bigint last_s, count(*)::bigint events from b group by path, k""",
    "index_stats_rollup": """with m as (select source_type label, count(*) s, count(distinct source_id) c, sum((n_chunks = 0)::int) r, sum(n_chunks) w from manifest group by 1)
      select sum(s)::bigint scanned, sum(c)::bigint changed, sum(r)::bigint removed, sum(w)::bigint chunks_written,
      string_agg(label || ': rows ' || w::bigint || '; ' || label || ': text', '; ' order by label) indexes from m""",
    "md_scan": f"select source_type as label, rel_path, md5(coalesce(raw_text, '')) digest from {_FILES}",
    "watch_stream_ingest": f"""{_CHUNKED_STEMS} select substr(sha256(source_id || ':' || chunk_ix), 1, 16) id, source_id, chunk_ix, heading_path, md5(text) digest from chunked_""",
    "note_frontmatter": text_sql.FRONTMATTER,
    "heading_sections": f"{text_sql.with_sections()} select source_id, ix, heading_path, length(body)::int chars, md5(body) digest from sections_",
    "paragraph_units": f"""{text_sql.with_sections()}, cut_ as (select (source_id, version, ix) k, body from sections_), {text_sql.pieces('cut_')}
      select s.source_id, s.ix, (j - 1)::int unit_ix, length(unit)::int chars, md5(unit) digest from units_ u join sections_ s on u.k = (s.source_id, s.version, s.ix)""",
    "split_body_chunks": f"""{_CHUNKED} select substr(sha256(source_id || ':' || chunk_ix), 1, 16) id, source_id, chunk_ix, heading_path, length(text)::int chars, md5(text) digest from chunked_""",
    "split_query_cap": f"""with recursive asked as (select distinct on (log_id) log_id k, prompt body from injections where prompt is not null), {text_sql.pieces('asked')},
      capped as (select k, cap, no, piece, max(no) over (partition by k) + 1 n from pieces_, unnest([5, 8]) t(cap))
      select k log_id, cap::int cap, (row_number() over (partition by k, cap order by no) - 1)::int unit_ix, length(piece)::int chars, md5(piece) digest from capped
      where n <= cap or no < cap - 1 or no = n - 1""",
    "full_vs_incremental": f"""{_CHUNKED_FILES}, files as {_FILES}, known as {_KNOWN},
      made as (select substr(sha256(source_id || ':' || chunk_ix), 1, 16) id, source_id, md5(text) digest from chunked_),
      todo as (select source_id from files left join known k using (source_id) where k.content_hash is distinct from files.content_hash),
      now as {_SLIM},
      whole as (select id, digest from now where source_id not in (select source_id from files) union select id, digest from made),
      part as (select id, digest from now where source_id not in (select source_id from todo) union select id, digest from made where source_id in (select source_id from todo))
      select (select count(*) from (from whole intersect from part))::bigint in_both, (select count(*) from (from whole except from part))::bigint only_full, (select count(*) from (from part except from whole))::bigint only_incremental""",
}
