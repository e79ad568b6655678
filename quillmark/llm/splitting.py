"""Splitting oversized items at natural boundaries (problem 2) by lexical cohesion.

Around every natural boundary (blank line, line end, sentence end) the words of the sentences before and after
are compared. Where their similarity has a valley the topic changes; within each size window the deepest
valley is cut, and each piece starts with the end of the one before.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.columns import trimmed
from quillmark.functions.text import note_sections
from quillmark.plans import text_sql
from quillmark.session import table

MAX_CHARS = 2000
OVERLAP_CHARS = 200
#: Sentences on either side whose words are compared.
BLOCK_SENTENCES = 4

_BOUNDARY = re.compile(r"\n[^\S\n]*\n\s*|\n|[.!?…][\"'”’)\]]*(?=\s)[^\S\n]*|[。！？]")
_BLANK_LINE, _LINE_END, _SENTENCE = 3, 2, 1
_WORD = re.compile(r"[^\W_]+")


def boundaries(text: str) -> list[tuple[int, int]]:
    """(position, kind) of the natural boundaries inside a text; a cut falls before the position."""
    found: list[tuple[int, int]] = []
    for m in _BOUNDARY.finditer(text):
        at, what = m.end(), m.group()
        kind = _BLANK_LINE if what.count("\n") > 1 else _LINE_END if "\n" in what else _SENTENCE
        if at >= len(text):
            break
        if found and found[-1][0] == at:
            kind = max(kind, found.pop()[1])
        found.append((at, kind))
    return found


def cohesion(parts: list[str], block: int = BLOCK_SENTENCES) -> list[float]:
    """For each gap between parts the cosine of the word counts of the ``block`` parts before and after.

    The two bags slide: each part enters and leaves each bag once, so the work is linear in the text.
    """
    bags = [Counter(_WORD.findall(p.lower())) for p in parts]
    left: Counter = Counter()
    right: Counter = Counter()
    both = left_sq = right_sq = 0

    def shift(bag: Counter, other: Counter, words: Counter, sign: int) -> tuple[int, int]:
        shared = squared = 0
        for w, n in words.items():
            old = bag[w]
            new = old + sign * n
            squared += new * new - old * old
            shared += sign * n * other.get(w, 0)
            if new:
                bag[w] = new
            else:
                del bag[w]
        return shared, squared

    for b in bags[:block]:
        s, q = shift(right, left, b, 1)
        both, right_sq = both + s, right_sq + q
    out: list[float] = []
    for gap in range(1, len(bags)):
        s, q = shift(right, left, bags[gap - 1], -1)
        both, right_sq = both + s, right_sq + q
        if gap + block - 1 < len(bags):
            s, q = shift(right, left, bags[gap + block - 1], 1)
            both, right_sq = both + s, right_sq + q
        s, q = shift(left, right, bags[gap - 1], 1)
        both, left_sq = both + s, left_sq + q
        if gap - 1 - block >= 0:
            s, q = shift(left, right, bags[gap - 1 - block], -1)
            both, left_sq = both + s, left_sq + q
        out.append(both / math.sqrt(left_sq * right_sq) if left_sq and right_sq else 0.0)
    return out


def depths(similar: list[float]) -> list[float]:
    """How far each gap lies below the nearest peaks on both sides."""
    n = len(similar)
    before, after = similar[:], similar[:]
    for i in range(1, n):
        if similar[i - 1] >= similar[i]:
            before[i] = before[i - 1]
    for i in range(n - 2, -1, -1):
        if similar[i + 1] >= similar[i]:
            after[i] = after[i + 1]
    return [before[i] + after[i] - 2 * similar[i] for i in range(n)]


def split_points(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Positions at which to cut, so that every piece with its overlap has at most max_chars characters.

    Among the natural boundaries in the second half of a window the deepest valley is taken, of equal ones the
    stronger kind, then the later; failing those the last boundary in the first half, the last blank, or the
    limit itself.
    """
    n = len(text)
    if n <= max_chars:
        return []
    natural = boundaries(text)
    edges = [0, *(p for p, _ in natural), n]
    depth = depths(cohesion([text[a:b] for a, b in zip(edges, edges[1:], strict=False)]))
    cuts: list[int] = []
    start, i = 0, 0
    while n - start > (room := max_chars - min(start, overlap)):
        while i < len(natural) and natural[i][0] <= start:
            i += 1
        first = i
        while i < len(natural) and natural[i][0] <= start + room:
            i += 1
        inside = range(first, i)
        late = [j for j in inside if natural[j][0] > start + room // 2]
        if late:
            cut = natural[max(late, key=lambda j: (round(depth[j], 9), natural[j][1], j))][0]
        elif inside:
            cut = natural[inside[-1]][0]
        else:
            window = text[start : start + room]
            blank = max((m.end() for m in re.finditer(r"\s+", window)), default=0)
            cut = start + (blank if room // 2 < blank else room)
        cuts.append(cut)
        start = cut
        i = first
    return cuts


def split_text(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[str, int]]:
    """(piece, characters it repeats of the one before); without the repeats the pieces join to the text."""
    cuts = split_points(text, max_chars, overlap)
    edges = [0, *cuts, len(text)]
    return [(text[a - (back := min(a, overlap)) : b], back) for a, b in zip(edges, edges[1:], strict=False)]


def split_oversized(df: DataFrame, text_column: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """The items of more than max_chars characters (after trimming, a line end counting as one) in pieces:
    all other columns of df, with piece_ix int, piece string and repeated_chars int.

    Each piece has at most max_chars characters, overlap included. Null, empty and small items give no rows;
    repeated rows come out repeatedly; an item without any boundary is cut at blanks or at the limit; the work
    is linear in the text, so very long items need no special path. Columns of df named like the new ones are
    replaced.
    """
    if not 0 <= overlap < max_chars // 2:
        raise ValueError("overlap must be less than half of max_chars")
    new = ("piece_ix", "piece", "repeated_chars")
    rest = [c for c in df.columns if c != text_column and c not in new]
    body = trimmed(F.regexp_replace(F.col(f"`{text_column}`"), "\r\n", "\n"))
    items = df.select(*(F.col(f"`{c}`") for c in rest), body.alias("_body")).where(F.length("_body") > max_chars)
    schema = items.select(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("piece_ix"), F.lit("").alias("piece"), F.lit(0).alias("repeated_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, ix, pieces, repeats = [], [], [], []
            for row, text in enumerate(batch.column(len(rest)).to_pylist()):
                for k, (piece, back) in enumerate(split_text(text, max_chars, overlap)):
                    source.append(row)
                    ix.append(k)
                    pieces.append(piece)
                    repeats.append(back)
            at = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(at) for c in batch.columns[:-1]), pa.array(ix, pa.int32()), pa.array(pieces, pa.string()), pa.array(repeats, pa.int32())],
                names=[*rest, *new],
            )

    return items.mapInArrow(run, schema)


def sections_of(notes: DataFrame, text_column: str = "raw_text") -> DataFrame:
    """Sections of raw notes with a non-blank body: the other columns, heading_path, ix from 0, body."""
    rest = [c for c in notes.columns if c not in (text_column, "heading_path", "ix", "body")]
    picked = notes.select(*rest, text_column).where(F.col(text_column).isNotNull())
    schema = picked.select(*rest, F.lit("").alias("heading_path"), F.lit(0).alias("ix"), F.lit("").alias("body")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, path, ix, body) for row, text in enumerate(batch.column(len(rest)).to_pylist()) for ix, (path, body) in enumerate(note_sections(text))]
            rows, paths, ixs, bodies = zip(*found, strict=True) if found else ((), (), (), ())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(at) for c in batch.columns[:-1]), pa.array(paths, pa.string()), pa.array(ixs, pa.int32()), pa.array(bodies, pa.string())],
                names=[*rest, "heading_path", "ix", "body"],
            )

    return picked.mapInArrow(run, schema)


def chunk_body(text):
    """What follows the first blank line of a chunk's text (nothing, if there is none)."""
    one = F.regexp_replace(text, "\r\n", "\n")
    at = F.instr(one, "\n\n")
    return F.when(at > 0, F.substring(one, at + 2, F.length(one)))


def items_over_limit(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of chunks and of note sections, each distinct item once. Texts that cannot reach the limit are
    left out before anything is shuffled or handed to Python."""
    chunks = (
        table(spark, d, "chunks")
        .where(F.length("text") > MAX_CHARS)
        .select(F.lit("chunks").alias("item_table"), "source_id", F.coalesce("heading_path", F.lit("")).alias("heading_path"), F.col("chunk_ix").alias("ix"), chunk_body(F.col("text")).alias("body"))
    )
    notes = sections_of(table(spark, d, "notes").where(F.length("raw_text") > MAX_CHARS).select("source_id", "raw_text"))
    sections = notes.select(F.lit("notes").alias("item_table"), "source_id", "heading_path", "ix", "body")
    return chunks.unionByName(sections).where(F.length("body") > MAX_CHARS).distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(items_over_limit(spark, d), "body")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).where("piece_ix = 0").select("item_table", "source_id", "heading_path", "ix").distinct()


def p2_whole(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every item's pieces: joined without their repeats they are the item, whose digest is given;
    none is above the limit, and each starts with the end of the one before."""
    items = items_over_limit(spark, d).withColumn("version", F.md5(F.col("body").cast("binary")))
    key = ["item_table", "source_id", "heading_path", "ix", "version"]
    pieces = split_oversized(items, "body").select(*key, "piece_ix", "piece", "repeated_chars")
    before = F.lag("piece").over(Window.partitionBy(*key).orderBy("piece_ix"))
    repeated = F.left("piece", F.col("repeated_chars"))
    checked = pieces.withColumn("amiss", (F.col("piece_ix") > 0) & ((F.col("repeated_chars") < 1) | (F.right(before, F.col("repeated_chars")) != repeated)))
    rest = F.struct("piece_ix", F.substring(F.col("piece"), F.col("repeated_chars") + 1, F.length("piece")).alias("t"))
    joined = checked.groupBy(*key).agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(rest)), lambda x: x["t"]), "").cast("binary")).alias("digest"),
        F.count_if(F.length("piece") > MAX_CHARS).alias("too_long"),
        F.count_if("amiss").alias("bad_repeats"),
    )
    return joined.drop("version")


#: Bodies over the limit, by the checking SQL of the text segmentation.
_ITEMS = f"""{text_sql.with_sections()},
  cut_bodies_ as (select 'chunks' item_table, source_id, coalesce(heading_path, '') heading_path, chunk_ix ix, substr(t, instr(t, chr(10) || chr(10)) + 2) body
    from (select *, replace(text, chr(13) || chr(10), chr(10)) t from chunks) where instr(t, chr(10) || chr(10)) > 0
    union all select 'notes', source_id, heading_path, ix, body from sections_),
  items_ as (select distinct item_table, source_id, heading_path, ix, {text_sql.trim('body')} body from cut_bodies_ where length({text_sql.trim('body')}) > {MAX_CHARS})"""
QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_whole": p2_whole}
SQL = {
    "p2_found": f"{_ITEMS} select distinct item_table, source_id, heading_path, ix from items_",
    "p2_whole": f"{_ITEMS} select item_table, source_id, heading_path, ix, md5(body) digest, 0::bigint too_long, 0::bigint bad_repeats from items_",
}
