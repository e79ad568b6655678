"""Text segmentation over DataFrames (X1-X8, W3-W6): the pure functions run in Arrow batches, whole texts at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions.columns import trimmed

_STRINGS = pa.list_(pa.string())


def _expand(df: DataFrame, columns: list[str], text_columns: list[str], schema: str, kinds: list[pa.DataType], rows_of: Callable) -> DataFrame:
    """For each row the rows that rows_of(*texts) gives, beside the kept columns. Null texts give none."""
    picked = df.select(*columns, *(F.col(c).alias(f"_text{i}") for i, c in enumerate(text_columns)))
    names = [x.split()[0] for x in schema.split(", ")]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.select(*columns).schema.fields), schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            found: list[tuple] = []
            for i, texts in enumerate(zip(*(batch.column(len(columns) + k).to_pylist() for k in range(len(text_columns))), strict=True)):
                if any(t is None for t in texts):
                    continue
                for row in rows_of(*texts):
                    at.append(i)
                    found.append(row)
            cells = list(zip(*found, strict=True)) if found else [()] * len(kinds)
            index = pa.array(at, pa.int64())
            kept = [batch.column(k).take(index) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(list(c), k) for c, k in zip(cells, kinds, strict=True))], names=[*columns, *names])

    return picked.mapInArrow(run, out)


def frontmatter_fields(notes: DataFrame, text_column: str) -> DataFrame:
    """The other columns with note_type, captured and tags of each note's frontmatter; absent fields are empty."""
    rest = [c for c in notes.columns if c != text_column]

    def fields(text: str):
        f, _ = T.parse_frontmatter(T.lines_of(text))
        yield f.note_type, f.captured, f.tags

    return _expand(notes, rest, [text_column], "note_type string, captured string, tags array<string>", [pa.string(), pa.string(), _STRINGS], fields)


def section_rows(notes: DataFrame, text_column: str) -> DataFrame:
    """The other columns with heading_path, body and ix of each section with a non-blank body."""
    rest = [c for c in notes.columns if c != text_column]
    return _expand(
        notes, rest, [text_column], "ix int, heading_path string, body string", [pa.int32(), pa.string(), pa.string()],
        lambda t: ((i, path, body) for i, (path, body) in enumerate(T.note_sections(t))),
    )


def paragraph_units(bodies: DataFrame, text_column: str) -> DataFrame:
    """The other columns with unit_ix and unit of each paragraph, or of each part of a long one."""
    rest = [c for c in bodies.columns if c != text_column]
    return _expand(bodies, rest, [text_column], "unit_ix int, unit string", [pa.int32(), pa.string()], lambda t: enumerate(T.units(t)))


def chunk_notes(notes: DataFrame, title_column: str = "title", text_column: str = "raw_text") -> DataFrame:
    """The other columns with text, heading_path, chunk_ix, entities, note_type, captured and tags of each chunk."""
    rest = [c for c in notes.columns if c not in (text_column, title_column)]

    def chunks(title: str, source: str):
        front, found = T.parse_note(title, source)
        for c in found:
            yield c.text, c.heading_path, c.ix, c.entities, front.note_type, front.captured, front.tags

    schema = "text string, heading_path string, chunk_ix int, entities array<string>, note_type string, captured string, tags array<string>"
    return _expand(notes, rest, [title_column, text_column], schema, [pa.string(), pa.string(), pa.int32(), _STRINGS, pa.string(), pa.string(), _STRINGS], chunks)


def query_units(queries: DataFrame, text_column: str, caps: tuple[int, ...]) -> DataFrame:
    """The other columns with cap, unit_ix and unit for each cap; blank queries have no units."""
    rest = [c for c in queries.columns if c != text_column]
    return _expand(
        queries, rest, [text_column], "cap int, unit_ix int, unit string", [pa.int32(), pa.int32(), pa.string()],
        lambda q: ((cap, i, u) for cap in caps for i, u in enumerate(T.split_query(q, cap))),
    )


def wikilink_targets(text: Column) -> Column:
    """Sorted distinct link targets, as an expression."""
    inner = F.regexp_extract_all(text, F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1))
    targets = F.transform(inner, lambda x: trimmed(F.regexp_replace(x, r"(?s)[|#].*$", "")))
    return F.array_sort(F.array_distinct(F.filter(targets, lambda x: x != "")))
