"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.config import CHUNKER_VERSION, ENVELOPE_PREFIXES, EXCLUDED_NAMES, NOTE_EXTENSION

WHITE_SPACE_CLASS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{WHITE_SPACE_CLASS}+|{WHITE_SPACE_CLASS}+$", "")


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def source_id(label: Column, rel_path: Column) -> Column:
    return F.concat(label, F.lit(":"), rel_path)


def chunk_id(source: Column, ix: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", source, ix.cast("string")), 256), 1, 16)


def content_hash(content: Column, version: int = CHUNKER_VERSION) -> Column:
    """Digest of the chunker version (four bytes, little end first) and the raw bytes."""
    prefix = F.lit(bytearray(version.to_bytes(4, "little")))
    return F.sha2(F.concat(prefix, content.cast("binary")), 256)


def file_stem(path: Column) -> Column:
    """File name without directory and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def is_indexable(path: Column) -> Column:
    return path.rlike(rf"[^/]\{NOTE_EXTENSION}$")


def is_excluded(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED_NAMES)))


def title_key(title: Column) -> Column:
    """The form in which titles compare: no letter case, directory, final ``.md`` or outer blanks;
    ``_`` is a blank and runs of blanks are one."""
    blank = F.regexp_replace(F.regexp_replace(F.lower(title), "_", " "), f"{WHITE_SPACE_CLASS}+", " ")
    base = F.trim(F.regexp_replace(blank, r"^.*/", ""))
    return F.trim(F.regexp_replace(base, r"\.md$", ""))


def tag_key(tag: Column) -> Column:
    """The form in which tags compare: no outer blanks, leading ``#`` or letter case."""
    return trimmed(F.regexp_replace(trimmed(F.lower(tag)), r"^#+", ""))


def instant(text: Column) -> Column:
    """RFC 3339 text, any offset, as a timestamp; null where it is none."""
    return text.try_cast("timestamp")


def is_envelope(prompt: Column) -> Column:
    """Whether a prompt is a tool's message rather than a person's."""
    start = F.regexp_replace(prompt, f"^{WHITE_SPACE_CLASS}+", "")
    test = F.lit(False)
    for prefix in ENVELOPE_PREFIXES:
        test = test | start.startswith(prefix)
    return test


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double; null if either side is null, NaN-free for equal lengths."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column, floor: float = 1e-12) -> Column:
    """The vector over its length, which counts as at least ``floor``."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(l2(a), F.lit(floor)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(l2(a) * l2(b), F.lit(1e-24))
