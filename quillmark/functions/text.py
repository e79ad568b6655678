"""Text segmentation on plain strings. Used inside Arrow stages and, directly, by tests.

Lengths count code points. White space is Unicode White_Space, which is not quite what ``str.strip()`` removes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quillmark.config import MAX_CHARS, OVERLAP_CHARS, TARGET_CHARS

# The code points with the property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_HEADING = re.compile(r"(#{1,6}) (.*)", re.DOTALL)
_LINK = re.compile(r"\[\[(.*?)\]\]", re.DOTALL)
_LINK_END = re.compile(r"[|#]")


def trim(s: str) -> str:
    return s.strip(WHITE_SPACE)


def is_blank(s: str) -> bool:
    return not trim(s)


def lines_of(text: str) -> list[str]:
    """Lines end at a line feed; one carriage return before it belongs to the end; no empty last line."""
    parts = text.split("\n")
    last = parts.pop()
    out = [p.removesuffix("\r") for p in parts]
    return out + [last] if last else out


@dataclass
class Frontmatter:
    note_type: str = ""
    captured: str = ""
    tags: list[str] = field(default_factory=list)


def parse_frontmatter(lines: list[str]) -> tuple[Frontmatter, int]:
    """The header's fields and the index of the first body line; without a closing fence all is body."""
    fences = (i for i, line in enumerate(lines) if line.rstrip(WHITE_SPACE) == "---")
    if next(fences, None) != 0 or (close := next(fences, None)) is None:
        return Frontmatter(), 0
    found, key = Frontmatter(), ""
    for raw in lines[1:close]:
        line = raw.strip(WHITE_SPACE)
        if raw.rstrip(WHITE_SPACE).lstrip(WHITE_SPACE).startswith("- "):
            if key == "tags":
                found.tags.append(trim(line[2:]).strip('"'))
            continue
        name, colon, value = line.partition(":")
        if not colon:
            continue
        key, value = trim(name), trim(value).strip('"').strip("'")
        if key == "type":
            found.note_type = value
        elif key == "captured":
            found.captured = value
        elif key == "tags" and value.startswith("[") and value.endswith("]") and len(value) > 1:
            found.tags = [x for x in (trim(v).strip('"') for v in value[1:-1].split(",")) if x]
    return found, close + 1


def wikilinks(text: str) -> list[str]:
    """Sorted distinct link targets: what stands in ``[[...]]`` before the first pipe or hash."""
    return sorted({x for inner in _LINK.findall(text) if (x := trim(_LINK_END.split(inner, maxsplit=1)[0]))})


def tail(s: str, n: int) -> str:
    return s[-n:] if n else ""


def slices(s: str, size: int = MAX_CHARS) -> list[str]:
    return [s[i : i + size] for i in range(0, len(s), size)]


def units(body: str) -> list[str]:
    """Paragraphs; one above the limit is packed line by line towards the target size."""
    out: list[str] = []
    for paragraph in body.split("\n\n"):
        if len(paragraph) <= MAX_CHARS:
            out.append(paragraph)
            continue
        packed = ""
        for line in lines_of(paragraph):
            if len(line) > MAX_CHARS:
                out += ([] if is_blank(packed) else [packed]) + slices(line)
                packed = ""
                continue
            if len(packed) + len(line) + 1 > TARGET_CHARS:
                out.append(packed)  # also when nothing is held
                packed = ""
            packed = f"{packed}\n{line}" if packed else line
        if not is_blank(packed):
            out.append(packed)
    return out


def split_body(body: str) -> list[str]:
    """Pieces near the target size; each after the first starts with the end of the one before."""
    out: list[str] = []
    current = ""
    for unit in units(body):
        if current and len(current) + len(unit) > TARGET_CHARS:
            out.append(current)
            current = tail(current, OVERLAP_CHARS)
        current = f"{current}\n\n{unit}" if current else unit
    if not is_blank(current):
        out.append(current)
    return [s for piece in out for s in (slices(piece) if len(piece) > MAX_CHARS else [piece])]


def split_query(query: str, max_units: int) -> list[str]:
    """Pieces of a query, at most max_units: the first ones and always the last."""
    pieces = split_body(query)
    if len(pieces) <= max_units:
        return pieces
    return pieces[: max(max_units - 1, 0)] + pieces[-1:]


def is_fence(line: str) -> bool:
    return line.lstrip(WHITE_SPACE).startswith(("```", "~~~"))


def heading_of(line: str) -> tuple[int, str] | None:
    """Level and text of an ATX heading."""
    m = _HEADING.match(line.lstrip(WHITE_SPACE))
    return (len(m[1]), trim(m[2])) if m else None


def sections(lines: list[str]) -> list[tuple[str, str]]:
    """(heading path, trimmed body) of every section with a non-blank body.

    A heading cuts the path to level - 1 entries, counted by depth: with skipped levels siblings nest.
    """
    out: list[tuple[str, str]] = []
    path: list[str] = []
    body: list[str] = []
    fenced = False

    def flush() -> None:
        if text := trim("\n".join(body)):
            out.append((" > ".join(path), text))
        body.clear()

    for line in lines:
        if is_fence(line):
            fenced = not fenced
        elif not fenced and (heading := heading_of(line)):
            flush()
            del path[heading[0] - 1 :]
            path.append(heading[1])
            continue
        body.append(line)
    flush()
    return out


def note_sections(source: str) -> list[tuple[str, str]]:
    """Sections of a raw note, without its frontmatter."""
    lines = lines_of(source)
    return sections(lines[parse_frontmatter(lines)[1] :])


@dataclass
class Chunk:
    text: str
    heading_path: str
    ix: int
    entities: list[str]


def parse_note(title: str, source: str) -> tuple[Frontmatter, list[Chunk]]:
    """Frontmatter and chunks of a note; chunk numbers skip blank pieces."""
    lines = lines_of(source)
    front, start = parse_frontmatter(lines)
    chunks: list[Chunk] = []
    for path, body in sections(lines[start:]):
        header = f"{title} > {path}" if path else title
        for piece in split_body(body):
            if not is_blank(piece):
                chunks.append(Chunk(f"{header}\n\n{piece}", path, len(chunks), wikilinks(piece)))
    return front, chunks
