"""Markdown trees as data sources (S1-S4, S10): a batch scan of notes and a stream of what changed.

``spark.read.format("quillmark_notes").option("roots", "label=dir:label=dir")`` lists files itself, as Spark's
file sources hide names that start with ``_`` or ``.``. One partition reads one slice of the sorted listing.
``spark.readStream.format("quillmark_watch").option("state", folder)`` reports files created, changed and removed
since the last offset by comparing listings, so deletions are seen.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillmark.config import EXCLUDED_NAMES, NOTE_EXTENSION, Root, parse_roots

FILES_PER_PARTITION = 2000


def is_indexable(path: str) -> bool:
    stem, dot = os.path.splitext(os.path.basename(path))
    return dot == NOTE_EXTENSION and bool(stem)


def is_excluded(path: str) -> bool:
    return any(part in EXCLUDED_NAMES for part in path.split("/"))


def note_paths(root: Root) -> list[str]:
    """Sorted paths of a root's notes. Excluded directories are not entered, links not followed, unreadable
    directories passed over. A root that lies below an excluded name has no notes."""
    if is_excluded(root.dir):
        return []
    found: list[str] = []
    for folder, inner, files in os.walk(root.dir, followlinks=False):
        inner[:] = [x for x in inner if x not in EXCLUDED_NAMES]
        for name in files:
            path = os.path.join(folder, name)
            if name not in EXCLUDED_NAMES and is_indexable(path) and os.path.isfile(path) and not os.path.islink(path):
                found.append(path)
    return sorted(found)


class _Slice(InputPartition):
    def __init__(self, files: list[tuple[str, str, str]]):
        self.files = files


class NotesSource(DataSource):
    """Rows (label, rel_path, path, content) of all notes of the roots."""

    @classmethod
    def name(cls) -> str:
        return "quillmark_notes"

    def schema(self) -> str:
        return "label string, rel_path string, path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _NotesReader(parse_roots(self.options.get("roots")), int(self.options.get("filesPerPartition", FILES_PER_PARTITION)))


class _NotesReader(DataSourceReader):
    def __init__(self, roots: list[Root], size: int):
        self.roots, self.size = roots, size

    def partitions(self) -> list[InputPartition]:
        files = [(r.label, os.path.relpath(p, r.dir), p) for r in self.roots for p in note_paths(r)]
        return [_Slice(files[i : i + self.size]) for i in range(0, len(files), self.size)] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for label, rel, path in partition.files:
            with open(path, "rb") as f:
                yield label, rel, path, f.read()


class WatchSource(DataSource):
    """Rows (path, change): created, modified or removed notes of the roots."""

    @classmethod
    def name(cls) -> str:
        return "quillmark_watch"

    def schema(self) -> str:
        return "path string, change string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _WatchReader(parse_roots(self.options.get("roots")), self.options.get("state"), self.options.get("initial", "all") == "all")


class _Change(InputPartition):
    def __init__(self, before: str, after: str):
        self.before, self.after = before, after


class _WatchReader(DataSourceStreamReader):
    """The offset is a version by root. A version is a listing (path, modification time, size), a file in the state
    folder, which the tasks that compare two of them must be able to read, as they are the notes themselves.
    Version 0 is the empty listing. One partition compares one root."""

    def __init__(self, roots: list[Root], state: str | None, replay: bool):
        if not state:
            raise ValueError("the option state must name a folder for listings")
        self.roots, self.state, self.replay = roots, state, replay

    def _stem(self, label: str) -> str:
        return f"{self.state}/{hashlib.sha256(label.encode()).hexdigest()[:16]}"

    def _file(self, label: str, version: int) -> str:
        return f"{self._stem(label)}.{version}"

    def _last(self, label: str) -> int:
        held = glob.glob(f"{glob.escape(self._stem(label))}.*")
        return max((int(v) for f in held if (v := f.rpartition(".")[2]).isdigit()), default=0)

    def initialOffset(self) -> dict:
        return dict.fromkeys((r.label for r in self.roots), 0) if self.replay else self.latestOffset()

    def latestOffset(self) -> dict:
        os.makedirs(self.state, exist_ok=True)
        offset = {}
        for root in self.roots:
            version, now = self._last(root.label), _listing(root)
            if now != (_stored(self._file(root.label, version)) if version else b""):
                version += 1
                draft = f"{self._file(root.label, version)}-{os.getpid()}"
                with open(draft, "wb") as f:
                    f.write(now)
                os.replace(draft, self._file(root.label, version))
            offset[root.label] = version
        return offset

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        changed = [label for label in end if start.get(label, 0) != end[label]]
        return [_Change(*(self._file(x, v) if v else "" for v in (start.get(x, 0), end[x]))) for x in changed] or [_Change("", "")]

    def read(self, partition: _Change) -> Iterator[tuple]:
        before, after = ({k: v for k, *v in map(json.loads, _stored(f).splitlines())} for f in (partition.before, partition.after))
        yield from changes_between(before, after)

    def commit(self, end: dict) -> None:
        for label, version in end.items():
            for old in glob.glob(f"{glob.escape(self._stem(label))}.*"):
                v = old.rpartition(".")[2]
                if v.isdigit() and int(v) < version:
                    os.remove(old)


def _listing(root: Root) -> bytes:
    """One JSON line a note, in path order."""
    lines = []
    for path in note_paths(root):
        try:
            s = os.stat(path)
        except OSError:
            continue  # gone since it was listed
        lines.append(json.dumps([path, s.st_mtime_ns, s.st_size]))
    return "\n".join(lines).encode()


def _stored(file: str) -> bytes:
    if not file:
        return b""
    with open(file, "rb") as f:
        return f.read()


def changes_between(before: dict, after: dict) -> list[tuple[str, str]]:
    """(path, change), in path order, each path once."""
    out = []
    for path in sorted(before.keys() | after.keys()):
        if path not in after:
            out.append((path, "removed"))
        elif path not in before:
            out.append((path, "created"))
        elif before[path] != after[path]:
            out.append((path, "modified"))
    return out


def register(spark) -> None:
    spark.dataSource.register(NotesSource)
    spark.dataSource.register(WatchSource)
