"""Explicit schemas of the stored tables; nothing is inferred on read."""

from __future__ import annotations

CHUNKS = (
    "id string not null, text string not null, vector array<float>, source_type string not null, "
    "source_id string not null, title string not null, heading_path string not null, rel_path string not null, "
    "note_type string not null, captured string not null, tags array<string>, entities array<string>, "
    "content_hash string not null, chunk_ix int not null"
)
MANIFEST = "source_id string, source_type string, content_hash string, n_chunks int, indexed_at string"
POINTER = (
    "title string, source_type string, path string, rel_path string, heading_path string, captured string, cosine double"
)
INJECTIONS = f"at string, prompt string, outcome string, elapsed_ms bigint, top_cosine double, injected array<struct<{POINTER.replace(' string', ':string').replace(' double', ':double')}>>"
FILES = "label string, rel_path string, path string, content binary"
CHANGES = "path string, change string"
