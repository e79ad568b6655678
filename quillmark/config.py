"""Constants of the engine, collection roots and the settings read from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

# Fixed values the results depend on.
EMBED_DIM = 384
EMBED_MAX_TOKENS = 512
CHUNKER_VERSION = 1
TARGET_CHARS = 1200
MAX_CHARS = 2000
OVERLAP_CHARS = 200
COSINE_GATE = 0.75
RECALL_HITS = 3
RECALL_DEPTH_FACTOR = 4
RECALL_MAX_UNITS = 5
SEARCH_MAX_UNITS = 8
DEFAULT_K = 3
MAX_K = 10
ANN_THRESHOLD_ROWS = 25_000
RRF_CONSTANT = 60
SWEEP_SECONDS = 3600
DEBOUNCE_SECONDS = 4
NOTE_EXTENSION = ".md"
EXCLUDED_NAMES = (".obsidian", ".git", ".trash", ".DS_Store")
ENVELOPE_PREFIXES = (
    "<task-notification>",
    "<task_notification>",
    "<local-command-caveat>",
    "<local-command-stdout>",
)
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
BM25_K1 = 1.2
BM25_B = 0.75

ROOTS_VARIABLE = "QUILLMARK_ROOTS"
MODEL_VARIABLE = "QUILLMARK_MODEL_DIR"
STATE_VARIABLE = "QUILLMARK_STATE_DIR"
SOCKET_VARIABLE = "QUILLMARK_SOCKET"
LOG_VARIABLE = "QUILLMARK_INJECTION_LOG"
THREADS_VARIABLE = "QUILLMARK_EMBED_THREADS"


class ConfigError(ValueError):
    """A setting that cannot be used; the message names the offending part."""


@dataclass(frozen=True)
class Root:
    """One labelled directory of notes."""

    label: str
    dir: str

    def source_id(self, rel_path: str) -> str:
        return f"{self.label}:{rel_path}"


def check_label(label: str) -> str:
    """The label itself, or ConfigError: labels prefix source ids, so ':' and '=' are reserved."""
    if not label:
        raise ConfigError("a root label may not be empty")
    for reserved in ":=":
        if reserved in label:
            raise ConfigError(f"root label {label!r} may not contain {reserved!r}")
    return label


def parse_roots(spec: str | None) -> list[Root]:
    """``label=dir[:label=dir]*`` as roots. Every entry's shape is checked before any directory is touched."""
    if spec is None:
        raise ConfigError(f"{ROOTS_VARIABLE} is not set")
    pairs: list[tuple[str, str]] = []
    for position, entry in enumerate(spec.split(":"), 1):
        if not entry:
            raise ConfigError(f"entry {position} of the roots is empty")
        label, sign, path = entry.partition("=")
        if not sign:
            raise ConfigError(f"entry {entry!r} of the roots has no '='; a path may not contain ':'")
        pairs.append((check_label(label), path))
    labels = [label for label, _ in pairs]
    if twice := next((x for x in labels if labels.count(x) > 1), None):
        raise ConfigError(f"root label {twice!r} is given twice")
    return [Root(label, _directory(label, path)) for label, path in pairs]


def _directory(label: str, path: str) -> str:
    if not path:
        raise ConfigError(f"root {label!r} has an empty path")
    try:
        real = Path(path).resolve(strict=True)
    except OSError as e:
        raise ConfigError(f"root {label!r}: {path} cannot be resolved: {e}") from e
    if not real.is_dir():
        raise ConfigError(f"root {label!r}: {path} is not a directory")
    return str(real)


def root_of_path(roots: list[Root], path: str) -> Root | None:
    """The first configured root that holds the path, by whole components; links are resolved on a second try."""
    for candidate in (Path(path), Path(os.path.realpath(path))):
        for root in roots:
            if candidate.is_relative_to(root.dir):
                return root
    return None


@dataclass(frozen=True)
class Settings:
    """Where state lives and what the embedder needs."""

    roots: list[Root] = field(default_factory=list)
    state_dir: str = ""
    model_dir: str | None = None
    socket: str = ""
    injection_log: str = ""
    embed_threads: int = 1

    @property
    def warehouse(self) -> str:
        return f"{self.state_dir}/warehouse"

    @property
    def watch_checkpoint(self) -> str:
        return f"{self.state_dir}/watch"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        """Empty variables count as unset. Embedding takes one thread a task unless told otherwise, as the tasks of
        a machine are as many as its cores; what is no whole number above 0 is ignored."""
        env = dict(os.environ) if env is None else env
        base = env.get("XDG_STATE_HOME") or f"{env.get('HOME') or '.'}/.local/state"
        state = env.get(STATE_VARIABLE) or f"{base}/quillmark"
        threads = env.get(THREADS_VARIABLE) or ""
        return cls(
            parse_roots(env.get(ROOTS_VARIABLE)), state, env.get(MODEL_VARIABLE) or None, env.get(SOCKET_VARIABLE) or f"{state}/daemon.sock",
            env.get(LOG_VARIABLE) or f"{state}/injections", int(threads) if threads.isdecimal() and int(threads) else 1,
        )
