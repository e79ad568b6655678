"""Thin serving shims over the engine (S11-S14, S16, X16): requests and responses as JSON objects, a JSON-RPC
tool interface over lines, and the plain-text renderers. They hold no logic of their own."""

from __future__ import annotations

import json
import logging
import os
import socket
import socketserver
import sys
import threading
from collections.abc import Callable
from typing import IO

from quillmark import __version__
from quillmark.api import Engine, clamp_k
from quillmark.config import DEFAULT_K, SWEEP_SECONDS
from quillmark.functions.text import is_blank
from quillmark.plans.indexing import IndexStats

TOOLS = [
    {
        "name": "notes_search",
        "description": "Searches the indexed notes by meaning and by words.",
        "inputSchema": {
            "type": "object",
            "properties": {
                "query": {"type": "string"},
                "k": {"type": "integer", "minimum": 1, "maximum": 10, "default": DEFAULT_K},
                "filter": {"type": "string", "description": "SQL predicate over the chunks' columns"},
            },
            "required": ["query"],
        },
    },
    {"name": "notes_status", "description": "Rows indexed per collection.", "inputSchema": {"type": "object", "properties": {}}},
]


def status_lines(rows: list[dict]) -> tuple[str, bool]:
    """One line a collection, and whether all could be counted."""
    lines = [f"{r['label']}: {r['rows']} rows" if r["error"] is None else f"{r['label']}: error: {r['error']}" for r in rows]
    return "\n".join(lines), all(r["error"] is None for r in rows)


def stats_lines(stats: IndexStats) -> str:
    head = f"scanned {stats.scanned}, changed {stats.changed}, removed {stats.removed}, chunks written {stats.chunks_written}"
    return "\n".join([head, *stats.indexes])


def hit_lines(hits: list[dict]) -> str:
    """A line with cosine, collection, path and heading, and one with the start of the text, for each hit."""
    out = []
    for h in hits:
        heading = f" > {h['heading_path']}" if h["heading_path"] else ""
        out += [f"{h['cosine']:.4f}  {h['source_type']}:{h['rel_path']}{heading}", "        " + h["text"][:120].replace("\n", " ")]
    return "\n".join(out)


def dispatch(engine: Engine, request: dict) -> dict:
    """The response to one request; whatever fails becomes an error response."""
    try:
        match request.get("op"):
            case "ping":
                return {"status": "pong", "version": __version__}
            case "status":
                return {"status": "status", "roots": [r.asDict() for r in engine.status().collect()]}
            case "search":
                rows = engine.search(request.get("query", ""), int(request.get("k", DEFAULT_K)), request.get("filter")).collect()
                return {"status": "hits", "hits": [r.asDict() for r in rows]}
            case "recall":
                found = engine.recall(request.get("prompt", ""))
                return {"status": "pointers", "pointers": [r.asDict() for r in found.pointers.collect()], "top_cosine": found.top_cosine}
            case "reindex":
                return {"status": "indexed", **vars(engine.index(bool(request.get("full"))))}
            case other:
                return {"status": "error", "message": f"bad request: unknown op {other!r}"}
    except Exception as e:  # noqa: BLE001  the caller gets the reason
        return {"status": "error", "message": str(e).splitlines()[0] if str(e) else type(e).__name__}


def answer(engine: Engine, line: str) -> str:
    """One request line to one response line."""
    try:
        request = json.loads(line)
        if not isinstance(request, dict):
            raise ValueError("not an object")
    except ValueError as e:
        return json.dumps({"status": "error", "message": f"bad request: {e}"})
    return json.dumps(dispatch(engine, request), default=str)


#: Longest path of a Unix socket on any system in use.
SOCKET_PATH_BYTES = 104
_log = logging.getLogger("quillmark")


def serve_socket(engine: Engine, path: str) -> socketserver.ThreadingUnixStreamServer:
    """A server on a Unix socket: one request and one response a connection. The caller runs serve_forever(). A
    socket left over from a killed server is removed."""
    size = len(os.fsencode(path))
    if size >= SOCKET_PATH_BYTES:
        raise ValueError(f"socket path is {size} bytes, must be under {SOCKET_PATH_BYTES}: {path}")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    if os.path.exists(path):
        os.remove(path)

    class Handler(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            self.wfile.write(answer(engine, self.rfile.readline().decode("utf-8", "replace")).encode() + b"\n")

    server = socketserver.ThreadingUnixStreamServer(path, Handler)
    server.daemon_threads = True
    return server


def request(path: str, message: dict, timeout: float = 30.0) -> dict:
    """Asks a server on a socket (S12). Raises OSError where there is none or it takes longer than ``timeout``."""
    with socket.socket(socket.AF_UNIX) as s:
        s.settimeout(timeout)
        s.connect(path)
        s.sendall(json.dumps(message).encode() + b"\n")
        with s.makefile("rb") as f:
            line = f.readline()
    if not line:
        raise ConnectionError("the server closed the connection without an answer")
    return json.loads(line)


class Daemon:
    """Socket, watcher and sweeps together (M5 to M7): answers at once, catches up in the background, then sweeps
    every ``seconds`` as a backstop for lost changes. Where roots cannot be watched, sweeps alone keep it current."""

    def __init__(self, engine: Engine, path: str, checkpoint: str, seconds: float = SWEEP_SECONDS, start_watch: Callable | None = None):
        from quillmark.streaming.watch import watch

        self.engine, self.checkpoint, self.seconds = engine, checkpoint, seconds
        self._start_watch = start_watch or watch
        self._stop = threading.Event()
        self.sweeps: list[str] = []
        self.stream = None
        self.server = serve_socket(engine, path)
        self._threads = [threading.Thread(target=run, daemon=True) for run in (self.server.serve_forever, self._sweeping)]

    def start(self) -> Daemon:
        for t in self._threads:
            t.start()
        try:
            self.stream = self._start_watch(self.engine, self.checkpoint)
        except Exception as e:  # noqa: BLE001  sweeps go on without a watcher
            _log.warning("roots cannot be watched, sweeps only: %s", e)
        return self

    def _sweeping(self) -> None:
        reason = "startup"
        while True:
            try:
                self.engine.index()
                self.sweeps.append(reason)
            except Exception as e:  # noqa: BLE001  the next sweep tries again
                _log.warning("%s sweep failed: %s", reason, e)
            reason = "periodic"
            if self._stop.wait(self.seconds):
                return

    def stop(self) -> None:
        self._stop.set()
        self.server.shutdown()
        self.server.server_close()
        if os.path.exists(self.server.server_address):
            os.remove(self.server.server_address)
        if self.stream is not None:
            self.stream.stop()
        self._threads[1].join(timeout=60)


def _tool(engine: Engine, name: str, arguments: dict) -> dict:
    say = lambda text, bad=False: {"content": [{"type": "text", "text": text}], "isError": bad}
    if name == "notes_status":
        text, fine = status_lines([r.asDict() for r in engine.status().collect()])
        return say(text, not fine)
    if name != "notes_search":
        return say(f"unknown tool {name}", True)
    query = arguments.get("query")
    if not isinstance(query, str) or is_blank(query):
        return say("query is required", True)
    try:
        return say(engine.markdown(engine.search(query, clamp_k(arguments.get("k")), arguments.get("filter"))))
    except Exception as e:  # noqa: BLE001  the caller gets the reason
        return say(str(e).splitlines()[0], True)


def rpc_reply(engine: Engine, line: str) -> dict | None:
    """The reply to a JSON-RPC line; none for notifications and lines that cannot be read."""
    try:
        message = json.loads(line)
    except ValueError:
        return None
    if not isinstance(message, dict) or message.get("id") is None:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    params = message.get("params") or {}
    match message.get("method"):
        case "initialize":
            result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "quillmark", "version": __version__}}
        case "ping":
            result = {}
        case "tools/list":
            result = {"tools": TOOLS}
        case "tools/call":
            result = _tool(engine, params.get("name", ""), params.get("arguments") or {})
        case other:
            return reply | {"error": {"code": -32601, "message": f"method not found: {other}"}}
    return reply | {"result": result}


def serve_rpc(engine: Engine, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    for line in source:
        if (reply := rpc_reply(engine, line)) is not None:
            sink.write(json.dumps(reply, default=str) + "\n")
            sink.flush()


def hook_output(engine: Engine, payload: str, deadline_ms: int | None = None) -> str:
    """What a prompt hook prints for its JSON payload: additional context, or nothing at all."""
    try:
        prompt = json.loads(payload)["prompt"]
    except (ValueError, KeyError, TypeError):
        return ""
    block = engine.hook(prompt, deadline_ms) if isinstance(prompt, str) else ""
    return json.dumps({"hookSpecificOutput": {"hookEventName": "UserPromptSubmit", "additionalContext": block}}) if block else ""
