"""Command line: ``python -m quillmark index|search|recall|status|rpc|daemon`` with roots and state from the environment."""

from __future__ import annotations

import argparse
import json
import signal
import sys
import threading

from quillmark.api import Engine
from quillmark.config import DEFAULT_K, Settings
from quillmark.operators.embedders import OnnxEmbedder
from quillmark.serving import Daemon, hit_lines, hook_output, serve_rpc, stats_lines, status_lines
from quillmark.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmark")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("--full", action="store_true")
    search = sub.add_parser("search")
    search.add_argument("query")
    search.add_argument("--k", type=int, default=DEFAULT_K)
    search.add_argument("--filter")
    search.add_argument("--json", action="store_true")
    for name in ("recall", "status", "rpc", "daemon"):
        sub.add_parser(name)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    settings = Settings.from_env()
    embedder = OnnxEmbedder(settings.model_dir, threads=settings.embed_threads) if settings.model_dir else None
    engine = Engine(local_session("*"), settings.roots, settings.warehouse, embedder, settings.injection_log)
    if args.command == "index":
        print(stats_lines(engine.index(args.full)))
    elif args.command == "search":
        hits = [r.asDict() for r in engine.search(args.query, args.k, args.filter).collect()]
        print(json.dumps(hits) if args.json else hit_lines(hits))
    elif args.command == "recall":
        print(hook_output(engine, sys.stdin.read()), end="")
    elif args.command == "status":
        text, fine = status_lines([r.asDict() for r in engine.status().collect()])
        print(text)
        return 0 if fine else 1
    elif args.command == "daemon":
        ended = threading.Event()
        for s in (signal.SIGTERM, signal.SIGINT):
            signal.signal(s, lambda *_: ended.set())
        daemon = Daemon(engine, settings.socket, settings.watch_checkpoint).start()
        ended.wait()
        daemon.stop()
    else:
        serve_rpc(engine)
    return 0


if __name__ == "__main__":
    sys.exit(main())
