import json
import os

import pytest

from quillmark.api import Engine, clamp_k
from quillmark.config import Root
from quillmark.plans.search import FilterError
from quillmark.streaming.watch import watch


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


@pytest.fixture
def engine(spark, tmp_path):
    notes, memory = tmp_path / "notes", tmp_path / "memory"
    put(notes, "cache.md", "---\ntype: system\ncaptured: 2026-04-10\ntags: [infra, caching]\n---\n\n# Cache\n\nThe cache expires after ten minutes.\n\n## Limits\n\nSee [[Rate Limiting|limits]].\n")
    put(notes, "sub/_draft.md", "# Draft\n\nRouters forward packets between networks.\n")
    put(notes, ".obsidian/skip.md", "never indexed")
    put(notes, "plain.txt", "never indexed")
    put(notes, "empty.md", "")
    put(memory, "cache.md", "The user prefers short answers about the cache.\n")
    roots = [Root("notes", str(notes)), Root("memory", str(memory))]
    return Engine(spark, roots, str(tmp_path / "warehouse"), log_directory=str(tmp_path / "log"))


def test_index_is_incremental_and_keeps_roots_apart(engine, tmp_path):
    assert {r["label"]: r["rows"] for r in engine.status().collect()} == {"memory": 0, "notes": 0}
    first = engine.index()
    assert (first.scanned, first.changed, first.removed, first.chunks_written) == (4, 4, 0, 4)
    assert {(r.source_id, r.n_chunks) for r in engine.store.read("manifest").collect()} == {
        ("notes:cache.md", 2), ("notes:sub/_draft.md", 1), ("notes:empty.md", 0), ("memory:cache.md", 1),
    }
    again = engine.index()
    assert (again.scanned, again.changed, again.removed, again.indexes) == (4, 0, 0, [])
    before = {r.id for r in engine.store.read("chunks").collect()}
    forced = engine.index(full=True)
    assert forced.changed == 4 and {r.id for r in engine.store.read("chunks").collect()} == before
    os.remove(tmp_path / "notes/sub/_draft.md")
    put(tmp_path / "notes", "cache.md", "# Cache\n\nNow it expires at once.\n")
    third = engine.index()
    assert (third.changed, third.removed) == (1, 1)
    rows = engine.store.read("chunks").collect()
    assert sorted(r.source_id for r in rows) == ["memory:cache.md", "notes:cache.md"]
    assert engine.store.read("postings").select("id").distinct().count() == 2
    assert {r["label"]: r["rows"] for r in engine.status().collect()} == {"memory": 1, "notes": 1}
    assert engine.store.vacuum() == 0 and engine.store.read("chunks").count() == 2  # every segment has live rows
    assert engine.purge_root("memory").removed == 1
    assert [r.source_id for r in engine.store.read("chunks").collect()] == ["notes:cache.md"]


def test_search_recall_and_hook(engine):
    assert engine.search("cache").count() == 0  # no index yet
    engine.index()
    hits = engine.search("when does the cache expire", 2).collect()
    assert len(hits) == 2 and hits[0].cosine >= hits[1].cosine and "cache" in hits[0].text.lower()
    assert [h.rel_path for h in engine.search("routers forward packets", 1).collect()] == ["sub/_draft.md"]
    only = engine.search("cache", 5, "source_type = 'memory'").collect()
    assert [h.source_type for h in only] == ["memory"]
    assert engine.search("cache", 5, "array_has(entities, 'Rate Limiting')").count() == 1
    assert engine.search(" \n\t\n").count() == 0
    for bad in ("id IN (SELECT 1)", "1 = 1; DROP TABLE x"):
        with pytest.raises(FilterError):
            engine.search("cache", 3, bad)
    with pytest.raises(Exception, match="(?i)no_such"):
        engine.search("cache", 3, "no_such = 1")
    assert engine.recall("  ").top_cosine is None
    found = engine.recall("notes cache The user prefers short answers about the cache")
    pointers = found.pointers.collect()
    assert found.top_cosine >= 0.75 and pointers[0].source_type == "memory" and pointers[0].path.endswith("/memory/cache.md")
    block = engine.hook("cache The user prefers short answers about the cache")
    assert "memory/cache.md" in block and "source memory" in block
    assert engine.hook("  <task-notification>done") == ""
    assert engine.hook("zebra xylophone") == ""
    assert engine.hook("The user prefers short answers about the cache", deadline_ms=0) == ""
    assert [r.outcome for r in engine.log().orderBy("at").collect()] == ["injected", "skipped", "miss", "unavailable"]
    assert "cosine" in engine.markdown(engine.search("cache", 1))


def test_a_broken_root_is_an_error_and_not_zero(engine, tmp_path):
    engine.index()
    part = tmp_path / "warehouse" / engine.store.state()["tables"]["chunks"][0]["dir"] / "source_type=notes"
    for f in part.iterdir():
        f.write_bytes(b"not parquet")
    state = {r["label"]: (r["rows"], r["error"]) for r in engine.status().collect()}
    assert state["memory"] == (1, None) and state["notes"][0] is None and state["notes"][1]


def test_paths_and_stream(engine, tmp_path):
    notes = tmp_path / "notes"
    stats = engine.index_paths([str(notes / "cache.md"), str(notes / "nowhere.md"), str(notes / ".obsidian/skip.md"), "/elsewhere/x.md"])
    assert (stats.changed, stats.removed) == (1, 1)  # a path that never was counts as removed
    assert engine.index_paths([]).changed == 0
    checkpoint = str(tmp_path / "checkpoint")
    q = watch(engine, checkpoint, once=True, replay=True)
    q.awaitTermination(120)
    assert q.exception() is None
    assert {r.source_id for r in engine.store.read("manifest").collect()} == {"notes:cache.md", "notes:sub/_draft.md", "notes:empty.md", "memory:cache.md"}
    os.remove(notes / "cache.md")
    put(notes, "new.md", "A fresh note.")
    q = watch(engine, checkpoint, once=True, replay=True)
    q.awaitTermination(120)
    assert {r.source_id for r in engine.store.read("manifest").collect()} == {"notes:new.md", "notes:sub/_draft.md", "notes:empty.md", "memory:cache.md"}


def test_one_commit_a_sweep(engine):
    engine.index()
    state = engine.store.state()
    assert state["seq"] == 1 and set(state["tables"]) == {"chunks", "manifest", "postings", "entities"} and not state["dead"]
    assert all(p["seq"] == 1 for parts in state["tables"].values() for p in parts) and json.dumps(state)
    assert [r.source_id for r in engine.mentions("Rate Limiting").collect()] == ["notes:cache.md"]


def test_what_a_commit_writes_follows_from_what_changed(spark, tmp_path):
    """The bytes a one-file change writes are the same for a small and a large warehouse."""

    def size(folder):
        return sum(f.stat().st_size for f in folder.rglob("*.parquet"))

    written, files = [], 0
    for n in (5, 400):
        notes, house = tmp_path / f"notes{n}", tmp_path / f"house{n}"
        for i in range(n):
            put(notes, f"n{i:03d}.md", f"# Note {i}\n\n" + f"Words number {i} and more words about topic {i % 7}. " * 30)
        engine = Engine(spark, [Root("notes", str(notes))], str(house))
        assert engine.index().changed == n
        before = size(house)
        put(notes, "n003.md", "# Note\n\n" + "Quite other words stand here now. " * 30)
        assert engine.index_paths([str(notes / "n003.md")]).changed == 1
        written.append(size(house) - before)
        assert engine.store.rows("manifest") == n + 1 and engine.store.read("manifest").count() == n
        assert engine.store.facts()["docs"] == engine.store.read("chunks").count()
        assert "other words" in engine.search("quite other words stand here", 1).first().text
    assert written[1] < 1.1 * written[0]


def test_segments_are_merged_and_dead_rows_leave(engine, tmp_path):
    engine.index()
    notes = tmp_path / "notes"
    for i in range(9):
        put(notes, "cache.md", f"# Cache\n\nIt expires after {i} minutes.\n")
        engine.index_paths([str(notes / "cache.md")])
    state = engine.store.state()
    assert all(len(parts) <= 8 for parts in state["tables"].values()) and len(state["dead"]) <= 9
    assert sorted((r.source_id, r.text.split("\n")[-1]) for r in engine.store.read("chunks").where("source_id = 'notes:cache.md'").collect()) == [("notes:cache.md", "It expires after 8 minutes.")]
    docs, words = engine.store.facts()["docs"], engine.store.facts()["words"]
    live = engine.store.read("chunks").selectExpr("count(*) n", "sum(len) w").first()
    assert (docs, words) == (live.n, live.w) and engine.store.read("manifest").count() == 4
    assert engine.store.read("postings").select("id").distinct().count() == docs
    assert engine.store.vacuum() > 0 and engine.store.read("chunks").count() == docs


def test_more_hits_than_the_tool_gives(spark, tmp_path):
    for i in range(15):
        put(tmp_path / "kb", f"f{i}.md", f"The cache number {i} expires.\n")
    engine = Engine(spark, [Root("notes", str(tmp_path / "kb"))], str(tmp_path / "w"))
    engine.index()
    assert engine.search("cache", 15).count() == 15 and engine.search("cache", 0).count() == 0
    from quillmark import serving

    text = serving._tool(engine, "notes_search", {"query": "cache", "k": 15})["content"][0]["text"]
    assert text.count("## notes:") == 10
    assert engine.search("cache", 3, "text <> 'array_has(' and array_has(array('a'), 'a')").count() == 3


def test_a_linked_path_is_the_file_it_leads_to(engine, tmp_path):
    engine.index()
    os.symlink(tmp_path / "notes", tmp_path / "link")
    put(tmp_path / "notes", "cache.md", "# Cache\n\nChanged through a link.\n")
    engine.index_paths([str(tmp_path / "link/cache.md"), str(tmp_path / "notes/cache.md")])
    assert sorted(r.source_id for r in engine.store.read("manifest").collect()) == ["memory:cache.md", "notes:cache.md", "notes:empty.md", "notes:sub/_draft.md"]


def test_cells_take_new_rows_and_are_fitted_anew_when_rows_double(spark, tmp_path):
    kb = tmp_path / "kb"
    for i in range(6):
        put(kb, f"f{i}.md", f"word{i} stands alone here {i}\n")
    engine = Engine(spark, [Root("notes", str(kb))], str(tmp_path / "w"), ann_threshold=4)
    engine.index()
    assert engine.store.facts()["fitted_rows"] == 6
    put(kb, "g.md", "zebra crossing\n")
    engine.index_paths([str(kb / "g.md")])
    assert engine.store.facts()["fitted_rows"] == 6 and len(engine.store.state()["tables"]["cells"]) == 2
    assert engine.search("zebra crossing", 1).first().rel_path == "g.md"
    os.remove(kb / "g.md")
    for i in range(7):
        put(kb, f"h{i}.md", f"other{i} text {i}\n")
    engine.index()
    assert engine.store.facts()["fitted_rows"] == 13 and engine.search("zebra crossing", 1).where("text like '%zebra%'").count() == 0


def test_daemon(spark, engine, tmp_path):
    import time

    from quillmark import serving

    path = str(tmp_path / "d.sock")
    put(tmp_path, "d.sock", "left over from a killed server")
    daemon = serving.Daemon(engine, path, str(tmp_path / "watch"), seconds=1).start()
    try:
        assert serving.request(path, {"op": "ping"})["status"] == "pong"
        end = time.monotonic() + 180
        while len(daemon.sweeps) < 2 and time.monotonic() < end:
            time.sleep(0.2)
        assert daemon.sweeps[:2] == ["startup", "periodic"] and daemon.stream is not None
        hits = serving.request(path, {"op": "search", "query": "routers forward packets", "k": 1}, timeout=120)["hits"]
        assert [h["rel_path"] for h in hits] == ["sub/_draft.md"]
        put(tmp_path / "notes", "new.md", "Zebras cross the road.\n")
        while not engine.store.read("manifest").where("source_id = 'notes:new.md'").count() and time.monotonic() < end:
            time.sleep(0.2)
        assert serving.request(path, {"op": "search", "query": "zebras cross", "k": 1}, timeout=120)["hits"][0]["rel_path"] == "new.md"
    finally:
        daemon.stop()
    with pytest.raises(OSError):
        serving.request(path, {"op": "ping"}, timeout=1)

    def broken(*_):
        raise OSError("no watcher here")

    alone = serving.Daemon(engine, path, str(tmp_path / "watch2"), seconds=600, start_watch=broken).start()
    try:
        assert alone.stream is None and serving.request(path, {"op": "ping"})["status"] == "pong"
    finally:
        alone.stop()
    with pytest.raises(ValueError, match="under 104"):
        serving.serve_socket(engine, "/" + "x" * 120)


@pytest.mark.parametrize(("asked", "k"), [(None, 3), ("7", 3), (-1, 3), (0, 1), (1, 1), (10, 10), (11, 10), (True, 3)])
def test_k(asked, k):
    assert clamp_k(asked) == k


def test_vectors_by_cell_from_a_threshold_on(spark, engine, tmp_path):
    engine.ann_threshold = 3
    assert engine.index_root(engine.roots[0]).indexes[-1] == "notes: 1 cells" and engine.access_path() == "cells"
    assert [h.rel_path for h in engine.search("routers forward packets", 1).collect()] == ["sub/_draft.md"]
    os.remove(tmp_path / "notes/sub/_draft.md")
    assert engine.index_root(engine.roots[0]).indexes[-1] == "notes: flat scan" and engine.access_path() == "flat scan"


def test_debounce_as_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillmark.streaming.watch import debounced

    rows = [("p", 0), ("p", 3), ("p", 8), ("q", 1), ("z", 9000)]
    spark.createDataFrame(rows, "path string, s int").select("path", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path / "events"))
    q = debounced(stream).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    # the last burst stays open: the watermark has not passed it
    assert sorted((r.path, r.events) for r in spark.table("bursts").collect()) == [("p", 1), ("p", 2), ("q", 1)]


def test_serving(engine):
    from quillmark import serving

    engine.index()
    assert json.loads(serving.answer(engine, "nonsense"))["message"].startswith("bad request")
    assert json.loads(serving.answer(engine, '{"op": "fly"}'))["status"] == "error"
    assert json.loads(serving.answer(engine, '{"op": "ping"}'))["status"] == "pong"
    hits = json.loads(serving.answer(engine, '{"op": "search", "query": "routers forward packets", "k": 1}'))["hits"]
    assert [h["rel_path"] for h in hits] == ["sub/_draft.md"] and "notes:sub/_draft.md > Draft" in serving.hit_lines(hits)
    assert json.loads(serving.answer(engine, '{"op": "search", "query": "x", "filter": "1 +"}'))["status"] == "error"
    assert json.loads(serving.answer(engine, '{"op": "recall", "prompt": ""}')) == {"status": "pointers", "pointers": [], "top_cosine": None}
    call = lambda m, **p: serving.rpc_reply(engine, json.dumps({"jsonrpc": "2.0", "id": 1, "method": m, "params": p}))
    assert call("nope")["error"]["code"] == -32601 and serving.rpc_reply(engine, "{") is None
    assert serving.rpc_reply(engine, '{"method": "notifications/initialized"}') is None
    assert len(call("tools/list")["result"]["tools"]) == 2
    assert call("tools/call", name="notes_search", arguments={"query": " "})["result"] == {"content": [{"type": "text", "text": "query is required"}], "isError": True}
    assert "## notes:" in call("tools/call", name="notes_search", arguments={"query": "routers", "k": 1})["result"]["content"][0]["text"]
    assert call("tools/call", name="notes_status")["result"]["content"][0]["text"] == "memory: 1 rows\nnotes: 3 rows"
    assert serving.status_lines([{"label": "a", "rows": None, "error": "x"}]) == ("a: error: x", False)
    assert serving.hook_output(engine, "{}") == "" and serving.hook_output(engine, '{"prompt": "<task-notification>"}') == ""
