"""Operators on small fixtures: expected values by hand or from a plain Python version."""

import hashlib
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillmark.functions import columns as C
from quillmark.operators import changes, fusion, merge, render
from quillmark.operators.lexical import ranked
from quillmark.operators.embedders import HashEmbedder, OnnxEmbedder, with_vectors
from quillmark.operators.orphans import bloom_blocks, bloom_filter, might_exist, merged_spans, orphan_references
from quillmark.operators.skew import hot_keys, join_unique
from quillmark.operators.vector import hash_embedding, nearest
from quillmark.sources import markdown


def one(spark, **exprs):
    return spark.range(1).select(*(c.alias(n) for n, c in exprs.items())).first()


def test_hashes_and_ids(spark):
    r = one(spark, h=C.content_hash(F.lit("abc")), i=C.chunk_id(F.lit("notes:a.md"), F.lit(0)), s=F.sha2(F.lit("abc"), 256), e=F.sha2(F.lit(""), 256))
    assert r.h == "3bf37c3c6ed7cf7b3e2cf548695e9fa4201c82a1a579496a69d7f10b51fcddd2" != r.s
    assert r.i == "e0cf4983f17841f1"
    assert (r.s, r.e) == (hashlib.sha256(b"abc").hexdigest(), hashlib.sha256(b"").hexdigest())


def test_title_and_tag_keys(spark):
    rows = spark.createDataFrame([("../log/Team_Map.md",), ("  TEAM   map ",), ("team map",), (None,), ("a.md.md",)], "t string")
    assert [r[0] for r in rows.select(C.title_key(F.col("t"))).collect()] == ["team map", "team map", "team map", None, "a.md"]
    tags = spark.createDataFrame([(" #Log ",), ("##log",), ("log",), ("#",)], "t string")
    assert [r[0] for r in tags.select(C.tag_key(F.col("t"))).collect()] == ["log", "log", "log", ""]


def test_path_predicates(spark):
    rows = spark.createDataFrame([("a/x.md",), ("a/.md",), (".md",), ("a/x.MD",), ("a/.git/x.md",), ("a/.gitx/x.md",)], "p string")
    got = rows.select(C.is_indexable(F.col("p")), C.is_excluded(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, False), (False, False), (True, True), (True, False)]
    assert markdown.is_indexable("a/x.md") and not markdown.is_indexable("a/.md") and markdown.is_excluded("/r/.trash/x.md")


def test_instants_and_envelopes(spark):
    r = one(spark, a=F.unix_micros(C.instant(F.lit("2025-01-01T00:33:03.5+05:30"))), b=C.instant(F.lit("no date")))
    assert r.a == 1735671783500000 and r.b is None
    cases = {"<task-notification>\nfinished": True, "  <task_notification>finished": True, "<local-command-stdout>done": True, "Explain <task-notification> handling": False, "": False}
    rows = spark.createDataFrame([(k,) for k in cases], "p string")
    assert [r[0] for r in rows.select(C.is_envelope(F.col("p"))).collect()] == list(cases.values())


def hits(spark, *rows):
    return spark.createDataFrame([(0, i, label, f"{label}{i}.md", "", "", "", "", c) for i, (label, c) in enumerate(rows)],
        "q int, at int, source_type string, rel_path string, heading_path string, title string, captured string, path string, cosine double")


@pytest.mark.parametrize(
    ("given", "limit", "expected"),
    [
        ([("wiki", 0.95), ("wiki", 0.94), ("wiki", 0.93), ("notes", 0.80)], 3, [("wiki", 0.95), ("notes", 0.80), ("wiki", 0.94)]),
        ([("notes", 0.90), ("notes", 0.85), ("notes", 0.80)], 3, [("notes", 0.90), ("notes", 0.85), ("notes", 0.80)]),
        ([("wiki", 0.95), ("wiki", 0.90), ("wiki", 0.85), ("notes", 0.80), ("notes", 0.70), ("memory", 0.60)], 5, [("wiki", 0.95), ("notes", 0.80), ("memory", 0.60), ("wiki", 0.90), ("notes", 0.70)]),
        ([("notes", 0.40), ("wiki", 0.99), ("notes", 0.90), ("wiki", 0.10), ("notes", 0.65)], 5, [("wiki", 0.99), ("notes", 0.90), ("wiki", 0.10), ("notes", 0.65), ("notes", 0.40)]),
        ([("wiki", 0.95), ("notes", 0.80), ("memory", 0.60), ("wiki", 0.90)], 2, [("wiki", 0.95), ("notes", 0.80)]),
        ([], 3, []),
    ],
)
def test_round_robin(spark, given, limit, expected):
    got = fusion.round_robin(hits(spark, *given), limit, ["q"]).orderBy("place").collect()
    assert [(r.source_type, r.cosine) for r in got] == expected


def test_consolidate_takes_the_best_turn_in_either_order(spark):
    schema = "q int, ord int, source_type string, rel_path string, heading_path string, title string, captured string, path string, cosine double"
    for turns in ([("Turn 1", 0.76), ("Turn 9", 0.91)], [("Turn 9", 0.91), ("Turn 1", 0.76)]):
        df = spark.createDataFrame([(0, i, "n", "cache.md", h, f"t{i}", "", "", c) for i, (h, c) in enumerate(turns)], schema)
        got = fusion.consolidate(df, ["q"], ["ord"]).collect()
        assert [(r.heading_path, r.cosine, r.title) for r in got] == [("Turn 9", 0.91, "t0")]
    tie = spark.createDataFrame([(0, i, "n", "a.md", h, "", "", "", c) for i, (h, c) in enumerate([("x", 0.8), ("y", 0.8), ("z", 0.4)])], schema)
    assert [r.heading_path for r in fusion.consolidate(tie, ["q"], ["ord"]).collect()] == ["x"]
    assert fusion.consolidate(tie, ["q"], ["ord"], gate=0.9).count() == 0


def test_best_k_and_rrf(spark):
    df = spark.createDataFrame([(0, 0, "n", "a", "same", 0.71), (0, 1, "n", "a", "same", 0.93), (0, 2, "n", "a", "other", 0.80), (0, 3, "m", "a", "same", 0.70)], "q int, ord int, source_type string, rel_path string, text string, cosine double")
    key = ["source_type", "rel_path", "text"]
    assert [r.cosine for r in fusion.best_k(df, 3, key, ["q"], ["ord"]).orderBy("place").collect()] == [0.93, 0.80, 0.70]
    assert [r.cosine for r in fusion.best_k(df, 1, key, ["q"], ["ord"]).collect()] == [0.93]
    legs = [spark.createDataFrame(x, "unit int, id int, rank int") for x in ([(0, 1, 0), (0, 2, 1)], [(0, 2, 0), (0, 3, 1)])]
    got = fusion.rrf(legs, 3).orderBy("rank").collect()
    assert [r.id for r in got] == [2, 1, 3] and got[0].score == pytest.approx(1 / 61 + 1 / 60) and got[1].score == pytest.approx(1 / 60)


def test_merges(spark):
    schema = "id string, source_id string, v int"
    current = spark.createDataFrame([("1", "a", 1), ("2", "a", 1), ("3", "b", 1), ("4", "c", 1)], schema)
    new = spark.createDataFrame([("1", "a", 2), ("5", "a", 2)], schema)
    scope = spark.createDataFrame([("a",), ("b",), ("a",)], "source_id string")
    assert sorted(map(tuple, merge.merge_scoped(current, new, scope).collect())) == [("1", "a", 2), ("4", "c", 1), ("5", "a", 2)]
    assert sorted(map(tuple, merge.merge_scoped(current, new.limit(0), scope).collect())) == [("4", "c", 1)]
    assert merge.merge_scoped(current, new, scope.limit(0)).count() == 4
    assert sorted(r.v for r in merge.upsert(current, new.limit(1), "id").collect()) == [1, 1, 1, 2]


def test_changes(spark):
    files = spark.createDataFrame([("n:a", "1"), ("n:b", "2"), ("n:c", "3")], "source_id string, content_hash string")
    known = spark.createDataFrame([("n:a", "1"), ("n:b", "x"), ("n:gone", "9"), ("m:other", "9")], "source_id string, content_hash string")
    assert {r.source_id: r.state for r in changes.detect_changes(files, known).collect()} == {"n:a": "unchanged", "n:b": "changed", "n:c": "new"}
    assert {r.state for r in changes.detect_changes(files, known, force=True).collect()} == {"changed", "new"}
    labels = spark.createDataFrame([("n",)], "label string")
    assert [r[0] for r in changes.orphans(known, files, labels).collect()] == ["n:gone"]
    assert {(r.source_id, r.n_chunks) for r in changes.manifest_counts(files, spark.createDataFrame([("n:a",), ("n:a",)], "source_id string")).collect()} == {("n:a", 2), ("n:b", 0), ("n:c", 0)}


def test_pointer_block(spark):
    rows = [
        ("T", "wiki", "/k/T.md", "T.md", "Some Heading", "2026-08-01", 0.42, 1), ("U", "memory", "", "U.md", "", "", 0.9, 2), ("V", "", "/k/V.md", "V.md", "", "", 0.5, 3),
    ]
    df = spark.createDataFrame(rows, "title string, source_type string, path string, rel_path string, heading_path string, captured string, cosine double, place int").withColumn("q", F.lit(0))
    assert render.pointer_block(df, ["q"], "place").first().block.split("\n") == [
        render.NOTES_FRAMING,
        "  /k/T.md > Some Heading  (source wiki, cos 0.42, captured 2026-08-01)",
        "  /k/V.md  (source notes, cos 0.50, captured: unknown)",
        render.FACTS_FRAMING,
        "  U.md  (source memory, cos 0.90, captured: unknown)",
    ]


def test_embedders_agree(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The cache, the CACHE!"), (2, ""), (3, None), (4, "Straße naïve 12")], "id int, text string")
    dense = {r.id: r.vector for r in with_vectors(docs, "text", HashEmbedder(64)).collect()}
    sparse = hash_embedding(docs, "id", "text", 64).collect()
    assert {(r.id, r.bucket): round(r.value, 6) for r in sparse} == {(i, b): round(x, 6) for i, v in dense.items() for b, x in enumerate(v) if x}
    assert not any(dense[2]) and not any(dense[3])
    with pytest.raises(FileNotFoundError):
        OnnxEmbedder(str(tmp_path))


def test_nearest_skips_unusable_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [2.0, 0.0])], "id int, vector array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "unit int, query_vector array<double>")
    assert sorted((r.id, round(r.score, 3)) for r in ranked(nearest(rows, q, 2), 2).collect()) == [(1, 1.0), (6, 1.0)]
    assert nearest(rows, q.limit(0), 2).count() == 0 and nearest(rows.limit(0), q, 2).count() == 0


def test_cells_find_most_of_what_a_full_scan_finds(spark):
    import numpy as np

    from quillmark.operators import ann

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(40, size=6000)] + 0.3 * rng.normal(size=(6000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None), (-2, [0.0] * 16)], "id int, vector array<float>")
    queries = rows.where("id % 50 = 0 and id >= 0").select(F.col("id").alias("unit"), F.col("vector").alias("query_vector"))
    cells = ann.fit_cells(rows)
    got = ranked(ann.probed(ann.with_cells(rows, cells), cells, queries, 5, probes=3), 5).collect()
    exact = {(r.unit, r.id) for r in ranked(nearest(rows, queries, 5), 5).collect()}
    assert len(cells.centroids) == 5 and len({(r.unit, r.id) for r in got} & exact) >= 0.9 * len(exact)
    assert ann.fit_cells(rows.limit(0)) is None


def test_cells_find_all_that_a_full_scan_finds(spark):
    import numpy as np
    import pyarrow as pa

    from quillmark.operators import ann

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 32))
    near = centres[rng.integers(60, size=10_000)] + 0.1 * rng.normal(size=(10_000, 32))
    x = np.concatenate([near, rng.normal(size=(25_000, 32))]).astype(np.float32)  # half is close together, the rest is not
    rows = spark.createDataFrame(pa.table({"id": pa.array(range(len(x)), pa.int32()), "vector": list(x)})).cache()
    queries = rows.where("id % 500 = 0").select(F.col("id").alias("unit"), F.col("vector").alias("query_vector"))
    cells = ann.fit_cells(rows)
    celled = ann.with_cells(rows, cells)
    assert len(cells.centroids) == 34 > 2 * ann.PROBES
    exact = {(r.unit, r.rank, r.id) for r in ranked(nearest(rows, queries, 5), 5).collect()}
    assert {(r.unit, r.rank, r.id) for r in ranked(ann.probed(celled, cells, queries, 5), 5).collect()} == exact
    # cells whose spans are not known are all read; of the others a query among close rows needs few
    unknown = ann.Cells(cells.centroids)
    assert {(r.unit, r.rank, r.id) for r in ranked(ann.probed(celled, unknown, queries, 5), 5).collect()} == exact
    q = near[:1] / np.linalg.norm(near[:1])
    assert cells.needed(q, np.array([-np.inf])).all() and cells.needed(q, np.array([0.999])).sum() < 34


def test_routing_and_debounce(spark):
    roots = spark.createDataFrame([("in", "/k/in", 1), ("all", "/k", 0)], "label string, dir string, ord int")
    paths = spark.createDataFrame([("/k/in/a.md",), ("/kx/a.md",), ("/k/b.md",)], "path string")
    assert {(r.path, r.label, r.rel_path) for r in changes.route_to_roots(paths, roots).collect()} == {("/k/in/a.md", "all", "in/a.md"), ("/kx/a.md", None, None), ("/k/b.md", "all", "b.md")}
    events = spark.createDataFrame([("p", 0), ("p", 3), ("p", 7), ("q", 1)], "path string, s int").select("path", F.timestamp_seconds("s").alias("ts"))
    assert sorted((r.path, r.events) for r in changes.debounce(events, 4).collect()) == [("p", 1), ("p", 2), ("q", 1)]


def test_stats_rollup(spark):
    df = spark.createDataFrame([Row(label="b", scanned=1, changed=1, removed=0, chunks_written=2, indexes=["x"]), Row(label="a", scanned=2, changed=0, removed=3, chunks_written=0, indexes=["y", "z"])])
    assert tuple(changes.stats_rollup(df).first()) == (3, 1, 3, 2, "a: y; a: z; b: x")


def test_listing(tmp_path):
    from quillmark.config import Root

    for name in ("a.md", "_u.md", ".h/x.md", ".git/x.md", "b.txt", "x.MD", "sub/c.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    os.symlink(tmp_path / "a.md", tmp_path / "link.md")
    found = [p[len(str(tmp_path)) + 1 :] for p in markdown.note_paths(Root("n", str(tmp_path)))]
    assert found == sorted([".h/x.md", "_u.md", "a.md", "sub/c.md"])
    assert markdown.changes_between({"a": [1], "b": [1]}, {"b": [2], "c": [1]}) == [("a", "removed"), ("b", "modified"), ("c", "created")]


# ---- problem 4


def refs(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, row int")


@pytest.mark.parametrize("blocks", [1, 64, 1 << 20])  # no filter at all, one far too small, one that fits
def test_orphans_equal_a_plain_anti_join(spark, blocks):
    parents = spark.range(3000).select(F.concat(F.lit("k"), F.col("id") * 2).alias("key"), F.lit("x").alias("row"))
    some = spark.range(6000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").cast("int").alias("row"))
    got = orphan_references(some, parents, "key", max_blocks=blocks)
    assert {r.row for r in got.collect()} == {i for i in range(6000) if i % 2}


def test_orphan_edge_cases(spark):
    parents = refs(spark, ("a", 1), ("a", 1), (None, 2))
    some = refs(spark, ("a", 1), ("b", 2), ("b", 2), (None, 3), ("", 4), ("x" * 100_000, 5))
    assert sorted(r.row for r in orphan_references(some, parents, "key").collect()) == [2, 2, 4, 5]
    assert sorted(r.row for r in orphan_references(some, parents.limit(0), "key").collect()) == [1, 2, 2, 4, 5]
    assert orphan_references(some.limit(0), parents, "key").count() == 0


@pytest.mark.parametrize("hot_rows", [100, 10**9])
def test_orphans_at_a_month_with_a_hot_key(spark, hot_rows):
    spans = [("a", 1, 3), ("a", 3, 4), ("a", 5, 5), ("a", 9, 12), ("b", 2, 2), ("b", 2, 2), ("c", 7, 6), (None, 1, 99)]
    parents = spark.createDataFrame(spans, "key string, since int, until int").withColumn("row", F.lit(0))
    merged = {tuple(r) for r in merged_spans(parents, "key").collect()}
    assert merged == {("a", 1, 5), ("a", 9, 12), ("b", 2, 2)}
    some = refs(spark, *[(k, m) for k in ("a", "b", "c", "d", None) for m in range(14)]).withColumnRenamed("row", "at")
    hot = spark.range(3000).select(F.lit("a").alias("key"), (F.col("id") % 2 * 6).cast("int").alias("at"))
    rows = some.unionByName(hot).withColumn("since", F.lit(1))
    there = lambda k, m: any(k == x and a <= m <= b for x, a, b in spans)
    expected = {(r.key, r["at"]): n for (r, n) in ((r, r.n) for r in rows.groupBy("key", "at").agg(F.count("*").alias("n")).collect()) if r.key and not there(r.key, r["at"])}
    got = orphan_references(rows, parents, "key", "at", hot_rows=hot_rows)
    assert {(r.key, r["at"]): r.n for r in got.groupBy("key", "at").agg(F.count("*").alias("n")).collect()} == expected and expected["a", 0] > 1500


def test_hot_keys_are_few_and_join_like_others(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"), "id")
    lookup = spark.range(0, 700, 2).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("v")).unionByName(spark.createDataFrame([("hot", 2), (None, 3)], "k string, v int"))
    assert [r.k for r in hot_keys(rows, ["k"], 100)] == ["hot"] and hot_keys(rows, ["k"]) == []
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = rows.join(lookup, ["k"], how)
        split = join_unique(rows, lookup, ["k"], how, 100)
        assert sorted(map(repr, split.collect())) == sorted(map(repr, plain.select(split.columns).collect()))
    # the hot rows pass no exchange: what is sorted by key leaves them out
    plan = join_unique(rows, lookup, ["k"], "inner", 100)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_only_the_filter_is_broadcast(spark, small):
    from quillmark.plans.orphan_queries import p4_found

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        found = p4_found(spark, small)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert joins and all("_block" in line for line in joins)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from quillmark.session import cut

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="checkpoint"):
        cut(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))))


def test_bloom_filter_has_no_false_negatives_and_a_bound(spark):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    blocks = bloom_blocks(2000)
    bloom = bloom_filter(keys, "key", blocks)
    assert might_exist(keys, "key", bloom, blocks, "m").where("not m").count() == 0
    strangers = spark.range(2000, 12000).select(F.col("id").cast("string").alias("key"))
    assert might_exist(strangers, "key", bloom, blocks, "m").where("m").count() < 500
    assert bloom_blocks(10**12) == 1 << 20 and bloom.count() <= blocks


def test_only_small_scans_are_dealt_out(spark, small):
    from quillmark.session import spread, table

    docs = table(spark, small, "documents")
    cores = spark.sparkContext.defaultParallelism
    assert spread(docs).rdd.getNumPartitions() >= cores and spread(docs).count() == docs.count()
    many = docs.repartition(3 * cores)
    assert spread(many)._jdf.equals(many._jdf) and spread(docs.groupBy("lang").count()).count() > 0


def test_pruned_bm25_is_exact_and_leaves_most_postings_alone(spark, monkeypatch):
    import random

    import numpy as np

    from quillmark.operators import lexical

    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(400)], k=rng.randint(1, 60))) for _ in range(300)]
    texts += texts[:20] * 6 + ["", None, "w0", "w0 w0 w0"] + [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts[20:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(3)
    queries = docs.where("id % 7 = 0").selectExpr("id unit", "text query").union(spark.createDataFrame([(-1, "w0 unknown"), (-2, "unknown"), (-3, None)], "unit bigint, query string"))
    for k in (1, 5, 500):
        want = lexical.ranked(lexical.bm25_scores(lexical.build_lexical_index(docs), queries), k).collect()
        for rows in (1 << 17, 50):
            monkeypatch.setattr(lexical, "POSTING_ROWS", rows)
            monkeypatch.setattr(lexical, "BOUND_ROWS", rows // 2)
            got = lexical.ranked(lexical.bm25_pruned(docs, queries, k), k).collect()
            key = lambda rs: sorted((r.unit, r.rank, r.id, round(r.score, 9)) for r in rs)
            assert key(got) == key(want) and len(got) > 50 * min(k, 5)
    # a unit whose copy is known needs the postings of few terms
    n = 2000
    rows, terms = np.repeat(np.arange(n), 8), np.array([[i % 1000 + 8, *range(7)] for i in range(n)]).ravel()
    held = lexical.TermSets([[0]], [f"w{i}" for i in range(1008)], np.r_[np.full(8, 0.01), np.full(1000, 5.0)], np.array([0, 8]), np.arange(8), 8.0, 1.2, 0.75)
    postings = lexical.Postings(rows, terms, np.full(n, 8.0), held)
    gone = []
    add = postings.add
    monkeypatch.setattr(postings, "add", lambda score, some: (gone.extend(some), add(score, some)))
    found, _ = postings.reaching(np.array([*range(7), 9]), float(postings.scores(np.array([1]), np.array([*range(7), 9]))[0]) - 1e-8)
    assert found.tolist() == [1, 1001] and sum(postings.count[gone]) == 2
