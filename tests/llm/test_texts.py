"""Problems 2, 3, 6, 7 and 8 on small fixtures, against plain Python versions."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.llm import cooccurrence as P3
from quillmark.llm import leaks as P7
from quillmark.llm import lookalikes as P8
from quillmark.llm import packing as P6
from quillmark.llm import splitting as P2

# ---- splitting


def rejoined(pieces):
    return "".join(p[back:] for p, back in pieces)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Sentence one. ", "line\n", "para\n\n", "x" * 90, "字。", "  ", "!? "]), max_size=200), st.integers(40, 200), st.integers(0, 19))
def test_split_is_a_round_trip_within_the_limit(parts, limit, overlap):
    text = "".join(parts)
    pieces = P2.split_text(text, limit, overlap)
    assert rejoined(pieces) == text and all(len(p) <= limit for p, _ in pieces)
    done = 0
    for (before, shared), (piece, back) in itertools.pairwise(pieces):
        done += len(before) - shared
        assert before.endswith(piece[:back]) and back == min(overlap, done)  # there may be less before it
    if len(text) > limit:
        assert all(p[back:] for p, back in pieces)


def test_cuts_where_the_topic_changes():
    cats = " ".join(f"The cat purrs and the cat sleeps number {i}." for i in range(12))
    boats = " ".join(f"A boat sails while a boat drifts number {i}." for i in range(12))
    text = f"{cats} {boats}"
    (cut, *_) = P2.split_points(text, 900, 50)
    assert abs(cut - len(cats) - 1) <= 1
    similar = P2.cohesion([s + "." for s in text.split(".") if s.strip()])
    assert int(np.argmin(similar)) == 11


def test_cohesion_equals_direct_counting():
    from collections import Counter

    rng = random.Random(4)
    parts = [" ".join(rng.choice("a b c d e".split()) for _ in range(rng.randint(0, 6))) for _ in range(40)]
    for i, got in enumerate(P2.cohesion(parts, 3), 1):
        a, b = (Counter(" ".join(x).split()) for x in (parts[max(0, i - 3) : i], parts[i : i + 3]))
        norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
        assert got == pytest.approx(sum(a[w] * b[w] for w in a) / norm if norm else 0.0)


def test_split_oversized_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "short", 0), (4, "y" * 100_000, 0), (5, "  " + "ab. " * 600 + "\n", 0), (5, "  " + "ab. " * 600 + "\n", 0), (6, "z" * 2000, 0), (7, "line\r\n" * 400, 0)]
    df = spark.createDataFrame(rows, "id int, text string, piece_ix int")
    got = P2.split_oversized(df, "text").collect()
    assert {r.id for r in got} == {4, 5}
    wall = sorted((r for r in got if r.id == 4), key=lambda r: r.piece_ix)
    assert rejoined([(r.piece, r.repeated_chars) for r in wall]) == "y" * 100_000
    assert sum(r.id == 5 and r.piece_ix == 0 for r in got) == 2
    assert max(len(r.piece) for r in got) <= 2000
    assert P2.split_oversized(df.limit(0), "text").count() == 0
    with pytest.raises(ValueError):
        P2.split_oversized(df, "text", 100, 60)


def test_sections_and_bodies(spark):
    notes = spark.createDataFrame([("n", "---\ntype: x\n---\n# A\n\nbody\n## B\n\n" + "w. " * 900, 7), ("m", None, 7)], "source_id string, raw_text string, ix int")
    assert [(r.heading_path, r.ix) for r in P2.sections_of(notes).orderBy("ix").collect()] == [("A", 0), ("A > B", 1)]
    body = spark.createDataFrame([("h\n\nb\n\nc",), ("h\r\n\r\nb",), ("no body",), (None,)], "t string").select(P2.chunk_body(F.col("t")).alias("b"))
    assert [r.b for r in body.collect()] == ["b\n\nc", "b", None, None]


# ---- co-occurrence


def brute_pairs(rows):
    baskets, held, both = {}, {}, {}
    for k, r, i in set(rows):
        if r is not None and i:
            baskets.setdefault((k, r), set()).add(i)
    for (k, _), items in baskets.items():
        for i in items:
            held[k, i] = held.get((k, i), 0) + 1
        for a, b in itertools.combinations(sorted(items), 2):
            both[k, a, b] = both.get((k, a, b), 0) + 1
    return held, both


@pytest.mark.parametrize("block", [2, 7, 256])
def test_cooccurrence_equals_brute_force(spark, block):
    rng = random.Random(block)
    rows = [("t", f"r{rng.randint(0, 40)}", f"i{min(rng.randint(0, 30), rng.randint(0, 30))}") for _ in range(600)]
    rows += [("e", "huge", f"i{i}") for i in range(50)] + [("t", None, "i1"), ("t", "r1", None), ("t", "r1", ""), ("t", "r1", "i1"), ("t", "r1", "i1")]
    held, both = brute_pairs(rows)
    df = spark.createDataFrame(rows, "kind string, record string, item string")
    n = 42
    got = {(r.kind, r.item_a, r.item_b): (r.both, r.held_a, r.held_b) for r in P3.cooccurring(df, n, 3, 1 / 500, 1.2, block).collect()}
    expected = {(k, a, b): (m, held[k, a], held[k, b]) for (k, a, b), m in both.items() if m >= 3 and m >= n / 500 and m * n >= 1.2 * held[k, a] * held[k, b]}
    assert got == expected and got
    hot = {(r.kind, r.item_a, r.item_b): (r.both, r.held_a, r.held_b) for r in P3.cooccurring(df, n, 3, 1 / 500, 1.2, block, hot_rows=10).collect()}
    assert hot == expected
    every = P3.cooccurring(df, n, 0, 0, 0, block)
    assert {(r.kind, r.item_a, r.item_b): r.both for r in every.collect()} == both
    assert P3.cooccurring(df.limit(0), 0).count() == 0


def test_pairs_of_a_text_with_many_copies_are_spread(spark):
    from quillmark.operators.skew import expand_pairs

    members = spark.range(60).select(F.col("id"), F.when(F.col("id") < 40, 1).when(F.col("id") < 50, 2).otherwise(3).alias("k"))
    links = spark.createDataFrame([(1, 2), (3, 2)], "a_k int, b_k int")
    for most, hot in ((7, 10**9), (7, 0), (10**6, 10**9)):
        got = expand_pairs(links, members, ["k"], most, hot)
        assert sorted(map(tuple, got.collect())) == sorted([(a, b) for a in range(40) for b in range(40, 50)] + [(b, c) for b in range(40, 50) for c in range(50, 60)])


def test_a_basket_of_a_third_of_all_rows_is_cut_into_products(spark):
    rows = spark.range(3000).select(F.lit("t").alias("kind"), F.when(F.col("id") < 1000, "big").otherwise(F.concat(F.lit("r"), F.col("id") % 400)).alias("record"), F.concat(F.lit("i"), F.col("id") % 1000).alias("item"))
    chunks = P3.basket_chunks(rows.distinct(), 64, 500).collect()
    big = [r for r in chunks if r.record == "big"]
    assert sum(r.x < r.y for r in big) == 16 * 15 // 2 and max(len(r.lefts) for r in big) < 128
    assert sum(len(r.lefts) for r in big if r.x == r.y) == 1000


@pytest.mark.parametrize(("record", "block"), [("source_id", P3.FILE_BLOCK), ("title", P3.BLOCK)])
def test_registered_queries_pass_through_products(spark, small, record, block):
    """Large baskets of the real tables are cut: their pairs come from products of chunks."""
    from quillmark.functions.columns import title_key
    from quillmark.session import table

    rows = P3._exploded(table(spark, f"{small}/../sf0.01", "chunks").select(record, "entities"), record, "entity", "entities", title_key)
    assert P3.basket_chunks(rows.where("record is not null and item <> ''").distinct(), block).where("x < y").count() > 0


# ---- packing


@pytest.fixture(scope="module")
def reviews(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(400)]
    return [*rows, (900, None), (901, ""), (902, "long text " * 900), (903, rows[0][1]), (5, rows[5][1]), (7, "another text of the same id"), (7, ""), (None, "lost")]


def test_packing_is_whole_and_tight(spark, reviews):
    df = spark.createDataFrame(reviews, "doc_id bigint, text string")
    got = P6.pack_texts(df, "doc_id", "text", shard_texts=200).collect()
    encode = P6.tokenizer().encode_ordinary
    keys = {(r.doc_id, r.text): r.k for r in df.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()}
    texts = {(i, keys[i, t]): t or "" for i, t in reviews if i is not None}
    sizes = {i: len(encode(t)) for i, t in texts.items()}
    by_doc, by_box = {}, {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.text_key), []).append((r.token_from, r.token_to))
        by_box.setdefault(r.container, []).append((r.slot, r.token_to - r.token_from))
    assert set(by_doc) == set(texts)
    for i, spans in by_doc.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == sizes[i] and all(a[1] == b[0] for a, b in itertools.pairwise(spans))
        assert len(spans) == 1 or sizes[i] > P6.CAPACITY
    for box in by_box.values():
        assert sorted(s for s, _ in box) == list(range(len(box))) and sum(n for _, n in box) <= P6.CAPACITY
    used = sum(sizes.values())
    assert used / (len(by_box) * P6.CAPACITY) > 0.95
    assert P6.pack_texts(df.limit(0), "doc_id", "text").count() == 0


def test_neighbours_come_in_order_of_score():
    terms = [np.array(t, np.int64) for t in ([1, 2], [1, 2, 3], [2], [9])]
    weights = [np.array(w, np.float32) for w in ([1, 1], [1, 2, 1], [1.5], [1])]
    index = P6.ShardIndex(terms, weights)
    assert index.neighbours(terms[0], np.array([False, True, True, True])).tolist() == [1, 2]
    assert index.neighbours(np.array([77]), np.ones(4, bool)).tolist() == [] == index.neighbours(np.array([5]), np.ones(4, bool)).tolist()
    assert P6.pack_shard(np.array([300, 200, 212, 10]), index, terms, 512) == [[0, 1, 3], [2]]
    assert P6.pack_shard(np.array([], int), P6.ShardIndex([], []), [], 512) == []


def test_shards_keep_like_texts_together_and_split_copies(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(0).cast("bigint").alias("text_key"), F.when(F.col("id") < 400, 7).otherwise(F.col("id") % 30).cast("int").alias("telling"))
    held = {}
    for r in P6.similar_shards(rows, 50).collect():
        held.setdefault(r.shard, []).append(r.telling)
    assert sum(map(len, held.values())) == 1000 and max(map(len, held.values())) < 90
    assert all(len({s for s, ts in held.items() if t in ts}) == 1 for t in range(30) if t != 7)


def test_weights_are_those_of_bm25(spark):
    texts = ["the cache expires", "the the cache", "the router", "", None, "lonely"]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id bigint, text_key bigint, text string")
    vectors = P6.text_vectors(df)
    corpus = P6.corpus_of(vectors)
    row = vectors.where("doc_id = 1").first()
    codes, tf, words = P6._vectors_of([row.codes], [row.tf])
    lengths = [len((t or "").split()) for t in texts]
    mean = sum(lengths) / len(texts)
    weight = lambda n, df: np.log(1 + (6 - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * 3 / mean))
    assert sorted(corpus.weights(codes, tf, np.array([3] * len(codes))).tolist()) == pytest.approx(sorted([weight(2, 3), weight(1, 2)]), rel=1e-5)
    assert corpus.texts == 6 and words.tolist() == [2] and row.len == 3 and row.tokens == 3
    told = {r.doc_id: r.telling for r in P6.with_telling(vectors, spark.sparkContext.broadcast(corpus)).collect()}
    assert None not in (told[0], told[1], told[2]) and told[3] is told[4] is told[5] is None


# ---- leaks


def levenshtein_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=90), st.lists(st.integers(0, 3), max_size=60))
def test_myers_equals_dynamic_programming(pattern, text):
    assert P7.myers(pattern, text) == levenshtein_within(pattern, text)
    if len(pattern) <= 63:
        used = np.array([[False, *[True] * len(text), False]])
        assert P7.myers_rows(np.array([pattern]), np.array([[7, *text, 7]]), used).tolist() == [levenshtein_within(pattern, text)]


@pytest.mark.parametrize("hot_rows", [30, 10**9])
def test_leaks_equal_brute_force(spark, hot_rows):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(8)] + [(50, "too short"), (51, None), (None, "x y z")]
    docs = []
    for d in range(120):
        item = items[rng.randrange(8)][1].split()
        start, length = rng.randrange(25), rng.randint(9, 15)
        part = item[start : start + length]
        for _ in range(rng.randint(0, 2)):
            at, what = rng.randrange(len(part)), rng.choice("dis")
            part = part[:at] + ([] if what == "d" else [rng.choice(words)]) + part[at + (what != "i") :]
        docs.append((d, " ".join([*(rng.choice(words) for _ in range(rng.randint(0, 10))), *part, *(rng.choice(words) for _ in range(5))]).upper()))
    docs += [(500, None), (501, ""), (None, items[0][1]), (3, docs[3][1]), (502, "ｗ１ " * 5 + items[0][1].replace(" ", " ") + " end" * 50_000)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    i = spark.createDataFrame([*items, items[2]], "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    for edits in (0, 1, 2):
        truth = {}
        for item_id, text in items:
            w = P7.words(text or "")
            for doc_id, body in docs[:120]:
                b = P7.words(body)
                best = min((levenshtein_within(w[s : s + 12], b) for s in range(len(w) - 11)), default=99) if item_id is not None else 99
                if best <= edits:
                    truth[item_id, doc_id] = min(best, truth.get((item_id, doc_id), 99))
        got = {(r.item_id, r.doc_id): r.edits for r in P7.find_leaks(d, i, max_edits=edits, hot_rows=hot_rows).collect()}
        assert got.pop((0, 502)) == 0
        assert {k: v for k, v in got.items() if k[1] < 500} == truth and truth
    assert P7.find_leaks(d.limit(0), i).count() == 0 and P7.find_leaks(d, i.limit(0)).count() == 0


# ---- look-alikes


def forms(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, form string")
    return [r.form for r in P8.canonical_text(df, "text", "form").orderBy("id").collect()]


@pytest.mark.parametrize(
    ("same", "as_"),
    [
        ("Ｆｕｌｌ　ｗｉｄｔｈ！", "Full width!"), ("ﬁne ﬂow", "fine flow"), ("été", "été"), ("раураl", "paypal"), ("ΑΒΕ", "ABE"),
        ("a​b­c﻿", "abc"), ("Ⅳ ⅱ", "IV ii"), ("Tr\u0435\u0300\u0455", "Très"), ("\u0450 \u1f78", "è ò"), ("\u045e", "y\u0306"), ("\u0443\u0306", "y\u0306"), ("\u0439", "\u0438\u0306"), ("non\u2011stop", "non-stop"), ("ⲤᎪꓰ", "CAE"), ("ĳs ⼀", "ijs 一"), ("\U0001f468\u200b\u200d\U0001f469", "\U0001f468\u200d\U0001f469"), ("\U0001f44d\u200d\U0001f44d", "\U0001f44d\U0001f44d"), ("a\U000e0041b", "ab"), ("a b c\td", "a b c d"), ("ｶﾞ", "ガ"), ("ё", "ë"), ("е́", "é"), ("a\r\nb", "a\nb"), ("❤️", "❤"),
    ],
)
def test_same_look_same_form(spark, same, as_):
    a, b = forms(spark, [same, as_])
    assert a == b


def test_what_a_reader_sees_stays(spark):
    seen = ["resume", "résumé", "Resume", "resume.", "resume!", "re sume", "re\nsume", "res0me", "resOme", "x2", "x²", "", None]
    got = forms(spark, seen)
    assert len(set(got)) == len(seen) and got[-1] is None and got[-2] == ""
    assert forms(spark, ["я" * 200_000 + " "]) == ["я" * 200_000 + " "]
    assert forms(spark, []) == []


def test_joined_pictographs_are_seen(spark):
    family, apart = "\U0001f468\u200d\U0001f469\u200d\U0001f467", "\U0001f468\U0001f469\U0001f467"
    a, b, c, d = forms(spark, [family, apart, apart + "\u200d", "a\u200d" + apart])
    assert a == family != b and b == c and d == "a" + apart
    flag = lambda region: "\U0001f3f4" + "".join(chr(0xE0000 + ord(x)) for x in region) + "\U000e007f"
    assert forms(spark, [flag("gbsct"), flag("gbeng") + "\U000e0041"]) == [flag("gbsct"), flag("gbeng")]


def test_lookalike_pairs(spark):
    rows = [(1, "café"), (2, "café"), (3, "café"), (4, "cafe"), (5, None), (None, "café"), (2, "café"), (6, ""), (7, "​")]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("form", F.lit(1)).withColumn("f1", F.lit(2))
    assert sorted(map(tuple, P8.lookalike_pairs(df, "id", "text").collect())) == [(1, 2), (1, 3), (6, 7)]
    classes = {r.id: (r.class_id, r.class_rows) for r in P8.lookalike_classes(df.where("id is not null").distinct(), "id", "text").collect()}
    assert classes == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1), 6: (6, 2), 7: (6, 2)}
    assert P8.lookalike_pairs(df.limit(0), "id", "text").count() == 0


def test_tables_are_one_to_one_where_they_must_be():
    one, more = P8.presentation_forms()
    assert one["Ａ"] == "A" and more["ﬃ"] == "ffi" and "²" not in one and "①" not in one
    looks = P8.lookalike_map()
    assert looks["а"] == "a" and all(len(k) == len(v) == 1 for k, v in looks.items())
