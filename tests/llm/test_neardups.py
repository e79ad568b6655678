import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.llm import neardups as N


def similarity(a, b):
    x, y = Counter(a), Counter(b)
    both = sum((x & y).values())
    return both / max(1, sum(x.values()) + sum(y.values()) - both)


def collection(seed, bases=12, copies=5, length=(40, 130), vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    texts = []
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(rng.randint(*length))]
        texts.append(base)
        for _ in range(copies):
            edited = base[:]
            for _ in range(rng.randint(0, len(base) // 5)):
                at, what = rng.randrange(len(edited)), rng.choice("dis")
                edited = edited[:at] + ([] if what == "d" else [rng.choice(words)]) + edited[at + (what != "i") :]
            rng.shuffle(edited)
            texts.append(edited)
    return texts


@pytest.mark.parametrize("task", [{}, {"task_bytes": 2000}, {"task_cost": 300}, {"hot_rows": 5, "task_bytes": 6000}])
@pytest.mark.parametrize("threshold", [0.75, 0.6])
def test_pairs_equal_brute_force(spark, threshold, task):
    texts = collection(int(threshold * 100))
    rows = [(f"d{i:03d}", ", ".join(t)) for i, t in enumerate(texts)]
    rows += [("copy", rows[0][1]), ("copy", rows[0][1]), ("null", None), (None, rows[1][1]), ("empty", ""), ("short", "a b c")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("n", F.lit(1)).withColumn("words", F.lit("x"))
    found = N.near_duplicates(df, "id", "text", 40, threshold, **task)
    got = sorted(map(tuple, found.pairs().collect()))
    known = {i: t.split(", ") for i, t in rows if i is not None and t is not None and len(t.split(", ")) >= 40}
    truth = sorted((a, b) for a in known for b in known if a < b and similarity(known[a], known[b]) >= threshold)
    assert got == truth and len(truth) > 10
    degrees = {r.id: r.links for r in found.degrees().collect()}
    assert degrees == {i: sum(i in p for p in truth) for i in known}


def test_very_long_texts(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    edited = [w if rng.random() > 0.1 else "changed" for w in base]
    df = spark.createDataFrame([("a", " ".join(base)), ("b", " ".join(edited)), ("c", " ".join(base[::-1][:17_000]))], "id string, text string")
    truth = sorted((x, y) for (x, s), (y, t) in (((p, q), (r, u)) for p, q in (("a", base), ("b", edited), ("c", base[::-1][:17_000])) for r, u in (("a", base), ("b", edited), ("c", base[::-1][:17_000]))) if x < y and similarity(s, t) >= 0.75)
    assert sorted(map(tuple, N.near_duplicates(df, "id", "text").pairs().collect())) == truth


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([("a", "too short"), ("b", None)], "id string, text string")
    found = N.near_duplicates(df, "id", "text")
    assert found.pairs().count() == 0 and found.degrees().count() == 0
    with pytest.raises(ValueError):
        N.near_duplicates(df, "id", "text", threshold=0)


def test_tasks_are_bounded_however_many_texts():
    rng = np.random.default_rng(3)
    share = rng.random(N.CODES) ** 8
    last = 0.0
    for texts in (10_000, 100_000, 1_000_000, 10_000_000, 100_000_000):
        plan = N.plan_instance(0, 80, 99, 0.75, (share * texts).astype(np.int64), texts)
        used = int((plan.allow > 0).sum())
        words = share.sum() / plan.groups
        spread = 1 if plan.parts == 1 else min(plan.parts, 1 + share.sum() / used) / plan.parts
        read = texts * (20 + 8 * plan.sketch_words + used / plan.groups + 2 * words) * spread
        assert read <= 1.05 * N.TASK_BYTES and N.GROUPS <= plan.groups <= used and (plan.parts == 1 or plan.groups == used)
        assert plan.groups * plan.parts >= last
        last = plan.groups * plan.parts


def test_copies_alone_are_pairs(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(f"d{i}", text) for i in range(4)], "id string, text string")
    assert N.near_duplicates(df, "id", "text").pairs().count() == 6


def test_elements_are_the_multiset_of_words():
    elements, offsets = N.word_elements(pa.array(["A b, a_B!", "", None, "b a b A", "Ünï 12"]))
    assert np.diff(offsets).tolist() == [4, 0, 0, 4, 2]
    assert elements[:4].tolist() == elements[4:8].tolist()
    back = N.unpack(N.pack(elements))
    assert (back >> np.uint64(24) == elements >> np.uint64(24)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 50)), min_size=3, max_size=9), st.data())
def test_allowances_are_cheapest(costs, data):
    import itertools

    first = np.array([a for a, _ in costs], float)
    second = first + np.array([b for _, b in costs])
    need = data.draw(st.integers(1, 2 * len(costs)))
    v = N.allowance(first, second, need)
    price = lambda c: sum((0, first[i], second[i])[x] for i, x in enumerate(c))
    assert v.sum() == need and price(v) == min(price(c) for c in itertools.product((0, 1, 2), repeat=len(costs)) if sum(c) == need)


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    for k in (0, 5, 60):
        b = np.concatenate([a[k:], rng.integers(0, 2**63, k).astype(np.uint64)])
        s = N.sketches(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 4)
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(np.setxor1d(a, b))


def test_rounds_bound_what_is_shuffled_at_once():
    rng = np.random.default_rng(3)
    share = rng.random(N.CODES) ** 8
    plans = [N.plan_instance(b, own, high, 0.75, (share * texts).astype(np.int64), texts) for b, own, high, texts in ((0, 80, 99, 10_000), (1, 100, 119, 3_000_000), (2, 120, 139, 400_000))]
    most = 1.5 * 5 * 100 * 3_410_000
    assert sum(p.tasks * p.task_bytes() for p in plans) > 4 * most
    rounds = N.plan_rounds(plans, most)
    assert all(sum((s.last - s.first) * s.inst.task_bytes() for s in r) <= most for r in rounds)
    done = [(s.inst.band, g, p) for r in rounds for s in r for g in s.groups() for p in range(*s.parts_of(g))]
    assert len(done) == len(set(done)) and set(done) == {(i.band, g, p) for i in plans for g in range(i.groups) for p in range(i.parts)}


@pytest.mark.parametrize("task", [{}, {"task_cost": 300}])
def test_rounds_lose_no_pair_and_leave_no_shuffle(spark, task):
    texts = collection(7)
    df = spark.createDataFrame([(f"d{i:03d}", " ".join(t)) for i, t in enumerate(texts)], "id string, text string")
    truth = sorted((f"d{i:03d}", f"d{j:03d}") for j in range(len(texts)) for i in range(j) if similarity(texts[i], texts[j]) >= 0.75)
    sets = N.cut(N.word_sets(df, "id", "text", 40))
    plans = N.plan_index(sets, 40, 0.75, **{"task_cost": N.TASK_COST} | task)
    most = sum(p.tasks * p.task_bytes() for p in plans) / 6
    assert len(N.plan_rounds(plans, most)) >= 6
    files = lambda: {f.getName() for f in _java_list(spark, spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle")}
    before = files()
    with N.dropped_shuffles(spark):
        N.cut(df.repartition(5, "id").groupBy("text").count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert sorted(map(tuple, N.near_duplicates(df, "id", "text", round_bytes=most, **task).pairs().collect())) == truth and len(truth) > 10


def _java_list(spark, seq):
    return list(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(seq))
