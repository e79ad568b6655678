import numpy as np
import pytest

from quillmark.llm import vectorgraph as V


def clustered(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 40), dim))
    return (centres[rng.integers(len(centres), size=n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)


def brute(values, ids, k, least):
    wide = np.asarray(values, np.float64)
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 6)
    out = {}
    for i, x in enumerate(ids):
        near = sorted((-cos[i, j], y) for j, y in enumerate(ids) if j != i and cos[i, j] >= least)
        out[x] = [y for _, y in near[:k]]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id string, vector array<float>, cell int, near string")
    return {r.id: [n.id for n in r.near] for r in V.nearest_lists(df, "id", "vector", **kw).collect()}


def test_graph_search_finds_what_brute_force_finds():
    unit = V.unit_vectors(clustered(3000, 32))
    g = V.build_graph(unit)
    assert (g.edges >= 0).sum(axis=1).max() <= V.DEGREE + V.SLACK
    found = V.search_all(g, unit, 6)
    sims = unit @ unit.T
    truth = np.argsort(-sims, axis=1)[:, :6]
    recall = np.mean([len(set(a) & set(b)) / 6 for a, b in zip(found, truth, strict=True)])
    assert recall >= 0.97


def test_pruning_keeps_diverse_edges():
    unit = V.unit_vectors(np.array([[1, 0, 0], [1, 0.01, 0], [1, 0.012, 0], [0, 0, 1]], np.float32))
    kept = V.robust_prune(unit, np.array([0]), np.array([[1, 2, 3, -1]], np.int32), degree=3)
    assert kept[0].tolist() == [1, 3, -1]  # 2 is nearer to 1 than to 0


@pytest.mark.parametrize("split", [{}, {"cell_rows": 120, "shard_rows": 60}, {"cell_rows": 60, "max_cells": 5}, {"cell_rows": 60, "shard_rows": 40, "max_cells": 5}])
def test_recall_against_brute_force(spark, split):
    values = clustered(900, 24, 3)
    ids = [f"{i * 7919 % 100003:06d}" for i in range(900)]
    got = run(spark, [(x, v.tolist(), 0, "n") for x, v in zip(ids, values, strict=True)], k=5, least=0.5, **split)
    truth = brute(values, ids, 5, 0.5)
    wanted = sum(map(len, truth.values()))
    assert set(got) == set(ids)
    assert sum(len(set(got[x]) & set(truth[x])) for x in ids) >= 0.97 * wanted


def test_edge_cases(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [("x", a), ("x", a), ("y", [2.0, 0.0, 0.0]), ("z", b), ("zero", [0.0] * 3), ("null", None), (None, a), ("nan", [float("nan"), 1.0, 0.0]), ("short", [1.0]), ("hole", [1.0, None, 0.0])]
    got = run(spark, [(i, v, 1, "c") for i, v in rows])
    assert got == {"x": ["y"], "y": ["x"], "z": []}
    assert run(spark, [("n", None, 1, "c")]) == {} and run(spark, []) == {}
    assert run(spark, [("only", a, 1, "c")]) == {"only": []}
    with pytest.raises(ValueError):
        run(spark, [("x", a, 1, "c")], k=0)


def test_copies_share_the_smallest_ids(spark):
    rows = [(f"c{i:02d}", [0.6, 0.8], 1, "x") for i in range(30)] + [("near", [0.61, 0.79], 1, "x"), ("far", [1.0, -0.5], 1, "x")]
    got = run(spark, rows)
    values = [r[1] for r in rows]
    assert got == brute(values, [r[0] for r in rows], 5, 0.75)
    assert run(spark, rows, k=20) == brute(values, [r[0] for r in rows], 20, 0.75)


@pytest.mark.parametrize("split", [{}, {"cell_rows": 120, "shard_rows": 60}, {"cell_rows": 40, "max_cells": 4}])
def test_of_many_equals_the_smallest_ids_come_first(spark, split):
    rng = np.random.default_rng(4)
    way = rng.normal(size=12)
    scaled = [way * s for s in rng.permutation(np.linspace(0.5, 3, 70))]  # one direction at many lengths
    beside = [way + 0.2 * rng.normal(size=12) for _ in range(20)]
    # 66 directions equally near to a common one
    even = [4.0 + (np.arange(12) == i) + (np.arange(12) == j) for i in range(12) for j in range(i)]
    values = np.concatenate([scaled, beside, even, [np.ones(12)], clustered(200, 12, 8)]).astype(np.float32)
    ids = [f"{i * 7919 % 100003:06d}" for i in range(len(values))]
    got = run(spark, [(x, v.tolist(), 0, "n") for x, v in zip(ids, values, strict=True)], **split)
    truth = brute(values, ids, 5, 0.75)
    tied = ids[:157]
    assert {x: got[x] for x in tied} == {x: truth[x] for x in tied}


def test_cells_fit_a_bounded_sample(spark):
    values = clustered(2000, 8, 5)
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(values)], "id string, vector array<float>")
    cells = V.fit_cells(df, cell_rows=200, shard_rows=50)
    assert len(cells.centroids) == 10 and cells.shards.max() > 1
    assert V.fit_cells(df.limit(0)) is None
    packed = V._planes(values)
    assert np.array_equal(V._from_planes(packed, 8), values)
