"""Most similar vectors for every vector (problem 1): robust-pruned directed graphs over shards.

Vectors go to the cell of their nearest centroid and to near-by cells, each cell is a shard or several; where
one level of centroids would be too many, each of its cells is cut into cells of its own. In a shard a directed graph grows by batches: greedy beam searches on the graph so far propose neighbours, relaxed
distance pruning keeps diverse edges, reverse edges are added and pruned likewise. Then every vector of the
shard is searched for on the finished graph by beam search, and the shards' lists are merged.

Searches go in blocks of near-by queries that share their frontier: each step takes the best unexpanded nodes
of all beams, and one matrix product compares the block with their unseen neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.config import COSINE_GATE
from quillmark.operators.skew import join_unique
from quillmark.session import cut, table

#: Vectors a cell has on average, and the most a shard may have by the sample's estimate.
CELL_ROWS, SHARD_ROWS = 4096, 24_576
#: Centroids are fitted on this many vectors for each cell. One level has at most so many cells, which bounds the
#: sample on the driver; with more, the square root of their number is fitted there, and each of these is cut
#: again by a task. Two levels hold for some 10^10 vectors, at MAX_CELLS^2 cells of CELL_ROWS.
SAMPLE_PER_CELL, MAX_CELLS = 48, 1024
#: Rows that are routed to the cells of the second level at once, and tasks the shards go to at most.
ROUTE_ROWS, MAX_TASKS = 32_768, 20_000
#: A vector also belongs to the next cells whose centroid is nearly as similar.
CLOSURE, MAX_CELLS_OF_ROW = 0.05, 3
#: Out-degree kept by pruning, slack before reverse edges are pruned, beam width, relaxation, queries a block.
DEGREE, SLACK, BEAM, ALPHA, BLOCK = 24, 12, 32, 1.2, 96
#: Neighbours from its own batch that are proposed to a node besides those found on the graph.
BATCH_MATES = 8
#: Ids of exact copies that travel with their vector, and at least k + 1; further copies take over the list of the
#: last of these.
COPIES = 6


# ---------------------------------------------------------------- graph of one shard


@dataclass
class Graph:
    vectors: np.ndarray  # unit length, float32
    edges: np.ndarray  # (nodes, DEGREE + SLACK), -1 where there is none
    pivots: np.ndarray  # nodes searches may start from


def locality(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """An order in which near-by vectors stand together: by nearest pivot, pivots chained by similarity."""
    if len(pivots) < 2:
        return np.arange(len(vectors))
    close = vectors @ pivots.T
    nearest = close.argmax(axis=1)
    among = pivots @ pivots.T
    chain, left = [0], np.ones(len(pivots), bool)
    left[0] = False
    while left.any():
        step = np.where(left, among[chain[-1]], -np.inf).argmax()
        chain.append(int(step))
        left[step] = False
    rank = np.empty(len(pivots), np.int64)
    rank[chain] = np.arange(len(pivots))
    return np.lexsort((-close[np.arange(len(vectors)), nearest], rank[nearest]))


def beam_search(g: Graph, queries: np.ndarray, starts: np.ndarray, beam: int = BEAM, step: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the ``beam`` best nodes met for each query of a block, best first; -1 pads."""
    n, width = len(g.vectors), len(queries)
    seen = np.zeros(n, bool)
    expanded = np.zeros(n, bool)
    nodes = np.full((width, beam), -1, np.int32)
    sims = np.full((width, beam), -np.inf, np.float32)
    fresh = np.unique(starts)
    while len(fresh):
        seen[fresh] = True
        got = queries @ g.vectors[fresh].T
        all_sims = np.concatenate([sims, got], axis=1)
        if all_sims.shape[1] > beam:
            pick = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        else:
            pick = np.broadcast_to(np.arange(beam), (width, beam))
        old = pick < beam
        nodes = np.where(old, np.take_along_axis(nodes, np.where(old, pick, 0), 1), fresh[np.where(old, 0, pick - beam)].astype(np.int32))
        sims = np.take_along_axis(all_sims, pick, 1)
        fresh = np.zeros(0, np.int64)
        while not len(fresh):
            open_sims = np.where((nodes >= 0) & ~expanded[nodes], sims, -np.inf)
            best = np.argpartition(-open_sims, step - 1, axis=1)[:, :step] if beam > step else np.broadcast_to(np.arange(beam), (width, beam))
            chosen = np.take_along_axis(nodes, best, 1)[np.take_along_axis(open_sims, best, 1) > -np.inf]
            if not len(chosen):
                break
            mark = np.zeros(n, bool)
            mark[chosen] = True
            expanded |= mark
            reach = g.edges[np.flatnonzero(mark)].ravel()
            mark[:] = False
            mark[reach[reach >= 0]] = True
            mark &= ~seen
            fresh = np.flatnonzero(mark)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)


def robust_prune(vectors: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each node at most ``degree`` of its candidates (-1 pads): the nearest one left is kept, and those
    that are ``alpha`` times nearer to it than to the node are dropped, again and again."""
    out = np.full((len(nodes), degree), -1, np.int32)
    for a in range(0, len(nodes), 512):
        node, cand = nodes[a : a + 512], candidates[a : a + 512]
        near = vectors[np.maximum(cand, 0)]
        alive = (cand >= 0) & (cand != node[:, None])
        from_node = 2 - 2 * np.matmul(near, vectors[node][:, :, None])[:, :, 0]
        order = np.argsort(np.where(alive, from_node, np.inf), axis=1, kind="stable")
        cand, from_node, alive = (np.take_along_axis(x, order, 1) for x in (cand, from_node, alive))
        near = np.take_along_axis(near, order[:, :, None], 1)
        between = (2 - 2 * np.matmul(near, near.transpose(0, 2, 1))) * np.float32(alpha)
        rows = np.arange(len(node))
        for k in range(degree):
            first = alive.argmax(axis=1)
            any_left = alive[rows, first]
            if not any_left.any():
                break
            out[a + rows[any_left], k] = cand[rows[any_left], first[any_left]]
            alive &= between[rows, first] > from_node
            alive[rows, first] = False
    return out


def _add_reverse(g: Graph, sources: np.ndarray, targets: np.ndarray, degree: int, alpha: float) -> None:
    """Edges target -> source; where a target's list would overflow, old and new are pruned together."""
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    at, start, count = np.unique(targets, return_index=True, return_counts=True)
    have = (g.edges[at] >= 0).sum(axis=1)
    room = have + count <= g.edges.shape[1]
    fits = np.repeat(room, count)
    rank = np.arange(len(targets)) - np.repeat(start, count)
    g.edges[targets[fits], (np.repeat(have, count) + rank)[fits]] = sources[fits]
    full = np.flatnonzero(~room)
    for a in range(0, len(full), 1024):
        some = full[a : a + 1024]
        most = int(count[some].max())
        new = np.full((len(some), most), -1, np.int32)
        for i, f in enumerate(some):
            new[i, : count[f]] = sources[start[f] : start[f] + count[f]]
        if most > 2 * degree:  # the nearest of many
            sims = np.empty(new.shape, np.float32)
            for i, f in enumerate(some):
                sims[i] = np.where(new[i] >= 0, g.vectors[new[i]] @ g.vectors[at[f]], -np.inf)
            new = np.take_along_axis(new, np.argsort(-sims, axis=1)[:, : 2 * degree], 1)
        kept = robust_prune(g.vectors, at[some], np.concatenate([g.edges[at[some]], new], axis=1), degree, alpha)
        g.edges[at[some]] = -1
        g.edges[at[some], :degree] = kept


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, block: int = BLOCK, seed: int = 7) -> Graph:
    """The pruned graph over unit vectors, grown in batches in an order that stands for a random one."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    turn = rng.permutation(n)
    g = Graph(vectors, np.full((n, degree + SLACK), -1, np.int32), turn[: max(1, int(np.sqrt(n)))])
    done = min(n, 4 * degree)
    first = turn[:done]
    g.edges[first, :degree] = robust_prune(vectors, first, np.broadcast_to(first.astype(np.int32), (done, done)).copy(), degree, alpha)
    while done < n:
        batch = turn[done : done + min(done, max(512, n // 8))]
        pivots = g.pivots[:done]
        batch = batch[locality(vectors[batch], vectors[pivots])]
        proposed = np.full((len(batch), beam + BATCH_MATES), -1, np.int32)
        for a in range(0, len(batch), block):
            own = batch[a : a + block]
            proposed[a : a + block, :beam] = beam_search(g, vectors[own], start_nodes(g, vectors[own], pivots), beam)[0]
            # nodes of one batch cannot meet on the graph yet; their block's nearest are proposed as well
            mates = vectors[own] @ vectors[own].T
            np.fill_diagonal(mates, -np.inf)
            near = np.argsort(-mates, axis=1)[:, : min(BATCH_MATES, len(own) - 1)]
            proposed[a : a + block, beam : beam + near.shape[1]] = own[near]
        kept = robust_prune(vectors, batch, proposed, degree, alpha)
        g.edges[batch, :degree] = kept
        source, k = np.nonzero(kept >= 0)
        _add_reverse(g, batch[source], kept[source, k], degree, alpha)
        done += len(batch)
    _link_unreached(g)
    return g


def _link_unreached(g: Graph) -> None:
    """An edge to every node that pruning has left without one, from the nearest node it points to."""
    reached = np.zeros(len(g.vectors), bool)
    reached[g.edges[g.edges >= 0]] = True
    for node in np.flatnonzero(~reached & (g.edges[:, 0] >= 0)):
        near = g.edges[node, 0]
        free = np.flatnonzero(g.edges[near] < 0)
        g.edges[near, free[0] if len(free) else -1] = node


def start_nodes(g: Graph, queries: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivots nearest to the block's queries, with the first as the common entry."""
    close = queries @ g.vectors[pivots].T
    return np.unique(np.concatenate([pivots[:1], pivots[np.unique(close.argmax(axis=1))]]))


def search_all(g: Graph, queries: np.ndarray, k: int, beam: int = BEAM, block: int = BLOCK, nodes_of: np.ndarray | None = None) -> np.ndarray:
    """(queries, k) nearest nodes by beam search, -1 pads. nodes_of: the node a query is itself, or -1; its
    search starts there as well."""
    out = np.full((len(queries), k), -1, np.int32)
    order = locality(queries, g.vectors[g.pivots])
    for a in range(0, len(queries), block):
        some = order[a : a + block]
        starts = start_nodes(g, queries[some], g.pivots)
        if nodes_of is not None:
            starts = np.concatenate([starts, nodes_of[some][nodes_of[some] >= 0]])
        nodes, _ = beam_search(g, queries[some], starts, max(beam, k))
        out[some] = nodes[:, :k]
    return out


# ---------------------------------------------------------------- cells


@dataclass
class Cells:
    """Centroids of the cells, into how many shards each cell is split, and into how many cells of a second level;
    fitted on a bounded sample."""

    centroids: np.ndarray
    shards: np.ndarray
    dim: int
    split: np.ndarray | None = None

    def of(self, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, cells) of the nearest cell, then of the next ones within the closure."""
        close = unit @ self.centroids.T
        most = min(MAX_CELLS_OF_ROW, close.shape[1])
        order = np.argsort(-close, axis=1, kind="stable")[:, :most]
        sims = np.take_along_axis(close, order, 1)
        near = sims >= sims[:, :1] - CLOSURE
        return [(rows := np.flatnonzero(near[:, j]), order[rows, j]) for j in range(most)]

    def spread(self, unit: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, shard, member): every shard a row is searched in; it is a node of one shard of each cell."""
        at, cell, shard, member = [], [], [], []
        for r, c in self.of(unit):
            count = self.shards[c]
            for s in range(int(count.max(initial=0))):
                some = count > s
                at.append(r[some])
                cell.append(c[some])
                shard.append(np.full(some.sum(), s))
                member.append(h[r[some]].view(np.uint64) % count[some].astype(np.uint64) == s)
        return tuple(map(np.concatenate, (at, cell, shard, member)))


def as_matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values): the usable vectors of an Arrow list column: of that length, finite, without nulls, not zero."""
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == dim)
    flat = vectors.take(pa.array(rows)).flatten()
    values = np.asarray(flat.cast(pa.float32()).fill_null(np.nan)).reshape(len(rows), dim)
    good = np.isfinite(values).all(axis=1) & values.any(axis=1)
    return rows[good], values[good]


def unit_vectors(values: np.ndarray) -> np.ndarray:
    wide = values.astype(np.float64)
    return (wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]).astype(np.float32)


def spherical_means(unit: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    means = unit[rng.choice(len(unit), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = (unit @ means.T).argmax(axis=1)
        order = np.argsort(nearest, kind="stable")
        at, start = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(unit[order], start, axis=0)
        means[at] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        empty = np.setdiff1d(np.arange(k), at)
        means[empty] = unit[rng.choice(len(unit), len(empty))]
    return means


def _sampled(vectors: DataFrame, share: float) -> DataFrame:
    """About that share of the rows, by a hash of their ids."""
    usable = vectors.where(F.col("vector").isNotNull())
    return usable if share >= 1 else usable.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1_000_000_000)) < int(1e9 * share) + 1)


def _shards_of(fitted: Cells, unit: np.ndarray, rows: float, shard_rows: int) -> np.ndarray:
    """How many shards each cell takes, if the sample stands for so many rows."""
    share = sum(np.bincount(c, minlength=len(fitted.centroids)) for _, c in fitted.of(unit)) / len(unit)
    return np.maximum(1, np.ceil(share * rows / shard_rows)).astype(np.int64)


def fit_cells(vectors: DataFrame, cell_rows: int = CELL_ROWS, shard_rows: int = SHARD_ROWS, max_cells: int = MAX_CELLS) -> Cells | None:
    """The first level of cells, from a sample of at most 2 * SAMPLE_PER_CELL * max_cells vectors, taken by a hash of
    the vectors' ids. The index itself takes in every vector. A cell that would outgrow a shard is split by hash
    into several; where more than max_cells are wanted, ``split`` tells how many each is cut into."""
    rows = vectors.count()
    wanted_cells = max(1, round(rows / cell_rows))
    cells = wanted_cells if wanted_cells <= max_cells else min(max_cells, int(np.ceil(np.sqrt(wanted_cells))))
    wanted = max(1024, SAMPLE_PER_CELL * cells)
    sample = _sampled(vectors, wanted / rows if rows > 2 * wanted else 1)
    got = sample.select("vector").limit(2 * wanted).toArrow().column(0).combine_chunks()
    if isinstance(got, pa.ChunkedArray):
        got = pa.concat_arrays(got.chunks) if got.num_chunks else pa.array([], pa.list_(pa.float32()))
    lengths = np.asarray(got.value_lengths().fill_null(0)) if len(got) else np.zeros(0, int)
    if not lengths.any():
        return None
    dim = int(np.bincount(lengths[lengths > 0]).argmax())
    _, values = as_matrix(got, dim)
    if not len(values):
        return None
    values = values[np.lexsort(values.T[:8])]  # the same cells in whatever order the sample came
    unit = unit_vectors(values)
    means = spherical_means(unit, min(cells, len(unit)))
    fitted = Cells(means, np.ones(len(means), np.int64), dim)
    if cells == wanted_cells:
        fitted.shards = _shards_of(fitted, unit, rows, shard_rows)
    else:
        share = np.bincount(fitted.of(unit)[0][1], minlength=len(means)) / len(unit)
        fitted.split = np.clip(np.rint(share * rows / cell_rows), 1, max_cells).astype(np.int64)
        fitted.shards = np.maximum(1, np.ceil(1.5 * share * rows / ROUTE_ROWS)).astype(np.int64)  # parts routed alone
    return fitted


def fit_second(vectors: DataFrame, shared, rows: int, shard_rows: int) -> DataFrame:
    """(cell, centroids binary, shards binary): the second level of every cell, fitted by a task a cell on about
    SAMPLE_PER_CELL vectors for each of its cells, at most 2 * SAMPLE_PER_CELL * MAX_CELLS."""
    dim, split = shared.value.dim, shared.value.split

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, values = as_matrix(batch.column(0), dim)
            if len(values):
                _, cell = shared.value.of(unit_vectors(values))[0]
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(_planes(values), pa.binary())], names=["cell", "vec"])

    def fit(key: tuple, group: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        packed = sorted(group.column("vec").to_pylist())[: 2 * SAMPLE_PER_CELL * int(split[cell]) + 1024]
        unit = unit_vectors(_from_planes(packed, dim))
        fitted = Cells(spherical_means(unit, min(int(split[cell]), len(unit))), np.zeros(0), dim)
        # the sample stands for the cell's share of all rows
        shards = _shards_of(fitted, unit, group.num_rows * per_row, shard_rows)
        return pa.table({"cell": pa.array([cell], pa.int32()), "centroids": pa.array([fitted.centroids.astype(np.float32).tobytes()], pa.binary()), "shards": pa.array([shards.tobytes()], pa.binary())})

    share = min(1.0, SAMPLE_PER_CELL * float(split.sum()) / rows)
    per_row = 1 / share
    placed = _sampled(vectors, share).select("vector").mapInArrow(place, "cell int, vec binary")
    return placed.groupBy("cell").applyInArrow(fit, "cell int, centroids binary, shards binary")


# ---------------------------------------------------------------- operator


def _planes(values: np.ndarray) -> list[bytes]:
    """Each vector's bytes by significance, so that the zeros of rounded values stand together and compress."""
    n, dim = values.shape
    turned = np.ascontiguousarray(values.view(np.uint8).reshape(n, dim, 4).transpose(0, 2, 1)).reshape(n, 4 * dim)
    return [r.tobytes() for r in turned]


def _from_planes(packed: list[bytes], dim: int) -> np.ndarray:
    turned = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), 4, dim).transpose(0, 2, 1)
    return np.ascontiguousarray(turned).reshape(len(packed), 4 * dim).view(np.float32)


def shared_directions(unit: np.ndarray, seed: int = 13) -> np.ndarray:
    """Which of the vectors point the way another one does, told by four projections."""
    turned = np.round(unit.astype(np.float64) @ np.random.default_rng(seed).normal(size=(unit.shape[1], 4)), 5)
    _, at, count = np.unique(turned, axis=0, return_inverse=True, return_counts=True)
    return (count > 1)[at.ravel()]


def scan_nodes(wide: np.ndarray, length: np.ndarray, own: np.ndarray, first_ids: list[str], rows: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) nodes by comparing the rows with all of them: by rounded cosine, then by smallest id; -1 pads."""
    rank = np.empty(len(own), np.int64)
    rank[sorted(range(len(own)), key=first_ids.__getitem__)] = np.arange(len(own))
    nodes, out = wide[own], np.full((len(rows), n), -1, np.int32)
    for a in range(0, len(rows), 64):
        some = rows[a : a + 64]
        cosine = wide[some] @ nodes.T / (length[some][:, None] * length[own])
        key = np.where(own == some[:, None], np.iinfo(np.int64).max, -np.rint(cosine * 1e6).astype(np.int64) * len(own) + rank)
        most = min(n, len(own))
        out[a : a + 64, :most] = np.argpartition(key, most - 1, axis=1)[:, :most]
    return out


def shard_lists(values: np.ndarray, ids: list[list[str]], members: np.ndarray, k: int, least: float) -> Iterator[tuple[str, list[tuple[int, str]]]]:
    """For every id of a shard its k nearest ids there as (minus the cosine in millionths, id). A row whose list
    the nodes found do not settle is compared with all nodes: where the last one found ties with the k-th, where
    one that counts shares its direction with others, and where the search met too few."""
    unit = unit_vectors(values)
    own = np.flatnonzero(members)
    graph = build_graph(np.ascontiguousarray(unit[own]))
    # beyond the k wanted, some more are compared exactly, as rounding and ids decide between equals
    nodes_of = np.where(members, np.cumsum(members) - 1, -1)
    most = 2 * k + 2
    found = search_all(graph, unit, most, nodes_of=nodes_of)
    shared = shared_directions(unit[own])
    wide = values.astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", wide, wide))

    def compared(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        other = np.where(found[some] >= 0, own[np.maximum(found[some], 0)], some[:, None])
        cosine = np.einsum("ijk,ik->ij", wide[other], wide[some]) / (length[other] * length[some][:, None])
        usable = (found[some] >= 0) & (other != some[:, None])
        return other, np.rint(cosine * 1e6).astype(np.int64), usable, (np.round(cosine, 6) >= least) & usable

    for a in range(0, len(values), 1024):
        some = np.arange(a, min(a + 1024, len(values)))
        other, millionths, usable, enough = compared(some)
        if len(own) > most:
            # a millionth to spare: the order of the search is that of float
            limit = np.maximum(np.partition(np.where(usable, millionths, -2_000_000), -k, axis=1)[:, -k], np.int64(np.floor(least * 1e6))) - 1
            open_rows = (found[some] < 0).any(axis=1) | (np.where(usable, millionths, 2_000_000).min(axis=1) >= limit)
            open_rows |= (shared[np.maximum(found[some], 0)] & (found[some] >= 0) & (~usable | (millionths >= limit[:, None]))).any(axis=1)
            if open_rows.any():
                found[some[open_rows]] = scan_nodes(wide, length, own, [ids[o][0] for o in own], some[open_rows], most)
                other, millionths, usable, enough = compared(some)
        for i, row in enumerate(some):
            near = sorted((-int(millionths[i, j]), x) for j in np.flatnonzero(enough[i]) for x in ids[other[i, j]])
            copies = [(-1_000_000, x) for x in ids[row]] if least <= 1 else []
            for x in ids[row]:
                yield x, [p for p in (sorted(copies + near)[: k + 1] if len(copies) > 1 else near) if p[1] != x][:k]


def nearest_lists(df: DataFrame, id_column: str, vector_column: str, k: int = 5, least: float = COSINE_GATE, cell_rows: int = CELL_ROWS, shard_rows: int = SHARD_ROWS, max_cells: int = MAX_CELLS) -> DataFrame:
    """(id string, near array<struct<neg:bigint,id:string>>): for every usable vector its at most k nearest
    others with a cosine of at least ``least``, nearest first; neg is minus the cosine in millionths.

    The cosine is computed in double, rounded to 6 decimals; of equal ones the smaller id comes first, however
    many are equal: what the graph leaves undecided is settled by a scan of the shard. Null
    ids, and vectors that are null, all zero, not finite, with null elements or of a length other than the
    usual one take no part. Repeated rows count once. Copies of a vector are one node that carries the
    smallest k + 1 ids or more; further copies take the list of the last of these, which is theirs as well. A
    vector without near ones has an empty list. No usable vector: no rows. Other columns are ignored.

    Beyond max_cells cells, rows are routed in two steps, the second one a part of a cell at a time. So a row is
    sent to a few shards however many rows there are, and neither the driver nor a broadcast grows with them.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark, carried = df.sparkSession, max(COPIES, k + 1)
    vectors = df.select(F.col(id_column).cast("string").alias("id"), F.col(vector_column).cast("array<float>").alias("vector")).where("id is not null and vector is not null")
    empty = "id string, near array<struct<neg:bigint,id:string>>"
    cells = fit_cells(vectors, cell_rows, shard_rows, max_cells)
    if cells is None:
        return spark.createDataFrame([], empty)
    shared = spark.sparkContext.broadcast(cells)
    columns = "cell int, sub int, shard int, member boolean, ids array<string>, vec binary, h bigint"
    names_of = [c.split()[0] for c in columns.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            rows, values = as_matrix(batch.column(1), cells.dim)
            if not len(rows):
                continue
            names = batch.column(0).take(pa.array(rows)).to_pylist()
            h = np.asarray(batch.column(2)).view(np.int64)[rows]
            ids: dict[bytes, set[str]] = {}
            keep: list[int] = []
            for i, (name, key) in enumerate(zip(names, map(bytes, np.ascontiguousarray(values).view(f"V{4 * cells.dim}")[:, 0]), strict=True)):
                if key in ids:
                    ids[key].add(name)
                else:
                    ids[key] = {name}
                    keep.append(i)
            sets = list(ids.values())
            values, h = values[keep], h[keep]
            few = [sorted(s)[:carried] for s in sets]
            packed = _planes(values)
            unit = unit_vectors(values)
            if cells.split is None:
                at, cell, shard, member = cells.spread(unit, h)
            else:  # to the cell's part that is routed by one task
                at, cell = map(np.concatenate, zip(*cells.of(unit), strict=True))
                shard, member = (h[at].view(np.uint64) % cells.shards[cell].astype(np.uint64)).astype(np.int64), np.ones(len(at), bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cell.astype(np.int32)), pa.array(np.zeros(len(at), np.int32)), pa.array(shard.astype(np.int32)), pa.array(member),
                    pa.array([few[i] for i in at], pa.list_(pa.string())), pa.array(packed, pa.binary()).take(pa.array(at)), pa.array(h[at]),
                ],
                names=names_of,
            )

    def route(rows: pa.Table, second: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows
        values = _from_planes(rows.column("vec").to_pylist(), shared.value.dim)
        if second.num_rows:
            centroids = np.frombuffer(second.column("centroids")[0].as_py(), np.float32).reshape(-1, shared.value.dim)
            inner = Cells(centroids, np.frombuffer(second.column("shards")[0].as_py(), np.int64), shared.value.dim)
        else:  # no row of the sample fell into the cell
            inner = Cells(np.ones((1, shared.value.dim), np.float32), np.ones(1, np.int64), shared.value.dim)
        at, cell, shard, member = inner.spread(unit_vectors(values), rows.column("h").to_numpy())
        out = rows.take(pa.array(at))
        for name, column in (("sub", pa.array(cell.astype(np.int32))), ("shard", pa.array(shard.astype(np.int32))), ("member", pa.array(member))):
            out = out.set_column(out.schema.get_field_index(name), name, column)
        return out

    def search(group: pa.Table) -> pa.Table:
        merged: dict[bytes, list] = {}
        for vec, ids, member in zip(*(group.column(c).to_pylist() for c in ("vec", "ids", "member")), strict=True):
            old = merged.get(vec)
            merged[vec] = [ids, member] if old is None else [sorted({*old[0], *ids})[:carried], old[1] or member]
        merged = dict(sorted(merged.items()))  # the same graph in whatever order the rows came
        values = _from_planes(list(merged), shared.value.dim)
        names, lists = [], []
        for name, near in shard_lists(values, [m[0] for m in merged.values()], np.array([m[1] for m in merged.values()]), k, least):
            names.append(name)
            lists.append([{"neg": n, "id": x} for n, x in near])
        return pa.table({"id": pa.array(names, pa.string()), "near": pa.array(lists, pa.list_(pa.struct([("neg", pa.int64()), ("id", pa.string())])))})

    keyed = vectors.select("id", "vector", F.xxhash64("vector").alias("h"))
    placed = keyed.mapInArrow(place, columns)
    if cells.split is not None:
        second = cut(fit_second(vectors, shared, vectors.count(), shard_rows))
        parts = spark.createDataFrame([(i, s) for i, n in enumerate(cells.shards.tolist()) for s in range(n)], "cell int, shard int")
        offered = second.join(parts.hint("merge"), "cell")
        placed = placed.groupBy("cell", "shard").cogroup(offered.groupBy("cell", "shard")).applyInArrow(route, columns)
    # a task a shard or two: graphs are dear for their bytes, by which tasks would else be merged
    shards = int(cells.shards.sum() if cells.split is None else cells.split.sum())
    by_shard = placed.repartition(min(2 * shards, MAX_TASKS), "cell", "sub", "shard").groupBy("cell", "sub", "shard").applyInArrow(search, empty)
    # kept, as the lists are read twice and the graphs behind them are dear
    lists = cut(by_shard.groupBy("id").agg(F.expr(f"slice(array_sort(array_distinct(flatten(collect_list(near)))), 1, {k})").alias("near")))
    return lists.unionByName(_further_copies(vectors, lists, carried))


def _further_copies(vectors: DataFrame, lists: DataFrame, carried: int) -> DataFrame:
    """Lists of the ids that did not travel with their vector, because ``carried`` smaller ids have the same one.
    Copies may be most of all rows: they meet their count and the list they take over by broadcast."""
    light = cut(vectors.select("id", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")))  # vectors are hashed once
    often = light.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > carried).select("h1", "h2")
    rows = cut(join_unique(light, often, ["h1", "h2"], "left_semi").distinct())
    # the smallest of each of 64 parts, then of those: no task gathers a group
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    smallest = f"slice(array_sort(collect_list(id)), 1, {carried})"
    ranked = rows.withColumn("part", part).selectExpr("h1", "h2", "part", "id", "row_number() over (partition by h1, h2, part order by id) r").where(F.col("r") <= carried)
    last = ranked.groupBy("h1", "h2").agg(F.expr(smallest).alias("least")).where(F.size("least") == carried).select("h1", "h2", F.element_at("least", carried).alias("last"))
    taken = last.join(lists.select(F.col("id").alias("last"), "near").hint("merge"), "last")
    return join_unique(rows, taken, ["h1", "h2"]).where(F.col("id") > F.col("last")).select("id", "near")


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """(id, place, neighbour, cosine) of every chunk's nearest others."""
    lists = nearest_lists(table(spark, d, "chunks"), "id", "vector")
    return lists.select("id", F.posexplode("near").alias("place", "n")).select("id", (F.col("place") + 1).alias("place"), F.col("n.id").alias("neighbour"), (F.col("n.neg") / -1e6).alias("cosine"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    lists = nearest_lists(table(spark, d, "chunks"), "id", "vector")
    pairs = lists.select("id", F.explode("near.id").alias("other"))
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


_NEAREST = f"""
with v as (select distinct id, vector from chunks where vector is not null and len(list_filter(vector, lambda x: x <> 0)) > 0),
u as (select id, list_transform(vector, lambda x: x::double) w from v),
c as (select a.id, b.id other, round(list_dot_product(a.w, b.w) / (sqrt(list_dot_product(a.w, a.w)) * sqrt(list_dot_product(b.w, b.w))), 6) s
  from u a join u b on a.id <> b.id),
r as (select *, row_number() over (partition by id order by s desc, other) place from c where s >= {COSINE_GATE})
select id, place, other, s from r where place <= 5
"""
QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours}
SQL = {
    "p1_found": f"select distinct least(id, other) id_a, greatest(id, other) id_b from ({_NEAREST})",
    "p1_neighbours": f"select id, place::int place, other neighbour, s cosine from ({_NEAREST})",
}
