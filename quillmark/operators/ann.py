"""Vector search by cells (I4): cells of near-by vectors, of which a query leaves out those that cannot matter.

Centroids are fitted on a bounded sample; every vector is put into its cell. Stored by cell, a search first
looks into the cells nearest to its queries, then into every other one that may hold a better row than the k-th
found there. What it returns is what a scan of all rows returns; how much it reads for that is up to the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.lexical import ranked

#: Vectors the centroids are fitted on, at most; vectors of a cell on average; cells at most, as each takes some of
#: the sample. With more rows cells grow; what a search returns does not depend on it.
SAMPLE_ROWS, CELL_ROWS, MAX_CELLS = 65_536, 1024, 4096
#: Cells a query looks into first; what it finds there tells which of the others it needs.
PROBES = 16
#: What rounding may take from a bound, and by how much a row may be nearer to another cell than to its own.
BOUND_SLACK, CELL_SLACK = 1e-7, 1e-9
#: Queries whose bounds are computed at once.
QUERIES_AT_ONCE = 4096


@dataclass
class Cells:
    """Unit centroids, and the least and the greatest cosine of each cell's rows with its centroid: nan where
    there are none or they are not known, which leaves the cell to be read."""

    centroids: np.ndarray
    span: np.ndarray | None = None

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        close = vectors @ self.centroids.T
        n = min(n, close.shape[1])
        return np.argsort(-close, axis=1, kind="stable")[:, :n]

    def needed(self, vectors: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """(vectors, cells) true where a row of the cell may be as similar to the vector as its kth score. By the
        triangle inequality of angles no row is nearer than its angle to the centroid differs from the vector's."""
        out = np.ones((len(vectors), len(self.centroids)), bool)
        if self.span is None:
            return out
        for a in range(0, len(vectors), QUERIES_AT_ONCE):
            close = np.clip(vectors[a : a + QUERIES_AT_ONCE] @ self.centroids.T, -1, 1)
            row = np.clip(close, self.span[:, 0], self.span[:, 1])
            most = row * close + np.sqrt((1 - row * row) * (1 - close * close))
            out[a : a + QUERIES_AT_ONCE] = ~(most < kth[a : a + QUERIES_AT_ONCE, None] - BOUND_SLACK)
        return out


def usable_matrix(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the usable vectors of a list column."""
    length = np.asarray(column.value_lengths().fill_null(0))
    dim = dim or (int(np.bincount(length[length > 0]).argmax()) if (length > 0).any() else 0)
    rows = np.flatnonzero(length == dim) if dim else np.zeros(0, np.int64)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan)
    values = np.asarray(flat).reshape(len(rows), dim)
    norm = np.linalg.norm(values, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], values[good] / norm[good, None]


def fit_cells(rows: DataFrame, vector: str = "vector", seed: int = 3, rounds: int = 8) -> Cells | None:
    """Spherical k-means on at most SAMPLE_ROWS vectors, chosen by a hash of their id; spans over all rows."""
    total = rows.count()
    share = max(1, total // SAMPLE_ROWS)
    sample = rows.where(F.col(vector).isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(share)) == 0)).select(vector).limit(SAMPLE_ROWS).toArrow().column(0)
    chunks = sample.chunks if isinstance(sample, pa.ChunkedArray) else [sample]
    if not chunks:
        return None
    _, unit = usable_matrix(pa.concat_arrays(chunks), None)
    if not len(unit):
        return None
    rng = np.random.default_rng(seed)
    k = int(max(1, min(MAX_CELLS, total // CELL_ROWS, len(unit))))
    centroids = unit[rng.choice(len(unit), k, replace=False)]
    for _ in range(rounds):
        cell = (unit @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centroids)
    return Cells(centroids, spans(rows, centroids, vector))


def spans(rows: DataFrame, centroids: np.ndarray, vector: str) -> np.ndarray:
    """The span of every cell over all usable rows. A row counts for all cells it is equally near to, as another
    pass may put it into any of them."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        least, most = np.full(len(centroids), np.inf), np.full(len(centroids), -np.inf)
        for batch in batches:
            _, unit = usable_matrix(batch.column(0), centroids.shape[1])
            if not len(unit):
                continue
            close = unit @ centroids.T
            at, cell = np.nonzero(close >= close.max(axis=1, keepdims=True) - CELL_SLACK)
            np.minimum.at(least, cell, close[at, cell])
            np.maximum.at(most, cell, close[at, cell])
        some = np.flatnonzero(least <= most)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(least[some]), pa.array(most[some])], names=["cell", "least", "most"])

    parts = rows.select(vector).mapInArrow(run, "cell int, least double, most double")
    span = np.full((len(centroids), 2), np.nan)
    for r in parts.groupBy("cell").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect():
        span[r.cell] = max(-1.0, r.least), min(1.0, r.most)
    return span


def with_cells(rows: DataFrame, cells: Cells, vector: str = "vector") -> DataFrame:
    """rows with the cell of each usable vector; the others get none and are never candidates."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)
    names = [c for c in rows.columns if c != "cell"]
    place = names.index(vector)
    picked = rows.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, unit = usable_matrix(batch.column(place), shared.value.centroids.shape[1])
            cell = np.full(len(batch), -1, np.int32)
            if len(at):
                cell[at] = shared.value.nearest(unit, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, mask=cell < 0)], names=[*names, "cell"])

    return picked.mapInArrow(run, picked.withColumn("cell", F.lit(None).cast("int")).schema)


def probed(celled: DataFrame, cells: Cells, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
    """(unit, id, score) with at least the k best of all rows for each query. queries: (unit, query_vector), a
    stated set. The ``probes`` nearest cells of each query are read first, then those that may hold a row as good
    as the k-th found, which may be all; a cell that no query needs is not read."""
    spark = celled.sparkSession
    held = queries.select("unit", "query_vector").toPandas()
    kind, unit_kind = celled.schema["id"].dataType.simpleString(), queries.schema["unit"].dataType.simpleString()
    if not len(held):
        return spark.createDataFrame([], f"unit {unit_kind}, id {kind}, score double")
    units = held["unit"].to_list()
    wide = np.stack(held["query_vector"].to_numpy()).astype(np.float64)
    wide /= np.maximum(np.linalg.norm(wide, axis=1, keepdims=True), 1e-12)
    asks = np.zeros((len(units), len(cells.centroids)), bool)
    np.put_along_axis(asks, cells.nearest(wide, probes), True, axis=1)
    if not asks.all():
        first = ranked(_best_of_cells(celled, units, wide, asks, k, unit_kind), k)
        worst = {r.unit: r.score for r in first.where(F.col("rank") == k - 1).select("unit", "score").collect()}
        asks = cells.needed(wide, np.array([worst.get(u, -np.inf) for u in units]))
    return _best_of_cells(celled, units, wide, asks, k, unit_kind)


def _best_of_cells(celled: DataFrame, units: list, wide: np.ndarray, asks: np.ndarray, k: int, unit_kind: str) -> DataFrame:
    """(unit, id, score) with at least the k best rows of each query within the cells it asks for."""
    kind = celled.schema["id"].dataType.simpleString()
    schema = f"unit {unit_kind}, id {kind}, score double"
    shared = celled.sparkSession.sparkContext.broadcast((units, wide, asks))
    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, q, asks = shared.value
        for batch in batches:
            at, unit = usable_matrix(batch.column(2), q.shape[1])
            cell, ids = np.asarray(batch.column(1))[at], batch.column(0).take(pa.array(at)).to_pylist()
            best: dict[int, list[tuple[float, int]]] = {}
            for c in np.unique(cell):
                rows = np.flatnonzero(cell == c)
                who = np.flatnonzero(asks[:, c])
                scores = np.round(q[who] @ unit[rows].T, 9)
                for i, w in enumerate(who):
                    keep = np.argpartition(-scores[i], k - 1)[:k] if len(rows) > k else np.arange(len(rows))
                    least = scores[i][keep].min(initial=np.inf)
                    best.setdefault(int(w), []).extend((scores[i][j], rows[j]) for j in np.flatnonzero(scores[i] >= least))
            out = [(units[w], ids[j], float(s)) for w, found in best.items() for s, j in found]
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (types[unit_kind], types[kind], pa.float64()), strict=True)], names=["unit", "id", "score"])

    wanted = np.flatnonzero(asks.any(axis=0)).tolist()
    return celled.where(F.col("cell").isin(wanted)).select("id", "cell", "vector").mapInArrow(run, schema)
