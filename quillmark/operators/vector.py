"""Vector search (T1, A10, A11, E3, E4, I4): exact ranking of all rows, and a hashing embedder as SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.config import EMBED_DIM
from quillmark.functions.columns import cosine
from quillmark.operators.embedders import HashEmbedder
from quillmark.operators.ann import usable_matrix
from quillmark.operators.lexical import ROWS_AT_ONCE, arrow_type, best_of, query_blocks, ranked, tokens
from quillmark.session import cut, spread

#: Query vectors compared with all rows at once; more go in further blocks.
QUERIES_PER_BLOCK = 4096


def _blocks(queries: DataFrame, size: int) -> list[DataFrame]:
    """The stated query set in parts of about ``size`` rows."""
    n = max(1, -(-queries.count() // size))
    return [queries if n == 1 else queries.where(F.pmod(F.xxhash64("unit"), F.lit(n)) == i) for i in range(n)]


def cosine_scores(rows: DataFrame, queries: DataFrame, vector: str = "vector") -> DataFrame:
    """(unit, id, score): the cosine of every query unit (unit, query_vector) with every row (id, vector).

    The stated query set is broadcast in blocks of QUERIES_PER_BLOCK; rows stream by once a block and are never
    shuffled before they are ranked.
    """
    held = rows.select("id", F.col(vector).alias("_v"))
    pairs = [held.crossJoin(F.broadcast(block.select("unit", "query_vector"))) for block in _blocks(queries, QUERIES_PER_BLOCK)]
    return reduce(DataFrame.unionByName, pairs).select("unit", "id", cosine(F.col("_v"), F.col("query_vector")).alias("score"))


def _over_blocks(rows: DataFrame, queries: DataFrame, vector: str, schema: str, score: Callable, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """score(units, ids, cosines) over Arrow batches of rows and blocks of queries, as an Arrow batch each. With
    several blocks the result of each is kept (``keep``) and written before the next is sent, so that one block is
    broadcast at a time."""
    spark = rows.sparkSession
    parts = []
    blocks = _blocks(queries, QUERIES_PER_BLOCK)
    names = [c.split()[0] for c in schema.split(", ")]
    for block in blocks:
        held = block.select("unit", "query_vector").toArrow().combine_chunks()
        at, wide = usable_matrix(_flat(held.column(1)), None)
        if not len(at):
            continue
        shared = spark.sparkContext.broadcast((_flat(held.column(0)).take(pa.array(at)), wide))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            units, q = shared.value
            for batch in batches:
                found, unit = usable_matrix(batch.column(1), q.shape[1])
                if len(found):
                    yield pa.RecordBatch.from_arrays(score(units, batch.column(0).take(pa.array(found)), np.round(q @ unit.T, 9)), names=names)

        part = rows.select("id", F.col(vector).alias("v")).mapInArrow(run, schema)
        if len(blocks) > 1:
            part = cut(keep(part))
            shared.unpersist()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def nearest(rows: DataFrame, queries: DataFrame, k: int, vector: str = "vector") -> DataFrame:
    """(unit, id, score) of the k most similar rows of every query, by matrix products over Arrow batches.

    Each batch keeps its own k best a query, with all that tie at the limit, so what is shuffled is k rows a query
    and batch. Rows and queries whose vector is null, zero or of another length are left out.
    """

    def best(units: pa.Array, ids: pa.Array, cosines: np.ndarray) -> list[pa.Array]:
        limit = np.partition(cosines, -k, axis=1)[:, -k, None] if len(ids) > k else -np.inf
        u, r = np.nonzero(cosines >= limit)  # ties at the limit are settled by the ranking
        return [units.take(pa.array(u)), ids.take(pa.array(r)), pa.array(cosines[u, r])]

    schema = f"unit {queries.schema['unit'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    return _over_blocks(rows, queries, vector, schema, best, lambda part: ranked(part, k).drop("rank"))


def links_above(rows: DataFrame, queries: DataFrame, least: float, vector: str = "vector") -> DataFrame:
    """(unit, links, best): how many rows other than itself have a cosine of at least ``least`` with a query, and the
    greatest of these. Batches count for themselves, so no pair is written."""

    def count(units: pa.Array, ids: pa.Array, cosines: np.ndarray) -> list[pa.Array]:
        near = (cosines >= least) & (np.array(units.to_pylist(), object)[:, None] != np.array(ids.to_pylist(), object))
        u = np.flatnonzero(near.any(axis=1))
        return [units.take(pa.array(u)), pa.array(near[u].sum(axis=1)), pa.array(np.where(near[u], cosines[u], -np.inf).max(axis=1, initial=-np.inf))]

    total = lambda part: part.groupBy("unit").agg(F.sum("links").alias("links"), F.max("best").alias("best"))
    return total(_over_blocks(rows, queries, vector, f"unit {queries.schema['unit'].dataType.simpleString()}, links bigint, best double", count, total))


def hash_bucket(term: Column, dim: int = EMBED_DIM) -> Column:
    return F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("bigint") % dim


def hash_embedding(df: DataFrame, id_column: str, text_column: str, dim: int = EMBED_DIM) -> DataFrame:
    """(id, bucket, value): the non-zero components of the unit vector of token counts by hash bucket. The
    deterministic stand-in for a model: the same in SQL, and sparse, so similarity is a join on buckets."""
    exploded = df.select(F.col(id_column).alias("id"), F.explode(tokens(F.col(text_column))).alias("term"))
    counts = exploded.groupBy("id", hash_bucket(F.col("term"), dim).alias("bucket")).agg(F.count("*").alias("n"))
    norms = counts.groupBy("id").agg(F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double"))).alias("norm"))
    return counts.join(norms, "id").select("id", "bucket", (F.col("n") / F.col("norm")).alias("value"))


def hash_best(docs: DataFrame, queries: DataFrame, k: int, dim: int = EMBED_DIM) -> DataFrame:
    """(unit, id, score) with at least the k most similar documents (id, text) of every query unit (unit, query)
    by hashed word counts. Documents stream by; only buckets that some query of the block has matter, and the
    document's length over all its buckets."""
    blocks = []
    for units, terms in query_blocks(queries):
        asked = HashEmbedder(dim).embed([" ".join(t) for t in terms])
        blocks.append((units, asked))
    spark = docs.sparkSession
    worded = spread(docs.select("id", "text")).select("id", F.transform(tokens(F.col("text")), lambda w: hash_bucket(w, dim).cast("int")).alias("buckets"))
    kind, unit_kind = docs.schema["id"].dataType.simpleString(), queries.schema["unit"].dataType.simpleString()
    schema = f"unit {unit_kind}, id {kind}, score double"
    parts = []
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            units, asked = shared.value
            for batch in batches:
                found: list[tuple] = []
                for a in range(0, len(batch), ROWS_AT_ONCE):
                    part = batch.slice(a, ROWS_AT_ONCE)
                    row = pc.list_parent_indices(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
                    bucket = part.column(1).flatten().to_numpy(zero_copy_only=False)
                    counts = np.bincount(row * dim + bucket, minlength=len(part) * dim).reshape(len(part), dim).astype(float)
                    unit = counts / np.maximum(np.sqrt((counts * counts).sum(axis=1)), 1e-12)[:, None]
                    found += best_of(np.round(asked @ unit.T, 9), np.array(part.column(0).to_pylist(), object), units, k, 1e-9)
                columns = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, run.types, strict=True)], names=["unit", "id", "score"])

        run.types = [arrow_type(unit_kind), arrow_type(kind), pa.float64()]
        parts.append(worded.mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)
