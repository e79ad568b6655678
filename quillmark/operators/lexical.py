"""Lexical search: tokens, BM25 statistics and postings, ranked retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.config import BM25_B, BM25_K1
from quillmark.session import cut, spread


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, with repetitions; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


@dataclass
class LexicalIndex:
    """postings (id, term, tf, len), terms (term, df), and the corpus constants as one row (docs, avg_len)."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame


def postings_of(docs: DataFrame, also: list[str]) -> DataFrame:
    """(also..., id, len, term, tf) of documents (also..., id, text)."""
    worded = docs.select(*also, "id", tokens(F.col("text")).alias("words")).withColumn("len", F.size("words"))
    return worded.select(*also, "id", "len", F.explode("words").alias("term")).groupBy(*also, "id", "len", "term").agg(F.count("*").alias("tf"))


def build_lexical_index(docs: DataFrame, id_column: str = "id", text_column: str = "text") -> LexicalIndex:
    """Statistics are those of all given rows. Ids are taken as unique; an empty text counts as a document."""
    named = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    worded = named.select(F.size(tokens(F.col("text"))).alias("len"))
    postings = postings_of(named, [])
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    corpus = worded.agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))
    return LexicalIndex(postings, terms, corpus)


def query_terms(queries: DataFrame, text_column: str = "query") -> DataFrame:
    """(unit, term): the distinct terms of every query unit."""
    return queries.select("unit", F.explode(F.array_distinct(tokens(F.col(text_column)))).alias("term"))


def bm25_scores(index: LexicalIndex, queries: DataFrame, within: DataFrame | None = None, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(unit, id, score) of all rows that have a term of the unit; ``within`` (id) restricts the rows searched,
    never the statistics. Query terms meet document frequencies before they meet postings."""
    wanted = query_terms(queries)
    idf = F.log(1 + (F.col("docs") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    weighted = wanted.join(index.terms, "term").crossJoin(F.broadcast(index.corpus)).select("unit", "term", idf.alias("idf"), "avg_len")
    postings = index.postings if within is None else index.postings.join(within.select("id"), "id", "left_semi")
    norm = F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("len") / F.col("avg_len"))
    return (
        postings.join(weighted, "term")
        .select("unit", "id", (F.col("idf") * F.col("tf") * F.lit(k1 + 1) / norm).alias("part"))
        .groupBy("unit", "id")
        .agg(F.sum("part").alias("score"))
    )


def ranked(scores: DataFrame, limit: int, score: str = "score") -> DataFrame:
    """The first ``limit`` rows of each unit with a rank from 0; equal to nine decimals, the smaller id is first.
    Spark keeps only ``limit`` rows a unit and task before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy("unit").orderBy(F.round(score, 9).desc(), F.col("id"))
    return scores.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < limit)


#: Query units scored against a batch at once, and rows of a batch scored at once.
UNITS_PER_BLOCK, ROWS_AT_ONCE = 512, 1000
#: Query terms that are broadcast to be counted; more are joined by sorting.
BROADCAST_TERMS = 500_000


def best_of(score: np.ndarray, ids: np.ndarray, units: list, k: int, least: float) -> Iterator[tuple]:
    """(unit, id, score) of the k best rows of each unit, with all that tie at the limit; score is (unit, row)."""
    for i, unit in enumerate(units):
        row = score[i]
        limit = max(least, np.partition(row, -k)[-k]) if len(row) > k else least
        for j in np.flatnonzero(row >= limit):
            yield unit, ids[j], float(row[j])


#: A term that more units of a block ask for is scored by a matrix product, others posting by posting.
COMMON_UNITS = 16


@dataclass
class Bm25Block:
    """Some query units, ready to score batches: their terms, the terms' weights, and which units ask for each term:
    units[starts[term]:starts[term + 1]] of ``askers``; terms many ask for have a row of ``common`` besides."""

    units: list
    vocabulary: list[str]
    idf: np.ndarray
    starts: np.ndarray
    askers: np.ndarray
    average: float
    k1: float
    b: float

    def __post_init__(self):
        count = np.diff(self.starts)
        self.row_of = np.full(len(count), -1)
        often = np.flatnonzero(count > COMMON_UNITS)
        self.row_of[often] = np.arange(len(often))
        self.common = np.zeros((len(often), len(self.units)))
        for i, t in enumerate(often):
            self.common[i, self.askers[self.starts[t] : self.starts[t + 1]]] = 1

    def score(self, row: np.ndarray, term: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(unit, row) from the occurrences (row, term) of known terms and the rows' lengths. Memory follows from the
        postings and the common terms, not from the whole vocabulary."""
        n = len(length)
        key, tf = np.unique(row * len(self.vocabulary) + term, return_counts=True)
        row, term = np.divmod(key, max(len(self.vocabulary), 1))
        weight = self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length[row] / self.average))
        often = self.row_of[term] >= 0
        dense = np.zeros((n, len(self.common)))
        dense[row[often], self.row_of[term[often]]] = weight[often]
        row, term, weight = row[~often], term[~often], weight[~often]
        asked = self.starts[term + 1] - self.starts[term]
        posting = np.repeat(np.arange(len(term)), asked)
        unit = self.askers[np.arange(len(posting)) + np.repeat(self.starts[term] - np.cumsum(asked) + asked, asked)]
        rare = np.bincount(unit * n + row[posting], weight[posting], minlength=len(self.units) * n).reshape(len(self.units), n)
        return (dense @ self.common).T + rare


def stream_best(docs: DataFrame, k: int, blocks: list[Bm25Block], unit_type: str) -> DataFrame:
    """(unit, id, score): documents (id, text) stream by once a block of queries and are never shuffled; what
    leaves a batch is about k rows a unit."""
    spark = docs.sparkSession
    worded = spread(docs.select("id", "text")).select("id", tokens(F.col("text")).alias("words"))
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"unit {unit_type}, id {kind}, score double"
    parts = []
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            known = pa.array(held.vocabulary, pa.string())
            for batch in batches:
                found: list[tuple] = []
                for a in range(0, len(batch), ROWS_AT_ONCE):
                    part = batch.slice(a, ROWS_AT_ONCE)
                    words = part.column(1)
                    row = pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)
                    column = pc.index_in(words.flatten(), known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                    length = np.bincount(row, minlength=len(part)).astype(float)
                    row, column = row[column >= 0], column[column >= 0]
                    # the score of a match is positive; equal to nine decimals means equal
                    scores = np.round(held.score(row, column, length), 9)
                    found += best_of(scores, np.array(part.column(0).to_pylist(), object), held.units, k, 1e-9)
                columns = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, run.types, strict=True)], names=["unit", "id", "score"])

        run.types = [arrow_type(unit_type), arrow_type(kind), pa.float64()]
        parts.append(worded.mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def arrow_type(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]


def query_blocks(queries: DataFrame, size: int = UNITS_PER_BLOCK) -> Iterator[tuple[list, list[list[str]]]]:
    """(units, their distinct terms) of the stated query set, some units at a time."""
    blocks = max(1, -(-queries.count() // size))
    for block in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("unit"), F.lit(blocks)) == block).select("unit", tokens(F.col("query")).alias("words")).collect()
        if got:
            yield [r.unit for r in got], [list(r.words) for r in got]


def statistics(docs: DataFrame, queries: DataFrame) -> tuple[int, float, DataFrame]:
    """(number of documents, mean length, frequencies (term, df) of the queries' terms)."""
    worded = docs.select(tokens(F.col("text")).alias("words"))
    total, average = worded.agg(F.count("*"), F.avg(F.size("words"))).first()
    asked = query_terms(queries).select("term").distinct()
    small = F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked.hint("merge")
    frequency = worded.select(F.explode(F.array_distinct("words")).alias("term")).join(small, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return total, float(average or 0) or 1.0, cut(frequency)  # one pass for the terms of all blocks


def known_frequencies(frequency: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    wanted = frequency.sparkSession.createDataFrame([(w,) for w in vocabulary], "term string")
    df = np.zeros(len(vocabulary))
    for r in frequency.join(F.broadcast(wanted), "term", "left_semi").collect():  # at most the block's own terms
        df[vocabulary[r.term]] = r.df
    return df


def bm25_best(docs: DataFrame, queries: DataFrame, k: int, within: DataFrame | None = None, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(unit, id, score) with at least the k best rows of every unit by BM25 (rank them with ``ranked``).

    docs: (id, text), whose statistics count; within: those searched, all unless given. Document frequencies
    are counted for the queries' terms only, by partial aggregation, so no postings are shuffled.
    """
    total, average, frequency = statistics(docs, queries)
    blocks = []
    for units, terms in query_blocks(queries):
        vocabulary = {w: i for i, w in enumerate(sorted({w for t in terms for w in t}))}
        if not vocabulary:
            continue
        df = known_frequencies(frequency, vocabulary)
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        pairs = sorted({(vocabulary[w], i) for i, t in enumerate(terms) for w in t})
        term, unit = np.array(pairs).T
        starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        blocks.append(Bm25Block(units, list(vocabulary), idf, starts, unit, average, k1, b))
    return stream_best(docs if within is None else within, k, blocks, queries.schema["unit"].dataType.simpleString())


# ---------------------------------------------------------------- pruned search on postings

#: Sets of query terms searched in one pass over the documents; documents whose postings are held at once, and those
#: of like length that share the bounds of what a term may add.
SETS_PER_PASS, POSTING_ROWS, BOUND_ROWS = 16_384, 1 << 17, 1 << 15
#: Rows of each piece that are scored for a first bound: the best by the rarest terms, which have postings for one in
#: FIRST_SHARE of the rows.
FIRST_ROWS, FIRST_SHARE = 64, 8
#: More than what summing rounds off and half of the ninth decimal.
SLACK = 1e-8


@dataclass
class TermSets:
    """Distinct sets of query terms, numbered from the rarest: set i has terms[starts[i]:starts[i + 1]] in that order,
    and the units askers[i]."""

    askers: list[list]
    vocabulary: list[str]
    idf: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    average: float
    k1: float
    b: float


class Postings:
    """The postings of some documents by term and by row, with the weights of BM25 and the greatest weight of each term."""

    def __init__(self, row: np.ndarray, term: np.ndarray, length: np.ndarray, held: TermSets):
        self.n, size = len(length), len(held.vocabulary)
        key, tf = np.unique(term * self.n + row, return_counts=True)
        term, self.row = np.divmod(key, self.n)
        self.weight = held.idf[term] * tf * (held.k1 + 1) / (tf + held.k1 * (1 - held.b + held.b * length[self.row] / held.average))
        self.starts = np.searchsorted(term, np.arange(size + 1))
        self.count = np.diff(self.starts)
        self.most = np.zeros(size)
        some = np.flatnonzero(self.count)
        if len(some):
            self.most[some] = np.maximum.reduceat(self.weight, self.starts[some])
        order = np.argsort(self.row, kind="stable")
        self.row_term, self.row_weight = term[order], self.weight[order]
        self.row_count = np.bincount(self.row, minlength=self.n)
        self.row_start = np.cumsum(self.row_count) - self.row_count
        self.asked = np.zeros(size, bool)

    def scores(self, rows: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The rows' scores, summed in the order of the terms' numbers, so that equal documents get equal sums."""
        count = self.row_count[rows]
        at = np.repeat(self.row_start[rows] - np.cumsum(count) + count, count) + np.arange(count.sum())
        self.asked[terms] = True
        hit = np.flatnonzero(self.asked[self.row_term[at]])
        self.asked[terms] = False
        return np.bincount(np.repeat(np.arange(len(rows)), count)[hit], self.row_weight[at[hit]], minlength=len(rows))

    def add(self, score: np.ndarray, terms: np.ndarray) -> None:
        for t in terms:
            a, b = self.starts[t], self.starts[t + 1]
            score[self.row[a:b]] += self.weight[a:b]

    def first(self, terms: np.ndarray) -> np.ndarray:
        """Scores of the FIRST_ROWS rows that are best by the rarest of the terms: a bound for the best, not the best."""
        terms = terms[self.count[terms] > 0]
        part = np.zeros(self.n)
        self.add(part, terms[: int(np.searchsorted(np.cumsum(self.count[terms]), self.n // FIRST_SHARE)) + 1])
        rows = np.flatnonzero(part)
        if len(rows) > FIRST_ROWS:
            rows = rows[np.argpartition(part[rows], -FIRST_ROWS)[-FIRST_ROWS:]]
        return self.scores(rows, terms)

    def reaching(self, terms: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all rows that reach ``least``. A row without any of the first terms can't, where all
        later terms together add less; so only the first terms' postings are gone through."""
        terms = terms[self.count[terms] > 0]
        terms = terms[np.argsort(self.count[terms] / self.most[terms], kind="stable")]
        rest = np.append(self.most[terms][::-1].cumsum()[::-1], 0.0)
        need = int((rest[:-1] >= least).sum())
        part = np.zeros(self.n)
        self.add(part, terms[:need])
        rows = np.flatnonzero(part >= max(least - rest[need], 1e-12))
        # as long as that is cheaper than reading the rows' own postings, later terms thin them out
        while need < len(terms) and len(rows) * len(self.row) > self.n * self.count[terms[need]]:
            self.add(part, terms[need : need + 1])
            need += 1
            rows = rows[part[rows] >= least - rest[need]]
        score = self.scores(rows, terms)
        keep = score >= least
        return rows[keep], score[keep]


def _pieces(batches: Iterator[pa.RecordBatch], held: TermSets) -> Iterator[tuple[Postings, pa.Array, np.ndarray]]:
    """(postings, ids, places of the ids in order) of documents (id, words), by length."""
    known, pending, n = pa.array(held.vocabulary, pa.string()), [], 0

    def indexed() -> Iterator[tuple[Postings, pa.Array, np.ndarray]]:
        ids = pa.chunked_array([p[0] for p in pending]).combine_chunks()
        at = np.cumsum([0, *(len(p[0]) for p in pending)])
        row, term = np.concatenate([p[1] + a for p, a in zip(pending, at, strict=False)]), np.concatenate([p[2] for p in pending])
        length = np.concatenate([p[3] for p in pending])
        place = np.empty(len(ids), np.int64)
        order = np.argsort(length, kind="stable")
        place[order] = np.arange(len(ids))
        row = place[row]
        for a in range(0, len(ids), BOUND_ROWS):
            mine = (row >= a) & (row < a + BOUND_ROWS)
            some = order[a : a + BOUND_ROWS]
            own = ids.take(pa.array(some))
            rank = np.empty(len(some), np.int64)
            rank[pc.sort_indices(own).to_numpy()] = np.arange(len(some))
            yield Postings(row[mine] - a, term[mine], length[some], held), own, rank

    for batch in batches:
        words = batch.column(1)
        row = pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)
        term = pc.index_in(words.flatten(), known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        length = np.bincount(row, minlength=len(batch)).astype(float)
        pending.append((batch.column(0), row[term >= 0], term[term >= 0], length))
        n += len(batch)
        if n >= POSTING_ROWS:
            yield from indexed()
            pending, n = [], 0
    if n:
        yield from indexed()


def term_sets(queries: DataFrame, total: int, average: float, frequency: DataFrame, k1: float, b: float) -> Iterator[TermSets]:
    for units, words in query_blocks(queries, SETS_PER_PASS):
        vocabulary = {w: i for i, w in enumerate(sorted({w for t in words for w in t}))}
        if not vocabulary:
            continue
        df = known_frequencies(frequency, vocabulary)
        rarest = np.argsort(df, kind="stable")
        spelling, df = np.array(list(vocabulary), object)[rarest].tolist(), df[rarest]
        place = {w: i for i, w in enumerate(spelling)}
        askers: dict[tuple, list] = {}
        for unit, t in zip(units, words, strict=True):
            if t:
                askers.setdefault(tuple(sorted({place[w] for w in t})), []).append(unit)
        starts = np.cumsum([0, *map(len, askers)])
        terms = np.concatenate([np.array(t) for t in askers])
        yield TermSets(list(askers.values()), spelling, np.log(1 + (total - df + 0.5) / (df + 0.5)), starts, terms, average, k1, b)


def bm25_pruned(docs: DataFrame, queries: DataFrame, k: int, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(unit, id, score) with at least the k best rows of every unit by BM25 (rank them with ``ranked``), exact.

    Two passes over docs (id, text), which are never shuffled: the first scores a few rows of each piece in full, so
    the k-th best of them bounds what must be found; the second goes only through postings of terms without which a row
    stays below the bound. Of each piece at most k rows a unit are sent on.
    """
    spark = docs.sparkSession
    total, average, frequency = statistics(docs, queries)
    worded = spread(docs.select("id", "text")).select("id", tokens(F.col("text")).alias("words"))
    kind, unit_kind = docs.schema["id"].dataType.simpleString(), queries.schema["unit"].dataType.simpleString()
    unit_type = arrow_type(unit_kind)
    parts = []
    for sets in term_sets(queries, total, average, frequency, k1, b):
        shared = spark.sparkContext.broadcast(sets)

        def first(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            found = np.full((len(held.askers), k), -np.inf)
            for postings, _, _ in _pieces(batches, held):
                for i in range(len(held.askers)):
                    score = postings.first(held.terms[held.starts[i] : held.starts[i + 1]])
                    found[i] = np.sort(np.concatenate([found[i], score]))[-k:]
            unit, at = np.nonzero(found > 0)
            yield pa.RecordBatch.from_arrays([pa.array(unit.astype(np.int32)), pa.array(np.round(found[unit, at], 9)), pa.array(at.astype(np.int32))], names=["unit", "score", "id"])

        bound = np.full(len(sets.askers), 1e-9)
        scored = worded.mapInArrow(first, "unit int, score double, id int")
        # the k best of all are kept a set, so k rows a set come here, and a set with fewer has no bound
        kth = ranked(scored, k).groupBy("unit").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).toArrow()
        bound[kth.column("unit").to_numpy()] = kth.column("least").to_numpy()
        bounds = spark.sparkContext.broadcast(bound)

        def best(batches: Iterator[pa.RecordBatch], shared=shared, bounds=bounds) -> Iterator[pa.RecordBatch]:
            held, least = shared.value, bounds.value.copy()
            for postings, ids, rank in _pieces(batches, held):
                reach = np.add.reduceat(postings.most[held.terms], held.starts[:-1])
                sets, picked, scores = [], [], []
                for i in np.flatnonzero(reach >= least - SLACK):
                    rows, score = postings.reaching(held.terms[held.starts[i] : held.starts[i + 1]], least[i] - SLACK)
                    score = np.round(score, 9)
                    if len(rows) >= k:
                        order = np.lexsort((rank[rows], -score))[:k]
                        rows, score = rows[order], score[order]
                        least[i] = max(least[i], score[-1])
                    for _ in held.askers[i]:
                        picked.append(rows)
                        scores.append(score)
                    sets += [u for u in held.askers[i] for _ in range(len(rows))]
                if sets:
                    rows = np.concatenate(picked)
                    yield pa.RecordBatch.from_arrays([pa.array(sets, unit_type), ids.take(pa.array(rows)), pa.array(np.concatenate(scores))], names=["unit", "id", "score"])

        parts.append(worded.mapInArrow(best, f"unit {unit_kind}, id {kind}, score double"))
    if not parts:
        return spark.createDataFrame([], f"unit {unit_kind}, id {kind}, score double")
    return reduce(DataFrame.unionByName, parts)
