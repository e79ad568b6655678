"""Filling fixed-capacity containers with texts (problem 6) by lexical retrieval packing.

Texts are sized in tokens of a public tokenizer. A BM25 inverted index, sharded so that texts with the same most
telling term lie together, returns, for the longest text not yet placed, its unused neighbours, which fill its
container greedily; the room no neighbour fits is topped up from the unused texts of the shard by size. Only a
text that alone exceeds the capacity is cut.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.config import BM25_B, BM25_K1, EMBED_MAX_TOKENS
from quillmark.llm.leaks import word_hashes
from quillmark.session import cut, table

CAPACITY = EMBED_MAX_TOKENS
TOKENIZERS = os.environ.get("QUILLMARK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary's public tokenizer cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts in a shard on average.
SHARD_TEXTS = 4000
#: Words are known by a hash of so many values, whose counts are broadcast (32 MB), whatever the vocabulary.
WORD_CODES = 1 << 22
#: Buckets of most telling words, by whose counts shards are laid out: what comes to the driver.
TERM_BUCKETS = 1 << 16
#: Tasks the shards go to at most.
MAX_TASKS = 20_000


@cache
def tokenizer(folder: str = TOKENIZERS, file: str = VOCABULARY):
    """The tokenizer of a vocabulary file."""
    return _encoding(vocabulary(folder, file))


def vocabulary(folder: str, file: str) -> bytes:
    with open(os.path.join(folder, file), "rb") as f:
        return f.read()


@cache
def _encoding(ranks_file: bytes):
    """The tokenizer of a vocabulary of ranks, made once a worker."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def text_vectors(texts: DataFrame, folder: str = TOKENIZERS, file: str = VOCABULARY) -> DataFrame:
    """(doc_id, text_key, tokens, len, codes binary, tf binary) of texts (doc_id, text_key, text): the number of tokens,
    and the word codes with their counts as 32-bit numbers. Null counts as the empty text, which has none. The
    vocabulary (about a megabyte) is read here and travels with the job, so the workers need no file."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary(folder, file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value).encode_ordinary
        for batch in batches:
            text = batch.column(2)
            tokens = [len(encode(t)) if t else 0 for t in text.to_pylist()]
            flat, offsets = word_hashes(text.cast(pa.string()))
            row = np.repeat(np.arange(len(text)), np.diff(offsets))
            key, tf = np.unique(row * WORD_CODES + (flat % np.uint64(WORD_CODES)).astype(np.int64), return_counts=True)
            cuts = np.searchsorted(key, np.arange(1, len(text)) * WORD_CODES)
            parts = [[x.astype(np.int32).tobytes() for x in np.split(values, cuts)] for values in (key % WORD_CODES, tf)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int32()), pa.array(np.diff(offsets).astype(np.int32)), *(pa.array(p, pa.binary()) for p in parts)],
                names=["doc_id", "text_key", "tokens", "len", "codes", "tf"],
            )

    return texts.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id bigint, text_key bigint, tokens int, len int, codes binary, tf binary")


@dataclass
class Corpus:
    """What BM25 needs to know of all texts: their number, mean length, and how many have each word code."""

    texts: int
    average: float
    df: np.ndarray

    def weights(self, codes: np.ndarray, tf: np.ndarray, length: np.ndarray, k1: float = BM25_K1, b: float = BM25_B) -> np.ndarray:
        """Weights of words; those of one text alone find nothing and have none."""
        df = self.df[codes]
        idf = np.log(1 + (self.texts - df + 0.5) / (df + 0.5))
        return np.where(df > 1, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / self.average)), 0).astype(np.float32)


def corpus_of(vectors: DataFrame) -> Corpus:
    """Counts over all texts, by tasks and then by code: at most WORD_CODES rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(WORD_CODES, np.int64)
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            df += np.bincount(codes, minlength=WORD_CODES)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["code", "df"])

    texts, average = vectors.agg(F.count("*"), F.avg("len")).first()
    got = vectors.select("codes").mapInArrow(run, "code int, df bigint").groupBy("code").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(WORD_CODES, np.int64)
    df[got.column("code").to_numpy()] = got.column("df").to_numpy()
    return Corpus(texts, float(average or 0) or 1.0, df)


def _vectors_of(codes: list[bytes], tf: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, counts, words of each text) of packed vectors."""
    return np.frombuffer(b"".join(codes), np.int32), np.frombuffer(b"".join(tf), np.int32), np.array([len(c) // 4 for c in codes], np.int64)


def with_telling(vectors: DataFrame, corpus) -> DataFrame:
    """vectors with ``telling``, the bucket of each text's word of greatest weight, null where none has weight."""
    schema = vectors.withColumn("telling", F.lit(None).cast("int")).schema
    at = [vectors.columns.index(c) for c in ("codes", "tf", "len")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, tf, words = _vectors_of(*(batch.column(i).to_pylist() for i in at[:2]))
            row = np.repeat(np.arange(len(words)), words)
            weight = corpus.value.weights(codes, tf, batch.column(at[2]).to_numpy()[row])
            order = np.lexsort((codes, -weight, row))
            first = np.searchsorted(row[order], np.arange(len(words)))
            some = np.flatnonzero(words)
            best = order[first[some]]
            telling = np.full(len(words), -1, np.int32)
            telling[some] = np.where(weight[best] > 0, codes[best] % TERM_BUCKETS, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(telling, mask=telling < 0)], names=schema.names)

    return vectors.mapInArrow(run, schema)


def similar_shards(rows: DataFrame, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """rows (doc_id, text_key, telling, ...) with ``shard``: about ``shard_texts`` rows each, texts with the same most
    telling word together. Buckets of such words are counted; small ones share a shard, and one with more texts
    than a shard holds, such as a group of copies, is spread over several by hash."""
    rows = rows.withColumn("_bucket", F.coalesce("telling", F.lit(0)))
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("n")).orderBy("_bucket").collect()  # at most TERM_BUCKETS
    layout, shard, held = [], 0, 0
    for r in counts:
        parts = -(-r.n // shard_texts)
        if held + r.n > shard_texts and held:
            shard, held = shard + 1, 0
        layout.append((r["_bucket"], shard, parts))
        if parts > 1:
            shard, held = shard + parts, 0
        else:
            held += r.n
    placed = rows.sparkSession.createDataFrame(layout, "_bucket int, _first int, _parts int")
    spread = F.pmod(F.xxhash64("doc_id", "text_key"), F.col("_parts")).cast("int")
    return rows.join(F.broadcast(placed), "_bucket").withColumn("shard", F.col("_first") + spread).drop("_bucket", "_first", "_parts")


class ShardIndex:
    """BM25 inverted index of one shard: per term the texts that have it, with their weights."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray]):
        owner = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        flat = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.terms, self.start = np.unique(flat[order], return_index=True)
        self.end = np.append(self.start[1:], len(flat))
        self.docs = owner[order]
        self.weights = (np.concatenate(weights) if weights else np.zeros(0, np.float32))[order]
        self.texts = len(terms)

    def neighbours(self, terms: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """All open texts that share a term, by score, of equal ones the first."""
        score = np.zeros(self.texts, np.float32)
        at = np.searchsorted(self.terms, terms)
        at = at[at < len(self.terms)]
        for i in at[np.isin(self.terms[at], terms)]:
            docs = self.docs[self.start[i] : self.end[i]]
            score[docs] += self.weights[self.start[i] : self.end[i]]
        hits = np.flatnonzero((score > 0) & open_)
        return hits[np.lexsort((hits, -score[hits]))]


def pack_shard(sizes: np.ndarray, index: ShardIndex, terms: list[np.ndarray], capacity: int) -> list[list[int]]:
    """Containers as lists of text numbers, each text of at most ``capacity`` in one of them.

    Seeds go from the longest text to the shortest. All neighbours are gone through in order of score and taken
    where they fit; then, as long as an unused text fits the rest, the largest such one.
    """
    order = np.lexsort((np.arange(len(sizes)), sizes))
    unused = np.ones(len(sizes), bool)
    left: list[tuple[int, int]] = [(int(sizes[i]), int(i)) for i in order]  # unused texts by size

    def take(i: int) -> None:
        unused[i] = False
        left.pop(bisect.bisect_left(left, (int(sizes[i]), i)))

    out: list[list[int]] = []
    while left:
        _, seed = left[-1]
        take(seed)
        held, room = [seed], capacity - int(sizes[seed])
        if room > 0 and left and left[0][0] <= room:
            for i in index.neighbours(terms[seed], unused & (sizes > 0) & (sizes <= room)):
                if sizes[i] <= room:
                    take(int(i))
                    held.append(int(i))
                    room -= int(sizes[i])
                    if not room or not left or left[0][0] > room:
                        break
        while left and (at := bisect.bisect_right(left, (room, len(sizes)))):
            size, i = left[at - 1]
            take(i)
            held.append(i)
            room -= size
        out.append(held)
    return out


def pack_texts(
    df: DataFrame, id_column: str, text_column: str, capacity: int = CAPACITY, shard_texts: int = SHARD_TEXTS, folder: str = TOKENIZERS, file: str = VOCABULARY
) -> DataFrame:
    """(container string, slot int, doc_id bigint, text_key bigint, piece int, token_from int, token_to int): every
    text, or every piece of one that alone exceeds the capacity, in a container of at most ``capacity`` tokens.
    text_key is Spark's xxhash64 of the text: it tells the texts of an id apart.

    A text above the capacity is cut every ``capacity`` tokens; its full pieces fill a container each and its
    rest is packed with the others. Null and empty texts have no tokens and share containers like any other.
    Null ids are left out; a repeated row counts once, and of an id with several texts each is packed.
    Shards have about ``shard_texts`` each, so no source or group of copies makes a large one; counts behind the
    scores are those of all texts. An empty table gives no rows.
    """
    texts = df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null")
    # tokens are dear for the bytes of a text, so that the shuffle's partitions are not merged by size
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.repartition(tasks, "doc_id", "text").distinct().withColumn("text_key", F.xxhash64("text"))
    sized = cut(text_vectors(texts, folder, file))  # the texts themselves are read once
    corpus = df.sparkSession.sparkContext.broadcast(corpus_of(sized))
    full = (
        sized.where(F.col("tokens") >= capacity)
        .select("doc_id", "text_key", "tokens", F.explode(F.sequence(F.lit(0), (F.col("tokens") / capacity).cast("int") - 1)).alias("piece"))
        .select(
            F.concat_ws("-", F.lit("f"), F.col("doc_id").cast("string"), F.hex("text_key"), F.col("piece").cast("string")).alias("container"), F.lit(0).alias("slot"), "doc_id", "text_key", "piece",
            (F.col("piece") * capacity).alias("token_from"), ((F.col("piece") + 1) * capacity).alias("token_to"),
        )
    )
    rest = sized.where((F.col("tokens") == 0) | (F.col("tokens") % capacity > 0))
    shards = max(1, -(-corpus.value.texts // shard_texts))
    rest = similar_shards(with_telling(rest, corpus), shard_texts).drop("telling")
    schema = "container string, slot int, doc_id bigint, text_key bigint, piece int, token_from int, token_to int"

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("text_key", "ascending")]).combine_chunks()
        doc, texts, tokens = (group.column(c).to_numpy() for c in ("doc_id", "text_key", "tokens"))
        codes, tf, words = _vectors_of(group.column("codes").to_pylist(), group.column("tf").to_pylist())
        weight = corpus.value.weights(codes, tf, np.repeat(group.column("len").to_numpy(), words))
        weighty = weight > 0
        cuts = np.cumsum(np.bincount(np.repeat(np.arange(len(words)), words)[weighty], minlength=len(words)))[:-1]
        terms = np.split(codes[weighty], cuts)
        packed = pack_shard(tokens % capacity, ShardIndex(terms, np.split(weight[weighty], cuts)), terms, capacity)
        rows = [(f"s{key[0].as_py()}-{c}", slot, i) for c, held in enumerate(packed) for slot, i in enumerate(held)]
        at = np.array([i for _, _, i in rows], np.int64)
        piece = tokens[at] // capacity
        return pa.table(
            {
                "container": pa.array([c for c, _, _ in rows], pa.string()),
                "slot": pa.array([s for _, s, _ in rows], pa.int32()),
                "doc_id": pa.array(doc[at]),
                "text_key": pa.array(texts[at]),
                "piece": pa.array(piece.astype(np.int32)),
                "token_from": pa.array((piece * capacity).astype(np.int32)),
                "token_to": pa.array(tokens[at].astype(np.int32)),
            }
        )

    # a task a shard or two: filling is dear for its bytes
    return full.unionByName(rest.repartition(min(2 * shards, MAX_TASKS), "shard").groupBy("shard").applyInArrow(fill, schema))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(table(spark, d, "documents"), "doc_id", "text")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    used = p6_containers(spark, d).groupBy("container").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"), F.count("*").alias("texts"))
    return used.agg(
        F.count("*").alias("containers"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("fullest"),
        F.round(F.sum("tokens") / (F.count("*") * F.lit(CAPACITY)), 6).alias("fill"),
    )


def p6_whole(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any filling: every document is there, its pieces join to the whole of its tokens, only one
    above the capacity is cut, no container is too full, and slots are numbered through."""
    rows = cut(p6_containers(spark, d))
    docs = rows.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"), F.min("token_from").alias("first"), F.max("token_to").alias("last"))
    boxes = rows.groupBy("container").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"), F.count("*").alias("texts"), F.max("slot").alias("slot"))
    whole = docs.agg(
        F.count("*").alias("documents"),
        F.count_if((F.col("first") != 0) | (F.col("tokens") != F.col("last"))).alias("not_whole"),
        F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= CAPACITY)).alias("cut_in_vain"),
    )
    return whole.crossJoin(boxes.agg(F.count_if(F.col("tokens") > CAPACITY).alias("too_full"), F.count_if(F.col("slot") + 1 != F.col("texts")).alias("gaps")))


QUERIES = {"p6_containers": p6_containers, "p6_fill": p6_fill, "p6_whole": p6_whole}
SQL = {"p6_whole": "select count(distinct doc_id)::bigint documents, 0::bigint not_whole, 0::bigint cut_in_vain, 0::bigint too_full, 0::bigint gaps from documents"}
