"""Evaluation texts inside training texts (problem 7): pigeonhole edit matching over words.

A passage of an item may occur in a document with some word edits. Split into one piece more than there are
edits, at least one piece occurs unchanged. The pieces of all items are a table of hashes; a document is read
once, its rolling hashes are tested against a bounded bitmap of the pieces, and what passes is joined with the
table. Myers' bit-parallel distance of the passage to the words around each hit decides, many hits at a time.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.lookalikes import canonical_array, character_forms, connection
from quillmark.operators.skew import HOT_ROWS, hot_keys
from quillmark.session import cut, spread, table

_WORD = re.compile(r"[^\W_]+")
#: Bits of the bitmap for each piece, and of the whole at most: 32 MB, whatever the number of items. A fuller
#: bitmap lets more hits through to the join; it never loses one.
BITS_PER_PIECE, MAX_BITS = 64, 1 << 28
_FACTOR, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words(text: str) -> list[str]:
    """The longest runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


def word_hashes(forms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the words of each text in order; text i has hashes[offsets[i]:offsets[i + 1]]."""
    lists = pc.split_pattern_regex(pc.utf8_lower(forms.fill_null("")), r"[^\p{L}\p{N}]+")
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    spelling = coded.dictionary.to_pylist()
    hashed = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in spelling], np.uint64)
    real = np.array([bool(w) for w in spelling], bool)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    keep = real[codes] if len(codes) else np.zeros(0, bool)
    offsets = np.zeros(len(forms) + 1, np.int64)
    np.cumsum(np.bincount(row[keep], minlength=len(forms)), out=offsets[1:])
    return (hashed[codes[keep]] if len(codes) else np.zeros(0, np.uint64)), offsets


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words."""
    n = max(0, len(codes) - size + 1)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ (out >> np.uint64(29))) * _FACTOR + codes[i : i + n]
    out = (out ^ (out >> np.uint64(32))) * _STEP
    return out ^ (out >> np.uint64(29))


def piece_bounds(length: int, pieces: int) -> list[tuple[int, int]]:
    """(start, end) of that many pieces, as even as can be."""
    cuts = [length * i // pieces for i in range(pieces + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def myers(pattern: list[int], text: list[int]) -> int:
    """Least edit distance of the pattern to any stretch of the text, one machine word (here: integer) a step."""
    m = len(pattern)
    if not m:
        return 0
    where: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for w in text:
        eq = where.get(w, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        h_plus = minus | (full & ~(diagonal | plus))
        h_minus = plus & diagonal
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = (h_plus << 1) & full
        h_minus = (h_minus << 1) & full
        plus = h_minus | (full & ~(vertical | h_plus))
        minus = h_plus & vertical
        best = min(best, score)
    return best


def myers_rows(patterns: np.ndarray, texts: np.ndarray, used: np.ndarray) -> np.ndarray:
    """``myers`` of many rows at once: patterns (rows, m) of at most 63 words; texts (rows, n), of which ``used``
    tells the words that are there."""
    m = patterns.shape[1]
    one = np.uint64(1)
    full, top = np.uint64((1 << m) - 1), np.uint64(1 << (m - 1))
    bits = one << np.arange(m, dtype=np.uint64)
    plus, minus = np.full(len(patterns), full), np.zeros(len(patterns), np.uint64)
    score = np.full(len(patterns), m)
    best = score.copy()
    for j in range(texts.shape[1]):
        there = used[:, j]
        eq = np.where(patterns == texts[:, j : j + 1], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        h_plus = minus | (full & ~(diagonal | plus))
        h_minus = plus & diagonal
        score = score + np.where(there, ((h_plus & top) > 0).astype(int) - ((h_minus & top) > 0), 0)
        h_plus, h_minus = (h_plus << one) & full, (h_minus << one) & full
        plus = np.where(there, h_minus | (full & ~(vertical | h_plus)), plus)
        minus = np.where(there, h_plus & vertical, minus)
        best = np.minimum(best, score)
    return best


def _lists(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A list array of flat[start:end] for each pair."""
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat[at].view(np.int64)))


def item_pieces(items: DataFrame, run_words: int, max_edits: int) -> DataFrame:
    """(gram, item, shift, passage): every piece of every passage of the items (item, text): its hash, where in
    the passage it starts, and the passage's words as hashes."""
    bounds = piece_bounds(run_words, max_edits + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        for batch in batches:
            flat, offsets = word_hashes(canonical_array(con, batch.column(1)))
            grams = {size: gram_hashes(flat, size) for size in {b - a for a, b in bounds}}
            count = np.maximum(np.diff(offsets) - run_words + 1, 0)
            row = np.repeat(np.arange(len(count)), count)
            start = offsets[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            passages = _lists(flat, start, start + run_words)
            for a, b in bounds:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[b - a][start + a].view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(np.full(len(row), a, np.int32)), passages], names=["gram", "item", "shift", "passage"]
                )

    return items.mapInArrow(run, "gram bigint, item bigint, shift int, passage array<bigint>")


def piece_bitmap(pieces: DataFrame) -> np.ndarray:
    """64-bit words of a bitmap with two bits set for each piece, at most MAX_BITS: built by one aggregation."""
    bits = 64
    while bits < min(MAX_BITS, BITS_PER_PIECE * max(1, pieces.count())):
        bits *= 2
    gram = F.col("gram")
    first, second = F.pmod(gram, F.lit(bits)), F.pmod(F.call_function("shiftrightunsigned", gram, F.lit(32)), F.lit(bits))
    at = pieces.select(F.explode(F.array(first, second)).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("bit", F.lit(64)).cast("int"))
    got = at.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, grams: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(bitmap) * 64 - 1)
    out = np.ones(len(grams), bool)
    for bit in (grams & mask, (grams >> np.uint64(32)) & mask):
        out &= (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
    return out


def document_hits(docs: DataFrame, bitmap, run_words: int, max_edits: int) -> DataFrame:
    """(gram, doc_id, before, words): the runs of words of the documents (d, t) that may be a piece, with the words
    around them that a passage with the piece may reach; ``before`` of them come before the run."""
    bounds = piece_bounds(run_words, max_edits + 1)
    reach_back, reach_on = bounds[-1][0] + max_edits, run_words + max_edits
    sizes = sorted({b - a for a, b in bounds})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        for batch in batches:
            flat, offsets = word_hashes(canonical_array(con, batch.column(1)))
            end_of = np.repeat(offsets[1:], np.diff(offsets))
            start_of = np.repeat(offsets[:-1], np.diff(offsets))
            for size in sizes:
                grams = gram_hashes(flat, size)
                at = np.arange(len(grams))
                at = at[(at + size <= end_of[: len(grams)]) & in_bitmap(bitmap.value, grams)]
                low = np.maximum(at - reach_back, start_of[at])
                row = np.searchsorted(offsets, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[at].view(np.int64)), batch.column(0).take(pa.array(row)), pa.array((at - low).astype(np.int32)),
                        _lists(flat, low, np.minimum(at + reach_on, end_of[at])),
                    ],
                    names=["gram", "doc_id", "before", "words"],
                )

    return docs.mapInArrow(run, "gram bigint, doc_id bigint, before int, words array<bigint>")


def verified(pairs: DataFrame, run_words: int, max_edits: int) -> DataFrame:
    """(item_id, doc_id, edits) of the joined hits within the budget."""
    width = run_words + 2 * max_edits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            item, doc, shift, passage, before, near = batch.columns
            patterns = passage.flatten().to_numpy().reshape(len(batch), run_words)
            start = before.to_numpy() - shift.to_numpy() - max_edits
            flat, ends = near.flatten().to_numpy(), np.cumsum(near.value_lengths().to_numpy())
            length = near.value_lengths().to_numpy()
            at = start[:, None] + np.arange(width)
            used = (at >= 0) & (at < length[:, None])
            texts = flat[np.where(used, (ends - length)[:, None] + at, 0)]
            if run_words <= 63:
                edits = myers_rows(patterns, texts, used)
            else:
                edits = np.array([myers(p.tolist(), t[u].tolist()) for p, t, u in zip(patterns, texts, used, strict=True)])
            keep = pa.array(np.flatnonzero(edits <= max_edits))
            yield pa.RecordBatch.from_arrays([item.take(keep), doc.take(keep), pa.array(edits.astype(np.int32)).take(keep)], names=["item_id", "doc_id", "edits"])

    return pairs.select("item", "doc_id", "shift", "passage", "before", "words").mapInArrow(run, "item_id bigint, doc_id bigint, edits int")


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    run_words: int = 12,
    max_edits: int = 1,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(item_id bigint, doc_id bigint, edits int): documents that carry a passage of ``run_words`` consecutive
    words of an item, changed by at most ``max_edits`` inserted, deleted or exchanged words.

    Both sides are brought to the form of problem 8 first and compared as lower-case words, by their 64-bit
    hashes. Documents are read once, however many items there are; of them only the words around a possible
    hit are shuffled. What is broadcast is a bitmap of at most MAX_BITS, and the pieces of hot hits: runs of
    words that more than one in 4096 of all hits have, as where a third of all documents are copies.

    Null ids and texts take no part. Items and documents with fewer words than a passage (less the edits) have
    no match. A repeated item row counts once; items of equal text under several ids are looked up once and
    reported under each. Each (item, document) comes out once with its least edits. Empty tables give no rows.
    Other columns are ignored.
    """
    if not 0 <= max_edits < run_words:
        raise ValueError("max_edits must be at least 0 and less than run_words")
    spark = docs.sparkSession
    named = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    leader = cut(named.groupBy("t").agg(F.min("i").alias("leader")))
    pieces = cut(item_pieces(leader.select("leader", "t"), run_words, max_edits).distinct())
    texts = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(doc_text).alias("t")).where("d is not null and t is not null")
    texts = spread(texts)
    bitmap = spark.sparkContext.broadcast(piece_bitmap(pieces))
    hits = cut(document_hits(texts, bitmap, run_words, max_edits))
    hot = hot_keys(hits, ["gram"], hot_rows)
    if hot:
        some = F.broadcast(spark.createDataFrame(hot, "gram bigint"))
        few = hits.join(some, "gram", "left_anti").join(pieces.hint("merge"), "gram")
        pairs = few.unionByName(hits.join(some, "gram", "left_semi").join(F.broadcast(pieces.join(some, "gram", "left_semi")), "gram"))
    else:
        pairs = hits.join(pieces.hint("merge"), "gram")
    least = verified(pairs, run_words, max_edits).groupBy("item_id", "doc_id").agg(F.min("edits").alias("edits"))
    copies = named.join(leader.hint("merge"), "t").select("i", "leader")
    return least.join(copies.hint("merge"), least.item_id == copies.leader).select(F.col("i").alias("item_id"), "doc_id", "edits")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the passages within the error budget, those that occur word for word."""
    return p7_leaks(spark, d).where("edits = 0").select("item_id", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per item, how many documents carry a passage of it, word for word and nearly."""
    return p7_leaks(spark, d).groupBy("item_id").agg(F.count_if(F.col("edits") == 0).alias("exact_docs"), F.count_if(F.col("edits") > 0).alias("near_docs"))


_WORDS = "regexp_extract_all(lower(form), '[\\p{L}\\p{N}]+')"
_RUN = 12
#: The words of both tables, by the checking SQL's own way to the one form.
_TEXTS = f"""i as (select e.item_id k, {_WORDS.replace('form', 'f.form')} w from eval_items e join {character_forms('(select item_id doc_id, text from eval_items)')} f on f.doc_id = e.item_id and f.text = e.text),
  d as (select d.doc_id k, {_WORDS.replace('form', 'f.form')} w from documents d join {character_forms('documents')} f on f.doc_id = d.doc_id and f.text = d.text)"""


def _windows(of: str, n: int) -> str:
    return f"(select distinct k, w[s:s + {n - 1}] p from {of}, unnest(range(1, len(w) - {n - 2})) t(s))"


def _one_edit(name: str, kind: str, source: str, first: int, last: int) -> str:
    """The windows of a table, each without one word in turn, as keys."""
    return f"{name} as (select distinct k, '{kind}' || array_to_string(list_concat(p[1:j - 1], p[j + 1:]), ' ') g from {source}, unnest(range({first}, {last + 1})) t(j))"


def _keys(name: str, kind: str, source: str) -> str:
    return f"{name} as (select distinct k, '{kind}' || array_to_string(p, ' ') g from {source})"


#: With one edit a passage is exact, has one word exchanged (equal without it), lacks one, or has one more inside.
_LEAKS = f"""with {_TEXTS},
  i12 as {_windows('i', _RUN)}, d11 as {_windows('d', _RUN - 1)}, d12 as {_windows('d', _RUN)}, d13 as {_windows('d', _RUN + 1)},
  {_keys('ie', '', 'i12')}, {_keys('de', '', 'd12')}, {_keys('dl', '', 'd11')},
  isub as (select distinct k, j || ':' || array_to_string(list_concat(p[1:j - 1], p[j + 1:]), ' ') g from i12, unnest(range(1, {_RUN + 1})) t(j)),
  dsub as (select distinct k, j || ':' || array_to_string(list_concat(p[1:j - 1], p[j + 1:]), ' ') g from d12, unnest(range(1, {_RUN + 1})) t(j)),
  {_one_edit('il', '', 'i12', 1, _RUN)}, {_one_edit('dm', '', 'd13', 2, _RUN)},
  found as (select ie.k i, de.k d, 0 e from ie join de using (g) union all select isub.k, dsub.k, 1 from isub join dsub using (g)
    union all select il.k, dl.k, 1 from il join dl using (g) union all select ie.k, dm.k, 1 from ie join dm using (g))
  select i item_id, d doc_id, min(e)::int edits from found group by 1, 2"""

QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks, "p7_report": p7_report}
SQL = {
    "p7_found": f"with {_TEXTS}, a as {_windows('i', _RUN)}, b as {_windows('d', _RUN)} select distinct a.k item_id, b.k doc_id from a join b using (p)",
    "p7_leaks": _LEAKS,
    "p7_report": f"select item_id, count(*) filter (edits = 0)::bigint exact_docs, count(*) filter (edits > 0)::bigint near_docs from ({_LEAKS}) group by 1",
}
