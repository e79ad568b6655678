"""Near-duplicate texts with small edits (problem 5): universe-partition pigeonhole, exact at any threshold.

Texts are multisets of words, seen as sets of (word, occurrence). Two texts of at most U words that share a
fraction t of them differ in at most H = 2 U (1 - t) / (1 + t) elements. By size band, a hash cuts the
universe of elements into segments, and segment i gets an allowance v_i of 0, 1 or 2 with sum H + 1: then in
some segment the two differ in fewer elements than its allowance. An allowance of 1 is an equal segment; one
of 2 an equal segment or one equal to the other's with one element deleted, so each text is indexed under
its segments' subsets and their one-deletion neighbourhoods. Which segments get which allowance is decided by
costs from the counts of all texts. Candidates meet a parity sketch whose bit distance never exceeds the true
difference, and what is left is verified by comparing all elements. Elements are compared by 40 bits of their
hashes: two words of a pair of texts of n words are taken for one with a chance of about n * n / 2^40.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.splitting import chunk_body
from quillmark.operators.orphans import bloom_blocks, bloom_filter, might_exist
from quillmark.operators.skew import HOT_ROWS, expand_pairs, join_unique
from quillmark.session import cut, dropped_shuffles, spread, table

MIN_WORDS = 40
THRESHOLD = 0.75
#: Element codes that carry statistics; element hashes are reduced to them inside the index.
CODES = 1 << 14
#: Segments of an instance go to at least this many tasks, each with the sketches of the instance's texts once.
GROUPS = 4
#: Size bands between a length and the greatest length a partner can have: more bands fit the budget of
#: differences more tightly (fewer candidates), but index each text once more.
BAND_STEPS = 2
#: What one task of an instance may read, and the cost it may have by the plan's estimate: an instance gets as
#: many groups of segments as that takes, and where each segment has a task of its own, parts by signature.
TASK_BYTES, TASK_COST, MAX_TASKS = 96 << 20, 4e7, 20_000
#: Tasks are run in rounds: what one round shuffles is at most this, or this share of the texts' elements, and is
#: dropped before the next. All tasks together shuffle 20 to 40 times the input from 1 GB on.
ROUND_BYTES, ROUND_SHARE = 512 << 20, 1.5
#: Relative costs of handling one signature and one candidate pair.
SIGNATURE_COST, PAIR_COST = 1.0, 0.4
PAIRS_AT_ONCE = 1 << 18

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


# ---------------------------------------------------------------- elements of texts


def word_elements(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the elements of each text, sorted; text i has hashes[offsets[i]:offsets[i + 1]]."""
    n = len(texts)
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}\p{N}]+")
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    spelling = coded.dictionary.to_pylist()
    hashed = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in spelling], np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    real = np.array([bool(w) for w in spelling], bool)[codes] if spelling else np.zeros(0, bool)
    rows, word = rows[real], hashed[codes[real]] if spelling else np.zeros(0, np.uint64)
    order = np.lexsort((word, rows))
    rows, word = rows[order], word[order]
    first = np.ones(len(word), bool)
    first[1:] = (word[1:] != word[:-1]) | (rows[1:] != rows[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(word)), 0))
    occurrence = (np.arange(len(word)) - start).astype(np.uint64)
    element = mix(word + occurrence * _STEP)
    order = np.lexsort((element, rows))
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=n), out=offsets[1:])
    return element[order], offsets


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def pack(elements: np.ndarray) -> bytes:
    """The upper 40 bits of each element: all of the first 32, then all of the next 8."""
    return (elements >> np.uint64(32)).astype(np.uint32).tobytes() + (elements >> np.uint64(24)).astype(np.uint8).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    n = len(packed) // 5
    return (np.frombuffer(packed, np.uint32, n).astype(np.uint64) << np.uint64(32)) | (np.frombuffer(packed, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(24))


def word_sets(df: DataFrame, id_column: str, text_column: str, min_words: int) -> DataFrame:
    """(id, n, h1, h2, words): the elements of every text of at least min_words words; h1, h2 name the multiset."""
    picked = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("id is not null and text is not null")
    schema = picked.select("id", F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("h1"), F.lit(0).cast("bigint").alias("h2"), F.lit(b"").alias("words")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements, offsets = word_elements(batch.column(1).cast(pa.string()))
            size = np.diff(offsets)
            h1, h2 = row_sums(elements, offsets), row_sums(mix(elements + _STEP), offsets)
            keep = np.flatnonzero(size >= min_words)
            words = [pack(elements[offsets[i] : offsets[i + 1]]) for i in keep]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep)),
                    pa.array(size[keep].astype(np.int32)),
                    pa.array(h1[keep].astype(np.int64)),
                    pa.array(h2[keep].astype(np.int64)),
                    pa.array(words, pa.binary()),
                ],
                names=["id", "n", "h1", "h2", "words"],
            )

    return picked.mapInArrow(run, schema)


def code_of(elements: np.ndarray, codes: int) -> np.ndarray:
    return (elements >> np.uint64(24)) % np.uint64(codes)


# ---------------------------------------------------------------- plan


def band_edges(longest: int, min_words: int, threshold: float, steps: int = BAND_STEPS) -> list[int]:
    """Least sizes of the bands; the last entry ends the last band."""
    edges, k = [max(1, min_words)], 0
    while edges[-1] <= longest:
        k += 1
        edges.append(max(edges[-1] + 1, int(edges[0] * threshold ** (-k / steps))))
    return edges


def allowance(first: np.ndarray, second: np.ndarray, need: int) -> np.ndarray:
    """Allowances 0, 1 or 2 of least total cost with sum ``need``; first, second: the costs of 1 and of 2."""
    m = len(first)
    best = np.full(need + 1, np.inf)
    best[0] = 0
    taken = np.zeros((m, need + 1), np.int8)
    for s in range(m):
        new = best.copy()
        for v, cost in ((1, first[s]), (2, second[s])):
            other = np.full(need + 1, np.inf)
            other[v:] = best[: need + 1 - v] + cost
            better = other < new
            new[better], taken[s, better] = other[better], v
        best = new
    out = np.zeros(m, np.int8)
    for s in range(m - 1, -1, -1):
        out[s] = taken[s, need]
        need -= int(out[s])
    return out


@dataclass
class Instance:
    """How texts whose longer partner lies in one size band are indexed."""

    band: int
    low: int  # least size of the shorter text
    own: int  # least size of the longer text
    high: int  # greatest size
    texts: int
    codes: int
    segment: np.ndarray | None  # segment of each code; None: the code modulo the number of segments
    allow: np.ndarray  # allowance of each segment
    groups: int
    parts: int
    sketch_words: int
    words: float  # elements in segments in use, of a mean text

    @property
    def tasks(self) -> int:
        return self.groups * self.parts

    def task_bytes(self) -> float:
        """What a mean task reads: with several parts a text goes to that of each of its signatures."""
        used = int((self.allow > 0).sum())
        sent = 1.0 if self.parts == 1 else min(self.parts, 1 + self.words / used) / self.parts
        return self.texts * sent * (20 + 8 * self.sketch_words + (used + (2 if self.codes <= 1 << 16 else 4) * self.words) / self.groups)


@dataclass
class Slice:
    """Tasks first to last - 1 of an instance, of its groups' parts one after another."""

    inst: Instance
    first: int
    last: int

    def parts_of(self, group: int) -> tuple[int, int]:
        """The first part of a group that is in the slice, and the one after the last."""
        at = group * self.inst.parts
        return max(self.first - at, 0), min(self.last - at, self.inst.parts)

    def groups(self) -> range:
        return range(self.first // self.inst.parts, -(-self.last // self.inst.parts))


def plan_rounds(plans: list[Instance], most: float) -> list[list[Slice]]:
    """All tasks of all instances, each once, in rounds of at most ``most`` bytes (but of one task at least)."""
    rounds, left = [[]], most
    for inst in plans:
        size, at = inst.task_bytes(), 0
        while at < inst.tasks:
            fits = min(inst.tasks - at, int(left // size))
            if not fits and rounds[-1]:
                rounds.append([])
                left = most
                continue
            fits = max(fits, 1)
            rounds[-1].append(Slice(inst, at, at + fits))
            at, left = at + fits, left - fits * size
    return rounds


def plan_instance(band: int, own: int, high: int, threshold: float, counts: np.ndarray, texts: int, task_bytes: float = TASK_BYTES, task_cost: float = TASK_COST) -> Instance:
    """The index of texts whose longer partner has own to high words. counts: how many of the texts that take
    part have each code."""
    budget = int(2 * high * (1 - threshold) / (1 + threshold) + 1e-9)
    need = budget + 1
    codes = CODES
    while codes < 4 * need:
        codes *= 2
    least = -(-need // 2)
    low = min(own, int(np.ceil(threshold * own - 1e-9)))
    common = dict(band=band, low=low, own=own, high=high, texts=texts, codes=codes, sketch_words=max(1, -(-int(1.2 * high) // 64)))
    length = np.full(least, high / least)
    if codes > CODES:
        segment, allow, cost = None, np.full(least, 2, np.int8), float(texts * (least + high) * SIGNATURE_COST)
    else:
        p = np.minimum(counts / max(texts, 1), 1.0)
        equal = p * p + (1 - p) * (1 - p)
        info = -np.log(equal)
        telling = np.argsort(-info, kind="stable")[: int((info > 0).sum())]
        choices = sorted({least, least + least // 4, least + least // 2, need})
        plans = []
        for m in choices:
            # most telling codes first, in rounds of one a segment, the most telling to the one that tells least so
            # far; codes that tell nothing are dealt out
            of = np.arange(codes, dtype=np.int32) % m
            told = np.zeros(m)
            for a in range(0, len(telling), m):
                some = telling[a : a + m]
                to = np.argsort(told, kind="stable")[: len(some)]
                of[some] = to
                told[to] += info[some]
            total = np.bincount(of, info, m)
            one_off = np.bincount(of, 2 * p * (1 - p) / equal, m)
            length = np.bincount(of, p, m)
            same = np.exp(-total) * texts * texts / 2
            first = texts * SIGNATURE_COST + same * PAIR_COST
            second = texts * (1 + length) * SIGNATURE_COST + same * (1 + one_off) * PAIR_COST
            v = allowance(first, second, need)
            plans.append((float(np.where(v == 1, first, np.where(v == 2, second, 0)).sum()), m, of, v, length))
        cost, _, segment, allow, length = min(plans, key=lambda x: x[:2])
    used = int((allow > 0).sum())
    words = float(length[allow > 0].sum())
    read = lambda groups: texts * (20 + 8 * common["sketch_words"] + (used + 2 * words) / groups)  # noqa: E731  bytes of a task
    groups = min(GROUPS, used)
    while groups < used and (read(groups) > task_bytes or cost / groups > task_cost):
        groups += 1
    # a part holds the texts one of whose signatures falls into it: of 1 + the segment's words
    parts = max(1, int(np.ceil(cost / groups / task_cost)) if groups == used else 1)
    if read(groups) > task_bytes:
        parts = max(parts, int(np.ceil(read(groups) * (1 + words / used) / task_bytes)))
    return Instance(segment=segment, allow=allow, groups=groups, parts=parts, words=words, **common)


# ---------------------------------------------------------------- index


def segments_of(elements: np.ndarray, inst: Instance) -> tuple[np.ndarray, np.ndarray]:
    code = code_of(elements, inst.codes)
    segment = (code % np.uint64(len(inst.allow))).astype(np.int32) if inst.segment is None else inst.segment[code]
    return code, segment


def sketches(elements: np.ndarray, rows: np.ndarray, n: int, words: int) -> np.ndarray:
    """Parity of the elements that fall on each bit: its bit distance is at most the true difference."""
    bit = (mix(elements) >> np.uint64(20)) % np.uint64(64 * words)
    cell = rows * (64 * words) + bit.astype(np.int64)
    odd = (np.bincount(cell, minlength=n * 64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64).reshape(n, words)


def code_hash(code: np.ndarray) -> np.ndarray:
    return mix(code.astype(np.uint64) * _STEP + _STEP)


def index_rows(size: np.ndarray, name: np.ndarray, words: list[bytes], slices: list[Slice]) -> Iterator[tuple[int, int, int, bytes]]:
    """(band, group, part, block of texts) of a batch for the tasks of the slices; equal multisets of the batch go once."""
    _, keep = np.unique(name, axis=0, return_index=True)
    for some_tasks in slices:
        inst = some_tasks.inst
        mine = keep[(size[keep] >= inst.low) & (size[keep] <= inst.high)]
        if not len(mine):
            continue
        elements = np.concatenate([unpack(words[i]) for i in mine])
        rows = np.repeat(np.arange(len(mine)), size[mine])
        sketch = sketches(elements, rows, len(mine), inst.sketch_words)
        code, segment = segments_of(elements, inst)
        live = inst.allow[segment] > 0
        rows, code, segment = rows[live], code[live], segment[live]
        slot = (np.cumsum(inst.allow > 0) - 1).astype(np.int32)[segment]  # running number of the segments in use
        group = slot % inst.groups
        width = -(-int((inst.allow > 0).sum()) // inst.groups)
        within = slot // inst.groups
        kind = np.uint16 if inst.codes <= 1 << 16 else np.uint32
        for g in some_tasks.groups():
            pick = np.flatnonzero(group == g)
            r, c, s = rows[pick], code[pick], within[pick]
            order = np.lexsort((c, s, r))
            r, c, s = r[order], c[order], s[order]
            counts = np.bincount(r * width + s, minlength=len(mine) * width).reshape(len(mine), width)
            if inst.parts == 1:
                yield inst.band, g, 0, _block(name[mine], size[mine], sketch, counts, c.astype(kind))
                continue
            whole = np.zeros(len(mine), np.uint64)
            h = code_hash(c)
            np.add.at(whole, r, h)
            parts = np.uint64(inst.parts)
            low, high = some_tasks.parts_of(g)
            both = np.unique(np.concatenate([(whole % parts).astype(np.int64) * len(mine) + np.arange(len(mine)), ((whole[r] - h) % parts).astype(np.int64) * len(mine) + r]))
            start = np.zeros(len(mine) + 1, np.int64)
            np.cumsum(np.bincount(r, minlength=len(mine)), out=start[1:])
            part_of, texts = both // len(mine), both % len(mine)
            here = (part_of >= low) & (part_of < high)
            part_of, texts = part_of[here], texts[here]
            if not len(texts):
                continue
            edges = np.flatnonzero(np.concatenate([[True], part_of[1:] != part_of[:-1], [True]]))
            for x, y in zip(edges, edges[1:], strict=False):
                some = texts[x:y]
                size_of = start[some + 1] - start[some]
                own = np.repeat(start[some] - np.cumsum(size_of) + size_of, size_of) + np.arange(size_of.sum())
                yield inst.band, g, int(part_of[x]), _block(name[mine][some], size[mine][some], sketch[some], counts[some], c[own].astype(kind))


def _block(name: np.ndarray, size: np.ndarray, sketch: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> bytes:
    fields = (name.astype(np.int64), size.astype(np.uint32), sketch, counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32), codes)
    head = struct.pack("<5i", len(name), sketch.shape[1], counts.shape[1], fields[3].itemsize, codes.itemsize)
    return head + b"".join(np.ascontiguousarray(f).tobytes() for f in fields)


def _unblock(block: bytes) -> tuple[np.ndarray, ...]:
    n, w, width, count_size, code_size = struct.unpack_from("<5i", block)
    at, out = 20, []
    for kind, shape in ((np.int64, (n, 2)), (np.uint32, (n,)), (np.uint64, (n, w)), (np.dtype(f"u{count_size}"), (n, width))):
        k = int(np.prod(shape))
        out.append(np.frombuffer(block, kind, k, at).reshape(shape))
        at += k * np.dtype(kind).itemsize
    out.append(np.frombuffer(block, np.dtype(f"u{code_size}"), -1, at))
    return tuple(out)


# ---------------------------------------------------------------- candidates


def _expand(left: np.ndarray, start: np.ndarray, count: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (left[i], order[start[i] + k]), k < count[i], some at a time; a hot entry is cut across blocks."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    for a in range(0, total, PAIRS_AT_ONCE):
        at = np.arange(a, min(a + PAIRS_AT_ONCE, total))
        lo, hi = np.searchsorted(ends, [at[0], at[-1]], "right")
        span = ends[lo : hi + 1]
        i = lo + np.repeat(np.arange(len(span)), np.diff(np.concatenate([[at[0]], np.minimum(span, at[-1] + 1)])))
        yield left[i], order[start[i] + at - (ends[i] - count[i])]


def segment_pairs(whole: np.ndarray, rows: np.ndarray, own: np.ndarray, shortened: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of texts with equal segments, and of texts one of whose segments is the other's with one element
    deleted, if at least one of the two is ``own`` (a text of the band's own sizes). whole: hashes of the
    segments of the texts ``rows``; shortened: those of the texts ``owner``; own: by text."""
    mine = own[rows]
    order = np.lexsort((~mine, whole))  # within equal segments own texts come first
    values, start, count = np.unique(whole[order], return_index=True, return_counts=True)
    owned = np.add.reduceat(mine[order].astype(np.int64), start) if len(start) else count
    later = np.repeat(start + count, count) - np.arange(len(order)) - 1
    some = np.flatnonzero((later > 0) & mine[order])
    order = rows[order].astype(np.int32)
    yield from _expand(order[some], some + 1, later[some], order)
    if not (len(shortened) and len(values)):
        return
    mask = np.uint64((1 << max(16, int(len(values) * 8).bit_length())) - 1)
    seen = np.zeros(int(mask) + 1, bool)
    seen[values & mask] = True
    maybe = np.flatnonzero(seen[shortened & mask])
    at = np.searchsorted(values, shortened[maybe])
    hit = values[np.minimum(at, len(values) - 1)] == shortened[maybe]
    at, maybe = at[hit], owner[maybe[hit]].astype(np.int32)
    yield from _expand(maybe, start[at], np.where(own[maybe], count[at], owned[at]), order)


def group_candidates(blocks: list[bytes], inst: Instance, group: int, part: int, threshold: float) -> tuple[np.ndarray, int]:
    """(pairs of names, candidates met) of the texts of one task. Equal multisets of several blocks count once."""
    pieces = [_unblock(b) for b in blocks]
    name, size, sketch, counts, codes = (np.concatenate([p[k] for p in pieces]) for k in range(5))
    n, width = counts.shape
    counts = counts.astype(np.int64).ravel()
    h = code_hash(codes)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=total[1:])
    ends = np.cumsum(counts)
    whole = (total[ends] - total[ends - counts]).reshape(n, width)
    cell = np.repeat(np.arange(n * width), counts)
    _, first = np.unique(name, axis=0, return_index=True)
    place = np.full(n, -1, np.int64)
    place[first] = np.arange(len(first))
    name, size, sketch, whole = name[first], size[first].astype(np.float32), sketch[first], whole[first]
    row, column = place[cell // width], cell % width
    used = np.flatnonzero(inst.allow > 0)
    share, own = (1 - threshold) / (1 + threshold), size >= inst.own
    found: list[np.ndarray] = []
    met = 0
    for k, slot in enumerate(range(group, len(used), inst.groups)):
        mine, rows = whole[:, k], np.arange(len(name))
        owner, shortened = rows[:0], mine[:0]
        if inst.allow[used[slot]] == 2:
            at = np.flatnonzero((column == k) & (row >= 0))
            owner, shortened = row[at], mine[row[at]] - h[at]
        if inst.parts > 1:
            rows = np.flatnonzero(mine % np.uint64(inst.parts) == part)
            here = shortened % np.uint64(inst.parts) == part
            owner, shortened = owner[here], shortened[here]
        for a, b in segment_pairs(mine[rows], rows, own, shortened, owner):
            met += len(a)
            sa, sb = size[a], size[b]
            long, short = np.maximum(sa, sb), np.minimum(sa, sb)
            ok = np.flatnonzero((short >= np.float32(threshold) * long - np.float32(1e-3)) & (a != b))
            a, b, most = a[ok], b[ok], (sa[ok] + sb[ok]) * np.float32(share) + np.float32(1e-3)
            far = np.bitwise_count(sketch[a] ^ sketch[b])
            ok = far.sum(axis=1, dtype=np.uint16 if far.shape[1] < 1024 else np.uint32) <= most
            a, b = a[ok], b[ok]
            found.append(np.minimum(a, b).astype(np.int64) * len(name) + np.maximum(a, b))
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return np.concatenate([name[both // len(name)], name[both % len(name)]], axis=1), met


# ---------------------------------------------------------------- operator


def _band_counts(sets: DataFrame, edges: list[int]) -> DataFrame:
    """(band, code, texts): how many texts of each size band have each code; code -1 counts the texts."""
    limits = np.array(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            size, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            band = np.searchsorted(limits, size, "right") - 1
            for b in np.unique(band):
                mine = np.flatnonzero(band == b)
                code = code_of(np.concatenate([unpack(words[i]) for i in mine]), CODES).astype(np.int64)
                seen = np.unique(np.repeat(np.arange(len(mine)), size[mine]) * CODES + code) % CODES
                counts = held.setdefault(int(b), np.zeros(CODES + 1, np.int64))
                counts[:CODES] += np.bincount(seen, minlength=CODES)
                counts[CODES] += len(mine)
        for b, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), b, np.int32)), pa.array(np.where(at == CODES, -1, at).astype(np.int32)), pa.array(counts[at])],
                names=["band", "code", "texts"],
            )

    found = sets.select("n", "words").mapInArrow(run, "band int, code int, texts bigint")
    return found.groupBy("band", "code").agg(F.sum("texts").alias("texts"))


def plan_index(sets: DataFrame, min_words: int, threshold: float, task_bytes: float = TASK_BYTES, task_cost: float = TASK_COST) -> list[Instance]:
    """The indexes of all size bands, from the counts of all texts. What comes to the driver has at most CODES
    rows a band, and there are some 8 bands to a factor of 10 in length."""
    longest = sets.agg(F.max("n")).first()[0]
    if longest is None:
        return []
    edges = band_edges(longest, min_words, threshold)
    counts = np.zeros((len(edges), CODES), np.int64)
    texts = np.zeros(len(edges), np.int64)
    got = _band_counts(sets, edges).toArrow()
    band, code, n = (got.column(k).to_numpy() for k in range(3))
    counts[band[code >= 0], code[code >= 0]] = n[code >= 0]
    texts[band[code < 0]] = n[code < 0]
    plans = []
    for b in np.flatnonzero(texts):
        near = slice(max(0, b - BAND_STEPS), b + 1)
        plans.append(plan_instance(int(b), edges[b], min(edges[b + 1] - 1, longest), threshold, counts[near].sum(axis=0), int(texts[near].sum()), task_bytes, task_cost))
    return plans


def similar_classes(sets: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, task_bytes: float = TASK_BYTES, task_cost: float = TASK_COST, hot_rows: int = HOT_ROWS, round_bytes: float | None = None) -> DataFrame:
    """(a1, a2, b1, b2, similarity): the pairs of different multisets that share at least ``threshold``.

    sets: rows of word_sets, best cut. Copies count once throughout: a batch sends a multiset once, and a task
    drops those it has, so a text that is a third of all rows costs no more than its batches.
    """
    spark = sets.sparkSession
    plans = plan_index(sets, min_words, threshold, task_bytes, task_cost)
    if not plans:
        return spark.createDataFrame([], "a1 bigint, a2 bigint, b1 bigint, b2 bigint, similarity double")
    shared = spark.sparkContext.broadcast(plans)
    if round_bytes is None:
        round_bytes = max(ROUND_BYTES, ROUND_SHARE * 5 * (sets.agg(F.sum("n")).first()[0] or 0))

    def index(batches: Iterator[pa.RecordBatch], slices) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(0).to_numpy().astype(np.int64)
            name = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
            for band, group, part, block in index_rows(size, name, batch.column(3).to_pylist(), slices.value):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([band], pa.int32()), pa.array([group], pa.int32()), pa.array([part], pa.int32()), pa.array([block], pa.binary())],
                    names=["band", "grp", "part", "block"],
                )

    def candidates(key: tuple, group: pa.Table) -> pa.Table:
        band, grp, part = (k.as_py() for k in key)
        plan = next(p for p in shared.value if p.band == band)
        pairs, _ = group_candidates(group.column("block").to_pylist(), plan, grp, part, threshold)
        swap = (pairs[:, 0] > pairs[:, 2]) | ((pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] > pairs[:, 3]))
        pairs[swap] = pairs[swap][:, [2, 3, 0, 1]]
        return pa.table({k: pa.array(np.ascontiguousarray(pairs[:, i])) for i, k in enumerate(("a1", "a2", "b1", "b2"))})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                both = len(np.intersect1d(unpack(x), unpack(y), assume_unique=True))
                sims.append(both / (len(x) // 5 + len(y) // 5 - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sims, pa.float64())], names=["a1", "a2", "b1", "b2", "similarity"])

    def pairs_of(slices: list[Slice]) -> DataFrame:
        held = spark.sparkContext.broadcast(slices)
        sized = F.col("n").between(min(s.inst.low for s in slices), max(s.inst.high for s in slices))
        blocks = sets.where(sized).select("n", "h1", "h2", "words").mapInArrow(lambda b: index(b, held), "band int, grp int, part int, block binary")
        # a task a group of segments or two, as candidates are dear for their bytes
        tasks = min(2 * sum(s.last - s.first for s in slices), MAX_TASKS)
        return cut(blocks.repartition(tasks, "band", "grp", "part").groupBy("band", "grp", "part").applyInArrow(candidates, "a1 bigint, a2 bigint, b1 bigint, b2 bigint").distinct())

    rounds = plan_rounds(plans, round_bytes)
    if len(rounds) == 1:
        pairs = pairs_of(rounds[0])
    else:
        with dropped_shuffles(spark):
            each = [pairs_of(slices) for slices in rounds]
        pairs = cut(reduce(DataFrame.unionByName, each).distinct())
    names = pairs.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).unionByName(pairs.select(F.col("b1").alias("h1"), F.col("b2").alias("h2"))).distinct()
    # only texts with a candidate are moved again: a Bloom filter of bounded size finds them where they lie
    bits = bloom_blocks(2 * pairs.count())
    needed = might_exist(sets.select("h1", "h2", "words"), "h1", bloom_filter(names, "h1", bits), bits, "_maybe").where("_maybe").drop("_maybe")
    needed = cut(needed.join(names.hint("merge"), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]))
    a = needed.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("words").alias("x"))
    b = needed.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("words").alias("y"))
    # a text with very many candidates meets them by broadcast, on either side
    both = join_unique(join_unique(pairs, a, ["a1", "a2"], "inner", hot_rows), b, ["b1", "b2"], "inner", hot_rows, pairs).select("a1", "a2", "b1", "b2", "x", "y")
    return both.mapInArrow(verify, "a1 bigint, a2 bigint, b1 bigint, b2 bigint, similarity double").where(F.col("similarity") >= threshold - 1e-12)


@dataclass
class NearDuplicates:
    """members: (id, h1, h2), each id once, with the multiset it has; links: similar pairs of multisets."""

    members: DataFrame
    links: DataFrame
    hot_rows: int = HOT_ROWS

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: all similar pairs of ids, copies of one text included. As many rows as
        there are pairs; where copies are many, use links, classes or degrees. A class of many copies is spread
        over tasks."""
        copies = self.members.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
        same = copies.select(F.col("h1").alias("a_h1"), F.col("h2").alias("a_h2"), F.col("h1").alias("b_h1"), F.col("h2").alias("b_h2"))
        other = self.links.select(F.col("a1").alias("a_h1"), F.col("a2").alias("a_h2"), F.col("b1").alias("b_h1"), F.col("b2").alias("b_h2"))
        return expand_pairs(other.unionByName(same), self.members, ["h1", "h2"], hot_rows=self.hot_rows)

    def degrees(self) -> DataFrame:
        """(id, class_id, copies, links): one row an id: the smallest id with the same multiset, how many have
        it, and to how many other ids it is linked, copies included. Nothing is expanded."""
        classes = self.members.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
        size = classes.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), "copies")
        turned = self.links.select("a1", "a2", "b1", "b2").unionByName(self.links.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")))
        far = join_unique(turned, size, ["b1", "b2"], "inner", self.hot_rows).groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(F.sum("copies").alias("others"))
        totals = classes.join(far.hint("merge"), ["h1", "h2"], "left").select("h1", "h2", "class_id", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"))
        return join_unique(self.members, totals, ["h1", "h2"], "inner", self.hot_rows).select("id", "class_id", "copies", "links")


def near_duplicates(
    df: DataFrame, id_column: str, text_column: str, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, task_bytes: float = TASK_BYTES, task_cost: float = TASK_COST, hot_rows: int = HOT_ROWS, round_bytes: float | None = None
) -> NearDuplicates:
    """Texts of at least ``min_words`` words (longest runs of letters and digits, lower case, repetitions
    counted) that share at least ``threshold`` of them: the sum of the smaller counts over that of the larger.

    Word order plays no part. Null ids and texts and shorter texts take no part; the empty text is one of
    them. A repeated row counts once; an id with several texts has each of them. Texts are taken whole. Any
    number of equal texts, no text at all, and further columns of any name are fine. No pair is missed.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    sets = cut(word_sets(spread(df.select(id_column, text_column)), id_column, text_column, min_words))
    links = similar_classes(sets, min_words, threshold, task_bytes, task_cost, hot_rows, round_bytes)
    return NearDuplicates(sets.select("id", "h1", "h2").distinct(), cut(links), hot_rows)


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", chunk_body(F.col("text")).alias("body"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(_bodies(spark, d), "id", "body").pairs().distinct()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a chunk: its class of equal bodies and its number of near-duplicates."""
    return near_duplicates(_bodies(spark, d), "id", "body").degrees()


_COUNTS = f"""bodies as (select distinct id, substr(text, instr(text, chr(10) || chr(10)) + 2) body from chunks where instr(text, chr(10) || chr(10)) > 0),
lists as (select id, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') w from bodies),
long as (select * from lists where len(w) >= {MIN_WORDS}),
words as (select id, len(w) n, unnest(w) word from long),
counts as (select id, n, word, count(*) k from words group by all),
shared as (select a.id id_a, b.id id_b, a.n + b.n total, sum(least(a.k, b.k)) both_
  from counts a join counts b on a.word = b.word and a.id < b.id and least(a.n, b.n) >= 0.75 * greatest(a.n, b.n) group by all),
pairs as (select id_a, id_b from shared where both_ >= 0.75 * (total - both_))"""
QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
SQL = {
    "p5_found": f"with {_COUNTS} select id_a, id_b from pairs",
    "p5_groups": f"""with {_COUNTS}, ends as (select id_a id from pairs union all select id_b from pairs), degrees as (select id, count(*) links from ends group by 1),
      keyed as (select id, list_sort(w) key from long)
      select id, min(id) over (partition by key) class_id, count(*) over (partition by key) copies, coalesce(links, 0)::bigint links from keyed left join degrees using (id)""",
}
