"""References to records that do not exist (problem 4).

A split-block Bloom filter of the parents' keys, one 256-bit block per row, is built by one aggregation and
broadcast. A reference that misses it is an orphan for certain; of the others each distinct key is joined
exactly once, and their rows take over the answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.skew import HOT_ROWS, join_unique
from quillmark.session import cut

BLOCK_BITS = 256
LANES = 4
#: 2^20 rows of a block id and four words: some 60 MB broadcast at the very most.
MAX_BLOCKS = 1 << 20
#: With fewer bits for a key a filter passes nearly everything, so none is built.
LEAST_BITS = 4


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _lane(key: Column, lane: int) -> Column:
    """One bit of the 64 of a lane, from a hash of its own."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(F.lit(lane + 1), key), F.lit(64)).cast("int"))


def bloom_blocks(rows: int, bits_per_key: int = 16, max_blocks: int = MAX_BLOCKS) -> int:
    """Blocks for that many keys: a power of two, never above max_blocks. A filter that would need more
    lets more references through to the exact join; it never loses one."""
    need = max(1, rows * bits_per_key // BLOCK_BITS)
    return min(max_blocks, 1 << (need - 1).bit_length())


def bloom_filter(parents: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w3) of the distinct non-null keys. Partial aggregation leaves at most ``blocks`` rows a task."""
    k = F.col(key)
    return (
        parents.where(k.isNotNull())
        .groupBy(_block(k, blocks).alias("block"))
        .agg(*(F.bit_or(_lane(k, i)).alias(f"w{i}") for i in range(LANES)))
    )


def might_exist(refs: DataFrame, key: str, bloom: DataFrame, blocks: int, flag: str) -> DataFrame:
    """refs with a boolean: false means that no parent has this key. The filter has at most ``blocks`` rows,
    hence the broadcast is bounded."""
    k = F.col(key)
    named = bloom.select(F.col("block").alias("_block"), *(F.col(f"w{i}").alias(f"_w{i}") for i in range(LANES)))
    hit = reduce(lambda a, b: a & b, (F.col(f"_w{i}").bitwiseAND(_lane(k, i)) != 0 for i in range(LANES)))
    return (
        refs.withColumn("_block", _block(k, blocks))
        .join(F.broadcast(named), "_block", "left")
        .withColumn(flag, F.coalesce(hit, F.lit(False)))
        .drop("_block", *(f"_w{i}" for i in range(LANES)))
    )


def merged_spans(parents: DataFrame, key: str, since: str = "since", until: str = "until") -> DataFrame:
    """(key, since, until) of whole numbers, both included: the union of each key's spans as disjoint ones.

    Each span is a step up and a step down, and the steps of a key at one number are summed before anything is
    gathered, so a key with most of all spans is no burden: what is sorted by key has a row a distinct number.
    """
    steps = parents.where(F.col(key).isNotNull() & (F.col(since) <= F.col(until))).select(
        key, F.explode(F.array(F.struct(F.col(since).alias("at"), F.lit(1).alias("step")), F.struct((F.col(until) + 1).alias("at"), F.lit(-1).alias("step")))).alias("s")
    )
    summed = steps.groupBy(key, "s.at").agg(F.sum("s.step").alias("step"))
    w = Window.partitionBy(key).orderBy("at")
    level = F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a level above 0 lasts to the next step; spans that touch are joined again by keeping only starts and ends
    marked = summed.withColumn("level", level).withColumn("before", F.lag("level", 1, 0).over(w)).where("(level > 0) <> (before > 0)")
    paired = marked.withColumn("end", F.lead("at").over(w) - 1)
    return paired.where("level > 0").select(key, F.col("at").alias(since), F.col("end").alias(until))


def orphan_references(refs: DataFrame, parents: DataFrame, key: str, at: str | None = None, max_blocks: int = MAX_BLOCKS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of refs whose key no row of parents has; with ``at``, a whole number of refs, whose key no parent has
    in a span ``since`` to ``until`` (both included) that holds it.

    refs: any columns (names starting with ``_orphan`` or ``_w`` are reserved), ``key`` and ``at``.
    parents: ``key``, and with ``at`` the spans; further columns are ignored, so clashing names do no harm.

    A null key (or ``at``) refers to nothing and is no orphan; it is left out. Repeated references come out as
    often as they came in; repeated and overlapping parents count once. No parents: every reference with a key
    is an orphan; no references: no rows.

    Only the filter is broadcast, MAX_BLOCKS rows at most; where that would leave a key fewer than LEAST_BITS
    bits, no filter is built and all references count as filter-positive. A hot key is harmless: the filter is
    probed without a shuffle, each distinct filter-positive key is joined once, and rows with a hot key learn
    the answer by the broadcast of ``join_unique``.
    """
    whole = [key] if at is None else [key, at]
    asked = cut(refs.dropna(subset=whole))
    if at is None:
        known = parents.select(key).where(F.col(key).isNotNull()).distinct()
    else:
        known = merged_spans(parents, key).withColumnsRenamed({"since": "_orphan_since", "until": "_orphan_until"})
    known = cut(known)
    keys = known.count()
    if keys * LEAST_BITS <= max_blocks * BLOCK_BITS:
        blocks = bloom_blocks(keys, max_blocks=max_blocks)
        tested = might_exist(asked, key, bloom_filter(known, key, blocks), blocks, "_orphan_maybe")
    else:
        tested = asked.withColumn("_orphan_maybe", F.lit(True))
    definite = tested.where(~F.col("_orphan_maybe")).select(*refs.columns)
    maybe = tested.where("_orphan_maybe").select(*refs.columns)
    distinct = maybe.select(*whole).distinct()
    if at is None:
        bad = distinct.join(known.hint("merge"), key, "left_anti")
    else:
        there = known.withColumnRenamed(key, "_orphan_key").hint("merge")
        bad = distinct.join(there, (F.col(key) == F.col("_orphan_key")) & F.col(at).between(F.col("_orphan_since"), F.col("_orphan_until")), "left_anti")
    verified = join_unique(maybe, bad, whole, "left_semi", hot_rows)
    return definite.unionByName(verified.select(*refs.columns))
