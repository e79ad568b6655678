"""Joins that hold when one key has a third of all rows.

A key with more than one in HOT_SHARE of the rows is hot, so there are fewer than HOT_SHARE of them whatever the
data. Rows with a hot key meet their partner by broadcast and are never shuffled; all others are joined by
sorting, with at most that share of the rows on one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillmark.session import cut

HOT_SHARE = 4096
#: A key with fewer rows than this is no burden to any task.
HOT_ROWS = 200_000


def hot_keys(rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> list[Row]:
    """The keys without nulls that hold more than ``hot_rows`` rows and more than one in HOT_SHARE of all: fewer
    than HOT_SHARE. Counted by partial aggregation over the key columns alone."""
    total = rows.count()
    if total <= hot_rows:
        return []
    counts = rows.select(*keys).dropna().groupBy(*keys).agg(F.count("*").alias("_n"))
    return counts.where(F.col("_n") > max(hot_rows, total // HOT_SHARE)).select(*keys).collect()


def join_unique(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = HOT_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """rows joined with lookup, which has each key at most once. how: inner, left, left_semi or left_anti.
    counted: what the keys are counted in instead of rows, where those are dear to compute twice.

    Equal keys join, null ones never do. Neither side is broadcast as a whole, whatever Spark takes its size
    for: of lookup only the rows of hot keys are, fewer than HOT_SHARE.
    """
    hot = hot_keys(rows if counted is None else counted, keys, hot_rows)
    if not hot:
        return rows.join(lookup.hint("merge"), keys, how)
    named = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(*keys).schema))
    held = lookup.join(named, keys, "left_semi")
    cold = rows.join(named, keys, "left_anti").join(lookup.hint("merge"), keys, how)
    return cold.unionByName(rows.join(named, keys, "left_semi").join(F.broadcast(held), keys, how))


def _salted(members: DataFrame, sizes: DataFrame, keys: list[str], most: int, hot_rows: int) -> DataFrame:
    """members with ``_salt``: which of its class's parts of about ``most`` rows a member is in."""
    held = join_unique(members, sizes, keys, "inner", hot_rows)
    return held.withColumn("_salt", F.pmod(F.xxhash64("id"), F.floor(F.col("_n") / most) + 1).cast("int"))


def expand_pairs(links: DataFrame, members: DataFrame, keys: list[str], most: int = 20_000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id_a, id_b), id_a < id_b: for every pair of classes the pairs of an id of the one with an id of the other; a
    class paired with itself stands for the pairs of its ids.

    links: a_<key> and b_<key> for each key, each pair of classes once; members: id and keys, each id of a class
    once. A class of more than ``most`` members is spread over parts, which meet the links' parts one by one, so
    neither a class of many copies nor one with many links is gathered in a task.
    """
    links = cut(links)
    ends = [links.select(*(F.col(f"{side}_{k}").alias(k) for k in keys)) for side in "ab"]
    linked = cut(members.join(ends[0].unionByName(ends[1]).distinct().hint("merge"), keys, "left_semi"))
    sizes = linked.groupBy(*keys).agg(F.count("*").alias("_n"))
    parts = _salted(linked, sizes, keys, most, hot_rows)
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    out = links.withColumn("_same", same)
    named = {side: [f"{side}_{k}" for k in keys] for side in "ab"}
    rename = lambda df, side, *rest: df.select(*(F.col(k).alias(n) for k, n in zip(keys, named[side], strict=True)), *rest)
    for side in "ab":
        spread = F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / most).cast("int")))
        out = join_unique(out, rename(sizes, side, "_n"), named[side], "inner", hot_rows, links).withColumn(f"_salt_{side}", spread).drop("_n")
    for side in "ab":
        ids = rename(parts, side, F.col("_salt").alias(f"_salt_{side}"), F.col("id").alias(f"_{side}"))
        out = out.join(ids.hint("merge"), [*named[side], f"_salt_{side}"]).drop(f"_salt_{side}", *named[side])
    return out.where(~F.col("_same") | (F.col("_a") < F.col("_b"))).select(F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b"))
