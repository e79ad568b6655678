"""Items that appear together (problem 3): pair counts over baskets, with blocking of large baskets.

A basket of more than ``block`` items is split into item chunks; every pair of its chunks is a product of its
own, done by whichever task gets it. Ordinary baskets are one chunk paired with itself. Counts of both kinds
are combined by one aggregation, then set against what chance would give. A basket or an item with a large
share of all rows meets its count by broadcast and is never gathered (``join_unique``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.columns import tag_key, title_key
from quillmark.operators.skew import HOT_ROWS, join_unique
from quillmark.plans.orphan_queries import sql_title_key
from quillmark.session import cut, table

#: Items in a chunk of a large basket: a product has about BLOCK^2 pairs, so that no task is held up by one basket.
#: Files have few items, so that there a basket of more than FILE_BLOCK counts as large.
BLOCK, FILE_BLOCK = 32, 8


def item_counts(baskets: DataFrame) -> DataFrame:
    """(kind, item, held) over distinct (kind, record, item) rows."""
    return baskets.groupBy("kind", "item").agg(F.count("*").alias("held"))


def basket_chunks(baskets: DataFrame, block: int = BLOCK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(kind, record, x, y, lefts, rights) with arrays of items: all chunk products of every basket, x <= y.

    A basket's items are never gathered in one place: its size comes from a partial aggregation, and a chunk
    is grouped by (record, chunk number), with about ``block`` items. For x = y only lefts is filled.
    """
    sizes = baskets.groupBy("kind", "record").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / block).cast("int")
    chunked = (
        join_unique(baskets, sizes, ["kind", "record"], "inner", hot_rows)
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
        .groupBy("kind", "record", "parts", "part")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    one = chunked.where("parts = 1").select("kind", "record", F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("items").alias("lefts"), F.lit(None).cast("array<string>").alias("rights"))
    many = chunked.where("parts > 1").withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    products = many.groupBy("kind", "record", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y")).agg(
        F.max(F.when(F.col("part") <= F.col("other"), F.col("items"))).alias("lefts"),
        F.max(F.when(F.col("part") > F.col("other"), F.col("items"))).alias("rights"),
    )
    return one.unionByName(products)


def pair_counts(baskets: DataFrame, block: int = BLOCK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(kind, item_a, item_b, both), item_a < item_b, over distinct (kind, record, item) rows."""
    chunks = basket_chunks(baskets, block, hot_rows)
    ordinary = chunks.where("x = y").select("kind", F.posexplode("lefts").alias("at", "a"), "lefts").select("kind", "a", F.explode(F.expr("slice(lefts, at + 2, size(lefts))")).alias("b"))
    crossing = chunks.where("x < y").select("kind", F.explode("lefts").alias("a"), "rights").select("kind", "a", F.explode("rights").alias("b"))
    return (
        ordinary.unionByName(crossing)
        .groupBy("kind", F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b"))
        .agg(F.count("*").alias("both"))
    )


def cooccurring(
    items: DataFrame,
    records: int,
    min_both: int = 3,
    min_share: float = 1 / 500,
    min_lift: float = 3.0,
    block: int = BLOCK,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(kind, item_a, item_b, both, held_a, held_b, lift, pmi, jaccard) of the pairs held together by at least
    ``min_both`` records and that share of all, at least ``min_lift`` times as often as chance would have it.

    items: kind, record, item (strings); null or empty items and null records are left out, repeats count
    once. records: the number of all records, those without items included. Two exact bounds thin the baskets
    before any pair is made: no pair is more frequent than its rarer item, and a pair whose lift is reached
    has no item in more than records / min_lift of them. Both follow from the thresholds; with thresholds of 0
    nothing is left out. Empty tables give no rows.
    """
    rows = cut(items.where("record is not null and item is not null and item <> ''").select("kind", "record", "item").distinct())
    least = max(float(min_both), min_share * records)
    held = item_counts(rows).where(F.col("held") >= least)
    if min_lift > 0:
        held = held.where(F.col("held") * F.lit(float(min_lift)) <= F.lit(float(records)))
    held = cut(held)
    kept = cut(join_unique(rows, held.select("kind", "item"), ["kind", "item"], "left_semi", hot_rows))
    pairs = pair_counts(kept, block, hot_rows).where(F.col("both") >= least)
    a = held.select("kind", F.col("item").alias("item_a"), F.col("held").alias("held_a"))
    b = held.select("kind", F.col("item").alias("item_b"), F.col("held").alias("held_b"))
    lift = F.col("both") * F.lit(float(records)) / (F.col("held_a") * F.col("held_b"))
    return (
        pairs.join(a.hint("merge"), ["kind", "item_a"])
        .join(b.hint("merge"), ["kind", "item_b"])
        .where(F.col("both") * F.lit(float(records)) >= F.lit(float(min_lift)) * F.col("held_a") * F.col("held_b"))
        .select(
            "kind", "item_a", "item_b", "both", "held_a", "held_b",
            F.round(lift, 6).alias("lift"),
            F.round(F.log2(lift), 6).alias("pmi"),
            F.round(F.col("both") / (F.col("held_a") + F.col("held_b") - F.col("both")), 6).alias("jaccard"),
        )
    )


def _exploded(chunks: DataFrame, record: str, kind: str, column: str, key) -> DataFrame:
    """Distinct spellings are few, so the key is made after a first partial de-duplication."""
    raw = chunks.where(F.size(column) > 0).select(F.col(record).alias("record"), F.explode(column).alias("raw")).distinct()
    item: Column = key(F.col("raw"))
    return raw.select(F.lit(kind).alias("kind"), "record", item.alias("item"))


def _pairs_by(chunks: DataFrame, record: str, block: int = BLOCK) -> DataFrame:
    """Pairs of tags and of entities held together by records, which are the distinct values of a column."""
    records = chunks.select(record).distinct().where(F.col(record).isNotNull()).count()
    items = _exploded(chunks, record, "tag", "tags", tag_key).unionByName(_exploded(chunks, record, "entity", "entities", title_key))
    return cooccurring(items, records, block=block)


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs_by(table(spark, d, "chunks").select("source_id", "tags", "entities"), "source_id", FILE_BLOCK)


def p3_titles(spark: SparkSession, d: str) -> DataFrame:
    """The same with a title as the record: one title has a tenth of all rows, hence a basket of very many items."""
    return _pairs_by(table(spark, d, "chunks").select("title", "tags", "entities"), "title")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pairs(spark, d).select(F.col("kind").alias("item_kind"), "item_a", "item_b")


_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _sql_tag_key(c: str) -> str:
    edges = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
    return edges(f"regexp_replace({edges(f'lower({c})')}, '^#+', '')")


def _pairs(record: str) -> str:
    return f"""
with items as (
  select distinct 'tag' kind, {record} record, {_sql_tag_key('x')} item from (select {record}, unnest(tags) x from chunks)
  union
  select distinct 'entity', {record}, {sql_title_key('x')} from (select {record}, unnest(entities) x from chunks)),
rows as (select * from items where record is not null and item is not null and item <> ''),
n as (select count(distinct {record}) n from chunks),
held as (select kind, item, count(*) held from rows group by 1, 2),
pairs as (select a.kind, a.item item_a, b.item item_b, count(*) both_
  from rows a join rows b on a.kind = b.kind and a.record = b.record and a.item < b.item group by 1, 2, 3 having count(*) >= 3)
select p.kind, item_a, item_b, both_, a.held held_a, b.held held_b, n
from pairs p, n, held a, held b
where a.kind = p.kind and a.item = item_a and b.kind = p.kind and b.item = item_b
  and both_ * 500 >= n and both_ * n >= 3 * a.held * b.held
"""


def _scored(record: str) -> str:
    return f"""select kind, item_a, item_b, both_ as "both", held_a, held_b, round(both_ * n::double / (held_a * held_b), 6) lift,
      round(log2(both_ * n::double / (held_a * held_b)), 6) pmi, round(both_::double / (held_a + held_b - both_), 6) jaccard from ({_pairs(record)})"""


QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs, "p3_titles": p3_titles}
SQL = {
    "p3_found": f"select kind item_kind, item_a, item_b from ({_pairs('source_id')})",
    "p3_pairs": _scored("source_id"),
    "p3_titles": _scored("title"),
}
