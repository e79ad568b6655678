"""Problem 4 on the engine's tables: link targets and injected titles without a file at the end of their month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.columns import instant, title_key
from quillmark.operators.orphans import orphan_references
from quillmark.operators.skew import join_unique
from quillmark.session import table


def month_number(ts: Column) -> Column:
    """Months since year 0, in UTC (the session's time zone must be UTC)."""
    return F.year(ts) * 12 + F.month(ts) - 1


def month_text(number: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"))


def title_spans(manifest: DataFrame, changes: DataFrame, horizon: int) -> DataFrame:
    """(title, since, until): months, up to the horizon, at whose ends a file is there, one row a span and file.

    Events of a file are reduced to the last of each month before anything is gathered by file, so a file
    with most of all changes is no burden. At the same instant an indexing counts as later than a removal.
    """
    indexed = manifest.select("source_id", instant(F.col("indexed_at")).alias("ts"), F.lit(True).alias("there"))
    removed = changes.where(F.col("change_kind") == "removed").select("source_id", F.col("happened_at").alias("ts"), F.lit(False).alias("there"))
    last = (
        indexed.unionByName(removed)
        .where("source_id is not null and ts is not null")
        .groupBy("source_id", month_number(F.col("ts")).alias("month"))
        .agg(F.max(F.struct("ts", "there")).alias("last"))
    )
    until = F.coalesce(F.lead("month").over(Window.partitionBy("source_id").orderBy("month")) - 1, F.lit(horizon))
    spans = last.withColumn("until", until).where("last.there and month <= until")
    title = title_key(F.regexp_replace("source_id", "^[^:]*:", ""))
    return spans.select(title.alias("title"), F.col("month").alias("since"), "until").where(F.col("title") != "")


def title_references(chunks: DataFrame, manifest: DataFrame, injections: DataFrame) -> DataFrame:
    """(ref_table, row_key, ref_title, month, title) of every reference; null and blank titles name nothing."""
    seen = manifest.where("source_id is not null").groupBy("source_id").agg(F.max(instant(F.col("indexed_at"))).alias("ts"))
    holders = chunks.where(F.size("entities") > 0).select("id", "source_id", "entities")
    linked = join_unique(holders, seen, ["source_id"]).select(
        F.lit("chunks").alias("ref_table"), F.col("id").alias("row_key"), F.explode("entities").alias("ref_title"), "ts"
    )
    shown = injections.where(F.size("injected") > 0).select(
        F.lit("injections").alias("ref_table"),
        F.col("log_id").cast("string").alias("row_key"),
        F.explode("injected.title").alias("ref_title"),
        instant(F.col("recall_at")).alias("ts"),
    )
    return (
        linked.unionByName(shown)
        .where("ref_title is not null and ts is not null and row_key is not null")
        .select("ref_table", "row_key", "ref_title", month_number(F.col("ts")).alias("month"), title_key(F.col("ref_title")).alias("title"))
        .where("title <> ''")
    )


def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    chunks, manifest, changes, injections = (table(spark, d, t) for t in ("chunks", "manifest", "changes", "injections"))
    latest = manifest.select(instant(F.col("indexed_at")).alias("ts")).unionByName(injections.select(instant(F.col("recall_at")).alias("ts")))
    horizon = latest.agg(F.max(month_number(F.col("ts")))).first()[0] or 0
    return orphan_references(title_references(chunks, manifest, injections), title_spans(manifest, changes, horizon), "title", "month")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_rows(spark, d).select("ref_table", month_text(F.col("month")).alias("ref_month"), "row_key", "ref_title").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and month."""
    return (
        p4_found(spark, d)
        .groupBy("ref_table", "ref_month")
        .agg(F.count("*").alias("orphans"), F.countDistinct("row_key").alias("rows_with_orphans"))
    )


WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_title_key(c: str) -> str:
    blank = f"regexp_replace(replace(lower({c}), '_', ' '), '{WS}+', ' ', 'g')"
    return f"trim(regexp_replace(trim(regexp_replace({blank}, '^.*/', '')), '\\.md$', ''))"


_FOUND = f"""
with ev as (
  select source_id, indexed_at::timestamptz at time zone 'UTC' ts, true there from manifest
  union all select source_id, (happened_at::timestamptz at time zone 'UTC')::timestamp, false from changes where change_kind = 'removed'),
refs as (
  select 'chunks' ref_table, c.id row_key, unnest(c.entities) ref_title, m.ts
  from chunks c join (select source_id, max(indexed_at::timestamptz at time zone 'UTC') ts from manifest group by 1) m using (source_id)
  union all
  select 'injections', log_id::varchar, x.title, recall_at::timestamptz at time zone 'UTC'
  from (select log_id, recall_at, unnest(injected) x from injections)),
keyed as (
  select distinct ref_table, row_key, ref_title, {sql_title_key('ref_title')} title, date_trunc('month', ts)::date m
  from refs where ref_title is not null),
months as (select distinct m from keyed),
states as (
  select e.source_id, mo.m, arg_max(e.there, (e.ts, e.there)) there
  from ev e join months mo on e.ts < mo.m + interval 1 month group by 1, 2),
present as (
  select distinct {sql_title_key("regexp_replace(source_id, '^[^:]*:', '')")} title, m from states where there)
select k.ref_table, strftime(k.m, '%Y-%m') ref_month, k.row_key, k.ref_title
from keyed k anti join present p on k.title = p.title and k.m = p.m
where k.title <> ''
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
SQL = {
    "p4_found": _FOUND,
    "p4_report": f"select ref_table, ref_month, count(*)::bigint orphans, count(distinct row_key)::bigint rows_with_orphans from ({_FOUND}) group by 1, 2",
}
