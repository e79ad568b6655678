"""Merging of hits: reciprocal rank fusion, gate and arg-max per file, de-duplication, fair interleave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.config import COSINE_GATE, RRF_CONSTANT


def rrf(legs: list[DataFrame], limit: int, constant: int = RRF_CONSTANT) -> DataFrame:
    """(unit, id, score, rank): legs of (unit, id, rank from 0) fused by the sum of 1 / (rank + constant)."""
    both = reduce(DataFrame.unionByName, (leg.select("unit", "id", "rank") for leg in legs))
    fused = both.groupBy("unit", "id").agg(F.sum(1 / (F.col("rank") + F.lit(float(constant)))).alias("score"))
    w = Window.partitionBy("unit").orderBy(F.round("score", 12).desc(), F.col("id"))
    return fused.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < limit)


def arrival(*columns: str) -> Column:
    return F.struct(*columns)


def best_k(hits: DataFrame, k: int, key: list[str], within: list[str], order: list[str]) -> DataFrame:
    """The k best hits of each request by cosine, one for each (source_type, rel_path, text) (A3, T5).

    within: columns of the request; key: of the chunk; order: arrival, which settles ties.
    """
    first = Window.partitionBy(*within, *key).orderBy(F.col("cosine").desc(), *order)
    rank = Window.partitionBy(*within).orderBy(F.col("cosine").desc(), *order)
    unique = hits.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
    return unique.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)


def consolidate(hits: DataFrame, within: list[str], order: list[str], gate: float = COSINE_GATE) -> DataFrame:
    """One row per file of a request among the hits at or above the gate (A2, F5): cosine and heading of its
    best hit, of equal ones the first; title, captured and path of its first; ``at`` is when it first appeared."""
    arrived = F.struct(*order)
    gated = hits.where(F.col("cosine") >= gate)
    files = gated.groupBy(*within, "source_type", "rel_path").agg(
        F.min(arrived).alias("at"),
        F.min(F.struct((-F.col("cosine")).alias("c"), arrived.alias("a"), F.col("heading_path").alias("h"))).alias("best"),
        F.min_by(F.struct("title", "captured", "path"), arrived).alias("first"),
    )
    return files.select(
        *within, "source_type", "rel_path", "first.title", "first.captured", "first.path",
        F.col("best.h").alias("heading_path"), (-F.col("best.c")).alias("cosine"), "at",
    )


def round_robin(pointers: DataFrame, limit: int, within: list[str]) -> DataFrame:
    """Fair interleave (W1): collections in the order of their best pointer take turns; ``place`` from 1."""
    by = [F.col("cosine").desc(), F.col("at")]
    turn = F.row_number().over(Window.partitionBy(*within, "source_type").orderBy(*by))
    overall = F.row_number().over(Window.partitionBy(*within).orderBy(*by))
    lead = F.min("_all").over(Window.partitionBy(*within, "source_type"))
    place = F.row_number().over(Window.partitionBy(*within).orderBy("_turn", "_lead"))
    ordered = pointers.withColumn("_all", overall).withColumn("_turn", turn).withColumn("_lead", lead)
    return ordered.withColumn("place", place).where(F.col("place") <= limit).drop("_all", "_turn", "_lead")


def top_cosine(hits: DataFrame, within: list[str]) -> DataFrame:
    """Greatest cosine of a request before the gate (A4)."""
    return hits.groupBy(*within).agg(F.max("cosine").alias("top_cosine"))
