"""The search plan: units, two ranked legs under one pushed-down filter, rank fusion, best hits by cosine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.config import SEARCH_MAX_UNITS
from quillmark.functions.text import is_blank, split_query
from quillmark.operators import fusion, lexical, vector

_ALIASES = {"array_has": "array_contains", "list_contains": "array_contains"}
_SUBQUERY = re.compile(r"\b(select|exists)\b", re.IGNORECASE)
_STRING = re.compile(r"'(?:[^']|'')*'")


class FilterError(ValueError):
    """A filter that is not a plain boolean expression over the columns."""


def sql_quote(value: str) -> str:
    """A string constant for a filter (F2)."""
    return "'" + value.replace("'", "''") + "'"


def sql_in_list(values: list[str]) -> str:
    """The right side of IN for a filter."""
    return "(" + ", ".join(map(sql_quote, values)) + ")"


def apply_filter(rows: DataFrame, predicate: str | None) -> DataFrame:
    """Rows that meet a SQL predicate, set below all ranking so that it reaches the scan. ``array_has`` is
    understood. Subqueries and anything but one boolean expression are refused."""
    if predicate is None or is_blank(predicate):
        return rows
    outside = _STRING.sub("''", predicate)
    if _SUBQUERY.search(outside) or ";" in outside:
        raise FilterError(f"the filter may not hold a subquery or several statements: {predicate}")
    # string constants stay as they are
    pieces = _STRING.split(predicate)
    for alias, name in _ALIASES.items():
        pieces = [re.sub(rf"\b{alias}\s*\(", f"{name}(", p, flags=re.IGNORECASE) for p in pieces]
    predicate = "".join(a + b for a, b in zip(pieces, [*_STRING.findall(predicate), ""], strict=True))
    kept = rows.where(F.expr(predicate))
    kept.schema  # noqa: B018  analyses now, so that a wrong filter fails here
    return kept


def unit_rows(spark, query: str, max_units: int = SEARCH_MAX_UNITS) -> DataFrame | None:
    """(unit, query) of a query's pieces; None for a blank query."""
    if is_blank(query):
        return None
    return spark.createDataFrame(list(enumerate(split_query(query, max_units))), "unit int, query string")


def hybrid_ranks(vector_scores: DataFrame, lexical_scores: DataFrame, limit: int, leg_limit: int | None = None) -> DataFrame:
    """(unit, id, score, rank) by rank fusion of the two legs."""
    depth = leg_limit or limit
    return fusion.rrf([lexical.ranked(vector_scores, depth), lexical.ranked(lexical_scores, depth)], limit)


def hashed_hybrid(docs: DataFrame, queries: DataFrame, limit: int, leg_limit: int | None = None, predicate: str | None = None) -> DataFrame:
    """Hybrid ranking with the hashing embedder; docs (id, text, ...), queries (unit, query)."""
    kept = apply_filter(docs, predicate)
    depth = leg_limit or limit
    near = vector.hash_best(kept, queries, depth)
    words = lexical.bm25_best(docs, queries, depth, kept if predicate else None)
    fused = hybrid_ranks(near, words, limit, leg_limit)
    # the cosine is worked out for the few rows that are left
    picked = docs.join(fused.select("id").distinct(), "id", "left_semi")
    asked = vector.hash_embedding(queries, "unit", "query").select(F.col("id").alias("unit"), "bucket", F.col("value").alias("q"))
    rows = fused.select("unit", "id").join(vector.hash_embedding(picked, "id", "text"), "id")
    cosine = rows.join(asked, ["unit", "bucket"]).groupBy("unit", "id").agg(F.sum(F.col("value") * F.col("q")).alias("cosine"))
    return fused.join(cosine, ["unit", "id"], "left")
