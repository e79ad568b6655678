"""Text forms of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.columns import empty_if_null

FACTS_FRAMING = "Recorded facts and preferences that may bear on this prompt. Open the exact files; each note is itself the source:"
NOTES_FRAMING = "Dated notes that may bear on this prompt. Open the exact files, and check what they describe against its present state:"
FACTS_LABEL = "memory"
NO_HITS = "No matching notes in the index."


def _or(c: str, default: Column) -> Column:
    return F.when(empty_if_null(F.col(c)) == "", default).otherwise(F.col(c))


def pointer_line() -> Column:
    """One line of a pointer: path, heading, source, cosine and date."""
    heading = F.when(empty_if_null(F.col("heading_path")) == "", F.lit("")).otherwise(F.concat(F.lit(" > "), F.col("heading_path")))
    captured = F.when(empty_if_null(F.col("captured")) == "", F.lit("captured: unknown")).otherwise(F.concat(F.lit("captured "), F.col("captured")))
    return F.format_string(
        "  %s%s  (source %s, cos %.2f, %s)", _or("path", F.col("rel_path")), heading, _or("source_type", F.lit("notes")), F.col("cosine"), captured
    )


def framing() -> Column:
    return F.when(F.col("source_type") == FACTS_LABEL, FACTS_FRAMING).otherwise(NOTES_FRAMING)


def framed(pointers: DataFrame, within: list[str], order: str) -> DataFrame:
    """Pointers grouped by framing, groups in order of first appearance: adds framing, group and line."""
    f = pointers.withColumn("framing", framing())
    first = F.min(order).over(Window.partitionBy(*within, "framing"))
    place = F.row_number().over(Window.partitionBy(*within).orderBy("_first", order))
    return f.withColumn("_first", first).withColumn("line_no", place).withColumn("line", pointer_line()).drop("_first")


def pointer_block(pointers: DataFrame, within: list[str], order: str) -> DataFrame:
    """(within, block): the whole text block of a request."""
    rows = framed(pointers, within, order)
    groups = rows.groupBy(*within, "framing").agg(
        F.min("line_no").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("lines")
    )
    text = F.transform(F.array_sort(F.collect_list(F.struct("first", F.concat("framing", F.lit("\n"), "lines").alias("t")))), lambda s: s["t"])
    return groups.groupBy(*within).agg(F.array_join(text, "\n").alias("block"))


def hit_markdown() -> Column:
    """A hit as a markdown section; the separator stands before an empty heading, too."""
    return F.format_string(
        "## %s:%s > %s\ncosine %.3f | captured %s\n\n%s",
        F.col("source_type"), F.col("rel_path"), empty_if_null(F.col("heading_path")), F.col("cosine"), _or("captured", F.lit("unknown")), F.col("text"),
    )


def snippet(text: Column, n: int = 120) -> Column:
    return F.translate(F.substring(text, 1, n), "\n", " ")
