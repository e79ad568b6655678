"""The injection log (S15): JSON lines with an explicit schema, appended to and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.schemas import INJECTIONS


def append_log(rows: DataFrame, directory: str) -> None:
    rows.write.mode("append").json(directory)


def read_log(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.schema(INJECTIONS).json(directory)
