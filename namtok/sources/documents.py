"""Documents from literals and from lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_texts(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def from_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): a document for each line of the files at a path; ids ascend within a file but have gaps."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))
