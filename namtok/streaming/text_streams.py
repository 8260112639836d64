"""The stateless operators on streams, and windowed counts as an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namtok.functions.charclass import kind
from namtok.functions.text import pre_tokens, split_sentences


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """One document a line of the text files that arrive in a folder."""
    return spark.readStream.text(path).withColumnRenamed("value", "text")


def token_stream(stream: DataFrame, text_col: str = "text", keep_whitespace: bool = False) -> DataFrame:
    """The stream's columns with ord, token and kind of every script run."""
    rows = stream.select("*", F.posexplode(pre_tokens(F.col(text_col))).alias("ord", "token")).withColumn("kind", kind(F.col("token")))
    return rows if keep_whitespace else rows.filter("kind <> 'Whitespace'")


def sentence_stream(stream: DataFrame, text_col: str = "text") -> DataFrame:
    return stream.select("*", F.posexplode(split_sentences(F.col(text_col))).alias("ord", "sentence"))


def windowed_counts(stream: DataFrame, time_col: str, key_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key, with a watermark."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), key_col).agg(F.count("*").alias("n"))
