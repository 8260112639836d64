"""Spelling suggestions: a length-banded, piece-blocked edit join against a word list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namtok.functions.phonetic import lk82
from namtok.operators.segmentation import segment
from namtok.sources.lexicons import Lexicons

EDITS = 2


def _third(word: Column, i: int) -> Column:
    """One of three pieces of a word; words within two edits share one, moved by two places at most."""
    n = F.length(word)
    start = F.floor(n * i / 3).cast("int")
    return F.struct(F.lit(i).alias("i"), n.alias("n"), F.substring(word, start + 1, F.floor(n * (i + 1) / 3).cast("int") - start).alias("s"))


def _probes(word: Column) -> Column:
    """Where a piece of a word up to two edits away can lie in this one."""
    n, out = F.length(word), []
    for i in range(3):
        for length in range(-EDITS, EDITS + 1):
            m = n + length
            start, end = F.floor(m * i / 3).cast("int"), F.floor(m * (i + 1) / 3).cast("int")
            for move in range(-EDITS, EDITS + 1):
                at = start + move
                out.append(F.when((m >= 1) & (at >= 0) & (at + end - start <= n), F.struct(F.lit(i).alias("i"), m.alias("n"), F.substring(word, at + 1, end - start).alias("s"))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def suggestions(inputs: DataFrame, words: DataFrame, max_n: int | None = 10, input_col: str = "input") -> DataFrame:
    """(input, word, edit_distance, soundex_match, freq_score) of the best words within two edits.

    Order: same phonetic code, fewer edits, higher frequency, word. ``words`` is (word, freq); it is
    blocked on pieces that a word within two edits must share, not crossed with the inputs.
    """
    distinct = inputs.select(F.col(input_col).alias("input")).filter("input <> ''").distinct()
    keyed = words.select("word", F.col("freq").alias("freq_score"), F.explode(F.array(*[_third(F.col("word"), i) for i in range(3)])).alias("key"))
    found = distinct.select("input", F.explode(_probes(F.col("input"))).alias("key")).join(keyed, "key").drop("key").distinct()
    found = found.withColumn("edit_distance", F.levenshtein("input", "word", EDITS)).filter("edit_distance >= 0")
    found = found.withColumn("soundex_match", lk82(F.col("input")) == lk82(F.col("word"))).select("input", "word", "edit_distance", "soundex_match", F.col("freq_score").cast("bigint"))
    if max_n is None:
        return found
    best = Window.partitionBy("input").orderBy(F.desc("soundex_match"), "edit_distance", F.desc("freq_score"), "word")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max_n)


def did_you_mean(inputs: DataFrame, words: DataFrame, input_col: str = "input") -> DataFrame:
    """(input, suggestion): the best word, null if there is none or it is the input."""
    best = suggestions(inputs, words, 1, input_col).select("input", F.when(F.col("edit_distance") > 0, F.col("word")).alias("suggestion"))
    return inputs.select(F.col(input_col).alias("input")).distinct().join(best, "input", "left")


def correct_text(df: DataFrame, lexicons: Lexicons, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, corrected): unknown tokens of two or more characters are replaced; white space is lost."""
    tokens = segment(df, lexicons, id_col, text_col, spans=False)
    wrong = tokens.filter((F.col("kind") == "Unknown") & (F.length("text") >= 2))
    fixes = did_you_mean(wrong.select(F.col("text").alias("input")), lexicons.words).withColumn("kind", F.lit("Unknown"))
    fixed = tokens.join(fixes.filter("suggestion is not null").withColumnRenamed("input", "text"), ["text", "kind"], "left")
    parts = fixed.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("suggestion", "text").alias("t")))).alias("p"))
    return parts.select(id_col, F.array_join(F.transform("p", lambda x: x["t"]), "").alias("corrected"))
