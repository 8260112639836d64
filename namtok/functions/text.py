"""Text structure: normalising, script runs, character clusters, sentences and n-grams, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namtok.functions.charclass import CLUSTER, RUNS, SPACE, kind


def normalize(text: Column) -> Column:
    """A run of tone marks becomes its last; nikhahit and sara aa become sara am."""
    return F.replace(F.regexp_replace(text, r"[\x{0E48}-\x{0E4B}]+([\x{0E48}-\x{0E4B}])", "$1"), F.lit("ํา"), F.lit("ำ"))


def pre_tokens(text: Column) -> Column:
    """Maximal runs of one kind of character, white space included; they join to the text."""
    return F.regexp_extract_all(text, F.lit(f"({RUNS})"), F.lit(1))


def clusters(text: Column) -> Column:
    """Thai character clusters and runs of other characters."""
    return F.regexp_extract_all(text, F.lit(f"({CLUSTER})"), F.lit(1))


def cluster_boundaries(text: Column) -> Column:
    """Byte offsets of cluster boundaries, 0 and the end included."""
    parts = clusters(text)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.octet_length(F.array_join(F.slice(parts, 1, i), "")))


#: Zero-width places after which a sentence ends.
SENTENCE_END = rf"(?<=[\x{{0E5A}}\x{{0E5B}}\n!?])|(?<=(?<!\x{{0E2F}}\x{{0E25}})\x{{0E2F}})(?!\x{{0E25}}\x{{0E2F}})|(?<=(?<![0-9])\.)(?=[{SPACE}]|\z)"


def sentence_pieces(text: Column) -> Column:
    """All pieces between sentence ends, blank ones included; they join to the text."""
    return F.filter(F.split(text, SENTENCE_END, -1), lambda s: s != "")


def split_sentences(text: Column) -> Column:
    """Sentences with their delimiter, untrimmed; blank pieces are dropped."""
    return F.filter(sentence_pieces(text), lambda s: ~s.rlike(rf"^[{SPACE}]*\z"))


def char_ngrams(text: Column, n: int) -> Column:
    """Substrings of n characters; none for n = 0 or longer than the text."""
    if n < 1:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).when(text.isNotNull(), F.array().cast("array<string>"))


def token_ngrams(tokens: Column, n: int, separator: str = "") -> Column:
    """Joins of n neighbouring tokens."""
    if n < 1:
        return F.when(tokens.isNotNull(), F.array().cast("array<string>"))
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), separator))).when(tokens.isNotNull(), F.array().cast("array<string>"))


def with_spans(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Adds char_start, char_end, byte_start and byte_end of pieces that join to a text, in ``order`` within ``keys``."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows
    for unit, length in (("char", F.length(text)), ("byte", F.octet_length(text))):
        start = F.coalesce(F.sum(length).over(before), F.lit(0)).cast("int")
        out = out.withColumn(f"{unit}_start", start).withColumn(f"{unit}_end", (F.col(f"{unit}_start") + length).cast("int"))
    return out


def script_tokens(df: DataFrame, id_col: str, text_col: str, spans: bool = False) -> DataFrame:
    """(id, ord, text, kind) of every run; with ``spans`` also offsets in characters and bytes."""
    out = df.select(id_col, F.posexplode(pre_tokens(F.col(text_col))).alias("ord", "token"))
    out = out.withColumn("kind", kind(F.col("token")))
    return with_spans(out, [id_col], "ord", "token") if spans else out


def sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, sentence, offsets) of every sentence that isn't blank."""
    out = df.select(id_col, F.posexplode(sentence_pieces(F.col(text_col))).alias("ord", "sentence"))
    return with_spans(out, [id_col], "ord", "sentence").filter(~F.col("sentence").rlike(rf"^[{SPACE}]*\z"))
