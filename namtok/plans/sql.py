"""The scalar functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from namtok.functions import dates, numbers, phonetic, text

#: name: (arguments, expression over columns of those names)
FUNCTIONS = {
    "normalize_thai": ("t string", lambda: text.normalize(F.col("t"))),
    "thai_clusters": ("t string", lambda: text.clusters(F.col("t"))),
    "script_runs": ("t string", lambda: text.pre_tokens(F.col("t"))),
    "split_sentences": ("t string", lambda: text.split_sentences(F.col("t"))),
    "thai_digits_to_ascii": ("t string", lambda: numbers.thai_digits_to_ascii(F.col("t"))),
    "thai_word_to_number": ("t string", lambda: numbers.thai_word_to_number(F.col("t"))),
    "number_to_thai_word": ("n bigint", lambda: numbers.number_to_thai_word(F.col("n"))),
    "number_to_baht_text": ("b bigint, s int", lambda: numbers.number_to_baht_text(F.col("b"), F.col("s"))),
    "parse_baht_text": ("t string", lambda: numbers.parse_baht_text(F.col("t"))),
    "parse_thai_date": ("t string", lambda: dates.parse_thai_date(F.col("t"))),
    "lk82": ("t string", lambda: phonetic.lk82(F.col("t"))),
    "udom83": ("t string", lambda: phonetic.udom83(F.col("t"))),
    "metasound": ("t string", lambda: phonetic.metasound(F.col("t"))),
    "english_soundex": ("t string", lambda: phonetic.english_soundex(F.col("t"))),
    "thai_english_soundex": ("t string", lambda: phonetic.thai_english_soundex(F.col("t"))),
    "sounds_like": ("a string, b string", lambda: phonetic.sounds_like(F.col("a"), F.col("b"))),
    "sounds_like_cross_lang": ("a string, b string", lambda: phonetic.sounds_like_cross_lang(F.col("a"), F.col("b"))),
}


def apply(spark: SparkSession, name: str, view: str, columns: dict[str, str], out: str) -> None:
    """Makes the temporary view ``out``: ``view`` with column ``name`` computed from its columns, given by argument."""
    expression = FUNCTIONS[name][1]()
    rows = spark.table(view)
    named = rows.select("*", *[F.col(source).alias(argument) for argument, source in columns.items() if argument not in rows.columns])
    named.withColumn(name, expression).select(*rows.columns, name).createOrReplaceTempView(out)
