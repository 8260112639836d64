"""From raw documents to token ids, in five stages. Each takes (spark, docs, sf_dir) and gives a DataFrame.

All stages but the last return the columns of ``documents``. Rows with null ids or texts, repeated
rows and empty tables go through: a null text has no language and goes in the first stage, and an
empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namtok.llm import decontaminate, language_id, line_dedup, sentencepiece, similar
from namtok.llm.common import materialize, table
from namtok.shipping import ship

#: Least posterior of the best language.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; those without a letter and doubtful ones go."""
    found = language_id.predict(docs, language_id.fit(docs))
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= SURE)).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one up to two edits."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with similar shingles of five words (0.8 or more), the one with the least id."""
    found = similar.groups(docs.select("doc_id", "text"))
    stay = found.filter("first").select(F.col("id").alias("__id"), F.col("text_hash").alias("__text"))
    rows = docs.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = rows.join(stay, rows["doc_id"].eqNullSafe(stay["__id"]) & (rows["__hash"] == stay["__text"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__hash"]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("matches") == 0).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids, as little-endian unsigned 32-bit integers, and if they decode to its text."""
    return sentencepiece.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


def _stage(function):
    """The stage, after the package has been sent to the executors."""
    return lambda spark, docs, sf_dir: function(ship(spark), docs, sf_dir)


STAGES = [
    ("language_id", _stage(identify_language)),
    ("line_dedup", _stage(dedup_lines)),
    ("simhash", _stage(drop_near_duplicates)),
    ("decontaminate", _stage(drop_contaminated)),
    ("sentencepiece", _stage(encode_pieces)),
]

#: SQL can't express the model, the edit join, the fingerprints or the encoding; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
