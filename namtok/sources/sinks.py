"""Text, JSON and CSV forms of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the CSV forms.
CSV_COLUMNS = {
    "tokens": ["text", "kind", "char_start", "char_end", "byte_start", "byte_end", "confidence"],
    "fts": ["text", "position", "kind", "is_stop", "pos", "ne", "synonyms", "confidence"],
    "spell": ["input", "word", "edit_distance", "soundex_match", "freq_score"],
    "keywords": ["type", "word", "score", "count"],
}


def joined_text(tokens: DataFrame, separator: str = "|", id_col: str = "doc_id", order_col: str = "ord", shown: Column | None = None) -> DataFrame:
    """(id, line): a document's tokens, or what ``shown`` makes of each, joined."""
    own = F.struct(order_col, (shown if shown is not None else F.col("text")).alias("t"))
    return tokens.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["t"]), separator).alias("line"))


def shown_token(with_kind: bool = False, with_spans: bool = False, with_confidence: bool = False) -> Column:
    parts = [F.col("text")]
    if with_kind:
        parts.append(F.concat(F.lit(":"), F.col("kind")))
    if with_spans:
        parts.append(F.format_string("@%d-%d", F.col("char_start"), F.col("char_end")))
    if with_confidence:
        parts.append(F.format_string("(%.2f)", F.col("confidence")))
    return F.concat(*parts)


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def csv_lines(df: DataFrame, form: str) -> DataFrame:
    """Lines of a CSV form without its header; fields with a comma or quote are quoted, lists are joined by ``;``."""

    def field(name: str) -> Column:
        value = F.array_join(name, ";") if df.schema[name].dataType.typeName() == "array" else F.col(name).cast("string")
        value = F.coalesce(value, F.lit(""))
        return F.when(value.rlike('[,"]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)

    return df.select(F.concat_ws(",", *map(field, CSV_COLUMNS[form])).alias("value"))
