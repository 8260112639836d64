"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from namtok.llm.decontaminate import OP3_SQL, op3_decontaminate
from namtok.llm.exact_substrings import op4_repeats
from namtok.llm.language_id import op10_language_id
from namtok.llm.line_dedup import op6_line_dedup
from namtok.llm.media_copies import op8_media_copies
from namtok.llm.sentencepiece import op9_sentencepiece
from namtok.llm.simhash import op2_simhash
from namtok.llm.token_counts import op1_token_counts
from namtok.llm.token_files import op5_token_files
from namtok.llm.warc import OP7_SQL, op7_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_simhash": op2_simhash,
        "op3_decontaminate": op3_decontaminate,
        "op4_repeats": op4_repeats,
        "op5_token_files": op5_token_files,
        "op6_line_dedup": op6_line_dedup,
        "op7_warc": op7_warc,
        "op8_media_copies": op8_media_copies,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_language_id": op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op7_warc": OP7_SQL}
