"""Operator 1: token counts of whole texts, by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from namtok.llm import word_tokens
from namtok.llm.common import slices, table


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    The driver proves once which vocabulary strings encode alone as one token (bounded by the
    vocabulary) and broadcasts them with the tokenizer; rows then stream through the workers
    without a shuffle. Null and empty texts have 0 bytes and 0 tokens; a null id stays null;
    repeated rows each give a row; other columns are ignored, whatever their names.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((source, word_tokens.whole_tokens(Tokenizer.from_str(source))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens.encoder(*shared.value)
        width = encoder.dtype.itemsize
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            tokens = np.array([len(encoder.ids(t)) // width for t in texts], np.int64)
            n_bytes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(tokens), pa.array(tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return rows.mapInArrow(count, schema).withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
