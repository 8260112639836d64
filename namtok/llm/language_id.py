"""Operator 10: language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namtok.llm.common import slices, table

#: Hash buckets that all n-grams of 1 to 3 characters share.
BUCKETS = 1 << 16
#: Additive smoothing of a bucket's count.
SMOOTHING = 0.5
#: Characters that are scored at once; longer texts are scored in pieces whose n-grams add up to the text's.
PIECE = 1 << 19
#: The model is fitted on this many labelled documents at most, those with the smallest xxhash64 of their id.
SAMPLE = 6000
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    langs: list[str]
    prior: np.ndarray
    log_probability: np.ndarray  # languages x BUCKETS


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[bool], list[str]]]:
    """Texts in lots of about PIECE characters: (row of each piece, if it begins its text, pieces); pieces of a text overlap by two."""
    rows, begins, lot, size = [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text)), PIECE):
            rows.append(row)
            begins.append(at == 0)
            lot.append(text[max(0, at - 2) : at + PIECE])
            size += len(lot[-1])
            if size >= PIECE:
                yield rows, begins, lot
                rows, begins, lot, size = [], [], [], 0
    if lot:
        yield rows, begins, lot


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every n-gram that ends in a letter or, of two or more characters, holds one.

    Texts are lower-cased and what isn't a letter counts as a space.
    """
    for rows, begins, lot in _pieces([t.lower() for t in texts]):
        codes = np.frombuffer("".join(lot).encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[codes]
        codes = np.where(letter, codes, 32).astype(np.uint32)
        lengths = np.array([len(t) for t in lot])
        piece = np.repeat(np.arange(len(lot)), lengths)
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - first[piece]
        row, new = np.array(rows)[piece], np.array(begins)[piece] | (place >= 2)  # the two that overlap were counted before
        mixed, held = codes * np.uint32(0x9E3779B1), letter
        for n in (1, 2, 3):
            if n > 1:
                mixed = mixed[1:] + codes[: len(mixed) - 1] * np.uint32((0x85EBCA6B, 0xC2B2AE35)[n - 2])
                held = held[1:] | letter[: len(held) - 1]
            at = slice(n - 1, None)
            ok = held & new[at] & (place[at] >= n - 1)
            yield row[at][ok], ((mixed[ok] ^ (mixed[ok] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64) % BUCKETS


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from rows with a text and a language, of them ``sample`` at most.

    Counts are summed by Spark; the driver gets languages x BUCKETS sums, whatever the table's size.
    Without such rows the model has no language and predicts ``und``.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    chosen = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = rows.join(F.broadcast(chosen.distinct()), "id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                own[BUCKETS] += langs.count(lang)
                for _, bucket in ngrams([t for k, t in zip(langs, texts, strict=True) if k == lang]):
                    own[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": at, "n": own[at]})

    sums = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sums["lang"].to_pylist()
    langs = sorted(set(names))
    counts = np.zeros((len(langs), BUCKETS + 1))
    counts[[langs.index(x) for x in names], sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    prior = np.log(counts[:, BUCKETS] / max(1, counts[:, BUCKETS].sum()))
    smooth = counts[:, :BUCKETS] + SMOOTHING
    return Model(langs, prior, np.log(smooth / smooth.sum(axis=1, keepdims=True)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns but for clashing ones, and ``lang_pred`` and ``score`` (its posterior, 0 to 1).

    Only the text is looked at. A null text or one without a letter gives ``und`` with score 0;
    ties go to the first language in alphabetical order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("lang_pred", "score")
    at = rows.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(at).cast(pa.string()).to_pylist()]
            total = np.zeros((len(texts), len(m.langs)))
            seen = np.zeros(len(texts), bool)
            for row, bucket in ngrams(texts):
                seen[row] = True
                for k, weights in enumerate(m.log_probability):
                    total[:, k] += np.bincount(row, weights[bucket], len(texts))
            if not m.langs:
                best, top = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                total += m.prior
                share = np.exp(total - total.max(axis=1, keepdims=True))
                top = np.where(seen, 1 / share.sum(axis=1), 0.0)
                best = [m.langs[k] if s else UNKNOWN for k, s in zip(total.argmax(axis=1), seen, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(top, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", lang_pred string, score double"
    return rows.mapInArrow(score, schema)


def held_out(id_col: str = "doc_id"):
    """Documents that no model learns from: crc32 of the id as text, mod 4, is 2; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
