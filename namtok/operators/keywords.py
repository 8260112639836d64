"""Keywords and keyphrases by term frequency and a frequency-list stand-in for inverse document frequency."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from namtok.operators.words import content_in_order, content_words, settled, slices

SKIPPED = ["Whitespace", "Punctuation", "Emoji", "Unknown"]
#: Words that hold over one HOT_WORDS-th of all are known to every task, so there are fewer than HOT_WORDS of them.
HOT_WORDS = 500_000
RANKED = "word string, count bigint, score float, rank int"


def max_frequency(frequencies: DataFrame) -> int:
    return frequencies.agg(F.coalesce(F.max("freq"), F.lit(0))).first()[0]


def _best(max_n: int, scores: np.ndarray, counts: np.ndarray, word: Callable[[int], str]) -> list[tuple[str, int, float, int]]:
    """The best by the score as a float, then by the word."""
    scores = scores.astype(np.float32)
    least = np.partition(scores, -max_n)[-max_n] if len(scores) > max_n else -np.inf
    kept = sorted((-float(scores[i]), word(i), int(counts[i])) for i in np.flatnonzero(scores >= least).tolist())
    return [(w, n, -s, k) for k, (s, w, n) in enumerate(kept[:max_n], 1)]


def _keywords(places: np.ndarray, idf: np.ndarray, names: list[str], max_n: int) -> list[tuple]:
    """``places``: of each content word in ``names``, those without an idf after the others."""
    counts = np.bincount(places, minlength=len(names))[: len(idf)]
    return _best(max_n, counts / len(places) * idf, counts, names.__getitem__)


def _keyphrases(places: np.ndarray, idf: np.ndarray, names: list[str], max_n: int) -> list[tuple]:
    """Pairs and triples as numbers, which fit for two million different words of a document."""
    at, size = places[places < len(idf)], len(idf)
    pairs, n_pairs = np.unique(at[:-1] * size + at[1:], return_counts=True)
    if size < 2_000_000:
        triples, n_triples = np.unique((at[:-2] * size + at[1:-1]) * size + at[2:], return_counts=True)
        a, b, c = triples // (size * size or 1), triples // (size or 1) % (size or 1), triples % (size or 1)
    else:
        rows, n_triples = np.unique(np.stack([at[:-2], at[1:-1], at[2:]], 1), axis=0, return_counts=True)
        a, b, c = rows.T
    x, y = pairs // (size or 1), pairs % (size or 1)
    counts = np.concatenate([n_pairs, n_triples])
    mean = np.concatenate([(idf[x] + idf[y]) / 2, (idf[a] + idf[b] + idf[c]) / 3])
    word = lambda i: f"{names[x[i]]} {names[y[i]]}" if i < len(x) else f"{names[a[i - len(x)]]} {names[b[i - len(x)]]} {names[c[i - len(x)]]}"
    return _best(max_n, counts / max(1, len(at)) * mean, counts, word)


def _ranked(docs: DataFrame, texts: bool, frequencies: DataFrame, stopwords: DataFrame, max_n: int, score: Callable) -> DataFrame:
    """(id, word, count, score, rank) of ``docs`` (id, held): a text, or with ``texts`` false the content words in order.

    A document stays one row. Frequent words' counts are broadcast; of the others each document's
    different ones meet their counts by a shuffle and go to the document.
    """
    id_col, spark = docs.columns[0], docs.sparkSession
    frequencies = settled(frequencies.select("word", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq")))
    total, most = frequencies.agg(F.coalesce(F.sum("freq"), F.lit(0)), F.coalesce(F.max("freq"), F.lit(0))).first()
    frequent, top = F.col("freq") * HOT_WORDS > total, float(most) + 1
    known = spark.sparkContext.broadcast((dict(frequencies.filter(frequent).collect()), {r.word for r in stopwords.select("word").collect()}))
    id_field = docs.schema[0]

    def rare(batches):
        hot, stops = known.value
        for batch in slices(batches):
            rows, out = [], []
            for i, held in enumerate(batch.column(1).to_pylist()):
                mine = [w for w in set(content_words(held) if texts else held).difference(hot, stops) if len(w) >= 2] if held else []
                rows += [i] * len(mine)
                out += mine
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(out, pa.string())], names=[id_col, "word"])

    def rank(batches):
        hot, stops = known.value
        for batch in slices(batches):
            rows, out = [], []
            for i, (held, own_words, own_counts) in enumerate(zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True)):
                mine = content_in_order(held) if texts else [w for part in held for w in part]
                own, distinct = dict(zip(own_words, own_counts, strict=True)), set(mine)
                names = [w for w in distinct if len(w) >= 2 and w not in stops]
                idf = top / (np.array([hot[w] if w in hot else own.get(w, 0) for w in names], np.float64) + 1)
                names += distinct.difference(names)
                place = dict(zip(names, range(len(names)), strict=True))
                best = score(np.fromiter(map(place.__getitem__, mine), np.int64, len(mine)), idf, names, max_n) if mine else []
                rows += [i] * len(best)
                out += best
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.string(), pa.int64(), pa.float32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[id_col, "word", "count", "score", "rank"])

    pairs = docs.mapInArrow(rare, StructType([id_field, StructField("word", StringType())]))
    rare_ones = pairs.join(frequencies.filter(~frequent), "word").select(id_col, F.lit(None).cast(docs.schema[1].dataType).alias("held"), "word", "freq")
    texts_first = docs.withColumns({"word": F.lit(None).cast("string"), "freq": F.lit(None).cast("bigint")})
    whole = texts_first.unionByName(rare_ones).groupBy(id_col).agg(*[F.collect_list(c).alias(c) for c in ("held", "word", "freq")])
    return whole.mapInArrow(rank, StructType([id_field, *StructType.fromDDL(RANKED).fields]))


def _words(tokens: DataFrame, id_col: str, order_col: str | None = None) -> DataFrame:
    """(id, held): content tokens of each document in order."""
    content = tokens.filter(~F.col("kind").isin(SKIPPED))
    if order_col is None:
        return content.groupBy(id_col).agg(F.collect_list("text").alias("held"))
    sorted_ones = F.array_sort(F.collect_list(F.struct(order_col, "text")))
    return content.groupBy(id_col).agg(F.transform(sorted_ones, lambda t: t["text"]).alias("held"))


def keywords(tokens: DataFrame, frequencies: DataFrame, stopwords: DataFrame, max_n: int = 10, id_col: str = "doc_id") -> DataFrame:
    """(id, word, count, score, rank). The term frequency's denominator counts stop words and single characters too."""
    return _ranked(_words(tokens, id_col), False, frequencies, stopwords, max_n, _keywords)


def keyphrases(tokens: DataFrame, frequencies: DataFrame, stopwords: DataFrame, max_n: int = 10, id_col: str = "doc_id", order_col: str = "ord") -> DataFrame:
    """(id, word, count, score, rank) of pairs and triples of neighbouring candidates; the idf is their mean."""
    return _ranked(_words(tokens, id_col, order_col), False, frequencies, stopwords, max_n, _keyphrases)


def text_keywords(df: DataFrame, frequencies: DataFrame, stopwords: DataFrame, max_n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keywords`` of the script runs of texts, without a row for each token."""
    return _ranked(df.select(id_col, F.col(text_col).alias("held")), True, frequencies, stopwords, max_n, _keywords)


def text_keyphrases(df: DataFrame, frequencies: DataFrame, stopwords: DataFrame, max_n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keyphrases`` of the script runs of texts, without a row for each token."""
    return _ranked(df.select(id_col, F.col(text_col).alias("held")), True, frequencies, stopwords, max_n, _keyphrases)


def corpus_frequencies(tokens: DataFrame) -> DataFrame:
    """(word, freq) over all documents."""
    return tokens.filter(~F.col("kind").isin(SKIPPED)).groupBy(F.col("text").alias("word")).agg(F.count("*").alias("freq"))
