"""Dictionary segmentation with confidence scores, in Arrow batches of texts.

A row is segmented where it is: the lexicon is broadcast, a Thai run's clusters are joined to words
from the left, and the best way to each boundary is kept (fewest unknown pieces, fewest pieces, most
frequent words, earliest start of the last piece). Nothing is shuffled and no run meets another.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from namtok.functions.charclass import CLUSTER, KINDS, RUNS
from namtok.operators.words import in_python, slices
from namtok.sources.lexicons import Lexicons

#: Runs whose pieces a task remembers.
REMEMBERED = 20_000
_RUNS, _CLUSTERS = re.compile(in_python(RUNS)), re.compile(in_python(CLUSTER))
_KINDS = {k: re.compile(f"[{in_python(c)}]") for k, c in KINDS.items()}

#: (text, kind, confidence) of a token.
Piece = tuple[str, str, float]


def segmenter(words: dict[str, list[int]]) -> Callable[[str], list[list[Piece]]]:
    """A function that gives the pieces of each run of a text; ``words`` has the frequencies of each word."""
    longest: dict[str, int] = {}  # by the first two characters
    for w in words:
        longest[w[:2]] = max(longest.get(w[:2], 0), len(w))
    remembered: dict[str, list[Piece]] = {}
    kinds: dict[str, str] = {}

    def kind(char: str) -> str:
        if char not in kinds:
            kinds[char] = next((k for k, c in _KINDS.items() if c.match(char)), "Unknown")
        return kinds[char]

    def cut(run: str) -> list[Piece]:
        parts = _CLUSTERS.findall(run)
        n = len(parts)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        at = 0
        for i, word in enumerate(parts):
            most, j = longest.get(run[at : at + 2], 1), i + 1
            at += len(word)
            while len(word) <= most:
                for freq in words.get(word, ()):
                    ends[j].append((i, freq))
                if j == n:
                    break
                word += parts[j]
                j += 1
        # a way's key is smaller the better it is: unknown pieces, pieces, rarity, start of the last piece, if that is known, its frequency
        ways = [(0, 0, 0, 0, False, 0)]
        for j in range(1, n + 1):
            unknown, count, rarity = ways[j - 1][:3]
            best = (unknown + 1, count + 1, rarity, j - 1, False, 0)
            for i, freq in ends[j]:
                unknown, count, rarity = ways[i][:3]
                best = min(best, (unknown, count + 1, rarity - freq, i, True, freq))
            ways.append(best)
        out, j = [], n
        while j > 0:
            *_, i, known, freq = ways[j]
            sure = (1.0 if freq > 0 else 0.7) * {1: 0.9, 2: 0.8}.get(len(ends[j]), 0.7)
            out.append(("".join(parts[i:j]), "Thai", sure) if known else (parts[i], "Unknown", 0.0))
            j = i
        return out[::-1]

    def pieces(run: str) -> list[Piece]:
        own = kind(run[0])
        if own != "Thai":
            return [(run, own, 1.0)]
        if run not in remembered:
            if len(remembered) >= REMEMBERED:
                remembered.clear()
            remembered[run] = cut(run)
        return remembered[run]

    return lambda text: [pieces(run) for run in _RUNS.findall(text)]


def broadcast_words(lexicons: Lexicons):
    """The broadcast lexicon as ``segmenter`` takes it."""
    words: dict[str, list[int]] = {}
    for r in lexicons.words.select("word", F.coalesce("freq", F.lit(0)).alias("freq")).collect():
        if r.word:
            words.setdefault(r.word, []).append(r.freq)
    return lexicons.words.sparkSession.sparkContext.broadcast(words)


def segment(df: DataFrame, lexicons: Lexicons, id_col: str = "doc_id", text_col: str = "text", keep_whitespace: bool = False, spans: bool = True) -> DataFrame:
    """(id, ord, text, kind, confidence[, offsets]) of every token, in order of ``ord``; offsets are those in the row's text."""
    known, docs = broadcast_words(lexicons), df.select(id_col, text_col)
    schema = "ord struct<run_ord: int, piece: int>, text string, kind string, confidence float" + ", char_start int, char_end int, byte_start int, byte_end int" * spans
    types = [pa.string(), pa.string(), pa.float32(), *[pa.int32()] * (4 * spans)]

    def tokens(batches):
        cut = segmenter(known.value)
        for batch in slices(batches):
            rows, runs, places, out = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                char = byte = 0
                for k, pieces in enumerate(cut(text) if text else ()):
                    for place, piece in enumerate(pieces):
                        if spans:
                            size, held = len(piece[0]), len(piece[0].encode())
                            piece = (*piece, char, char + size, byte, byte + held)
                            char, byte = char + size, byte + held
                        if keep_whitespace or piece[1] != "Whitespace":
                            rows.append(i)
                            runs.append(k)
                            places.append(place)
                            out.append(piece)
            order = pa.StructArray.from_arrays([pa.array(runs, pa.int32()), pa.array(places, pa.int32())], names=["run_ord", "piece"])
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), order, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)

    out = StructType([docs.schema[0], *StructType.fromDDL(schema).fields])
    names = out.fieldNames()
    return docs.mapInArrow(tokens, out)


def segment_words(df: DataFrame, lexicons: Lexicons, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words): the texts of each row's tokens in order; rows without a token are left out."""
    known, docs = broadcast_words(lexicons), df.select(id_col, text_col)

    def words(batches):
        cut = segmenter(known.value)
        for batch in slices(batches):
            found = [[p[0] for run in cut(text) for p in run if p[1] != "Whitespace"] if text else [] for text in batch.column(1).to_pylist()]
            rows = [i for i, w in enumerate(found) if w]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array([w for w in found if w], pa.list_(pa.string()))], names=[id_col, "words"])

    return docs.mapInArrow(words, StructType([docs.schema[0], *StructType.fromDDL("words array<string>").fields]))


def next_word(tokens: DataFrame) -> DataFrame:
    return tokens.filter("kind <> 'Whitespace'")


def next_known(tokens: DataFrame) -> DataFrame:
    return tokens.filter(~F.col("kind").isin("Whitespace", "Unknown"))


def above_confidence(tokens: DataFrame, least: float) -> DataFrame:
    return tokens.filter(F.col("confidence") >= F.lit(least).cast("float"))


def prefixes(df: DataFrame, words: DataFrame, text_col: str = "text") -> DataFrame:
    """Every lexicon word that a text begins with, longest first within a text."""
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    at = df.select("*", F.explode(F.sequence(F.lit(1), F.least(F.length(text_col), F.lit(longest)))).alias("_n")).filter(F.length(text_col) > 0)
    return at.withColumn("word", F.substring(F.col(text_col), F.lit(1), F.col("_n"))).join(F.broadcast(words.select("word")), "word").drop("_n")


def contains(df: DataFrame, words: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``known``: if the text is a word of the lexicon."""
    marked = words.select(F.col("word").alias("_word")).distinct().withColumn("known", F.lit(True))
    return df.join(F.broadcast(marked), df[text_col] == marked["_word"], "left").drop("_word").withColumn("known", F.coalesce("known", F.lit(False)))


def unknown_counts(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return tokens.groupBy(id_col).agg(F.count_if(F.col("kind") == "Unknown").alias("unknown"))



