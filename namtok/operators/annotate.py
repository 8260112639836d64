"""Full-text tokens: normalising, abbreviations, segmentation, names, stop words, synonyms, phonetic codes and tags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namtok.functions import numbers, phonetic, text
from namtok.operators.segmentation import segment
from namtok.sources.lexicons import Lexicons

#: Tokens that a name may span.
NAME_TOKENS = 5


@dataclass(frozen=True)
class AnalyzerConfig:
    """Options of the full-text tokenizer and of the two dialects of indexing.

    ``dialect`` postgres: stop words, punctuation and emoji take no position, Latin is lower-cased;
    sqlite: all tokens are indexed as they are.
    """

    ngram_size: int = 3
    soundex: str | None = None
    romanization: bool = False
    abbreviations: bool = False
    number_normalize: bool = True
    stopwords: bool = True
    pos_lexemes: bool = False
    dialect: str = "postgres"

    @classmethod
    def from_options(cls, options: str) -> AnalyzerConfig:
        """From ``name value`` pairs of a table's tokenizer string: soundex, stopwords on/off, ngram_size."""
        words = options.replace("'", " ").split()
        given = dict(zip(words[::2], words[1::2], strict=False))
        algorithm = given.get("soundex", "lk82").lower()
        algorithm = None if algorithm == "none" else algorithm if algorithm in phonetic.ALGORITHMS else "lk82"
        return cls(ngram_size=int(given.get("ngram_size", 3)), soundex=algorithm, stopwords=given.get("stopwords", "off") == "on", dialect="sqlite")


def expand_abbreviations(column: Column, abbreviations: dict[str, list[str]]) -> Column:
    """Leftmost, longest key first, each by its first expansion; expansions aren't expanded again."""
    if not abbreviations:
        return column
    keys = sorted(abbreviations, key=lambda k: (-len(k.encode()), k))
    names = F.create_map(*[F.lit(x) for k in keys for x in (k, abbreviations[k][0])])
    quoted = "|".join("".join(f"\\x{{{ord(c):04X}}}" for c in k) for k in keys)
    parts = F.regexp_extract_all(column, F.lit(rf"({quoted}|[\s\S])"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(names, p), p)), "")


def lookup_abbreviations(df: DataFrame, abbreviations: DataFrame, column: str) -> DataFrame:
    """A row for each expansion of a token; tokens without one are left out."""
    return df.join(F.broadcast(abbreviations.withColumnRenamed("key", column)), column).withColumn("expansion", F.explode("expansions")).drop("expansions")


def merge_names(tokens: DataFrame, source: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Merges runs of up to NAME_TOKENS Thai tokens that spell a name, longest first from the left, without overlap.

    What is compared is the source from the first token to the last, so a name may hold a space.
    A merged token has the least confidence of its parts and its kind is the name's. Tokens come with
    character and byte offsets, and ``ord`` is renumbered.
    """
    order = Window.partitionBy(id_col).orderBy("char_start")
    rows = tokens.withColumn("n", F.row_number().over(order)).withColumn("run", F.sum(F.when(F.col("kind") == "Thai", 0).otherwise(1)).over(order))
    thai = rows.filter("kind = 'Thai'")
    ahead = Window.partitionBy(id_col, "run").orderBy("n").rowsBetween(0, NAME_TOKENS - 1)
    spans = thai.withColumn("ends", F.collect_list(F.struct("n", "char_end")).over(ahead)).select(id_col, "n", "char_start", F.explode("ends").alias("e"))
    texts = source.select(id_col, F.col(text_col).alias("_source"))
    spans = spans.join(texts, id_col).withColumn("phrase", F.substring("_source", F.col("char_start") + 1, F.col("e.char_end") - F.col("char_start")))
    hits = spans.join(F.broadcast(names), "phrase").groupBy(id_col, "n").agg(F.max_by(F.struct(F.col("e.n").alias("last"), "phrase", "ne"), F.col("e.n")).alias("hit"))
    # greedy from the left: a hit is taken if it begins after the last one taken
    taken = hits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("n", "hit"))).alias("hits"))
    none = F.filter("hits", lambda _: F.lit(False))
    pick = F.aggregate("hits", F.struct(F.lit(0).alias("last"), none.alias("out")), lambda s, h: F.when(h["n"] > s["last"], F.struct(h["hit"]["last"].alias("last"), F.concat(s["out"], F.array(h)).alias("out"))).otherwise(s))
    taken = taken.select(id_col, F.explode(pick["out"]).alias("h")).select(F.col(id_col).alias("_id"), F.col("h.n").alias("first"), "h.hit.last", "h.hit.phrase", "h.hit.ne")
    marked = rows.join(taken, (rows[id_col] == taken["_id"]) & F.col("n").between(F.col("first"), F.col("last")), "left")
    group = F.coalesce("first", "n")
    merged = marked.groupBy(id_col, group.alias("ord")).agg(
        F.coalesce(F.first("phrase"), F.first("text")).alias("text"), F.coalesce(F.first("ne"), F.first("kind")).alias("kind"), F.first("ne").alias("ne"), F.min("confidence").alias("confidence"),
        F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"),
    )
    return merged


def fts_tokens(df: DataFrame, lexicons: Lexicons, config: AnalyzerConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position, text, kind, is_stop, synonyms, trigrams, pos, ne, roman, confidence) of every token that isn't white space.

    Positions count from 0 and stop words keep theirs. Lexicons are broadcast; distinct tokens need no join of their own.
    """
    config = config or AnalyzerConfig()
    source = text.normalize(F.col(text_col))
    if config.abbreviations:
        source = expand_abbreviations(source, lexicons.abbreviations)
    docs = df.select(id_col, source.alias("_text"))
    tokens = merge_names(segment(docs, lexicons, id_col, "_text"), docs, lexicons.names, id_col, "_text")
    tokens = tokens.withColumn("position", (F.row_number().over(Window.partitionBy(id_col).orderBy("char_start")) - 1).cast("int"))
    stops = lexicons.stopwords.select(F.col("word").alias("text")).distinct().withColumn("is_stop", F.lit(True))
    synonyms = lexicons.synonyms.select(F.col("word").alias("text"), F.col("synonyms").alias("own"))
    roman = lexicons.romanization.select(F.col("word").alias("text"), "roman")
    pos = lexicons.pos.select(F.col("word").alias("text"), F.col("pos").alias("tag"))
    for table in (stops, synonyms, roman, pos):
        tokens = tokens.join(F.broadcast(table), "text", "left")
    spoken = (F.col("kind") == "Thai") | F.col("ne").isNotNull()
    more = [F.coalesce("own", F.array().cast("array<string>"))]
    one = lambda ok, value: F.when(ok & value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>"))
    if config.romanization:
        more.append(one(spoken, F.col("roman")))
    if config.soundex:
        code = phonetic.soundex(F.col("text"), config.soundex)
        more.append(one(spoken & ~code.rlike("^0*$"), code))
    if config.number_normalize:
        ascii_digits = numbers.thai_digits_to_ascii(F.col("text"))
        more.append(one((F.col("kind") == "Number") & (ascii_digits != F.col("text")), ascii_digits))
        more.append(one(F.col("kind") == "Thai", F.when(F.col("kind") == "Thai", numbers.thai_word_to_decimal(F.col("text")))))
    grams = F.when(F.col("kind") == "Unknown", text.char_ngrams(F.col("text"), config.ngram_size)).otherwise(F.array().cast("array<string>"))
    return tokens.select(
        id_col, "position", "text", "kind", F.coalesce("is_stop", F.lit(False)).alias("is_stop"), F.concat(*more).alias("synonyms"), grams.alias("trigrams"),
        F.when(F.col("kind") == "Thai", F.col("tag")).alias("pos"), "ne", F.when(spoken, F.col("roman")).alias("roman"), "confidence", "char_start", "char_end",
    )


def index_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.filter(~F.col("is_stop"))


def lexemes(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, lexemes): text, synonyms and trigrams of every token that isn't a stop word, in order."""
    own = F.struct("position", F.concat(F.array("text"), F.col("synonyms"), F.col("trigrams")).alias("l"))
    return index_tokens(tokens).groupBy(id_col).agg(F.flatten(F.transform(F.array_sort(F.collect_list(own)), lambda t: t["l"])).alias("lexemes"))
