"""Lexicon files, the small built-in lexicons, and the bundle that the operators take.

Files are read as text lines: blank lines and lines that begin with ``#`` are skipped, a byte order
mark is dropped. Full lexicons are parameters; the built-in ones cover examples only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namtok.functions.charclass import trim
from namtok.functions.dates import MONTHS, SHORT_MONTHS
from namtok.functions.numbers import BAHT, MILLION, MULTIPLIERS, ONE_AFTER_TEN, SATANG, TWO_BEFORE_TEN, WHOLE, WORDS
from namtok.functions.text import clusters

# Built-in lexicons: common words with made-up frequencies, and examples of each annotation.
SEED_WORDS = {
    "กิน": 900, "ข้าว": 800, "กินข้าว": 300, "กับ": 2000, "ปลา": 500, "หมู": 400, "สวัสดี": 250, "ชาวโลก": 40, "โลก": 600, "ชาว": 300, "ธนาคาร": 200, "แห่ง": 900,
    "คน": 3000, "ไป": 4000, "มา": 4000, "ราคา": 500, "บาท": 800, "ลด": 300, "เปอร์เซ็นต์": 100, "ที่นี่": 200, "นั้น": 2500, "ที่": 9000, "นี่": 900, "วัน": 2000, "วันที่": 400,
    "บ้าน": 1200, "รถ": 900, "รถยนต์": 300, "โรงเรียน": 500, "ประเทศ": 900, "ไทย": 1500, "ประเทศไทย": 400, "กรุงเทพ": 300, "เชียงใหม่": 150, "น้ำ": 1200, "ใจ": 900, "น้ำใจ": 60,
    "ดี": 3000, "มี": 5000, "จาก": 3000, "ร้าน": 400, "จา": 10, "กร้าน": 2, "ซี่": 20, "และ": 6000, "ของ": 6000, "เป็น": 6000, "ไม่": 6000, "ใน": 6000, "ทดสอบ": 100, "ทุกวัน": 90, "ส่ง": 400, "ถึง": 900, "อีเมล": 30,
}
SEED_STOPWORDS = ["กับ", "และ", "ของ", "เป็น", "ไม่", "ใน", "ที่", "นั้น", "มี", "จาก", "ไป", "มา"]
SEED_SYNONYMS = {"กิน": ["ทาน", "รับประทาน"], "บ้าน": ["เรือน"], "รถยนต์": ["รถ"]}
SEED_ROMAN = {"กิน": "kin", "ข้าว": "khao", "ปลา": "pla", "บ้าน": "ban", "ไทย": "thai", "น้ำ": "nam", "คน": "khon", "วัน": "wan"}
SEED_NAMES = {"ประเทศไทย": "PLACE", "กรุงเทพ": "PLACE", "เชียงใหม่": "PLACE", "ธนาคารไทย": "ORG"}
SEED_POS = {"กิน": "VERB", "ไป": "VERB", "มา": "VERB", "ข้าว": "NOUN", "ปลา": "NOUN", "บ้าน": "NOUN", "คน": "NOUN", "ดี": "ADJ", "ใน": "ADP", "และ": "CCONJ"}
NAME_KINDS = {"PERSON": "Person", "PLACE": "Place", "ORG": "Org"}
POS_TAGS = ["NOUN", "VERB", "ADJ", "ADV", "PRON", "DET", "ADP", "CCONJ", "SCONJ", "PART", "NUM", "PUNCT", "PROPN"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of the lines that count; a missing path raises."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("line"))
    return lines.filter((trim(F.col("line")) != "") & ~trim(F.col("line")).startswith("#"))


def _last(lines: DataFrame, value: Column, name: str, key: str) -> DataFrame:
    rows = lines.select(F.col("line_no"), trim(F.split("line", "\t", 2)[0]).alias(key), value.alias(name)).filter(F.col(name).isNotNull() & (F.col(key) != ""))
    return rows.groupBy(key).agg(F.max_by(name, "line_no").alias(name))


def _second() -> Column:
    return trim(F.get(F.split("line", "\t", 2), F.lit(1)))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).select(trim(F.col("line")).alias("word")).distinct()


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """Bad counts are skipped; the last of equal words wins."""
    return _last(read_lines(spark, path), F.when(_second().rlike("^[0-9]+$"), _second().try_cast("bigint")), "freq", "word")


def read_romanization(spark: SparkSession, path: str) -> DataFrame:
    return _last(read_lines(spark, path), _second(), "roman", "word")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in NAME_KINDS.items() for x in pair])
    return _last(read_lines(spark, path), F.try_element_at(kinds, _second()), "ne", "phrase")


def read_pos(spark: SparkSession, path: str) -> DataFrame:
    return _last(read_lines(spark, path), F.when(_second().isin(POS_TAGS), _second()), "pos", "word")


def _merged(lines: DataFrame, key: str, values: str) -> DataFrame:
    """Values of equal keys come together, in the order of lines."""
    parts = F.transform(F.split("line", "\t"), trim)
    rows = lines.select("line_no", parts[0].alias(key), F.filter(F.slice(parts, 2, 1 << 20), lambda v: v != "").alias("v")).filter((F.col(key) != "") & (F.size("v") > 0))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "v"))).alias("all")).select(key, F.flatten(F.transform("all", lambda r: r["v"])).alias(values))


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    return _merged(read_lines(spark, path), "word", "synonyms")


def read_abbreviations(spark: SparkSession, path: str) -> DataFrame:
    return _merged(read_lines(spark, path), "key", "expansions")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, input, gold) of ``input|token|token…`` lines."""
    parts = F.split(trim(F.col("line")), r"\|")
    return read_lines(spark, path).select(F.col("line_no").alias("case_id"), parts[0].alias("input"), F.slice(parts, 2, 1 << 20).alias("gold"))


def number_words() -> dict[str, int]:
    return dict.fromkeys([*WORDS, *MULTIPLIERS, ONE_AFTER_TEN, TWO_BEFORE_TEN, MILLION, BAHT, SATANG, WHOLE, *MONTHS], 100)


@dataclass(frozen=True)
class Lexicons:
    """Small tables: words (word, freq), stopwords (word), synonyms (word, synonyms), romanization (word, roman), names (phrase, ne), pos (word, pos), abbreviations {key: expansions}."""

    words: DataFrame
    stopwords: DataFrame
    synonyms: DataFrame
    romanization: DataFrame
    names: DataFrame
    pos: DataFrame
    abbreviations: dict[str, list[str]]

    def with_words(self, extra: DataFrame) -> Lexicons:
        """More words, with frequency 0 unless known; whether merged or rebuilt is the same here."""
        new = extra.select(trim(F.col("word")).alias("word")).filter("word <> ''").distinct().join(self.words, "word", "left_anti")
        return replace(self, words=self.words.unionByName(new.withColumn("freq", F.lit(0).cast("bigint"))))

    def with_stopwords(self, extra: DataFrame) -> Lexicons:
        return replace(self, stopwords=self.stopwords.union(extra.select("word")).distinct())

    def width(self) -> int:
        """Clusters in the longest word, which bounds the lattice's edges."""
        return self.words.agg(F.max(F.size(clusters(F.col("word"))))).first()[0] or 1

    def sizes(self) -> dict[str, int]:
        return {name: getattr(self, name).count() for name in ("words", "stopwords", "synonyms", "romanization", "names", "pos")} | {"abbreviations": len(self.abbreviations)}


def with_frequencies(words: DataFrame, frequencies: DataFrame) -> DataFrame:
    return words.select("word").distinct().join(frequencies, "word", "left").select("word", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq"))


def builtin(spark: SparkSession) -> Lexicons:
    table = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return Lexicons(
        words=table((SEED_WORDS | number_words()).items(), "word string, freq bigint"),
        stopwords=table([(w,) for w in SEED_STOPWORDS], "word string"),
        synonyms=table(SEED_SYNONYMS.items(), "word string, synonyms array<string>"),
        romanization=table(SEED_ROMAN.items(), "word string, roman string"),
        names=table([(k, NAME_KINDS[v]) for k, v in SEED_NAMES.items()], "phrase string, ne string"),
        pos=table(SEED_POS.items(), "word string, pos string"),
        abbreviations={s: [m] for s, m in zip(SHORT_MONTHS, MONTHS, strict=True)} | {"พ.ศ.": ["พุทธศักราช"], "ค.ศ.": ["คริสต์ศักราช"]},
    )
