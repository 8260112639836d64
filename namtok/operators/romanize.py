"""Romanisation by table and by rule."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from namtok.functions.charclass import THAI
from namtok.operators.segmentation import segment
from namtok.sources.lexicons import Lexicons

# Sounds of consonants at the beginning and end of a syllable, and of vowels.
INITIALS = {"ก": "k", "ขคฅฆ": "kh", "ง": "ng", "จฉชฌ": "ch", "ซศษส": "s", "ญย": "y", "ฎด": "d", "ฏต": "t", "ฐฑฒถทธ": "th", "นณ": "n", "บ": "b", "ป": "p", "ผพภ": "ph", "ฝฟ": "f", "ม": "m", "ร": "r", "ลฬ": "l", "ว": "w", "หฮ": "h"}
FINALS = {"กขคฅฆ": "k", "ง": "ng", "จชซฌฎดฏตถทธศษส": "t", "นณ": "n", "บปพภฝฟ": "p", "ม": "m", "ยญ": "i", "รลฬ": "n", "ว": "o"}
VOWELS = {"ิ": "i", "็": "i", "ี": "i", "ึ": "ue", "ื": "ue", "ั": "a", "ุ": "u", "ู": "u", "า": "a", "ะ": "a"}
LEADS = {"เ": "e", "แ": "ae", "โ": "o", "ใ": "ai", "ไ": "ai"}
AFTER_E = {"อ": "oe", "า": "ao"}

_INITIAL = {c: sound for chars, sound in INITIALS.items() for c in chars}
_FINAL = {c: sound for chars, sound in FINALS.items() for c in chars}
_MARKS = "".join(VOWELS)
_SKIPPED = "่-๋ํฺ"
_ABOVE = "่-๋ิีึืั็ุูํฺ"
#: A consonant with its marks and the final that no vowel claims, or a stray mark.
_PLAIN = re.compile(f"(?P<initial>[ก-ฮ])(?P<marks>[{_MARKS}{_SKIPPED}]*)(?:(?P<silent>์)|(?P<am>ำ)|(?:[ก-ฮ]์|(?P<final>[ก-ฮ])(?![เแโใไ{_MARKS}ำ]))?)|[{_SKIPPED}์]")
_ONSET = re.compile(f"(?P<lead>[เแโใไ])[่-๋]*(?:(?P<onset>[ก-ฮ])[{_ABOVE}]*)?")
_CODA = re.compile("(?P<coda>[ก-ฮ])(?P<mute>์)?")


def _plain(m: re.Match) -> str:
    """A syllable without a lead vowel; nothing if its consonant is silent or it is a stray mark."""
    if not m["initial"] or m["silent"]:
        return ""
    sounds = [VOWELS[c] for c in m["marks"] if c in VOWELS]
    vowel = "am" if m["am"] else sounds[-1] if sounds else ""
    return _INITIAL.get(m["initial"], "") + vowel + _FINAL.get(m["final"] or "", "")


def romanize_word(word: str) -> str:
    """A word by the rules alone; other characters pass through."""
    out, at = [], 0
    while at < len(word):
        if led := _ONSET.match(word, at):
            at, vowel = led.end(), LEADS[led["lead"]]
            if led["onset"]:
                if led["lead"] == "เ" and word[at : at + 1] in AFTER_E:
                    vowel, at = AFTER_E[word[at]], at + 1
                vowel = _INITIAL.get(led["onset"], "") + vowel
                if coda := _CODA.match(word, at):
                    at, vowel = coda.end(), vowel + ("" if coda["mute"] else _FINAL.get(coda["coda"], ""))
            out.append(vowel)
        elif plain := _PLAIN.match(word, at):
            at = plain.end()
            out.append(_plain(plain))
        else:
            out.append(word[at])
            at += 1
    return "".join(out)


def romanize_by_rule(words: Column) -> Column:
    """Arrow batches of words; use it on distinct words."""

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda w: None if w is None else romanize_word(w))

    return F.pandas_udf(run, StringType())(words)


def romanize_column(df: DataFrame, lexicons: Lexicons, word_col: str, out: str = "roman", mode: str = "rule") -> DataFrame:
    """Adds the romanisation of a word. ``table``: null if the table lacks it; ``raw``: the word itself; ``rule``: the rules
    for words with Thai, the word itself for others; ``owned``: the rules, null without Thai. Rules run once for each distinct word."""
    names = lexicons.romanization.select(F.col("word").alias("_word"), F.col("roman").alias("_roman"))
    joined = df.join(F.broadcast(names), df[word_col] == names["_word"], "left")
    word: Column = F.col(word_col)
    if mode == "table":
        return joined.withColumn(out, F.col("_roman")).drop("_word", "_roman")
    if mode == "raw":
        return joined.withColumn(out, F.coalesce("_roman", word)).drop("_word", "_roman")
    rest = df.select(word.alias("_rule_word")).filter(word.rlike(f"[{THAI}๐-๙]")).distinct().join(names, F.col("_rule_word") == F.col("_word"), "left_anti")
    rules = rest.select("_rule_word", romanize_by_rule(F.col("_rule_word")).alias("_rule"))
    joined = joined.join(rules, joined[word_col] == rules["_rule_word"], "left")
    last = [word] if mode == "rule" else []
    return joined.withColumn(out, F.coalesce("_roman", "_rule", *last)).drop("_word", "_roman", "_rule_word", "_rule")


def romanize_pairs(df: DataFrame, lexicons: Lexicons, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ord, text, roman) of tokens, by table or as they are."""
    return romanize_column(segment(df, lexicons, id_col, text_col, spans=False), lexicons, "text", mode="raw").select(id_col, "ord", "text", "roman")


def romanize_sentence(df: DataFrame, lexicons: Lexicons, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, roman): Thai tokens by table or rule, everything else as it is, joined without separators."""
    tokens = segment(df, lexicons, id_col, text_col, keep_whitespace=True, spans=False)
    thai = F.col("kind") == "Thai"
    named = romanize_column(tokens.withColumn("_thai", F.when(thai, F.col("text"))), lexicons, "_thai", "_r")
    parts = named.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("_r", "text").alias("r")))).alias("parts"))
    out = parts.select(id_col, F.array_join(F.transform("parts", lambda p: p["r"]), "").alias("roman"))
    return df.select(id_col, F.col(text_col).alias("_t")).join(out, id_col, "left").select(id_col, F.when(F.col("_t").isNotNull(), F.coalesce("roman", F.lit(""))).alias("roman"))
