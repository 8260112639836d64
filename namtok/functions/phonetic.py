"""Phonetic codes of Thai and English words, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from namtok.functions.numbers import once

# Each algorithm's consonant groups and their codes.
LK82 = {"0": "อฃฅ", "1": "กขคฆ", "2": "จชซศษสฉฌญ", "3": "ตถทธฏฐฑฒดฎ", "4": "บปพผภฝฟ", "5": "ม", "6": "นณ", "7": "ง", "8": "ลรฬ", "9": "ว", "A": "ย", "B": "หฮ"}
UDOM83 = {"0": "อฃฅ", "1": "กขคฆ", "2": "จชฉฌ", "3": "ซศษส", "4": "ตถทธฏฐฑฒดฎ", "5": "บปพผภฝฟ", "6": "ม", "7": "นณญ", "8": "ง", "9": "ลฬ", "A": "ร", "B": "ว", "C": "ย", "D": "หฮ"}
ENGLISH = {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}
CROSS_THAI = {"1": "บปผพภฝฟ", "2": "กขฃคฅฆจฉชฌซศษส", "3": "ฎดฏตฐฑฒถทธ", "4": "ลฬ", "5": "มณน", "6": "ร"}
META_INITIAL = {"1": "กขคฆ", "2": "ง", "3": "จชฉฌ", "4": "ซศษส", "5": "ญย", "6": "ฎด", "7": "ฏต", "8": "ฐฑฒถทธ", "9": "นณ", "A": "บ", "B": "ป", "C": "ผพภ", "D": "ฝฟ", "E": "ม", "F": "ร", "G": "ลฬ", "H": "ว", "I": "หฮ"}
META_FINAL = {"1": "ก", "2": "นณญรลฬ", "3": "ม", "4": "ง", "5": "ยว"}
META_UPPER = {"ั": "0", "ิ": "2", "ี": "3", "ึ": "4", "ื": "5", "ุ": "6", "ู": "7"}

CONSONANT, LEAD, UPPER, FOLLOW, TONE, SILENT, NIKHAHIT = r"\x{0E01}-\x{0E2E}", r"\x{0E40}-\x{0E44}", r"\x{0E31}\x{0E34}-\x{0E3A}", r"\x{0E30}\x{0E32}\x{0E33}", r"\x{0E48}-\x{0E4B}", r"\x{0E4C}", r"\x{0E4D}"


def _tables(groups: dict[str, str]) -> tuple[str, str]:
    return "".join(groups.values()), "".join(code * len(chars) for code, chars in groups.items())


def _other(groups: dict[str, str], rest: str, code: str) -> dict[str, str]:
    held = "".join(groups.values())
    return groups | {code: groups.get(code, "") + "".join(c for c in rest if c not in held)}


def _collapsed(codes: Column) -> Column:
    return F.regexp_replace(codes, r"(.)\1+", "$1")


CONSONANTS = "".join(chr(c) for c in range(0x0E01, 0x0E2F))
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _grouped(word: Column, groups: dict[str, str]) -> Column:
    spoken = F.regexp_replace(F.regexp_replace(word, rf"(?s).{SILENT}", ""), f"[^{CONSONANT}]", "")
    return F.rpad(F.substring(_collapsed(F.translate(spoken, *_tables(_other(groups, CONSONANTS, "0")))), 1, 4), 4, "0")


def lk82(word: Column) -> Column:
    return _grouped(word, LK82)


def udom83(word: Column) -> Column:
    return _grouped(word, UDOM83)


#: Lead vowel, initial, silent mark | marks, following vowel, final consonant that isn't the next initial.
SYLLABLE = rf"([{LEAD}])?([{CONSONANT}])(?:({SILENT})|([{UPPER}{TONE}{NIKHAHIT}]*)([{FOLLOW}])?(?:[{CONSONANT}]{SILENT}|([{CONSONANT}])(?![{UPPER}{FOLLOW}{LEAD}]))?)"


def metasound(word: Column) -> Column:
    """Three characters a syllable (initial, vowel, final); 000 without a syllable."""

    def code(p: Column) -> Column:
        lead, first, silent, marks, follow, last = (F.get(p, F.lit(i)) for i in range(6))

        def vowel(upper: Column) -> Column:
            out = F.when(F.contains(marks, F.lit("ํ")), "D").when(lead.isin("ไ", "ใ"), "E").when((lead == "เ") & (follow == "า"), "F").when(lead.isin("เ", "แ"), "8").when(lead == "โ", "9")
            for mark, value in META_UPPER.items():
                out = out.when(upper == mark, value)
            return out.when(follow == "า", "1").when(follow == "ำ", "D").otherwise("0")

        upper = F.substring(F.regexp_replace(marks, f"[^{UPPER}]", ""), -1, 1)
        initial = F.translate(first, *_tables(_other(META_INITIAL, CONSONANTS, "J")))
        final = F.when(last == "", "6").otherwise(F.translate(last, *_tables(_other(META_FINAL, CONSONANTS, "6"))))
        return F.when((first == "") | (silent != ""), "").otherwise(F.concat(initial, once(upper, vowel), final))

    # all syllables are parted at once; what is in none becomes a row of empty parts
    rows = F.split(F.regexp_replace(word, rf"(?s){SYLLABLE}|.", "$1|$2|$3|$4|$5|$6;"), ";")
    parted = F.transform(F.slice(rows, 1, F.size(rows) - 1), lambda r: F.split(r, r"\|", -1))
    out = once(F.array_join(F.transform(parted, code), ""), lambda codes: F.when(codes == "", "000").otherwise(codes))
    return F.when(word.isNotNull(), out)


def thai_english_soundex(word: Column) -> Column:
    """One code for a Thai transliteration and its English source; as long as the word."""
    spoken = F.upper(F.regexp_replace(F.regexp_replace(word, f"[{CONSONANT}]{SILENT}", ""), f"[^A-Za-z{CONSONANT}]", ""))
    both = {code: ENGLISH[code] + CROSS_THAI[code] for code in ENGLISH}
    first = both | {"0": "AEIOUHWYอหฮวญย", "N": "ง"}
    later = both | {"7": "AEIOU", "8": "Hหฮ", "9": "Yญย", "1": both["1"] + "Wว", "N": "ง"}
    # a character without a code before the first that has one doesn't count as first
    code = lambda text, groups: F.replace(F.translate(text, *_tables(groups)), F.lit("N"), F.lit("52"))
    kept = F.regexp_replace(spoken, "^[ฤฦ]+", "")
    tail = F.regexp_replace(F.substring(kept, F.lit(2), F.length(kept)), "[อฤฦ]", "")
    return _collapsed(F.concat(code(F.regexp_replace(F.substring(kept, 1, 1), "[ฤฦ]", ""), first), code(tail, later)))


def english_soundex(word: Column) -> Column:
    """A letter and three digits; vowels, H, W and Y part equal codes. Empty without an ASCII letter."""
    letters = F.upper(F.regexp_replace(word, "[^A-Za-z]", ""))
    codes = _collapsed(F.translate(letters, *_tables(_other(ENGLISH, LETTERS, "0"))))
    rest = F.replace(F.substring(codes, F.lit(2), F.length(codes)), F.lit("0"), F.lit(""))
    return F.when(letters == "", "").otherwise(F.rpad(F.substring(F.concat(F.substring(letters, 1, 1), rest), 1, 4), 4, "0"))


ALGORITHMS = {"lk82": lk82, "udom83": udom83, "metasound": metasound}


def soundex(word: Column, algorithm: str = "lk82") -> Column:
    """By name; an unknown name means lk82."""
    return ALGORITHMS.get(algorithm.lower(), lk82)(word)


def sounds_like(a: Column, b: Column, algorithm: str = "lk82") -> Column:
    """If both words have the same code, and one that isn't all zeros."""
    code = soundex(a, algorithm)
    return (a != "") & (b != "") & ~code.rlike("^0+$") & (code == soundex(b, algorithm))


def sounds_like_cross_lang(a: Column, b: Column) -> Column:
    code = thai_english_soundex(a)
    return (code != "") & (code == thai_english_soundex(b))
