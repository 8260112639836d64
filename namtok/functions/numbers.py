"""Thai digits, number words and Baht amounts, as Column expressions. Numbers are BIGINT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from namtok.functions.charclass import trim

# Digits, digit words, multipliers and special forms of Thai number words.
DIGITS = "๐๑๒๓๔๕๖๗๘๙"
WORDS = ["ศูนย์", "หนึ่ง", "สอง", "สาม", "สี่", "ห้า", "หก", "เจ็ด", "แปด", "เก้า"]
MULTIPLIERS = {"แสน": 100_000, "หมื่น": 10_000, "พัน": 1_000, "ร้อย": 100, "สิบ": 10}
ONE_AFTER_TEN, TWO_BEFORE_TEN, MILLION = "เอ็ด", "ยี่", "ล้าน"
BAHT, SATANG, WHOLE = "บาท", "สตางค์", "ถ้วน"


def thai_digits_to_ascii(text: Column) -> Column:
    return F.translate(text, DIGITS, "0123456789")


def is_thai_digits(text: Column) -> Column:
    return text.rlike(f"^[{DIGITS}]+$")


def _digits(n: int, places: list[str]) -> str:
    """Words of a number of three digits or less whose places have these names."""
    out = ""
    for digit, place in zip(map(int, f"{n:03d}"), places, strict=True):
        if not digit:
            continue
        if place == "สิบ":
            out += ("" if digit == 1 else TWO_BEFORE_TEN if digit == 2 else WORDS[digit]) + place
        elif not place and digit == 1 and n % 100 > 10:
            out += ONE_AFTER_TEN
        else:
            out += WORDS[digit] + place
    return out


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is named; else each naming computes it again."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _lookup(n: Column, places: list[str]) -> Column:
    """The words of 0 … 999, from a table made by rule that the optimiser folds to a constant."""
    return F.get(F.split(F.lit(",".join(_digits(i, places) for i in range(1000))), ","), n.cast("int"))


def _below_million(n: Column) -> Column:
    return F.concat(_lookup(_div(n, 1000), ["แสน", "หมื่น", "พัน"]), _lookup(n % 1000, ["ร้อย", "สิบ", ""]))


def _div(n: Column, size: int) -> Column:
    return F.call_function("div", n, F.lit(size).cast("bigint"))


def number_to_thai_word(number: Column) -> Column:
    """Number words of 0 … 2^63 - 1; null for negative numbers. Integers and no arrays, as this runs on every row of large tables."""
    n = number.cast("bigint")
    parts = [F.when(n >= 10**p, F.concat(_below_million(_div(n, 10**p) % 1_000_000), F.lit(MILLION))).otherwise("") for p in (18, 12, 6)]
    return F.when(n == 0, WORDS[0]).when(n >= 10**6, F.concat(*parts, _below_million(n % 1_000_000))).when(n > 0, _below_million(n))


TOKENS = "|".join([WORDS[0], WORDS[1], ONE_AFTER_TEN, TWO_BEFORE_TEN, *WORDS[2:], "สิบ", "ร้อย", "พัน", "หมื่น", "แสน"])


#: The words of a number as they usually stand: each place once, from the largest, then one after ten or a digit.
_DIGIT = "|".join([*WORDS, TWO_BEFORE_TEN])
USUAL = "".join(f"((?:{_DIGIT})?{m})?" for m in list(MULTIPLIERS)[:4]) + f"(?:((?:{_DIGIT})?สิบ)({ONE_AFTER_TEN})?)?({_DIGIT})?"


def _usual_below_million(text: Column) -> Column:
    """The value of USUAL words, or null: they are parted once and each part is looked up."""
    digits = {w: i for i, w in enumerate(WORDS)} | {TWO_BEFORE_TEN: 2}
    tables = [{"": 0, m: size} | {w + m: i * size for w, i in digits.items()} for m, size in MULTIPLIERS.items()] + [{"": 0, ONE_AFTER_TEN: 1}, {"": 0} | digits]
    parts = F.split(F.regexp_replace(text, rf"\A{USUAL}\z", "$1|$2|$3|$4|$5|$6|$7"), r"\|", -1)
    maps = [F.create_map(*[F.lit(x).cast("bigint") if isinstance(x, int) else F.lit(x) for pair in t.items() for x in pair]) for t in tables]
    value = once(parts, lambda p: sum((F.try_element_at(m, F.get(p, F.lit(i))) for i, m in enumerate(maps[1:], 1)), F.try_element_at(maps[0], F.get(p, F.lit(0)))))
    return F.when((text != "") & ~F.contains(text, F.lit("|")), value)


def _parse_below_million(text: Column) -> Column:
    """Value of words without a million; null if they aren't well formed."""
    return once(text, lambda t: F.coalesce(_usual_below_million(t), _folded_below_million(t)))


def _folded_below_million(text: Column) -> Column:
    """Value of words in any order, token by token; null if they aren't well formed."""
    tokens = F.regexp_extract_all(text, F.lit(f"({TOKENS})"), F.lit(1))
    values = F.create_map(*[x for pair in [(F.lit(w), F.lit(i).cast("bigint")) for i, w in enumerate(WORDS)] + [(F.lit(TWO_BEFORE_TEN), F.lit(2).cast("bigint"))] for x in pair])
    sizes = F.create_map(*[x for w, n in MULTIPLIERS.items() for x in (F.lit(w), F.lit(n).cast("bigint"))])
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(-1).cast("bigint").alias("pending"), F.lit(False).alias("ten"), F.lit(True).alias("ok"))

    def step(s: Column, token: Column) -> Column:
        digit, size = F.try_element_at(values, token), F.try_element_at(sizes, token)
        one = token == ONE_AFTER_TEN
        coefficient = F.when(s["pending"] < 0, F.lit(1).cast("bigint")).otherwise(s["pending"])
        return F.struct(
            F.when(one, s["total"] + 1).when(size.isNotNull(), s["total"] + coefficient * size).otherwise(s["total"]).alias("total"),
            F.when(digit.isNotNull(), digit).when(size.isNotNull(), F.lit(-1).cast("bigint")).otherwise(s["pending"]).alias("pending"),
            (s["ten"] | F.coalesce(size == 10, F.lit(False))).alias("ten"),
            (s["ok"] & F.when(one, s["ten"] & (s["pending"] < 0)).when(digit.isNotNull(), s["pending"] < 0).otherwise(True)).alias("ok"),
        )

    finish = lambda s: F.when(s["ok"], s["total"] + F.greatest(s["pending"], F.lit(0).cast("bigint")))
    return F.when(text.rlike(f"^(?:{TOKENS})+$"), F.aggregate(tokens, start, step, finish))


def thai_word_to_number(text: Column) -> Column:
    """The number that words spell, or null. The text is cut at the first million; a bare multiplier counts once."""

    def parsed(s: Column) -> Column:
        at = F.instr(s, MILLION)
        before = F.substring(s, F.lit(1), at - 1)
        after = F.substring(s, at + len(MILLION), F.length(s))
        millions = F.when(before == "", F.lit(1).cast("bigint")).otherwise(_parse_below_million(before))
        rest = F.when(after == "", F.lit(0).cast("bigint")).otherwise(_parse_below_million(after))
        return F.when(s == "", None).when(at > 0, millions * 1_000_000 + rest).otherwise(_parse_below_million(s))

    return once(trim(text), parsed)


def thai_word_to_decimal(text: Column) -> Column:
    return thai_word_to_number(text).cast("string")


def number_to_baht_text(baht: Column, satang: Column) -> Column:
    """Amounts are written as they are given, satang over 99 too."""
    return F.concat(number_to_thai_word(baht), F.lit(BAHT), F.when(satang == 0, WHOLE).otherwise(F.concat(number_to_thai_word(satang), F.lit(SATANG))))


def parse_baht_text(text: Column) -> Column:
    """struct(baht, satang), or null."""

    def amount(s: Column, at: Column, rest: Column) -> Column:
        satang = F.when((rest == "") | (rest == WHOLE), F.lit(0).cast("bigint")).when(rest.endswith(SATANG), thai_word_to_number(F.substring(rest, F.lit(1), F.length(rest) - len(SATANG))))
        both = F.struct(thai_word_to_number(F.substring(s, F.lit(1), at - 1)).alias("baht"), satang.alias("satang"))
        ok = lambda b: b["baht"].isNotNull() & b["satang"].isNotNull() & (b["satang"] <= 99)
        return F.when(at > 0, once(both, lambda b: F.when(ok(b), F.struct(b["baht"].alias("baht"), b["satang"].cast("int").alias("satang")))))

    return once(trim(text), lambda s: once(F.instr(s, BAHT), lambda at: once(trim(F.substring(s, at + len(BAHT), F.length(s))), lambda rest: amount(s, at, rest))))
