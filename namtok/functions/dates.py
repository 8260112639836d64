"""Thai dates: parsing, eras and formats, as Column expressions. Days and months are checked for range only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from namtok.functions.charclass import SPACE, trim
from namtok.functions.numbers import thai_digits_to_ascii

# Month names from January, full and short, and era marks.
MONTHS = ["มกราคม", "กุมภาพันธ์", "มีนาคม", "เมษายน", "พฤษภาคม", "มิถุนายน", "กรกฎาคม", "สิงหาคม", "กันยายน", "ตุลาคม", "พฤศจิกายน", "ธันวาคม"]
SHORT_MONTHS = ["ม.ค.", "ก.พ.", "มี.ค.", "เม.ย.", "พ.ค.", "มิ.ย.", "ก.ค.", "ส.ค.", "ก.ย.", "ต.ค.", "พ.ย.", "ธ.ค."]
BUDDHIST, GREGORIAN, DATE = "พ.ศ.", "ค.ศ.", "วันที่"
#: Years of the Buddhist era are ahead by OFFSET; a year from LEAST_BUDDHIST on without a mark is one.
OFFSET, LEAST_BUDDHIST = 543, 2300

_MONTH = "|".join(map(re.escape, MONTHS + SHORT_MONTHS))
WORDED = rf"^(?:{DATE}[{SPACE}]*)?([0-9]+)[{SPACE}]*({_MONTH})[{SPACE}]*({re.escape(BUDDHIST)}|{re.escape(GREGORIAN)})?[{SPACE}]*([0-9]+)"


def parse_thai_date(text: Column) -> Column:
    """struct(day, month, year, era), or null. Numeric forms (slash before dash) come before worded ones."""
    s = trim(thai_digits_to_ascii(trim(text)))
    parts = F.when(F.contains(s, F.lit("/")), F.split(s, "/", 3)).when(F.contains(s, F.lit("-")), F.split(s, "-", 3))
    value = lambda c: F.expr("try_cast(null as bigint)") if c is None else c.try_cast("bigint")
    number = lambda i: F.when(trim(F.get(parts, F.lit(i))).rlike(r"^\+?[0-9]{1,10}$"), value(trim(F.get(parts, F.lit(i)))))
    worded = lambda i: F.when(s.rlike(WORDED), F.regexp_extract(s, WORDED, i))
    day, month, year = number(0), number(1), number(2)
    numeric = (F.size(parts) == 3) & day.between(1, 31) & month.between(1, 12) & year.between(0, 4294967295)
    names = F.create_map(*[x for i, pair in enumerate(zip(MONTHS, SHORT_MONTHS, strict=True), 1) for name in pair for x in (F.lit(name), F.lit(i).cast("bigint"))])
    w_day, w_month, w_year, mark = value(worded(1)), F.try_element_at(names, worded(2)), value(worded(4)), worded(3)
    in_words = w_day.between(1, 31) & w_year.between(0, 4294967295)

    def date(d: Column, m: Column, y: Column, era: Column) -> Column:
        return F.struct(d.cast("int").alias("day"), m.cast("int").alias("month"), y.try_cast("int").alias("year"), era.alias("era"))

    inferred = lambda y: F.when(y >= LEAST_BUDDHIST, "Buddhist").otherwise("Gregorian")
    era = F.when(mark == BUDDHIST, "Buddhist").when(mark == GREGORIAN, "Gregorian").otherwise(inferred(w_year))
    return F.when(numeric, date(day, month, year, inferred(year))).when(in_words, date(w_day, w_month, w_year, era))


def gregorian_year(date: Column) -> Column:
    return F.when(date["era"] == "Buddhist", date["year"] - OFFSET).otherwise(date["year"])


def buddhist_year(date: Column) -> Column:
    return F.when(date["era"] == "Gregorian", date["year"] + OFFSET).otherwise(date["year"])


def to_iso8601(date: Column) -> Column:
    """Year of four digits or more, month and day of two, whether or not the calendar has that day."""
    year = gregorian_year(date)
    digits = F.abs(year).cast("string")
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0"))
    return F.concat(F.when(year < 0, "-").otherwise(""), padded, F.lit("-"), F.lpad(date["month"].cast("string"), 2, "0"), F.lit("-"), F.lpad(date["day"].cast("string"), 2, "0"))


def to_date(date: Column) -> Column:
    """A DATE, null where the calendar has no such day."""
    return F.try_make_timestamp(gregorian_year(date), date["month"], date["day"], F.lit(0), F.lit(0), F.lit(0)).cast("date")


def format_thai_date(year_be: Column, month: Column, day: Column) -> Column:
    """Day, month name and Buddhist year; null if day or month is out of range."""
    name = F.get(F.array(*map(F.lit, MONTHS)), (month - 1).cast("int"))
    return F.when(month.between(1, 12) & day.between(1, 31), F.concat(day.cast("string"), F.lit(" "), name, F.lit(f" {BUDDHIST} "), year_be.cast("string")))


def to_thai_text(date: Column) -> Column:
    return format_thai_date(buddhist_year(date), date["month"], date["day"])
