"""Character classes as regular expressions that Java and RE2 read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points of each kind of token; the first kind that fits wins.
NUMBER = r"0-9\x{0E50}-\x{0E59}\x{FF10}-\x{FF19}"
THAI = r"\x{0E00}-\x{0E4F}\x{0E5A}-\x{0E7F}"
LATIN = r"A-Za-z\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}"
WHITESPACE = r" \t\n\r\x{00A0}\x{3000}"
EMOJI = r"\x{200D}\x{FE0F}\x{2600}-\x{27BF}\x{1F300}-\x{1F9FF}\x{1FA00}-\x{1FAFF}"
PUNCTUATION = r"!-/:-@\[-`{-~\x{2000}-\x{200C}\x{200E}-\x{206F}"
KINDS = {"Number": NUMBER, "Thai": THAI, "Latin": LATIN, "Whitespace": WHITESPACE, "Emoji": EMOJI, "Punctuation": PUNCTUATION}

#: One maximal run of a kind; what no class holds is Unknown.
RUNS = "|".join(f"[{c}]+" for c in KINDS.values()) + f"|[^{''.join(KINDS.values())}]+"

#: One Thai character cluster: a lead vowel and consonant with its marks, any other Thai character, or a run of others.
CLUSTER = r"[\x{0E40}-\x{0E44}]?(?:[\x{0E24}\x{0E26}]|[\x{0E01}-\x{0E23}\x{0E25}\x{0E27}-\x{0E2E}][\x{0E31}\x{0E34}-\x{0E3A}]*[\x{0E48}-\x{0E4B}]*[\x{0E4C}\x{0E30}\x{0E32}\x{0E33}\x{0E4D}]?)|[\x{0E00}-\x{0E7F}]|[^\x{0E00}-\x{0E7F}]+"

#: Unicode white space, for trimming.
SPACE = r"\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def kind(token: Column) -> Column:
    """The kind of a token or character, by its first character."""
    out = F.when(token.isNull() | (token == ""), F.lit(None).cast("string"))
    for name, chars in KINDS.items():
        out = out.when(token.rlike(f"^[{chars}]"), name)
    return out.otherwise("Unknown")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")
