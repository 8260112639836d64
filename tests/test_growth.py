"""Steps that must grow with the input: the same results as plain code, and no row for each token in a shuffle or window."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from namtok.functions import numbers, phonetic
from namtok.operators import evaluate, keywords, segmentation, words
from namtok.operators.words import in_python
from namtok.plans import fulltext
from namtok.sources import lexicons


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_content_words():
    rng = random.Random(2)
    texts = ["".join(rng.choices(["ab", "C", "12", "é", " ", "\n", ".", "ก", "๑", "Ａ", "７", "😀", "—", "漢"], k=rng.randint(0, 12))) for _ in range(3000)]
    for text in texts:
        assert words.content_words(text) == re.findall(in_python(words.CONTENT), text), text


@pytest.mark.parametrize("hot", [1, 30, 10**6])
def test_text_keywords_and_keyphrases(spark, monkeypatch, hot):
    monkeypatch.setattr(keywords, "HOT_WORDS", hot)
    rng = random.Random(hot)
    vocabulary = ["the", "of", "a", "xé", "ปลา", "12", *[f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]]
    docs = [(i, "".join(w + rng.choice([" ", ", "]) for w in rng.choices(vocabulary, [70 - k for k in range(66)], k=rng.randint(0, 80)))) for i in range(40)] + [(90, None), (91, "")]
    df = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    counts = Counter(w for _, t in docs if t for w in re.findall(in_python(words.CONTENT), t))
    frequencies = words.frequencies(df)
    assert {r.word: r.freq for r in frequencies.collect()} == dict(counts)
    stops, top = {"the", "of"}, max(counts.values()) + 1.0
    stopwords = spark.createDataFrame([(w,) for w in stops], "word string")
    candidate = lambda w: len(w) >= 2 and w not in stops
    idf = {w: top / (n + 1) for w, n in counts.items()}
    want_words, want_phrases = set(), set()
    for i, t in docs:
        every = re.findall(in_python(words.CONTENT), t or "")
        kept = [w for w in every if candidate(w)]
        scored = [(-float(np.float32(n / len(every) * idf[w])), w, n) for w, n in Counter(every).items() if candidate(w)]
        want_words |= {(i, w, n, -s, k) for k, (s, w, n) in enumerate(sorted(scored)[:4], 1)}
        grams = Counter([*zip(kept, kept[1:]), *zip(kept, kept[1:], kept[2:])])  # noqa: B905
        scored = [(-float(np.float32(n / len(kept) * (sum(idf[w] for w in g) / len(g)))), " ".join(g), n) for g, n in grams.items()]
        want_phrases |= {(i, w, n, -s, k) for k, (s, w, n) in enumerate(sorted(scored)[:4], 1)}
    found = keywords.text_keywords(df, frequencies, stopwords, 4)
    assert {tuple(r) for r in found.collect()} == want_words
    phrases = keywords.text_keyphrases(df, frequencies, stopwords, 4)
    assert {tuple(r) for r in phrases.collect()} == want_phrases
    for df in (found, phrases):
        assert "Window" not in plan_of(df) and "Generate" not in plan_of(df)


def test_keywords_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, "aa bb, cc"), (1, "dd ee"), (None, "xx yy"), (None, "xx")], "doc_id int, text string")
    frequencies, none = words.frequencies(df), spark.createDataFrame([], "word string")
    rows = {(r.doc_id, r.word): r["count"] for r in keywords.text_keywords(df, frequencies, none).collect()}
    assert rows == {(1, w): 1 for w in ("aa", "bb", "cc", "dd", "ee")} | {(None, "xx"): 2, (None, "yy"): 1}
    phrases = {r.word for r in keywords.text_keyphrases(df, frequencies, none).filter("doc_id = 1").collect()}
    assert {"aa dd", "bb ee", "ee cc"} <= phrases and "cc dd" not in phrases  # by their places: aa dd | bb ee | cc


def test_number_words_by_lookup(column):
    """The usual words are looked up, the rest is folded token by token; both give what the fold gives."""
    rng = random.Random(4)
    usual = [numbers._digits(rng.randint(0, 999), ["แสน", "หมื่น", "พัน"]) + numbers._digits(rng.randint(0, 999), ["ร้อย", "สิบ", ""]) for _ in range(300)]
    tokens = [*numbers.WORDS, *numbers.MULTIPLIERS, numbers.ONE_AFTER_TEN, numbers.TWO_BEFORE_TEN, "|", "x", "\n"]
    odd = ["".join(rng.choices(tokens, k=rng.randint(0, 5))) for _ in range(1500)] + ["||||||หนึ่ง", "หนึ่ง|", "สิบ\n", "", None]
    both = column(numbers._parse_below_million, [*usual, *odd])
    assert both == column(numbers._folded_below_million, [*usual, *odd])
    fast = column(numbers._usual_below_million, usual)
    assert all(v is not None for v, t in zip(fast, usual, strict=True) if t)
    values = [rng.randint(0, 10 ** rng.randint(1, 18)) for _ in range(500)] + [10**k + d for k in range(1, 19) for d in (-1, 0, 1)]
    words_of = column(numbers.number_to_thai_word, values, "bigint")

    def plain(n):
        groups = [n // 10 ** (6 * i) % 10**6 for i in (3, 2, 1, 0) if n >= 10 ** (6 * i)]
        return numbers.MILLION.join(numbers._digits(g // 1000, ["แสน", "หมื่น", "พัน"]) + numbers._digits(g % 1000, ["ร้อย", "สิบ", ""]) for g in groups)

    assert words_of == [plain(n) if n else "ศูนย์" for n in values]


def test_script_postings(spark):
    """Positions counted within the row are the window's, and no posting is shuffled or sorted for them."""
    rng = random.Random(6)
    parts = ["The", "the", "of", "Cat", "é", "ÉX", "12", "๑๒", "กินข้าว", "ＡＢ", " ", " ", ", ", "!", "😀", "\x01", "x" * 130]
    docs = [(i, "".join(rng.choices(parts, k=rng.randint(0, 25)))) for i in range(60)] + [(90, None), (91, "")]
    stops = spark.createDataFrame([("the",), ("of",), ("é",)], "word string")
    for rows in (docs, [*docs[:5], (90, "cat dog")], [(i % 7 or None, t) for i, t in docs]):
        df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
        one = lambda x: sorted(map(str, x.select("doc_id", "lexeme", "weight", "head").collect()))
        fast, slow = (f(df, stopwords=stops) for f in (fulltext.script_postings, lambda *a, **b: fulltext.postings(fulltext.script_fts_tokens(*a, **b))))
        assert one(fast) == one(slow)
        counts = {(r.lexeme, r.ndoc, r.nentry) for r in fulltext.ts_stat(fast).collect()}
        ids = {}
        for r in slow.collect():
            ids.setdefault(r.lexeme, []).append(r.doc_id)
        assert counts == {(x, len(set(i) - {None}), len(i)) for x, i in ids.items()}
        if len({i for i, _ in rows}) == len(rows):
            assert sorted(map(str, fast.collect())) == sorted(map(str, slow.collect()))
            assert "Window" not in plan_of(fast) and "Exchange hashpartitioning" not in plan_of(fast)
    df = spark.createDataFrame(docs, "doc_id int, text string")
    index = fulltext.script_postings(df, stopwords=stops)
    for text in ("cat & 12", "cat | 12", "cat & !12", "!cat", "(cat | x) & !(12 & ab)"):
        query = fulltext.to_tsquery(text)
        for given in (None, df):
            assert sorted(r.doc_id for r in fulltext.search(index, query, docs=given).collect()) == sorted(r.doc_id for r in fulltext.matched(index, query, docs=given).collect()), text
    joined = fulltext.ts_stat(fulltext.script_postings(df.repartition("doc_id"), stopwords=stops))
    assert "hashpartitioning(lexeme, doc_id" not in re.sub(r"#\d+", "", plan_of(joined))
    assert plan_of(fulltext.ts_rank(index, fulltext.to_tsquery("cat & 12"))).count("Generate") == 1


def test_segmentation_stays_in_rows(spark):
    lex = lexicons.builtin(spark)
    df = spark.createDataFrame([(1, "กินข้าว 12 ok!é", ["กินข้าว", "12", "ok", "é"]), (2, "จากร้าน", ["จา", "กร้าน"]), (3, None, None), (4, "", []), (2, "ปลา", ["ปลา"])], "doc_id int, text string, gold array<string>")
    tokens = segmentation.segment(df, lex, keep_whitespace=True)
    rows = [(r.text, r.kind, r.char_start, r.char_end, r.byte_start, r.byte_end) for r in tokens.filter("doc_id = 1").orderBy("ord").collect()]
    assert rows == [("กินข้าว", "Thai", 0, 7, 0, 21), (" ", "Whitespace", 7, 8, 21, 22), ("12", "Number", 8, 10, 22, 24), (" ", "Whitespace", 10, 11, 24, 25), ("ok", "Latin", 11, 13, 25, 27), ("!", "Punctuation", 13, 14, 27, 28), ("é", "Unknown", 14, 15, 28, 30)]
    words_of = segmentation.segment_words(df, lex)
    assert sorted((r.doc_id, r.words) for r in words_of.collect()) == [(1, ["กินข้าว", "12", "ok", "!", "é"]), (2, ["จาก", "ร้าน"]), (2, ["ปลา"])]
    once_each = df.filter("text <> 'ปลา' or text is null")
    scores = evaluate.case_scores(once_each, lex, "gold", "text")
    long_way = evaluate.boundary_scores(evaluate.gold_spans(once_each, "doc_id", "gold", "text"), segmentation.segment(once_each, lex))
    assert scores.collect() == long_way.collect() and scores.first().tp == 4
    for made in (tokens, words_of, scores):
        assert "hashpartitioning" not in plan_of(made)  # nothing is dealt by document, run or span


def test_metasound_syllables(column):
    """Codes are those of each syllable alone; texts are parted once."""
    rng = random.Random(7)
    chars = "กงนมยรอหฮญ" + "เแโใไ" + "ัิีืฺุู" + "่้์ํ" + "ะาำ" + "a|;\n "
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 12))) for _ in range(1500)] + [None]

    def plain(text):
        out, meta = "", in_python(phonetic.SYLLABLE)
        initials, finals = ({c: k for k, v in phonetic._other(g, phonetic.CONSONANTS, other).items() for c in v} for g, other in ((phonetic.META_INITIAL, "J"), (phonetic.META_FINAL, "6")))
        for m in re.finditer(meta, text):
            lead, first, silent, marks, follow, last = (g or "" for g in m.groups())
            if silent:
                continue
            upper = re.sub(in_python(f"[^{phonetic.UPPER}]"), "", marks)[-1:]
            vowel = "D" if "ํ" in marks else "E" if lead in tuple("ไใ") else "F" if lead == "เ" and follow == "า" else "8" if lead in tuple("เแ") else "9" if lead == "โ" else phonetic.META_UPPER.get(upper) or {"า": "1", "ำ": "D"}.get(follow, "0")
            out += initials[first] + vowel + (finals[last] if last else "6")
        return out or "000"

    assert column(phonetic.metasound, texts) == [None if t is None else plain(t) for t in texts]
