import random

import pytest
from pyspark.sql import functions as F

from namtok.functions.text import clusters
from namtok.operators import annotate, evaluate, keywords, romanize, segmentation, spelling
from namtok.plans import fulltext
from namtok.sources import lexicons, sinks
from namtok.streaming import text_streams


@pytest.fixture(scope="module")
def lex(spark):
    return lexicons.builtin(spark)


def words_of(df, lex):
    return {r.doc_id: r.words for r in segmentation.segment_words(df, lex).collect()}


def test_goldens(spark, lex):
    cases = ["กินข้าว|กับ|ปลา", "สวัสดี|hello", "ธนาคาร|100|แห่ง", "คน|42|ไป", "ไป|123|มา|456", "ราคา|99|บาท", "สวัสดี|ชาวโลก", "เป|ป|ซี่", "จาก|ร้าน"]
    df = spark.createDataFrame([(i, c.replace("|", "")) for i, c in enumerate(cases)] + [(90, None), (91, ""), (92, " ")], "doc_id int, text string")
    assert words_of(df, lex) == {i: c.split("|") for i, c in enumerate(cases)}


def test_segmentation_against_plain_search(spark, column):
    rng = random.Random(5)
    units = ["กา", "มี", "นา", "เป", "ล", "ดี"]
    lexicon = {"".join(rng.choices(units, k=rng.randint(1, 3))): rng.choice([0, 5, 9, 200]) for _ in range(14)}
    texts = ["".join(rng.choices(units, k=rng.randint(1, 9))) for _ in range(40)]
    words = spark.createDataFrame(list(lexicon.items()), "word string, freq bigint")
    lex = lexicons.builtin(spark)
    lex = lexicons.Lexicons(words, lex.stopwords, lex.synonyms, lex.romanization, lex.names, lex.pos, {})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in segmentation.segment(df, lex).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.kind, round(r.confidence, 2), r.char_start))

    def plain(parts):
        best = [(0, 0, 0, 0, [])]
        for j in range(1, len(parts) + 1):
            ends = [i for i in range(j) if "".join(parts[i:j]) in lexicon]
            rivals = {1: 1.0, 2: 0.9, 3: 0.8}.get(len(ends) + 1, 0.7)
            ways = []
            for i in [*ends, None]:
                k = j - 1 if i is None else i
                word = "".join(parts[k:j])
                freq = 0 if i is None else lexicon[word]
                sure = 0.0 if i is None else (1.0 if freq else 0.7) * rivals
                ways.append((best[k][0] + (i is None), best[k][1] + 1, best[k][2] - freq, k, best[k][4] + [(word, "Unknown" if i is None else "Thai", round(sure, 2))]))
            best.append(min(ways, key=lambda w: w[:4]))
        return best[-1][4]

    for i, parts in enumerate(column(clusters, texts)):
        want, at = [], 0
        for word, kind, sure in plain(parts):
            want.append((word, kind, sure, at))
            at += len(word)
        assert [(t, k, pytest.approx(c, abs=0.011), s) for t, k, c, s in want] == got[i]


def test_fts_tokens_and_lexemes(spark, lex):
    df = spark.createDataFrame([(1, "กินข้าวกับปลาที่ประเทศไทย ๑๒๓"), (2, "ยี่สิบ คน 5 ม.ค. xé"), (3, None)], "doc_id int, text string")
    config = annotate.AnalyzerConfig(soundex="lk82", romanization=True, abbreviations=True)
    tokens = {(r.doc_id, r.text): r for r in annotate.fts_tokens(df, lex, config).collect()}
    assert tokens[1, "ประเทศไทย"].ne == "Place" and tokens[1, "ประเทศไทย"].kind == "Place"
    assert tokens[1, "กับ"].is_stop and tokens[1, "กับ"].position == 1
    assert tokens[1, "ปลา"].synonyms == ["pla", "4800"] and tokens[1, "ปลา"].pos == "NOUN"
    assert tokens[1, "๑๒๓"].synonyms == ["123"]
    assert (2, "มกราคม") in tokens and tokens[2, "สิบ"].synonyms[-1] == "10"
    found = {r.doc_id: r.lexemes for r in annotate.lexemes(annotate.fts_tokens(df, lex)).collect()}
    assert found[1] == ["กินข้าว", "ปลา", "ประเทศไทย", "๑๒๓", "123"]


def test_abbreviations_do_not_recurse(column):
    expand = lambda c: annotate.expand_abbreviations(c, {"ab": ["b"], "b": ["c"], "abc": ["x", "y"]})
    assert column(expand, ["abcabb", "zz\nb", "", None]) == ["xbc", "zz\nc", "", None]


def test_romanize(spark, lex):
    assert [romanize.romanize_word(w) for w in ["กิน", "เธอ", "เรา", "น้ำ", "แม่", "abc", "การ์", "ห์"]] == ["kin", "thoe", "rao", "nam", "mae", "abc", "ka", ""]
    df = spark.createDataFrame([(1, "กินข้าว กับ x"), (2, ""), (3, None)], "doc_id int, text string")
    assert {r.doc_id: r.roman for r in romanize.romanize_sentence(df, lex).collect()} == {1: "kinkhao kap x", 2: "", 3: None}


def test_spelling_against_cross_join(spark):
    rng = random.Random(3)
    make = lambda: "".join(rng.choices("abc", k=rng.randint(1, 7)))
    words = spark.createDataFrame([(w, len(w)) for w in {make() for _ in range(120)}], "word string, freq bigint")
    inputs = spark.createDataFrame([(w,) for w in {make() for _ in range(60)}], "input string")
    got = {(r.input, r.word, r.edit_distance) for r in spelling.suggestions(inputs, words, None).collect()}
    want = {(r.input, r.word, r.d) for r in inputs.crossJoin(words).selectExpr("input", "word", "levenshtein(input, word) as d").filter("d <= 2").collect()}
    assert got == want


def test_did_you_mean(spark):
    words = spark.createDataFrame([("hello", 5), ("help", 9)], "word string, freq bigint")
    inputs = spark.createDataFrame([("helo",), ("hello",), ("zzzz",)], "input string")
    assert {r.input: r.suggestion for r in spelling.did_you_mean(inputs, words).collect()} == {"helo": "help", "hello": None, "zzzz": None}


def test_keywords(spark, lex):
    df = spark.createDataFrame([(1, "ปลา ปลา กับ ข้าว hello")], "doc_id int, text string")
    tokens = segmentation.segment(df, lex)
    rows = keywords.keywords(tokens, lex.words, lex.stopwords, 2).orderBy("rank").collect()
    assert [(r.word, r["count"]) for r in rows] == [("hello", 1), ("ปลา", 2)]
    phrases = {r.word for r in keywords.keyphrases(tokens, lex.words, lex.stopwords).collect()}
    assert {"ปลา ข้าว", "ปลา ปลา ข้าว"} <= phrases


def test_analysed_queries(spark):
    words = ["กินข้าว", "กับ", "ปลา", "หมู", "กุ้ง", "ต้มยำกุ้ง", "ข้าวผัด", "ผัดไทย", "แกงเขียวหวาน", "ข้าวมันไก่", "ต้มข่า", "ไก่", "ยำวุ้นเส้น", "ข้าวหน้าเป็ด", "แกงส้ม"]
    lex = lexicons.builtin(spark)
    table = spark.createDataFrame([(w, 10) for w in words], "word string, freq bigint")
    own = lexicons.Lexicons(table, lex.stopwords, lex.synonyms, lex.romanization, lex.names, lex.pos, {})
    names = ["ข้าวผัดกุ้ง", "ต้มยำกุ้ง", "ผัดไทย", "แกงเขียวหวาน", "ข้าวมันไก่", "ต้มข่าไก่", "ยำวุ้นเส้น", "ข้าวหน้าเป็ด", "กินข้าวกับปลา", "แกงส้มปลา"]
    index = fulltext.tsvector(spark.createDataFrame(list(enumerate(names, 1)), "doc_id int, text string"), own).cache()
    analyze = fulltext.query_analyzer(spark, own)
    ids = lambda q: sorted(r.doc_id for r in fulltext.search(index, q).collect())
    for text, want in (("กุ้ง", [1]), ("ปลา", [9, 10]), ("ไก่", [6]), ("หมู", []), ("กินข้าวกับปลา", [9]), ("กับ ปลา", [9, 10]), ("กับ", [])):
        assert ids(fulltext.plainto_tsquery(text, analyze)) == want, text
    assert ids(fulltext.phraseto_tsquery("กินข้าวกับปลา", analyze)) == [9]
    assert ids(fulltext.phraseto_tsquery("ปลากินข้าว", analyze)) == []
    assert ids(fulltext.to_tsquery("กินข้าว & ปลา", analyze)) == [9] and ids(fulltext.to_tsquery("กินข้าว & หมู", analyze)) == []
    assert ids(fulltext.to_tsquery("กับ & (กุ้ง | !กับ)", analyze)) == [1]
    assert ids(fulltext.websearch_to_tsquery("ปลา -กินข้าว", analyze)) == [10]
    index.unpersist()


def test_colocated_query_terms():
    both = lambda kind: fulltext.Op(kind, (fulltext.Term("a"), fulltext.Term("b")))
    assert fulltext.plainto_tsquery("x", lambda t: [both("and")]) == both("and")
    assert fulltext.plainto_tsquery("x y", lambda t: ["c", both("or")]) == fulltext.Op("and", (fulltext.Term("c"), both("or")))


def test_lexemes_of_127_bytes(spark):
    texts = ["x" * 130, "ก" * 50, "ก" * 42, "y" * 126 + "ก"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(fulltext.cut_lexeme(F.col("t")).alias("c")).collect()
    want = ["x" * 127, "ก" * 42, "ก" * 42, "y" * 126]
    assert [r.c for r in rows] == want
    assert fulltext.query_terms(texts[0]) == [want[0]] and fulltext.query_terms(texts[1]) == [want[1]]


def test_queries(spark, lex):
    df = spark.createDataFrame([(1, "กินข้าวกับปลา cat dog"), (2, "ปลา Dog bird"), (3, "หมู cat, bird"), (4, "!")], "doc_id int, text string")
    index = fulltext.tsvector(df, lex)
    ids = lambda q, **k: sorted(r.doc_id for r in fulltext.search(index, q, **k).collect())
    assert ids(fulltext.to_tsquery("cat & dog")) == [1]
    assert ids(fulltext.to_tsquery("cat | bird")) == [1, 2, 3]
    assert ids(fulltext.to_tsquery("bird & !(cat | x)")) == [2]
    assert ids(fulltext.to_tsquery("!dog"), docs=df) == [3, 4]
    assert ids(fulltext.plainto_tsquery("ปลา dog")) == [1, 2]
    assert ids(fulltext.Op("phrase", (fulltext.Term("กินข้าว"), fulltext.Term("ปลา")))) == [1]  # the stop word takes no place
    assert ids(fulltext.websearch_to_tsquery('"ปลา dog" or -bird cat')) == [1, 2]
    assert ids(fulltext.plainto_tsquery("")) == []
    ranks = {r.doc_id: r.rank for r in fulltext.ts_rank(index, fulltext.to_tsquery("cat | dog")).collect()}
    assert ranks[1] > ranks[2] > 0 and set(ranks) == {1, 2, 3}
    assert {r.lexeme: (r.ndoc, r.nentry) for r in fulltext.ts_stat(index).collect()}["ปลา"] == (2, 2)
    with pytest.raises(ValueError):
        fulltext.to_tsquery("a & (b")
    marked = fulltext.ts_headline(segmentation.segment(df, lex), fulltext.to_tsquery("dog"))
    assert {r.doc_id: r.headline for r in marked.collect()}[2] == "ปลา<b>Dog</b>bird"


def test_evaluate(spark, lex):
    cases = spark.createDataFrame([(1, "ธนาคาร100แห่ง", ["ธนาคาร", "100", "แห่ง"]), (2, "จากร้าน", ["จา", "กร้าน"])], "case_id int, input string, gold array<string>")
    system = segmentation.segment(cases, lex, "case_id", "input")
    row = evaluate.boundary_scores(evaluate.gold_spans(cases), system, keys=("case_id", "char_start", "char_end")).first()
    assert (row.tp, row.fp, row.fn) == (3, 2, 2)


def test_lexicon_files(spark, tmp_path):
    path = tmp_path / "lexicon.tsv"
    path.write_text("﻿# comment\n\nกิน\tทาน\nกิน\tรับประทาน\nบ้าน\t7\n", encoding="utf-8")
    assert {r.word: r.synonyms for r in lexicons.read_synonyms(spark, str(path)).collect()} == {"กิน": ["ทาน", "รับประทาน"], "บ้าน": ["7"]}
    assert {r.word: r.freq for r in lexicons.read_frequencies(spark, str(path)).collect()} == {"บ้าน": 7}
    assert {r.word: r.roman for r in lexicons.read_romanization(spark, str(path)).collect()}["กิน"] == "รับประทาน"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        lexicons.read_words(spark, str(tmp_path / "missing"))


def test_sinks(spark, lex):
    df = spark.createDataFrame([(1, 'กินข้าว,"x"')], "doc_id int, text string")
    tokens = segmentation.segment(df, lex)
    assert sinks.joined_text(tokens, "/").first().line == 'กินข้าว/,"/x/"'
    lines = {r.value for r in sinks.csv_lines(tokens, "tokens").collect()}
    assert any(x.startswith('",""",Punctuation') for x in lines)
    assert '"text":"x"' in " ".join(r.value for r in sinks.json_lines(tokens.drop("ord")).collect())


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("กิน 12\nhello\n", encoding="utf-8")
    stream = text_streams.token_stream(text_streams.line_stream(spark, str(source)))
    q = stream.writeStream.format("memory").queryName("tokens_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.token for r in spark.sql("SELECT token FROM tokens_out").collect()) == ["12", "hello", "กิน"]


def test_entry_without_llm(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", lambda: None)
    monkeypatch.setattr(entry, "_pipeline", lambda: None)
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "ts_stat" in entry.queries()
