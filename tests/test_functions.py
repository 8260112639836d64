from namtok.functions import charclass, dates, numbers, phonetic, text


def test_runs_and_kinds(column):
    values = ["ธนาคาร100แห่ง ok!é😀", "", None]
    assert column(text.pre_tokens, values) == [["ธนาคาร", "100", "แห่ง", " ", "ok", "!", "é", "😀"], [], None]
    assert column(charclass.kind, ["é", "ก", "1", "๑", " ", "!", "😀", "ａ", "\f", None, ""]) == ["Unknown", "Thai", "Number", "Number", "Whitespace", "Punctuation", "Emoji", "Latin", "Unknown", None, None]


def test_clusters(column):
    assert column(text.clusters, ["สวัสดี", "เปปซี่abc", "ฤดู"]) == [["ส", "วั", "ส", "ดี"], ["เป", "ป", "ซี่", "abc"], ["ฤ", "ดู"]]
    assert column(text.cluster_boundaries, ["กินab"]) == [[0, 6, 9, 11]]


def test_normalize(column):
    assert column(text.normalize, ["ก่้า", "กํา", "abc", None]) == ["ก้า", "กำ", "abc", None]


def test_sentences(column):
    assert column(text.split_sentences, ["a. b 1.5 c.\nx!  ฯลฯ ก.ค. y. z?", "3. x", " ", None]) == [["a.", " b 1.5 c.", "x!", "  ฯลฯ ก.ค.", " y.", " z?"], ["3. x"], [], None]


def test_ngrams(column):
    assert column(lambda c: text.char_ngrams(c, 3), ["abcd", "ab", None]) == [["abc", "bcd"], [], None]
    assert column(lambda c: text.char_ngrams(c, 0), ["abcd"]) == [[]]
    assert column(lambda c: text.token_ngrams(c, 2), [["a", "b", "c"], ["a"]], "array<string>") == [["ab", "bc"], []]


def test_numbers(column):
    values = [0, 1, 10, 11, 21, 100, 101, 111, 1_000_000, 1_000_001, 20_000_021, 999_999_999_999, 10**12, 9223372036854775807]
    words = column(numbers.number_to_thai_word, values, "bigint")
    assert words[:6] == ["ศูนย์", "หนึ่ง", "สิบ", "สิบเอ็ด", "ยี่สิบเอ็ด", "หนึ่งร้อย"]
    assert column(numbers.thai_word_to_number, words) == [*values[:-2], None, None]
    assert column(numbers.number_to_thai_word, [-1, None], "bigint") == [None, None]
    assert column(numbers.thai_word_to_number, ["ร้อยพัน", "เอ็ด", "สองสาม", "ล้าน", " ยี่สิบ ", "x", "", None]) == [1100, None, None, 1_000_000, 20, None, None, None]
    assert column(numbers.thai_digits_to_ascii, ["๑๒a๓"]) == ["12a3"]
    assert column(numbers.is_thai_digits, ["๑๒", "๑2", ""]) == [True, False, False]


def test_baht(column):
    parsed = column(numbers.parse_baht_text, ["หนึ่งร้อยบาทถ้วน", "ห้าบาทยี่สิบห้าสตางค์", "บาท", "สิบบาท x", "สิบบาทหนึ่งร้อยสตางค์", None])
    assert [p and tuple(p) for p in parsed] == [(100, 0), (5, 25), None, None, None, None]


def test_dates(column):
    iso = column(lambda c: dates.to_iso8601(dates.parse_thai_date(c)), ["1/2/2566", "31-12-2024", "วันที่ 5 มกราคม พ.ศ. 2567", "๑๒ ส.ค. ๒๕๖๖", "5 มีนาคม 2024 x", "32/1/2566", "1/2", "31/2/2566", "", None])
    assert iso == ["2023-02-01", "2024-12-31", "2024-01-05", "2023-08-12", "2024-03-05", None, None, "2023-02-31", None, None]
    assert column(lambda c: dates.to_thai_text(dates.parse_thai_date(c)), ["1/2/2024"]) == ["1 กุมภาพันธ์ พ.ศ. 2567"]
    assert [str(x) for x in column(lambda c: dates.to_date(dates.parse_thai_date(c)), ["1/2/2024", "31/2/2024"])] == ["2024-02-01", "None"]


def test_phonetics(column):
    assert column(phonetic.lk82, ["กรุงเทพ", "", "abc"]) == ["1873", "0000", "0000"]
    assert column(phonetic.metasound, ["กาน", "", "กรณ์"]) == ["112", "000", "102"]
    assert column(phonetic.english_soundex, ["Thompson", "Ashcraft", "", "123"]) == ["T512", "A226", "", ""]
    assert column(phonetic.thai_english_soundex, ["Robert", "กรุงเทพ"]) == ["671763", "265231"]
    assert column(lambda c: phonetic.sounds_like(c, c), ["กา", "abc", ""]) == [True, False, False]
    assert column(lambda c: phonetic.soundex(c, "nonsense") == phonetic.lk82(c), ["กา"]) == [True]
