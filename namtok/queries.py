"""Registered queries of the text operators over the test tables, and the SQL that DuckDB holds them against.

The tables hold no Thai, so Thai inputs (number words, amounts, dates) are made from their numbers
and dates, on both sides by separate code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namtok.functions import charclass, dates, numbers, phonetic, text
from namtok.operators import annotate, evaluate, keywords, romanize, segmentation, spelling, words
from namtok.plans import fulltext
from namtok.sources import lexicons, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- SQL pieces -------------------------------------------------------------------------------------

RUNS = f"unnest(regexp_extract_all(text, '{charclass.RUNS}')) AS token, unnest(range(len(regexp_extract_all(text, '{charclass.RUNS}')))) AS ord"
KIND = "CASE " + " ".join(f"WHEN regexp_matches(token, '^[{c}]') THEN '{k}'" for k, c in charclass.KINDS.items()) + " ELSE 'Unknown' END"


def _sql_digit(n: str) -> str:
    return f"(['', {', '.join(repr(w) for w in numbers.WORDS[1:])}])[({n})::INTEGER + 1]"


def _sql_below(n: str) -> str:
    parts = [f"CASE WHEN ({n}) // {size} % 10 > 0 THEN {_sql_digit(f'({n}) // {size} % 10')} || '{w}' ELSE '' END" for w, size in numbers.MULTIPLIERS.items() if size > 10]
    tens = f"({n}) // 10 % 10"
    parts.append(f"CASE {tens} WHEN 0 THEN '' WHEN 1 THEN 'สิบ' WHEN 2 THEN 'ยี่สิบ' ELSE {_sql_digit(tens)} || 'สิบ' END")
    parts.append(f"CASE WHEN ({n}) % 10 = 1 AND {tens} > 0 THEN 'เอ็ด' ELSE {_sql_digit(f'({n}) % 10')} END")
    return " || ".join(f"({p})" for p in parts)


def _sql_word(n: str) -> str:
    """Number words of n below 10^12."""
    return f"CASE WHEN {n} = 0 THEN 'ศูนย์' WHEN {n} >= 1000000 THEN {_sql_below(f'({n}) // 1000000')} || 'ล้าน' || {_sql_below(f'({n}) % 1000000')} ELSE {_sql_below(n)} END"


def _sql_collapse(s: str, symbols: str) -> str:
    for c in symbols:
        s = f"regexp_replace({s}, '{c}+', '{c}', 'g')"
    return s


BIG = "(l_orderkey * 1000003 + l_linenumber * 37) % 900000000000"
AMOUNT = "cast(floor(o_totalprice) AS BIGINT)"


def _big() -> Column:
    return (F.col("l_orderkey") * 1000003 + F.col("l_linenumber") * 37) % 900000000000


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _big().alias("n"))


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt to all cores before costly expressions: a file of a few MB, read by a task, holds millions of them."""
    context, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    return df.repartition(max(4 * context.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions"))), key)


def _words(spark: SparkSession, d: str, spread: bool = False) -> DataFrame:
    """(o_orderkey, word): order keys in words."""
    orders = _table(spark, d, "orders").select("o_orderkey")
    return (_spread(orders, "o_orderkey") if spread else orders).select("o_orderkey", numbers.number_to_thai_word(F.col("o_orderkey")).alias("word"))


WORDS = f"SELECT o_orderkey, {_sql_word('o_orderkey')} AS word FROM orders"

# -- script runs, clusters, sentences, n-grams ------------------------------------------------------


@query(f"SELECT doc_id, {KIND} AS kind, count(*) AS n, sum(length(token))::BIGINT AS chars FROM (SELECT doc_id, {RUNS} FROM documents) GROUP BY ALL")
def token_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    tokens = text.script_tokens(_table(spark, d, "documents"), "doc_id", "text")
    return tokens.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("token")).alias("chars"))


_SPANS = f"SELECT conv_id, turn, ord::INTEGER AS ord, token, {KIND} AS kind FROM (SELECT conv_id, turn, {RUNS} FROM conversations)"


@query(f"SELECT * FROM ({_SPANS})")
def pre_tokenize(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(text.pre_tokens(F.col("text"))).alias("ord", "token"))
    return rows.withColumn("kind", charclass.kind(F.col("token")))


@query(
    f"SELECT conv_id, turn, ord, token, kind, coalesce(sum(length(token)) OVER w, 0)::INTEGER AS char_start, (coalesce(sum(length(token)) OVER w, 0) + length(token))::INTEGER AS char_end, "
    f"coalesce(sum(strlen(token)) OVER w, 0)::INTEGER AS byte_start, (coalesce(sum(strlen(token)) OVER w, 0) + strlen(token))::INTEGER AS byte_end FROM ({_SPANS}) "
    "WINDOW w AS (PARTITION BY conv_id, turn ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)
def token_spans(spark: SparkSession, d: str) -> DataFrame:
    return text.with_spans(pre_tokenize(spark, d), ["conv_id", "turn"], "ord", "token")


@query(f"SELECT * FROM ({_SPANS}) WHERE kind NOT IN ('Whitespace', 'Unknown')")
def next_known(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.next_known(pre_tokenize(spark, d))


_CHARS = "SELECT doc_id, i, c, lag(c) OVER w AS p, lead(c) OVER w AS q FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM documents) WINDOW w AS (PARTITION BY doc_id ORDER BY i)"
_ENDS = f"SELECT doc_id, i, c, (c IN ('!', '?', chr(10), '๚', '๛', 'ฯ') OR (c = '.' AND NOT regexp_matches(coalesce(p, 'x'), '[0-9]') AND (q IS NULL OR regexp_matches(q, '[{charclass.SPACE}]'))))::INTEGER AS e FROM ({_CHARS})"


@query(
    f"SELECT doc_id, count(*) AS n_sentences, sum(n)::BIGINT AS chars, max(n)::BIGINT AS longest FROM (SELECT doc_id, k, count(*) AS n FROM "
    f"(SELECT doc_id, c, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ({_ENDS})) "
    f"GROUP BY doc_id, k HAVING count(*) FILTER (WHERE NOT regexp_matches(c, '[{charclass.SPACE}]')) > 0) GROUP BY doc_id"
)
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").select("doc_id", F.explode(text.split_sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("s")).alias("chars"), F.max(F.length("s")).cast("bigint").alias("longest"))


@query(f"SELECT o_orderkey, regexp_replace(replace(word, '้', '่้'), '[่-๋]+([่-๋])', '\\1', 'g') AS normal FROM ({WORDS})")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    doubled = F.replace("word", F.lit("้"), F.lit("่้"))
    return _words(spark, d).select("o_orderkey", text.normalize(doubled).alias("normal"))


@query(f"SELECT o_orderkey, regexp_extract_all(word, '{charclass.CLUSTER}') AS clusters FROM ({WORDS})")
def thai_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).select("o_orderkey", text.clusters(F.col("word")).alias("clusters"))


@query("SELECT p_partkey, unnest(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i::INTEGER, 3))) AS gram FROM part")
def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", F.explode(text.char_ngrams(F.col("p_name"), 3)).alias("gram"))


@query("SELECT item_id, list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1]) AS grams FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark)")
def token_ngrams(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    return _table(spark, d, "benchmark").select("item_id", text.token_ngrams(words, 2).alias("grams"))


# -- numbers and dates ------------------------------------------------------------------------------


@query(f"SELECT l_orderkey, l_linenumber, {_sql_word(BIG)} AS word FROM lineitem")
def number_to_thai_word(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(spark, d).select("l_orderkey", "l_linenumber", numbers.number_to_thai_word(F.col("n")).alias("word"))


@query(f"SELECT l_orderkey, l_linenumber, {BIG} AS n, cast({BIG} AS VARCHAR) AS decimal FROM lineitem")
def parse_thai_word(spark: SparkSession, d: str) -> DataFrame:
    word = numbers.number_to_thai_word(F.col("n"))
    parsed = _spread(_numbers(spark, d), "l_orderkey").select("l_orderkey", "l_linenumber", numbers.thai_word_to_number(word).alias("n"))
    return parsed.withColumn("decimal", F.col("n").cast("string"))


@query("SELECT o_orderkey, translate(cast(o_orderkey AS VARCHAR), '0123456789', '๐๑๒๓๔๕๖๗๘๙') AS thai, cast(o_orderkey AS VARCHAR) AS ascii, true AS is_thai FROM orders")
def thai_digits(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "orders").select("o_orderkey", F.translate(F.col("o_orderkey").cast("string"), "0123456789", numbers.DIGITS).alias("thai"))
    return rows.withColumn("ascii", numbers.thai_digits_to_ascii(F.col("thai"))).withColumn("is_thai", numbers.is_thai_digits(F.col("thai")))


_BAHT = f"SELECT o_orderkey, {AMOUNT} AS baht, (o_orderkey % 100)::INTEGER AS satang FROM orders"


def _amounts(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("baht"), (F.col("o_orderkey") % 100).cast("int").alias("satang"))


@query(f"SELECT o_orderkey, {_sql_word('baht')} || 'บาท' || CASE WHEN satang = 0 THEN 'ถ้วน' ELSE {_sql_word('satang')} || 'สตางค์' END AS amount FROM ({_BAHT})")
def baht_text(spark: SparkSession, d: str) -> DataFrame:
    return _amounts(spark, d).select("o_orderkey", numbers.number_to_baht_text(F.col("baht"), F.col("satang")).alias("amount"))


@query(_BAHT)
def parse_baht(spark: SparkSession, d: str) -> DataFrame:
    parsed = numbers.parse_baht_text(F.col("amount"))
    amounts = _spread(_amounts(spark, d), "o_orderkey").select("o_orderkey", numbers.number_to_baht_text(F.col("baht"), F.col("satang")).alias("amount"))
    return amounts.select("o_orderkey", parsed.alias("p")).select("o_orderkey", "p.baht", "p.satang")


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query(f"SELECT o_orderkey, day(o_orderdate) || ' ' || ({_list(dates.MONTHS)})[month(o_orderdate)] || ' พ.ศ. ' || (year(o_orderdate) + 543) AS thai FROM orders")
def thai_date_text(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    return _table(spark, d, "orders").select("o_orderkey", dates.format_thai_date(F.year(at) + 543, F.month(at), F.dayofmonth(at)).alias("thai"))


_DATE = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, {era} AS era FROM orders"


def _dates(spark: SparkSession, d: str, form: Callable[[Column, Column, Column], Column]) -> DataFrame:
    at = F.col("o_orderdate")
    parsed = dates.parse_thai_date(form(F.dayofmonth(at), F.month(at), F.year(at)))
    return _table(spark, d, "orders").select("o_orderkey", parsed.alias("p")).select("o_orderkey", dates.to_iso8601(F.col("p")).alias("iso"), "p.era")


@query(_DATE.format(era="'Buddhist'"))
def parse_thai_date_full(spark: SparkSession, d: str) -> DataFrame:
    return _dates(spark, d, lambda day, month, year: F.concat(F.lit("วันที่ "), dates.format_thai_date(year + 543, month, day)))


@query(_DATE.format(era="'Buddhist'"))
def parse_thai_date_short(spark: SparkSession, d: str) -> DataFrame:
    short = F.array(*map(F.lit, dates.SHORT_MONTHS))
    return _dates(spark, d, lambda day, month, year: F.concat_ws(" ", day, F.get(short, month - 1), year + 543))


@query(_DATE.format(era="'Gregorian'"))
def parse_thai_date_slash(spark: SparkSession, d: str) -> DataFrame:
    return _dates(spark, d, lambda day, month, year: F.concat_ws("/", day, month, year))


@query(_DATE.format(era="'Buddhist'"))
def parse_thai_date_thai_digits(spark: SparkSession, d: str) -> DataFrame:
    return _dates(spark, d, lambda day, month, year: F.translate(F.concat_ws("-", day, month, year + 543), "0123456789", numbers.DIGITS))


@query(_DATE.format(era="'Gregorian'"))
def parse_thai_date_era(spark: SparkSession, d: str) -> DataFrame:
    full = F.array(*map(F.lit, dates.MONTHS))
    return _dates(spark, d, lambda day, month, year: F.concat(day, F.lit(" "), F.get(full, month - 1), F.lit(" ค.ศ. "), year))


@query(f"SELECT o_orderkey, day(o_orderdate) || ' ' || ({_list(dates.MONTHS)})[month(o_orderdate)] || ' x' AS expanded FROM orders")
def expand_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    short = F.concat(F.dayofmonth(at), F.lit(" "), F.get(F.array(*map(F.lit, dates.SHORT_MONTHS)), F.month(at) - 1), F.lit(" x"))
    return _table(spark, d, "orders").select("o_orderkey", annotate.expand_abbreviations(short, lexicons.builtin(spark).abbreviations).alias("expanded"))


# -- phonetics --------------------------------------------------------------------------------------


def _sql_thai_code(groups: dict[str, str]) -> str:
    chars, codes = "".join(groups.values()), "".join(k * len(v) for k, v in groups.items())
    kept = f"regexp_replace(regexp_replace(word, '.์', '', 'g'), '[^{chars}]', '', 'g')"
    return f"rpad(substr({_sql_collapse(f"translate({kept}, '{chars}', '{codes}')", ''.join(groups))}, 1, 4), 4, '0')"


@query(f"SELECT o_orderkey, {_sql_thai_code(phonetic.LK82)} AS lk82, {_sql_thai_code(phonetic.UDOM83)} AS udom83 FROM ({WORDS})")
def thai_soundex(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).select("o_orderkey", phonetic.lk82(F.col("word")).alias("lk82"), phonetic.udom83(F.col("word")).alias("udom83"))


_LATIN = "SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents"


def _latin(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("word")).distinct()


_ENGLISH = _sql_collapse("translate(upper(word), 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '11112222222233455600000000')", "0123456")


@query(f"SELECT word, rpad(substr(upper(word[1]) || replace(substr({_ENGLISH}, 2), '0', ''), 1, 4), 4, '0') AS code FROM ({_LATIN})")
def english_soundex(spark: SparkSession, d: str) -> DataFrame:
    return _latin(spark, d).select("word", phonetic.english_soundex(F.col("word")).alias("code"))


_CROSS = "translate(upper(word[1]), 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '11112222222233455600000000') || translate(substr(upper(word), 2), 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '11112222222233455677777819')"


@query(f"SELECT word, {_sql_collapse('(' + _CROSS + ')', '0123456789')} AS code FROM ({_LATIN})")
def thai_english_soundex(spark: SparkSession, d: str) -> DataFrame:
    return _latin(spark, d).select("word", phonetic.thai_english_soundex(F.col("word")).alias("code"))


_NAMES = "SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark"


@query(f"WITH c AS (SELECT word, rpad(substr(upper(word[1]) || replace(substr({_ENGLISH}, 2), '0', ''), 1, 4), 4, '0') AS code FROM ({_NAMES})) SELECT a.word AS a, b.word AS b, a.code FROM c a JOIN c b ON a.code = b.code AND a.word < b.word")
def sounds_like_join(spark: SparkSession, d: str) -> DataFrame:
    words = _table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).distinct()
    coded = words.withColumn("code", phonetic.english_soundex(F.col("word")))
    return coded.select(F.col("word").alias("a"), "code").join(coded.select(F.col("word").alias("b"), "code"), "code").filter("a < b")


@query()
def metasound(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d, spread=True).select("o_orderkey", phonetic.metasound(F.col("word")).alias("code"))


@query()
def romanize_rule(spark: SparkSession, d: str) -> DataFrame:
    rows = _words(spark, d)
    rules = rows.select("word").distinct().withColumn("roman", romanize.romanize_by_rule(F.col("word")))
    return rows.join(rules, "word").select("o_orderkey", "roman")


# -- segmentation and annotation --------------------------------------------------------------------

_PIECES = f"SELECT o_orderkey, regexp_extract_all(word, '{'|'.join(sorted(lexicons.number_words(), key=len, reverse=True))}') AS words FROM ({WORDS})"


@query(_PIECES)
def segment_numbers(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.segment_words(_words(spark, d, spread=True), lexicons.builtin(spark), "o_orderkey", "word")


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE word = 'สิบ') AS tens FROM (SELECT unnest(words) AS word FROM ({_PIECES}))")
def above_confidence(spark: SparkSession, d: str) -> DataFrame:
    tokens = segmentation.segment(_words(spark, d, spread=True), lexicons.builtin(spark), "o_orderkey", "word", spans=False)
    return segmentation.above_confidence(tokens, 0.5).agg(F.count("*").alias("n"), F.count_if(F.col("text") == "สิบ").alias("tens"))


@query(f"WITH p AS (SELECT o_orderkey, sum(len(words)) AS n FROM ({_PIECES}) GROUP BY ALL) SELECT sum(n)::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1 FROM p")
def boundary_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _words(spark, d, spread=True).select("o_orderkey", F.col("word").alias("input"))
    cut = "|".join(sorted(lexicons.number_words(), key=len, reverse=True))
    cases = rows.withColumn("gold", F.regexp_extract_all("input", F.lit(f"({cut})"), F.lit(1)))
    return evaluate.case_scores(cases, lexicons.builtin(spark))


_MEAL = "SELECT n_nationkey, 'กินข้าวกับปลาที่ประเทศไทย' AS text FROM nation"


def _meals(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "nation").select("n_nationkey", F.lit("กินข้าวกับปลาที่ประเทศไทย").alias("text"))


@query(
    f"SELECT n_nationkey, v.position, v.text, v.kind, v.is_stop, v.pos, v.ne FROM ({_MEAL}) CROSS JOIN (VALUES (0, 'กินข้าว', 'Thai', false, NULL, NULL), (1, 'กับ', 'Thai', true, NULL, NULL), "
    "(2, 'ปลา', 'Thai', false, 'NOUN', NULL), (3, 'ที่', 'Thai', true, NULL, NULL), (4, 'ประเทศไทย', 'Place', false, NULL, 'Place')) v(position, text, kind, is_stop, pos, ne)"
)
def fts_annotate(spark: SparkSession, d: str) -> DataFrame:
    tokens = annotate.fts_tokens(_meals(spark, d), lexicons.builtin(spark), id_col="n_nationkey")
    return tokens.select("n_nationkey", "position", "text", "kind", "is_stop", "pos", "ne")


@query(f"SELECT n_nationkey, ['กินข้าว', 'ปลา', 'pla', 'ประเทศไทย'] AS lexemes FROM ({_MEAL})")
def lexemes(spark: SparkSession, d: str) -> DataFrame:
    config = annotate.AnalyzerConfig(romanization=True)
    return annotate.lexemes(annotate.fts_tokens(_meals(spark, d), lexicons.builtin(spark), config, "n_nationkey"), "n_nationkey")


_FIRST = f"SELECT o_orderkey, word, unnest(range(1, length(word) + 1)) AS n FROM ({WORDS})"


@query(f"SELECT o_orderkey, substr(word, 1, n::INTEGER) AS word FROM ({_FIRST}) WHERE substr(word, 1, n::INTEGER) IN ({', '.join(repr(w) for w in lexicons.number_words())})")
def dictionary_prefixes(spark: SparkSession, d: str) -> DataFrame:
    rows = _words(spark, d).withColumnRenamed("word", "text")
    words = lexicons.builtin(spark).words.filter(F.col("word").isin(*lexicons.number_words()))
    return segmentation.prefixes(rows, words).select("o_orderkey", "word")


@query("SELECT * FROM (VALUES (1, 'thai'), (2, 'latin'), (3, 'number'), (4, 'punctuation'), (5, 'emoji'), (6, 'unknown'), (7, 'named')) t(tokid, alias)")
def token_types(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.token_types(spark)


@query(f"SELECT conv_id, turn, count(*) FILTER (WHERE kind = 'Unknown') AS unknown FROM ({_SPANS}) GROUP BY ALL")
def unknown_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = pre_tokenize(spark, d).withColumn("id", F.struct("conv_id", "turn"))
    return segmentation.unknown_counts(rows, "id").select("id.conv_id", "id.turn", "unknown")


@query()
def romanize_sentences(spark: SparkSession, d: str) -> DataFrame:
    return romanize.romanize_sentence(_meals(spark, d), lexicons.builtin(spark), "n_nationkey")


# -- spelling and keywords --------------------------------------------------------------------------

_VOCABULARY = "SELECT lower(w) AS word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM conversations) GROUP BY ALL"
_MISSPELT = "SELECT DISTINCT substr(lower(w), 2) AS input FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark) WHERE length(w) > 4"


def _lower_words(spark: SparkSession, d: str, name: str) -> DataFrame:
    return _table(spark, d, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word"))


def _misspelt(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    inputs = _lower_words(spark, d, "benchmark").filter(F.length("word") > 4).select(F.expr("substring(word, 2)").alias("input")).distinct()
    return inputs, _lower_words(spark, d, "conversations").groupBy("word").agg(F.count("*").alias("freq"))


_NEAR = f"WITH v AS ({_VOCABULARY}), i AS ({_MISSPELT}), s AS (SELECT input, word, levenshtein(input, word)::INTEGER AS edit_distance, true AS soundex_match, freq::BIGINT AS freq_score FROM i, v WHERE abs(length(input) - length(word)) <= 2 AND levenshtein(input, word) <= 2), r AS (SELECT *, row_number() OVER (PARTITION BY input ORDER BY edit_distance, freq_score DESC, word) AS rank FROM s) "


@query(_NEAR + "SELECT input, word, edit_distance, soundex_match, freq_score, rank::INTEGER AS rank FROM r WHERE rank <= 3")
def spell_suggestions(spark: SparkSession, d: str) -> DataFrame:
    inputs, words = _misspelt(spark, d)
    return spelling.suggestions(inputs, words, 3)


@query(_NEAR + "SELECT i.input, CASE WHEN edit_distance > 0 THEN word END AS suggestion FROM i LEFT JOIN r ON r.input = i.input AND rank = 1")
def did_you_mean(spark: SparkSession, d: str) -> DataFrame:
    inputs, words = _misspelt(spark, d)
    return spelling.did_you_mean(inputs, words)


_TOKENS = f"SELECT doc_id, ord, token, {KIND} AS kind FROM (SELECT doc_id, {RUNS} FROM documents)"
_CONTENT = f"SELECT * FROM ({_TOKENS}) WHERE kind NOT IN ('Whitespace', 'Punctuation', 'Emoji', 'Unknown')"
_STOPS = "('the', 'and', 'of', 'de', 'la', 'le', 'und', 'der', 'que')"


def _stopwords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in ("the", "and", "of", "de", "la", "le", "und", "der", "que")], "word string")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return text.script_tokens(_table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("token", "text")


@query(f"SELECT token AS word, count(*) AS freq FROM ({_CONTENT}) GROUP BY ALL")
def corpus_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return keywords.corpus_frequencies(_tokens(spark, d))


_FREQ = f"f AS (SELECT token, count(*) AS freq FROM ({_CONTENT}) GROUP BY ALL), top AS (SELECT max(freq) + 1.0::DOUBLE AS top FROM f)"


@query(
    f"WITH {_FREQ}, c AS (SELECT doc_id, token, count(*) AS n FROM ({_CONTENT}) GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM c), "
    f"s AS (SELECT doc_id, token AS word, n AS count, ((n::DOUBLE / total::DOUBLE) * (top / (freq + 1)::DOUBLE))::FLOAT AS score FROM t JOIN f USING (token), top WHERE length(token) >= 2 AND token NOT IN {_STOPS}), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS rank FROM s) SELECT doc_id, word, count, round(score::DOUBLE, 3) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5"
)
def keyword_top(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    found = keywords.text_keywords(docs, words.frequencies(docs), _stopwords(spark), 5)
    return found.withColumn("score", F.round(F.col("score").cast("double"), 3))


@query(
    f"WITH {_FREQ}, c AS (SELECT doc_id, ord, token, top / (freq + 1)::DOUBLE AS idf FROM ({_CONTENT}) JOIN f USING (token), top WHERE length(token) >= 2 AND token NOT IN {_STOPS}), "
    "w AS (SELECT doc_id, token AS a, idf AS x, lead(token) OVER o AS b, lead(idf) OVER o AS y, lead(token, 2) OVER o AS c, lead(idf, 2) OVER o AS z, count(*) OVER (PARTITION BY doc_id) AS total FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY ord)), "
    "p AS (SELECT doc_id, total, a || ' ' || b AS word, (x + y) / 2 AS idf FROM w WHERE b IS NOT NULL UNION ALL SELECT doc_id, total, a || ' ' || b || ' ' || c, (x + y + z) / 3 FROM w WHERE c IS NOT NULL), "
    "s AS (SELECT doc_id, word, count(*) AS count, ((count(*)::DOUBLE / any_value(total)::DOUBLE) * any_value(idf))::FLOAT AS score FROM p GROUP BY doc_id, word), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS rank FROM s) SELECT doc_id, word, count, round(score::DOUBLE, 2) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 3"
)
def keyphrase_top(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    found = keywords.text_keyphrases(docs, words.frequencies(docs), _stopwords(spark), 3)
    return found.withColumn("score", F.round(F.col("score").cast("double"), 2))


# -- full text --------------------------------------------------------------------------------------

_INDEXED = f"SELECT doc_id, CASE WHEN kind IN ('Latin', 'Unknown') THEN lower(token) ELSE token END AS lexeme, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS pos FROM ({_TOKENS}) WHERE kind NOT IN ('Whitespace', 'Punctuation', 'Emoji') AND token NOT IN {_STOPS}"
_HAS = "EXISTS (SELECT 1 FROM x WHERE x.doc_id = d.doc_id AND x.lexeme = '{}')"


def _index(spark: SparkSession, d: str, table: str = "documents") -> DataFrame:
    return fulltext.script_postings(_table(spark, d, table), stopwords=_stopwords(spark))


def _sql_search(where: str) -> str:
    return f"WITH x AS ({_INDEXED}) SELECT doc_id FROM documents d WHERE {where}"


@query(_sql_search(_HAS.format("that") + " AND " + _HAS.format("with")))
def fts_and(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.search(_index(spark, d), fulltext.to_tsquery("that & with"))


@query(_sql_search(_HAS.format("avec") + " OR " + _HAS.format("con")))
def fts_or(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.search(_index(spark, d), fulltext.to_tsquery("avec | con"))


@query(_sql_search(_HAS.format("is") + " AND NOT " + _HAS.format("was")))
def fts_not(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.search(_index(spark, d), fulltext.to_tsquery("is & !was"))


@query(_sql_search("NOT " + _HAS.format("is")))
def fts_only_not(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.search(_index(spark, d), fulltext.to_tsquery("!is"), docs=_table(spark, d, "documents"))


@query(f"WITH x AS ({_INDEXED}) SELECT DISTINCT a.doc_id FROM x a JOIN x b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.lexeme = 'to' AND b.lexeme = 'be'")
def fts_phrase(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.search(_index(spark, d), fulltext.phraseto_tsquery("to be"))


@query(_sql_search(f"({_HAS.format('with')} AND NOT {_HAS.format('was')}) OR {_HAS.format('pour')}"))
def fts_websearch(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.search(_index(spark, d), fulltext.websearch_to_tsquery("with -was or pour"))


@query(f"SELECT lexeme, count(DISTINCT doc_id) AS ndoc, count(*) AS nentry FROM ({_INDEXED}) GROUP BY lexeme")
def ts_stat(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "text").repartition("doc_id")
    return fulltext.ts_stat(fulltext.script_postings(docs, stopwords=_stopwords(spark)))


_RANK = f"WITH x AS ({_INDEXED}), k AS (SELECT doc_id, lexeme, row_number() OVER (PARTITION BY doc_id, lexeme ORDER BY pos) AS k FROM x WHERE lexeme IN ('that', 'with')), r AS (SELECT doc_id, round(sum(0.1::DOUBLE / (k * k)) / (1.64493406685 * 2), 9) AS rank FROM k GROUP BY doc_id HAVING count(DISTINCT lexeme) = 2) "


@query(_RANK + "SELECT doc_id, rank FROM r ORDER BY rank DESC, doc_id LIMIT 20")
def ts_rank_top(spark: SparkSession, d: str) -> DataFrame:
    ranked = fulltext.ts_rank(_index(spark, d), fulltext.plainto_tsquery("that with"))
    return ranked.withColumn("rank", F.round("rank", 9)).orderBy(F.desc("rank"), "doc_id").limit(20)


@query(f"SELECT conv_id, turn, string_agg(CASE WHEN lower(token) = 'the' THEN '<b>' || token || '</b>' ELSE token END, '' ORDER BY ord) AS headline FROM ({_SPANS}) GROUP BY ALL")
def ts_headline(spark: SparkSession, d: str) -> DataFrame:
    tokens = pre_tokenize(spark, d).withColumnRenamed("token", "text").withColumn("id", F.struct("conv_id", "turn"))
    return fulltext.ts_headline(tokens, fulltext.raw_tsquery("the"), "id").select("id.conv_id", "id.turn", "headline")


@query(
    "WITH t AS (SELECT p_partkey, lower(w) AS lexeme, (i + 1)::INTEGER AS pos, 'A' AS weight FROM (SELECT p_partkey, unnest(regexp_extract_all(p_name, '[A-Za-z]+|[0-9]+')) AS w, unnest(range(len(regexp_extract_all(p_name, '[A-Za-z]+|[0-9]+')))) AS i FROM part)), "
    "u AS (SELECT p_partkey, lower(w) AS lexeme, (i + 1)::INTEGER AS pos, 'C' AS weight FROM (SELECT p_partkey, unnest(regexp_extract_all(p_type, '[A-Za-z]+|[0-9]+')) AS w, unnest(range(len(regexp_extract_all(p_type, '[A-Za-z]+|[0-9]+')))) AS i FROM part)), "
    "m AS (SELECT p_partkey, max(pos) AS last FROM t GROUP BY ALL) SELECT * FROM t UNION ALL SELECT p_partkey, lexeme, (pos + coalesce(last, 0))::INTEGER, weight FROM u LEFT JOIN m USING (p_partkey)"
)
def setweight_concat(spark: SparkSession, d: str) -> DataFrame:
    part = _table(spark, d, "part")
    index = lambda c, w: fulltext.set_weight(fulltext.postings(fulltext.script_fts_tokens(part, "p_partkey", c), id_col="p_partkey"), w)
    return fulltext.concat(index("p_name", "A"), index("p_type", "C"), "p_partkey").select("p_partkey", "lexeme", "pos", "weight")


@query(f"SELECT count(*) FILTER (WHERE kind = 'Latin') AS latin, count(*) FILTER (WHERE kind = 'Number') AS number, count(*) FILTER (WHERE kind = 'Punctuation') AS punctuation FROM ({_TOKENS})")
def count_filter(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("kind")
    return _tokens(spark, d).agg(F.count_if(kind == "Latin").alias("latin"), F.count_if(kind == "Number").alias("number"), F.count_if(kind == "Punctuation").alias("punctuation"))


# -- sinks ------------------------------------------------------------------------------------------


@query(f"SELECT conv_id, turn, string_agg(token, '|' ORDER BY ord) AS line FROM ({_SPANS}) WHERE kind <> 'Whitespace' GROUP BY ALL")
def text_sink(spark: SparkSession, d: str) -> DataFrame:
    tokens = segmentation.next_word(pre_tokenize(spark, d)).withColumnRenamed("token", "text").withColumn("id", F.struct("conv_id", "turn"))
    return sinks.joined_text(tokens, "|", "id").select("id.conv_id", "id.turn", "line")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Ranked search: tokens to postings, an AND query, ranks, and the best documents."""
    return ts_rank_top(spark, d)
