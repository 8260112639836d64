"""Full-text index and queries: postings, boolean, phrase and web queries, ranks, headlines and statistics.

An index is a table of postings (doc_id, lexeme, pos, weight). A query filters it to its lexemes
(a predicate that reaches a stored index's files), groups what is left by document and decides on
that; a document's positions of the query's lexemes are all that a task holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namtok.functions.charclass import KINDS
from namtok.functions.text import script_tokens
from namtok.operators.annotate import AnalyzerConfig, fts_tokens
from namtok.sources.lexicons import Lexicons

# Token types of the parser, by number, and the weights of positions D to A.
TOKEN_TYPES = ["Thai", "Latin", "Number", "Punctuation", "Emoji", "Unknown", "Named"]
#: Bytes of a lexeme.
LONGEST = 127
WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}


def token_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name.lower()) for i, name in enumerate(TOKEN_TYPES, 1)], "tokid int, alias string")


def token_id(kind: Column) -> Column:
    """The type number of a kind; white space is 0, names of any sort are Named."""
    out = F.when(kind == "Whitespace", 0)
    for i, name in enumerate(TOKEN_TYPES, 1):
        out = out.when(kind == name, i)
    return out.otherwise(len(TOKEN_TYPES))


def parse(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, position, tokid, token)."""
    return tokens.select(id_col, "position", token_id(F.col("kind")).alias("tokid"), F.col("text").alias("token"))


def ts_debug(tokens: DataFrame, config: AnalyzerConfig | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, position, alias, token, lexemes): what indexing makes of each token; none for stop words, punctuation and emoji."""
    low = F.col("kind").isin("Latin", "Unknown")
    made = F.when(low, F.array(F.lower("text"))).otherwise(lexize(F.col("text"), F.col("synonyms"), F.col("pos")))
    skipped = F.col("kind").isin("Punctuation", "Emoji") | (F.col("is_stop") if (config or AnalyzerConfig()).stopwords else F.lit(False))
    alias = F.when(F.col("kind").isin(*TOKEN_TYPES), F.lower("kind")).otherwise("named")
    return tokens.select(id_col, "position", alias.alias("alias"), F.col("text").alias("token"), F.when(~skipped, made).otherwise(F.array().cast("array<string>")).alias("lexemes"))


def lexize(word: Column, synonyms: Column, pos: Column) -> Column:
    """A word, up to four synonyms, and its tag's lexeme."""
    tag = F.when(pos.isNotNull(), F.array(F.concat(F.lit("pos_"), F.lower(pos)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(word), F.slice(synonyms, 1, 4), tag)


def script_fts_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stopwords: DataFrame | None = None) -> DataFrame:
    """Full-text tokens by script runs alone, for texts without Thai: no dictionary and no shuffle."""
    tokens = script_tokens(df, id_col, text_col).filter("kind <> 'Whitespace'")
    out = tokens.select(id_col, F.col("ord").alias("position"), F.col("token").alias("text"), "kind", F.array().cast("array<string>").alias("synonyms"), F.array().cast("array<string>").alias("trigrams"), F.lit(None).cast("string").alias("pos"))
    if stopwords is None:
        return out.withColumn("is_stop", F.lit(False))
    stops = stopwords.select(F.col("word").alias("text")).distinct().withColumn("is_stop", F.lit(True))
    return out.join(F.broadcast(stops), "text", "left").withColumn("is_stop", F.coalesce("is_stop", F.lit(False)))


def cut_lexeme(word: Column) -> Column:
    """The longest prefix of whole characters in LONGEST bytes."""
    head = F.make_valid_utf8(F.substring(word.cast("binary"), 1, LONGEST).cast("string"))
    return F.when(F.octet_length(word) > LONGEST, F.regexp_replace(head, "\ufffd+$", "")).otherwise(word)


def postings(tokens: DataFrame, config: AnalyzerConfig | None = None, id_col: str = "doc_id", weight: str = "D", mode: str = "index") -> DataFrame:
    """(id, lexeme, pos, weight, head) of full-text tokens.

    postgres: stop words, punctuation and emoji take no position, Latin and unknown tokens are
    lower-cased, positions count from 1, and a tag's lexeme is ``pos_noun``. sqlite: every token
    that isn't a skipped stop word has the position it has in the text, as it is, with trigrams;
    tags (``posnoun``) are for indexing only.
    """
    config = config or AnalyzerConfig()
    postgres = config.dialect == "postgres"
    rows = tokens.filter(~F.col("is_stop")) if config.stopwords else tokens
    low = F.col("kind").isin("Latin", "Unknown")
    if postgres:
        rows = rows.filter(~F.col("kind").isin("Punctuation", "Emoji"))
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(id_col).orderBy("position")))
        head = F.when(low, F.lower("text")).otherwise(F.col("text"))
        more = F.when(low, F.array().cast("array<string>")).otherwise(F.slice("synonyms", 1, 4))
    else:
        rows, head, more = rows.withColumn("place", F.col("position") + 1), F.col("text"), F.concat("synonyms", "trigrams")
    if config.pos_lexemes and (postgres or mode == "index"):
        tag = F.concat(F.lit("pos_" if postgres else "pos"), F.lower("pos"))
        more = F.concat(more, F.when(F.col("pos").isNotNull() & ~low, F.array(tag)).otherwise(F.array().cast("array<string>")))
    every = F.array_distinct(F.concat(F.array(head), more))
    cut = F.transform(every, cut_lexeme) if postgres else every
    return rows.select(id_col, F.explode(cut).alias("lexeme"), F.col("place").cast("int").alias("pos"), F.lit(weight).alias("weight"), head.alias("head"))


#: What takes a position in an index: maximal runs of these kinds, whose classes share no character.
INDEXED = "|".join(f"[{KINDS[k]}]+" for k in ("Number", "Thai", "Latin")) + f"|[^{''.join(KINDS.values())}]+"


def script_postings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stopwords: DataFrame | None = None, weight: str = "D") -> DataFrame:
    """``postings`` of ``script_fts_tokens``, whose positions are counted within the row: no shuffle, sort or window.

    Only where ids repeat, which a look at the ids alone tells, does a document span rows and take the long way.
    """
    if not df.groupBy(id_col).count().filter("count > 1").isEmpty():
        return postings(script_fts_tokens(df, id_col, text_col, stopwords), id_col=id_col, weight=weight)
    words = F.regexp_extract_all(text_col, F.lit(f"({INDEXED})"), F.lit(1))
    if stopwords is not None:
        stops = [r.word for r in stopwords.select("word").distinct().collect()]
        words = F.filter(words, lambda w: ~w.isin(stops))
    rows = df.select(id_col, F.posexplode(words).alias("place", "token"))
    head = F.lower("token")  # numbers and Thai have no case
    return rows.select(id_col, cut_lexeme(head).alias("lexeme"), (F.col("place") + 1).cast("int").alias("pos"), F.lit(weight).alias("weight"), head.alias("head"))


def tsvector(df: DataFrame, lexicons: Lexicons, config: AnalyzerConfig | None = None, id_col: str = "doc_id", text_col: str = "text", weight: str = "D") -> DataFrame:
    config = config or AnalyzerConfig()
    return postings(fts_tokens(df, lexicons, config, id_col, text_col), config, id_col, weight)


def set_weight(index: DataFrame, weight: str) -> DataFrame:
    return index.withColumn("weight", F.lit(weight))


def concat(first: DataFrame, second: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Postings of both, the second's positions after the first's last."""
    last = first.groupBy(id_col).agg(F.max("pos").alias("_last"))
    moved = second.join(last, id_col, "left").withColumn("pos", (F.col("pos") + F.coalesce("_last", F.lit(0))).cast("int")).drop("_last")
    return first.unionByName(moved)


def write_index(index: DataFrame, table: str, buckets: int) -> None:
    """A table bucketed and sorted by lexeme, so queries read few row groups of few files."""
    index.write.bucketBy(buckets, "lexeme").sortBy("lexeme", "doc_id").saveAsTable(table)


# -- queries ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    lexeme: str


@dataclass(frozen=True)
class Op:
    """``and``, ``or``, ``not``, ``phrase`` (each part one place after the last)."""

    kind: str
    parts: tuple


#: A query without a term, which matches nothing.
NOTHING = Op("and", ())


def lexemes_of(query) -> list[str]:
    return [query.lexeme] if isinstance(query, Term) else sorted({x for p in query.parts for x in lexemes_of(p)})


def query_terms(text: str) -> list[str]:
    """Lexemes of a query's words by script: Latin lower-cased, punctuation dropped."""
    return [w.lower().encode()[:LONGEST].decode(errors="ignore") for w in re.findall(r"[A-Za-z]+|[0-9]+|[฀-๿]+|[^\sA-Za-z0-9฀-๿!-/:-@\[-`{-~]+", text)]


def query_analyzer(spark: SparkSession, lexicons: Lexicons, config: AnalyzerConfig | None = None) -> Callable[[str], list]:
    """For ``analyze``: a query's terms by the analysis that documents get, without stop words.

    Lexemes that one token gives stand at one place; in a query they are all required (postgres)
    or one of them is (sqlite). Each different text is analysed once, by a job over one row.
    """
    config, known = config or AnalyzerConfig(), {}
    kind = "and" if config.dialect == "postgres" else "or"

    def analyze(text: str) -> list:
        if text not in known:
            tokens = fts_tokens(spark.createDataFrame([(0, text)], "doc_id int, text string"), lexicons, config)
            places: dict[int, list[str]] = {}
            for r in sorted(postings(tokens, config, mode="query").select("pos", "lexeme").collect()):
                places.setdefault(r.pos, []).append(r.lexeme)
            known[text] = [x[0] if len(x) == 1 else Op(kind, tuple(Term(t) for t in x)) for x in places.values()]
        return known[text]

    return analyze


def _terms(text: str, analyze) -> tuple:
    return tuple(Term(t) if isinstance(t, str) else t for t in analyze(text))


def plainto_tsquery(text: str, analyze=query_terms):
    terms = _terms(text, analyze)
    return terms[0] if len(terms) == 1 else Op("and", tuple(terms))


def phraseto_tsquery(text: str, analyze=query_terms):
    terms = _terms(text, analyze)
    return terms[0] if len(terms) == 1 else Op("phrase", tuple(terms))


def websearch_to_tsquery(text: str, analyze=query_terms):
    """Words are ANDed, ``or`` between words ORs, ``-`` negates, quotes make a phrase."""
    either: list[list] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or" and not minus:
            either.append([])
            continue
        part = phraseto_tsquery(quoted, analyze) if quoted else plainto_tsquery(word, analyze)
        if isinstance(part, Op) and not part.parts:
            continue
        either[-1].append(Op("not", (part,)) if minus else part)
    ands = [x[0] if len(x) == 1 else Op("and", tuple(x)) for x in either if x]
    return ands[0] if len(ands) == 1 else Op("or" if ands else "and", tuple(ands))


def to_tsquery(text: str, analyze=query_terms):
    """``&``, ``|``, ``!``, ``<->`` and parentheses, binding as ! <-> & |."""
    tokens = re.findall(r"<->|[&|!()]|[^\s&|!()<]+", text)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def level(sign: str, kind: str, below):
        nonlocal at
        parts = [below()]
        while peek() == sign:
            at += 1
            parts.append(below())
        parts = [p for p in parts if p != NOTHING]  # stop words leave the query
        return NOTHING if not parts else parts[0] if len(parts) == 1 else Op(kind, tuple(parts))

    def atom():
        nonlocal at
        token = peek()
        if token is None or token in ("&", "|", ")", "<->"):
            raise ValueError(f"no operand at {at} of {text!r}")
        at += 1
        if token == "!":
            inner = atom()
            return inner if inner == NOTHING else Op("not", (inner,))
        if token == "(":
            inner = either()
            if peek() != ")":
                raise ValueError(f"unclosed parenthesis in {text!r}")
            at += 1
            return inner
        return plainto_tsquery(token, analyze)

    def either():
        return level("|", "or", lambda: level("&", "and", lambda: level("<->", "phrase", atom)))

    out = either()
    if at < len(tokens):
        raise ValueError(f"unexpected {tokens[at]!r} in {text!r}")
    return out


def raw_tsquery(lexeme: str) -> Term:
    """A lexeme as it stands in the index."""
    return Term(lexeme)


def matched(index: DataFrame, query, id_col: str = "doc_id", docs: DataFrame | None = None) -> DataFrame:
    """(id, places) of the documents that match; places maps the query's lexemes to positions.

    ``docs`` (ids) is needed where a document without any of the lexemes can match, as with a sole NOT.
    """
    names = lexemes_of(query) or [""]  # a query without lexemes matches what no lexeme decides
    kept = index.filter(F.col("lexeme").isin(names))
    places = kept.groupBy(id_col).agg(*[F.sort_array(F.collect_set(F.when(F.col("lexeme") == x, F.col("pos")))).alias(f"p{i}") for i, x in enumerate(names)])
    empty = F.array().cast("array<int>")
    if docs is not None:
        places = docs.select(id_col).join(places, id_col, "left").select(id_col, *[F.coalesce(f"p{i}", empty).alias(f"p{i}") for i in range(len(names))])
    column = {x: F.col(f"p{i}") for i, x in enumerate(names)}

    def ends(q) -> Column:
        """Places where a match of q ends."""
        if isinstance(q, Term):
            return column[q.lexeme]
        if q.kind == "phrase":
            return reduce(lambda a, p: F.filter(ends(p), lambda x: F.array_contains(a, x - 1)), q.parts[1:], ends(q.parts[0]))
        if q.kind == "and":  # lexemes of one token
            return reduce(F.array_intersect, [ends(p) for p in q.parts])
        if q.kind == "or":
            return reduce(F.array_union, [ends(p) for p in q.parts])
        raise ValueError(f"{q.kind} inside a phrase")

    def true(q) -> Column:
        if isinstance(q, Term) or q.kind == "phrase":
            return F.size(ends(q)) > 0
        if q.kind == "not":
            return ~true(q.parts[0])
        if not q.parts:
            return F.lit(False)
        return reduce(lambda a, b: a & b if q.kind == "and" else a | b, map(true, q.parts))

    found = places.filter(true(query))
    table = F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), F.col(f"p{i}"))])
    return found.select(id_col, table.alias("places"))


def has_phrase(query) -> bool:
    return isinstance(query, Op) and (query.kind == "phrase" or any(map(has_phrase, query.parts)))


def _held(names: list[str]) -> list[Column]:
    """If a document holds each lexeme, as aggregates."""
    return [F.max(F.col("lexeme") == x).alias(f"p{i}") for i, x in enumerate(names)]


def _true(query, names: list[str]) -> Column:
    """A query without phrases over the columns of ``_held``."""
    if isinstance(query, Term):
        return F.coalesce(f"p{names.index(query.lexeme)}", F.lit(False))
    if query.kind == "not":
        return ~_true(query.parts[0], names)
    return reduce(lambda a, b: a & b if query.kind == "and" else a | b, [_true(p, names) for p in query.parts]) if query.parts else F.lit(False)


def search(index: DataFrame, query, id_col: str = "doc_id", docs: DataFrame | None = None) -> DataFrame:
    """Ids of the documents that match; only phrases need places, else what each document holds is enough."""
    if has_phrase(query):
        return matched(index, query, id_col, docs).select(id_col)
    names = lexemes_of(query) or [""]
    found = index.filter(F.col("lexeme").isin(names)).groupBy(id_col).agg(*_held(names))
    if docs is not None:
        found = docs.select(id_col).join(found, id_col, "left")
    return found.filter(_true(query, names)).select(id_col)


def ts_rank(index: DataFrame, query, id_col: str = "doc_id", weights: dict[str, float] | None = None) -> DataFrame:
    """(id, rank) of matching documents: each lexeme gives the sum of its places' weights over the squares of their order, averaged over the query."""
    names, w = lexemes_of(query), weights or WEIGHTS
    value = F.coalesce(*[F.when(F.col("weight") == k, v) for k, v in w.items()], F.lit(w["D"]))
    order = Window.partitionBy(id_col, "lexeme").orderBy(F.desc("value"), "pos")
    kept = index.filter(F.col("lexeme").isin(names)).withColumn("value", value)
    rank = (F.sum(F.col("value") / (F.col("k") * F.col("k"))) / (1.64493406685 * max(1, len(names)))).alias("rank")
    ordered = kept.withColumn("k", F.row_number().over(order)).groupBy(id_col)
    if has_phrase(query):
        return ordered.agg(rank).join(search(index, query, id_col), id_col, "left_semi")
    return ordered.agg(rank, *_held(names)).filter(_true(query, names)).select(id_col, "rank")


def ts_rank_cd(index: DataFrame, query, id_col: str = "doc_id") -> DataFrame:
    """(id, rank): covers of neighbouring places of different lexemes, each by the inverse of its length."""
    names = lexemes_of(query)
    kept = index.filter(F.col("lexeme").isin(names)).select(id_col, "lexeme", "pos").distinct()
    order = Window.partitionBy(id_col).orderBy("pos", "lexeme")
    near = kept.withColumn("gap", F.when(F.lag("lexeme").over(order) != F.col("lexeme"), F.col("pos") - F.lag("pos").over(order) + 1))
    share = F.lit(0.1) * F.count("*") if len(names) < 2 else F.coalesce(F.sum(1.0 / F.greatest("gap", F.lit(1))), F.lit(0.0)) + F.lit(0.01) * F.count("*")
    return near.groupBy(id_col).agg(share.alias("rank")).join(search(index, query, id_col), id_col, "left_semi")


def ts_stat(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(lexeme, ndoc, nentry), by partial counts per document rather than distinct sets.

    Postings that come by document (of texts repartitioned by id) are counted where they are, without a shuffle of tokens.
    """
    each = index.groupBy("lexeme", id_col).agg(F.count("*").alias("n"))
    return each.groupBy("lexeme").agg(F.count(id_col).alias("ndoc"), F.sum("n").alias("nentry"))


def ts_headline(tokens: DataFrame, query, id_col: str = "doc_id", start: str = "<b>", stop: str = "</b>", order_col: str = "ord") -> DataFrame:
    """(id, headline): the whole document's tokens joined, those of the query marked, whatever their case. An operand that ends in ``*`` is a prefix.

    White space is in the headline only if it is among the tokens.
    """
    names = lexemes_of(query)
    word = F.lower("text")
    hit = reduce(lambda a, b: a | b, [word.startswith(x[:-1].lower()) if x.endswith("*") else word == x.lower() for x in names], F.lit(False))
    marked = tokens.select(id_col, F.struct(order_col, F.when(hit, F.concat(F.lit(start), F.col("text"), F.lit(stop))).otherwise(F.col("text")).alias("t")).alias("m"))
    return marked.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["t"]), "").alias("headline"))


def snippet(tokens: DataFrame, query, around: int = 8, id_col: str = "doc_id", start: str = "[", stop: str = "]", dots: str = "…", order_col: str = "ord") -> DataFrame:
    """(id, snippet): the tokens around the first hit, hits marked."""
    names = [x.lower() for x in lexemes_of(query)]
    rows = tokens.withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy(order_col))).withColumn("hit", F.lower("text").isin(names))
    rows = rows.withColumn("first", F.min(F.when(F.col("hit"), F.col("n"))).over(Window.partitionBy(id_col))).withColumn("last", F.max("n").over(Window.partitionBy(id_col)))
    near = rows.filter(F.abs(F.col("n") - F.col("first")) <= around)
    text = F.when(F.col("hit"), F.concat(F.lit(start), F.col("text"), F.lit(stop))).otherwise(F.col("text"))
    out = near.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda m: m["t"]), "").alias("s"), F.min("n").alias("a"), F.max("n").alias("b"), F.first("last").alias("last"))
    return out.select(id_col, F.concat(F.when(F.col("a") > 1, dots).otherwise(""), "s", F.when(F.col("b") < F.col("last"), dots).otherwise("")).alias("snippet"))
