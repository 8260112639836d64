"""Operator 3: benchmark decontamination by a BM25 index of the test items and block-max WAND.

Terms are lower-cased runs of ``\\w``. A document is cut into passages of twice as many words as the
longest item has, each beginning half a passage after the last, so that any copy of an item lies
whole in one. Every passage queries the index for all items above their thresholds, and each hit
is verified: a document is contaminated by an item of which a passage holds ``overlap`` (0.8) of
the distinct five-word shingles, question and answer together; the shares of the question's and
of the answer's (the last sentence's) shingles are reported beside it.

An item's threshold is its own BM25 score less its m largest term scores, where m is the number
of shingles that may be missing. A passage that lacks m shingles at most lacks m terms at most
(a word missing inside the item loses five shingles, one at its ends at least one of its own), so
no passage that verification would accept scores lower: retrieval is exact.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namtok.llm.common import slices, table

SHINGLE, OVERLAP = 5, 0.8
#: BM25 constants, items in a block of a posting list, and bytes of item text in one broadcast index.
K1, B, BLOCK, INDEX_BYTES = 1.2, 0.75, 16, 16 << 20
#: Share of an item's threshold that its listed terms must reach at least.
LEFT = 0.4
WORD = r"\w+"
MATCHES = "array<struct<item_id:bigint,overlap:double,question_overlap:double,answer_overlap:double>>"


def words(text: str | None) -> list[str]:
    return re.findall(WORD, (text or "").lower())


def shingles(ids: list[int], size: int = SHINGLE) -> set[tuple[int, ...]]:
    """Distinct shingles; of fewer words, the whole sequence; of none, nothing."""
    size = min(size, len(ids))
    return set(zip(*(ids[i:] for i in range(size)), strict=False)) if size else set()


def question_and_answer(text: str | None) -> tuple[str, str]:
    """The text before its last sentence or line, and that; a single sentence is all question."""
    text = (text or "").strip()
    cut = max((m.end() for m in re.finditer(r"[.!?]\s+|\n", text)), default=0)
    return (text[:cut], text[cut:]) if cut else (text, "")


class Index:
    """Posting lists in blocks with their largest weight; weights are shares of the item's threshold.

    The commonest terms get no list, as long as each item must still score a LEFT of its threshold
    with its other terms; the lists' weights are shares of what is left of it.
    """

    def __init__(self, items: list[tuple[int, str | None]], longest: int, overlap: float = OVERLAP):
        self.overlap, self.stride = overlap, max(longest, SHINGLE)
        self.terms: dict[str, int] = {}
        self.items, tokens = [], []
        for item_id, text in items:
            parts = [[self.terms.setdefault(w, len(self.terms)) for w in words(t)] for t in (text, *question_and_answer(text))]
            if parts[0]:
                tokens.append(parts[0])
                self.items.append((item_id, min(SHINGLE, len(parts[0])), *(shingles(p) for p in parts)))
        held = [set(t) for t in tokens]
        df = np.zeros(len(self.terms))
        for terms in held:
            df[list(terms)] += 1
        idf = np.log1p((len(tokens) - df + 0.5) / (df + 0.5))
        mean = sum(map(len, tokens)) / max(1, len(tokens))
        self.weights: list[dict[int, float]] = []
        for i, (own, terms) in enumerate(zip(tokens, held, strict=True)):
            norm = K1 * (1 - B + B * len(own) / mean)
            weight = {t: idf[t] * own.count(t) * (K1 + 1) / (own.count(t) + norm) for t in sorted(terms)}
            distinct = len(self.items[i][2])
            missing = distinct - math.ceil(overlap * distinct - 1e-9)
            least = sorted(weight.values())
            threshold = max(sum(least[: max(0, len(least) - missing)]), least[0])
            self.weights.append({t: w / threshold for t, w in weight.items()})
        items_of: list[list[int]] = [[] for _ in self.terms]
        for i, weight in enumerate(self.weights):
            for t in weight:
                items_of[t].append(i)
        common, left = set(), [1.0] * len(tokens)  # what an item's other terms must score
        for t in np.argsort(-df, kind="stable").tolist():
            if all(left[i] - self.weights[i][t] >= LEFT for i in items_of[t]):
                common.add(t)
                for i in items_of[t]:
                    left[i] -= self.weights[i][t]
        shares = [[] if t in common else [(i, self.weights[i][t] / left[i]) for i in own] for t, own in enumerate(items_of)]
        self.postings = [([i for i, _ in p], [w for _, w in p], [max(w for _, w in p[k : k + BLOCK]) for k in range(0, len(p), BLOCK)]) for p in shares]
        self.bounds = np.array([max(x[2], default=0.0) for x in self.postings] + [0.0])  # the last is for words of no item

    def retrieve(self, terms: set[int]) -> list[int]:
        """All items that score 1 or more for these terms: WAND with block maxima over the lists of the rarer ones, then full scores."""
        least, end = 1 - 1e-9, len(self.items)
        cursors = [[self.postings[t][0][0], 0, t] for t in terms if self.postings[t][0]]
        found = []
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.bounds[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0 or (item := cursors[pivot][0]) >= end:
                return found
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            for c in cursors[: pivot + 1]:  # to the pivot, by whole blocks first
                own, at = self.postings[c[2]][0], c[1]
                while at < len(own) and own[min(at | (BLOCK - 1), len(own) - 1)] < item:
                    at = (at | (BLOCK - 1)) + 1
                while at < len(own) and own[at] < item:
                    at += 1
                c[:2] = own[at] if at < len(own) else end, at
            on = [c for c in cursors[: pivot + 1] if c[0] == item]
            past = item + 1
            if sum(self.postings[t][2][at // BLOCK] for _, at, t in on) < least:  # so no item of these blocks alone can score enough
                ends = [self.postings[t][0][min(at | (BLOCK - 1), len(self.postings[t][0]) - 1)] + 1 for _, at, t in on]
                past = min(ends + [c[0] for c in cursors if c[0] != item])
            elif sum(self.postings[t][1][at] for _, at, t in on) >= least:
                if sum(w for t, w in self.weights[item].items() if t in terms) >= least:
                    found.append(item)
            for c in on:
                own, at = self.postings[c[2]][0], c[1] + 1
                while at < len(own) and own[at] < past:
                    at += 1
                c[:2] = own[at] if at < len(own) else end, at

    def matches(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item id, overlap, of the question, of the answer) of the items that contaminate a text, each by its best passage."""
        ids = np.fromiter(map(self.terms.get, words(text), _absent()), np.int64)
        if not len(ids) or not self.items:
            return []
        known = np.flatnonzero(ids >= 0)
        halves = -(-len(ids) // self.stride)
        each = np.unique(known // self.stride * len(self.bounds) + ids[known])  # a term counts once in a half passage
        bound = np.bincount(each // len(self.bounds), self.bounds[each % len(self.bounds)], halves + 1)
        starts = np.arange(0, max(len(ids) - self.stride, 1), self.stride)
        best: dict[int, tuple[float, float, float]] = {}
        for k in np.flatnonzero((bound[:-1] + bound[1:])[: len(starts)] >= 1 - 1e-6):
            own = ids[starts[k] : starts[k] + 2 * self.stride].tolist()
            sets: dict[int, set] = {}
            for i in self.retrieve({t for t in own if t >= 0}):
                item_id, size, *parts = self.items[i]
                if size not in sets:
                    sets[size] = shingles(own, size) if len(own) >= size else set()
                share = [len(p & sets[size]) / len(p) if p else 0.0 for p in parts]
                if share[0] >= self.overlap - 1e-9:
                    best[item_id] = max(best.get(item_id, (0.0, 0.0, 0.0)), tuple(share))
        return sorted(((i, *share) for i, share in best.items()), key=lambda x: _by_id(x[0]))


def _by_id(item_id: int | None) -> tuple[bool, int]:
    return item_id is None, item_id or 0


def _merged(matches: list[dict]) -> list[dict]:
    """The best match of each item id, by id, null last."""
    best = {}
    for m in sorted(matches, key=lambda m: (m["overlap"], m["question_overlap"], m["answer_overlap"])):
        best[m["item_id"]] = m
    return [best[i] for i in sorted(best, key=_by_id)]


def _absent() -> Iterator[int]:
    while True:
        yield -1


def longest_item(benchmark: DataFrame, text_col: str = "text") -> int:
    """Words in the longest item, counted by the workers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(words(t)) for t in batch.column(0).to_pylist()], pa.int64())})

    return benchmark.select(F.col(text_col).cast("string")).mapInArrow(count, "n long").agg(F.max("n")).first()[0] or 0


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", overlap: float = OVERLAP) -> DataFrame:
    """The input's columns but a clashing one, and ``matches``: the items that contaminate each row, by item id.

    The benchmark's size is checked: item texts of more than INDEX_BYTES are dealt by id and
    text into several indexes, repeated items once, and every document meets each in turn, in the
    same stage and without a shuffle. Texts of any length are read whole. Null and empty texts have no match, items without a word match nothing, an empty
    benchmark leaves every ``matches`` empty, and repeated rows or items each count (a repeated
    item id gives its best match).
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    shards, longest = max(1, math.ceil(size / INDEX_BYTES)), longest_item(items, "t")
    out = docs.drop("matches").withColumn("matches", F.lit(None).cast(MATCHES))
    at = out.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for shard in range(shards):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == shard).collect()
        shared = docs.sparkSession.sparkContext.broadcast(Index([(r.i, r.t) for r in rows], longest, overlap))

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in slices(batches):
                old = batch.column(batch.num_columns - 1)
                names = ("item_id", "overlap", "question_overlap", "answer_overlap")
                found = [_merged((m or []) + [dict(zip(names, x, strict=True)) for x in index.matches(t)]) for m, t in zip(old.to_pylist(), batch.column(at).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, old.type)], batch.schema.names)

        out = out.mapInArrow(match, schema)
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    best = F.coalesce(F.array_max("matches.overlap"), F.lit(0.0))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.col("matches.item_id").alias("item_ids"), F.round(best, 6).alias("overlap"))


OP3_SQL = """
WITH items AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark),
l AS (SELECT max(len(w)) AS stride FROM items),
docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents),
si AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM items)),
n AS (SELECT item_id, count(*) AS total FROM si GROUP BY item_id),
sd AS (SELECT doc_id, p - 1 AS p, len(w) AS len, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM docs)),
hit AS (SELECT doc_id, item_id, p, len, s FROM sd JOIN si USING (s)),
own AS (SELECT doc_id, item_id, s, p, len, stride, unnest([p // stride, p // stride - 1]) AS k FROM hit, l),
passage AS (SELECT doc_id, item_id, k, count(DISTINCT s) AS held FROM own
  WHERE k >= 0 AND k * stride < greatest(len - stride, 1) AND p + 5 <= (k + 2) * stride GROUP BY ALL),
match AS (SELECT doc_id, item_id, max(held / total) AS overlap FROM passage JOIN n USING (item_id) WHERE held >= 0.8 * total - 1e-9 GROUP BY ALL)
SELECT d.doc_id, count(m.item_id) > 0 AS contaminated, coalesce(list(m.item_id ORDER BY m.item_id) FILTER (WHERE m.item_id IS NOT NULL), []) AS item_ids,
  round(coalesce(max(m.overlap), 0), 6)::DOUBLE AS overlap
FROM documents d LEFT JOIN match m USING (doc_id) GROUP BY d.doc_id
"""
