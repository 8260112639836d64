"""Accuracy of boundaries against gold spans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namtok.operators.segmentation import broadcast_words, segmenter
from namtok.operators.words import slices
from namtok.sources.lexicons import Lexicons


def boundary_scores(gold: DataFrame, system: DataFrame, group: str | None = None, keys: tuple[str, ...] = ("doc_id", "char_start", "char_end")) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 by ``group`` and in all (null). Empty denominators give 1; f1 is 0 if both are 0."""
    keep = [*keys, *([group] if group else [])]
    both = gold.select(*keep).distinct().withColumn("_gold", F.lit(1)).join(system.select(*keep).distinct().withColumn("_system", F.lit(1)), list(keep), "full")
    counts = [F.count_if(F.col("_gold").isNotNull() & F.col("_system").isNotNull()).alias("tp"), F.count_if(F.col("_gold").isNull()).alias("fp"), F.count_if(F.col("_system").isNull()).alias("fn")]
    return _scored((both.rollup(group) if group else both.groupBy()).agg(*counts))


def _scored(rows: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    rows = rows.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    total = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total))


def gold_spans(cases: DataFrame, id_col: str = "case_id", gold_col: str = "gold", input_col: str = "input") -> DataFrame:
    """(id, char_start, char_end) of gold tokens, each found in the input from where the last one ended."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(s, token):
        at = F.position(token, F.col(input_col), s["at"])
        return F.when(at == 0, s).otherwise(F.struct((at + F.length(token)).alias("at"), F.concat(s["out"], F.array(F.struct((at - 1).alias("a"), (at - 1 + F.length(token)).alias("b")))).alias("out")))

    spans = cases.select(id_col, F.explode(F.aggregate(gold_col, start, step)["out"]).alias("s"))
    return spans.select(id_col, F.col("s.a").alias("char_start"), F.col("s.b").alias("char_end"))


def case_scores(cases: DataFrame, lexicons: Lexicons, gold_col: str = "gold", input_col: str = "input") -> DataFrame:
    """``boundary_scores`` of segmenting each input, whose spans are compared with its gold tokens' in the row: no span is shuffled."""
    known = broadcast_words(lexicons)

    def compare(batches):
        cut = segmenter(known.value)
        for batch in slices(batches):
            tp = fp = fn = 0
            for gold, text in zip(*[batch.column(k).to_pylist() for k in (0, 1)], strict=True):
                wanted, found, at, char = set(), set(), 0, 0
                for token in gold or () if text is not None else ():
                    start = text.find(token, at)
                    if start >= 0:
                        at = start + len(token)
                        wanted.add((start, at))
                for run in cut(text) if text else ():
                    for word, kind, _ in run:
                        if kind != "Whitespace":
                            found.add((char, char + len(word)))
                        char += len(word)
                both = len(wanted & found)
                tp, fp, fn = tp + both, fp + len(found) - both, fn + len(wanted) - both
            yield pa.RecordBatch.from_pydict({"tp": [tp], "fp": [fp], "fn": [fn]})

    counts = cases.select(gold_col, input_col).mapInArrow(compare, "tp bigint, fp bigint, fn bigint")
    return _scored(counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))
