"""Connected components of links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namtok.llm.common import drop, materialize


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (u, v) with u > v.

    The minimum of a node's neighbours is aggregated (partially before the shuffle) and joined to
    its links, so no task ever holds the neighbours of a node; a hot node's links are split by
    the adaptive skew join.
    """
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionAll(least.select("u", F.col("m").alias("v")))
    return small.distinct()


def connected_components(links: DataFrame, label: str) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b) but the roots themselves; a root is its component's least node.

    Repeats star steps until nothing changes, which takes about the logarithm of a component's
    diameter; each step's links are a table in the shared folder.
    """
    state = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    state, before = materialize(state, label), None
    while True:
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.xxhash64("v", "u") % 1000003).cast("long"))).first()
        if now == before or not now[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, last, before = materialize(_stars(state), label), state, now
        drop(last)
