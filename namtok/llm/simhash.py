"""Operator 2: near-duplicate documents by SimHash fingerprints and sharded BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namtok.llm.common import join_unique, materialize, slices, table
from namtok.llm.components import connected_components

#: Words in a shingle, seed of its XXH64, and differing bits at which fingerprints still link.
WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints that a shard should have on average, and that one tree holds at most.
SHARD, TREE = 256, 4096


def fingerprint(text: bytes | None) -> bytes:
    """The eight bytes of a text's fingerprint, most significant first; zero without a word."""
    words = (text or b"").lower().split()
    if not words:
        return bytes(8)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False)) if len(words) >= WORDS else [b" ".join(words)]
    hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text as a signed 64-bit integer."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = b"".join([fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(found, ">i8").astype(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(hashed, "id long, fp long")


def shard_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of which two fingerprints within the radius agree under at least one.

    64 bits in m blocks leave m - radius blocks without a difference, so each choice of that many
    blocks is a mask. m is the least that makes shards of n random fingerprints small.
    """
    for m in range(radius + 1, 17):
        edges = [64 * i // m for i in range(m + 1)]
        blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        masks = [sum(choice) for choice in combinations(blocks, m - radius)]
        if n <= SHARD << min(x.bit_count() for x in masks):
            break
    return masks


class BKTree:
    """Fingerprints by integer distance: a child's key is its Hamming distance to its parent.

    A union-find over the entries tells which links are needed to keep components whole.
    """

    def __init__(self, radius: int):
        self.radius, self.values, self.children, self.parent = radius, [], [], []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def near(self, value: int) -> list[int]:
        """Entries within the radius; only children whose distance can lead there are visited."""
        radius, values, children, found, stack = self.radius, self.values, self.children, [], [0] if self.values else []
        while stack:
            i = stack.pop()
            d = (values[i] ^ value).bit_count()
            if d <= radius:
                found.append(i)
            if own := children[i]:
                if len(own) > 2 * radius + 1:
                    stack += [own[k] for k in range(d - radius, d + radius + 1) if k in own]
                else:
                    stack += [j for k, j in own.items() if d - radius <= k <= d + radius]
        return found

    def join(self, value: int) -> Iterator[int]:
        """One near entry of each component, after which these are one component."""
        first = None
        for i in self.near(value):
            r = self.root(i)
            if first is None:
                first = r
            elif r != first:
                self.parent[r] = first
            else:
                continue
            yield i

    def insert(self, value: int) -> int:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        self.parent.append(new)
        i = 0 if new else None
        while i is not None:
            own, d = self.children[i], (self.values[i] ^ value).bit_count()
            i = own.get(d)
            if i is None:
                own[d] = new
        return new


def _shard_links(radius: int):
    """Over runs of rows (shard, value, member) with members first: links that span each component of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, None
        for batch in batches:
            links: list[tuple[int, int]] = []
            for own, fp, member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != shard:
                    shard, tree = own, BKTree(radius)
                value = fp % (1 << 64)
                near = list(tree.join(value))
                links += [(fp, tree.values[i]) for i in near]
                if member:
                    new = tree.insert(value)
                    if near:
                        tree.parent[new] = tree.root(near[0])
            b = np.array([x[1] for x in links], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array(b)], ["a", "b"])

    return run


def links(values: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that give the components of all pairs within the radius.

    Each fingerprint goes to the shard of every mask. A shard with more than TREE entries becomes
    several trees; its fingerprints then also query the trees after their own. Shards stream
    through the workers: a task holds one tree at a time and sends out a spanning forest, not all
    pairs.
    """
    masks = shard_masks(n, radius)
    signed = [x - (1 << 64) if x >> 63 else x for x in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(x)).alias("part")) for i, x in enumerate(signed)])
    rows = values.select("fp", F.inline(keys))
    sizes = rows.groupBy("mask", "part").agg(F.count("*").alias("size")).filter("size > 1")
    rows = rows.join(sizes, ["mask", "part"]).withColumn("trees", F.ceil(F.col("size") / TREE).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    rows = rows.select("mask", "part", "fp", "own", F.explode(F.sequence("own", F.col("trees") - 1)).alias("tree"))
    rows = rows.select(F.xxhash64("mask", "part", "tree").alias("shard"), "mask", "part", "tree", "fp", (F.col("own") == F.col("tree")).alias("member"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "mask", "part", "tree", F.desc("member"), "fp")
    rows = rows.select(F.struct("mask", "part", "tree").cast("string").alias("shard"), "fp", "member")
    return rows.mapInArrow(_shard_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hex digits) and ``component_id``, the least id reachable by links.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id take
    part and get the component of their fingerprint (null if no row in it has an id). Equal
    fingerprints are one node, so copies cost nothing; repeated rows each give a row. Other
    columns are ignored. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    n, total = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    labels = connected_components(links(nodes.select("fp"), n, radius), "simhash-links")
    nodes = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    found = materialize(nodes.join(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "n"), "simhash-components")
    out = join_unique(prints, found, "fp", "n", total)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
