"""Near duplicates by a least similarity of word shingles: SimHash candidates from BK-trees, verified.

A document's shingles are the distinct runs of WORDS lower-cased words. Its fingerprint has BITS bits,
each set if it is set in over half of the shingles' hashes, so the angle between two documents'
sets shows in the share of bits that differ. Fingerprints are dealt to shards by tables of chosen
bits, as many of them as the number of fingerprints asks for, and as many tables as make two
documents of just the least similarity meet with a probability of about MEET (``layout``); more
similar ones meet more surely. Each shard is a BK-tree whose edges carry Hamming distances, followed within the radius, in two rounds:

1. Every fingerprint is linked to its nearest entry in each tree. The links are verified by the exact
   Jaccard similarity of the shingles: first each document's nearest one, then all that still lie
   between different components. This joins most of what belongs together with few links.
2. The fingerprints that have a neighbour go through the trees again with their component. Those that
   have a partner within the radius in another component meet once more, with their shingles, and
   every such pair is verified where it stands, unless its components have been joined before. So no
   candidate is dropped, and only links that join components come out. What is missed is what no
   table brings together. Comparisons, not rows, grow with the square of a group whose documents are
   within the radius of each other without being similar.

Sets of shingles are hashes of 32 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namtok.llm.common import drop, materialize, slices
from namtok.llm.components import connected_components

WORDS, SIMILARITY, BITS, MEET = 5, 0.8, 256, 0.98
#: Entries that a leaf of a tree holds before it gets children, and unlike fingerprints that a shard should have.
LEAF, SHARD = 128, 16


def differing(similarity: float) -> float:
    """Share of bits in which the fingerprints of two sets of this Jaccard similarity are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(similarity: float) -> int:
    """Bits in which two fingerprints of this similarity differ at most, but for some in a hundred."""
    q = differing(similarity)
    return math.ceil(BITS * q + 2.5 * math.sqrt(BITS * q * (1 - q)))


def layout(n: int, similarity: float) -> np.ndarray:
    """The bits that each table takes, for n fingerprints: shards of SHARD unlike ones, and as many tables as MEET asks for.

    The bits in which two fingerprints differ are taken as binomial: tables for their mean alone would miss those of more.
    """
    bits = min(40, max(4, math.ceil(math.log2((n + 1) / SHARD))))
    q, away = differing(similarity), np.arange(radius(similarity) + 1)
    share = np.array([math.comb(BITS, k) * q**k * (1 - q) ** (BITS - k) for k in away.tolist()])
    share, alone = share / share.sum(), 1 - (1 - away / BITS) ** bits
    tables = 1
    while share @ alone**tables > 1 - MEET:
        tables += 1
    rng = np.random.default_rng(2)
    return np.array([np.sort(rng.choice(BITS, bits, replace=False)) for _ in range(tables)])


def sketch(text: bytes, words: int = WORDS) -> tuple[bytes, bytes]:
    """(fingerprint, sorted 32-bit hashes of the distinct shingles); of fewer words, the whole sequence is one; of none, nothing."""
    own = text.lower().split()
    if not own:
        return bytes(BITS // 8), b""
    found = {*map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False))} if len(own) >= words else {b" ".join(own)}
    hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s, seed) for s in found for seed in range(BITS // 128)]), np.uint8).reshape(-1, BITS // 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes(), np.unique(np.ascontiguousarray(hashes[:, :4]).view("<u4").ravel()).tobytes()


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


class Tree:
    """A BK-tree: children are keyed by their distance to their parent's pivot; small leaves are compared as arrays."""

    def __init__(self, values: np.ndarray):
        """``values``: the shard's fingerprints, some unsigned 64-bit integers each."""
        self.values = values
        self.top = [None, None, []]  # pivot, children by distance, entries of a leaf
        for i in range(len(values)):
            self.insert(i)

    def distances(self, i: int, others: list[int]) -> np.ndarray:
        return np.bitwise_count(self.values[others] ^ self.values[i]).sum(axis=1, dtype=np.int64)

    def insert(self, i: int) -> None:
        node = self.top
        while node[1] is not None:
            node = node[1].setdefault(int(self.distances(i, [node[0]])[0]), [None, None, []])
        node[2].append(i)
        if len(node[2]) > LEAF:
            pivot, rest = node[2][0], node[2][1:]
            away = self.distances(pivot, rest).tolist()
            if max(away) > min(away):
                children: dict[int, list] = {0: [None, None, [pivot]]}
                for d, j in zip(away, rest, strict=True):
                    children.setdefault(d, [None, None, []])[2].append(j)
                node[:] = [pivot, children, []]

    def nearest(self, i: int, within: int) -> int | None:
        """The nearest other entry within the radius, of equally near ones the first."""
        best, stack = (within + 1, -1), [(0, self.top)]
        while stack:
            least, (pivot, children, leaf) = stack.pop()
            if least > best[0]:
                continue
            if children is not None:
                d = int(self.distances(i, [pivot])[0])
                stack += sorted(((abs(d - k), c) for k, c in children.items() if abs(d - k) <= best[0]), key=lambda x: -x[0])
            elif leaf:
                away = self.distances(i, leaf)
                for at in np.flatnonzero(away <= min(best[0], within)).tolist():
                    if leaf[at] != i:
                        best = min(best, (int(away[at]), leaf[at]))
        return best[1] if best[1] >= 0 else None

    def near(self, i: int, within: int) -> list[int]:
        """All entries within the radius."""
        stack, found = [self.top], []
        while stack:
            pivot, children, leaf = stack.pop()
            if children is not None:
                d = int(self.distances(i, [pivot])[0])
                stack += [c for k, c in children.items() if d - within <= k <= d + within]
            elif leaf:
                found += [leaf[at] for at in np.flatnonzero(self.distances(i, leaf) <= within).tolist()]
        return found


def _distances(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values[:, None] ^ values).sum(axis=2, dtype=np.int64)


def nearest_links(values: np.ndarray, roots: np.ndarray, within: int) -> list[tuple[int, int]]:
    """Each entry of a shard and its nearest one, if there is any within the radius."""
    if len(values) <= LEAF:  # a tree of one leaf
        away = _distances(values)
        np.fill_diagonal(away, BITS + 1)
        first = away.argmin(axis=1)
        found = np.flatnonzero(away[np.arange(len(values)), first] <= within)
        return list(zip(found.tolist(), first[found].tolist(), strict=True))
    tree = Tree(values)
    return [(i, j) for i in range(len(values)) if (j := tree.nearest(i, within)) is not None]


def cross_links(values: np.ndarray, roots: np.ndarray, within: int) -> Iterator[tuple[int, np.ndarray]]:
    """All pairs of a shard's entries within the radius that have different roots, each once: an entry and its partners."""
    names, own, count = np.unique(roots, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return
    if len(values) <= LEAF:
        pairs = np.tril((_distances(values) <= within) & (own[:, None] != own))
        yield from ((i, np.flatnonzero(pairs[i])) for i in np.flatnonzero(pairs.any(axis=1)).tolist())
        return
    tree, most = Tree(values), int(np.argmax(count))
    for i in np.flatnonzero(own != most).tolist():  # entries of the largest component needn't ask: the others meet them
        near = np.array(sorted(tree.near(i, within)), np.int64)
        near = near[(own[near] == most) | (own[near] != own[i]) & (near < i)]
        if len(near):
            yield i, near


def _masks(tables: np.ndarray) -> np.ndarray:
    """The bits of each table, laid out as fingerprints are."""
    bits = np.zeros((len(tables), BITS), np.uint8)
    np.put_along_axis(bits, tables, 1, axis=1)
    return np.packbits(bits, axis=1).view(np.uint64)


def fresh(values: np.ndarray, i: int, near: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Of an entry's partners those that none of these (earlier) tables brings together with it."""
    out = []
    for at in range(0, len(near), 1024):
        own = near[at : at + 1024]
        away = values[own] ^ values[i]
        out.append(own[~((away[:, None, :] & masks) == 0).all(axis=2).any(axis=1)])
    return np.concatenate(out)


def _keys(tables: np.ndarray):
    """Rows (print, root) to rows (shard, print, root), one for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.int64(1) << np.arange(tables.shape[1], dtype=np.int64)
        for batch in slices(batches, 5000):
            own = batch.column(0).to_pylist()
            bits = np.unpackbits(np.frombuffer(b"".join(own), np.uint8).reshape(len(own), -1), axis=1)
            for t, chosen in enumerate(tables):
                yield pa.RecordBatch.from_arrays([pa.array((bits[:, chosen] @ weights) | np.int64(t << 40)), batch.column(0), batch.column(1)], ["shard", "print", "root"])

    return run


def _values(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, list]]:
    """(shard, prints, roots, last column) of each shard with two entries or more, of rows (shard, print, root, …) in order of shard."""
    held: list[tuple[np.ndarray, list, np.ndarray, list]] = []

    def whole(last: bool) -> Iterator[tuple[int, list, np.ndarray, list]]:
        shard, roots = (np.concatenate([x[k] for x in held]) for k in (0, 2))
        prints, more = ([p for x in held for p in x[k]] for k in (1, 3))
        held.clear()
        edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])).tolist()
        if not last:  # the last shard may go on
            at = edges[-2]
            held.append((shard[at:], prints[at:], roots[at:], more[at:]))
            edges.pop()
        for a, b in pairwise(edges):
            if b - a > 1:
                yield int(shard[a]), prints[a:b], roots[a:b], more[a:b]

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_pylist() if batch.num_columns > 3 else []))
            if held[0][0][0] != held[-1][0][-1]:
                yield from whole(False)
    if held:
        yield from whole(True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    while own := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*own, strict=True), schema, strict=True)], schema=schema)


def _links(within: int):
    """Rows (shard, print, root) in order of shard to links (a, b, distance) of each entry and its nearest one."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("distance", pa.int32())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, prints, roots, _ in _shards(batches):
            values = _values(prints)
            pairs = np.unique(np.sort(np.array(nearest_links(values, roots, within), np.int64).reshape(-1, 2), axis=1), axis=0)
            away = np.bitwise_count(values[pairs[:, 0]] ^ values[pairs[:, 1]]).sum(axis=1, dtype=np.int64)
            yield from ((prints[i], prints[j], d) for (i, j), d in zip(pairs.tolist(), away.tolist(), strict=True))

    return lambda batches: _batched(found(batches), schema)


def _meeting(within: int, masks: np.ndarray):
    """Rows (shard, print, root) in order of shard to those of entries that have a partner in another component, in the first shard that a pair shares."""
    schema = pa.schema([("shard", pa.int64()), ("print", pa.binary()), ("root", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for shard, prints, roots, _ in _shards(batches):
            values, kept = _values(prints), np.zeros(len(prints), bool)
            for i, near in cross_links(values, roots, within):
                near = fresh(values, i, near, masks[: shard >> 40])
                kept[near] = True
                kept[i] |= len(near) > 0
            yield from ((shard, prints[i], int(roots[i])) for i in np.flatnonzero(kept).tolist())

    return lambda batches: _batched(found(batches), schema)


def _settle(within: int, masks: np.ndarray, similarity: float):
    """Rows (shard, print, root, shingles) in order of shard to the verified links (a, b) that join components."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for shard, prints, roots, sets in _shards(batches):
            values, parent = _values(prints), {r: r for r in roots.tolist()}

            def root(r: int, parent=parent) -> int:
                while parent[r] != r:
                    parent[r] = parent[parent[r]]
                    r = parent[r]
                return r

            for i, near in cross_links(values, roots, within):
                for j in fresh(values, i, near, masks[: shard >> 40]).tolist():
                    a, b = root(int(roots[i])), root(int(roots[j]))
                    if a != b and jaccard(sets[i], sets[j]) >= similarity - 1e-9:
                        parent[a] = b
                        yield prints[i], prints[j]

    return lambda batches: _batched(found(batches), schema)


def _verify(similarity: float):
    """Rows (a, b, x, y) to the links of which the sets x and y are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = zip(*(batch.column(k).to_pylist() for k in (2, 3)), strict=True)
            good = pa.array([jaccard(x, y) >= similarity - 1e-9 for x, y in own], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    return run


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, text_hash, first): the rows' distinct ids and texts (xxhash64) and if each is the first of its group.

    A group is joined by links between documents whose sets of shingles have at least the least
    similarity; the first is that with the least id (null last), then hash. Null and empty texts
    are a group. Texts are taken whole whatever their length. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            prints, sets = zip(*(sketch(t, words) for t in batch.column(2).to_pylist()), strict=True)
            new = [None if p in seen else (seen.add(p), s)[1] for p, s in zip(prints, sets, strict=True)]  # a task sends a set once
            if len(seen) > 1 << 20:
                seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(new, pa.binary())], ["id", "text_hash", "print", "shingles"])

    prints = materialize(rows.mapInArrow(sketched, "id long, text_hash long, print binary, shingles binary"), "similar-prints")
    nodes = prints.groupBy("print").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash")).alias("least"))
    nodes = materialize(nodes.withColumn("node", F.xxhash64("print")), "similar-nodes")
    tables = layout(nodes.count(), similarity)

    within, masks = radius(similarity), _masks(tables)

    def dealt(members: DataFrame) -> DataFrame:
        """Rows (print, root) by shard."""
        return members.mapInArrow(_keys(tables), "shard long, print binary, root long").repartition("shard").sortWithinPartitions("shard", "print")

    near = dealt(nodes.select("print", F.col("node").alias("root"))).mapInArrow(_links(within), "a binary, b binary, distance int")
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").distinct()
    near = materialize(near, "similar-links")

    linked = materialize(near.select(F.col("a").alias("print")).unionAll(near.select("b")).distinct(), "similar-linked")
    sets = materialize(prints.filter("shingles is not null").join(linked, "print", "left_semi").select("print", "shingles").dropDuplicates(["print"]), "similar-sets")

    def verified(links: DataFrame) -> DataFrame:
        full = links.select("a", "b").join(sets.select(F.col("print").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("print").alias("b"), F.col("shingles").alias("y")), "b")
        good = full.select("a", "b", "x", "y").mapInArrow(_verify(similarity), "a binary, b binary")
        return good.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))

    both = near.unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    nearest = both.groupBy("a").agg(F.min_by("b", F.struct("distance", "b")).alias("b"))
    first = materialize(verified(nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "similar-nearest")
    labels = connected_components(first, "similar-near-groups")
    root = lambda side: F.coalesce(f"{side}_root", F.xxhash64(side))
    apart = near
    for side in "ab":
        own = labels.select(F.col("node").alias(f"{side}_node"), F.col("root").alias(f"{side}_root"))
        apart = apart.join(own, F.xxhash64(side) == F.col(f"{side}_node"), "left")
    second = materialize(first.unionAll(verified(apart.filter(root("a") != root("b")))), "similar-joined")
    labels = connected_components(second, "similar-joined-groups")
    rooted = linked.withColumn("node", F.xxhash64("print")).join(labels, "node", "left").select("print", F.coalesce("root", "node").alias("root"))
    meeting = materialize(dealt(rooted).mapInArrow(_meeting(within, masks), "shard long, print binary, root long"), "similar-meeting")
    full = meeting.join(sets, "print").select("shard", "print", "root", "shingles").repartition("shard").sortWithinPartitions("shard", "print")
    rest = full.mapInArrow(_settle(within, masks, similarity), "a binary, b binary").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    labels = connected_components(second.unionAll(rest), "similar-groups")
    named = nodes.join(labels, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    firsts = materialize(named.groupBy("root").agg(F.min("least").alias("least")).select("least.*"), "similar-firsts")
    drop(sets)
    return prints.select("id", "text_hash").distinct().join(firsts.select(F.coalesce("id", F.lit(0)).alias("i"), "unnamed", F.col("text_hash").alias("t")), (F.coalesce("id", F.lit(0)) == F.col("i")) & (F.col("id").isNull() == F.col("unnamed")) & (F.col("text_hash") == F.col("t")), "left").select("id", "text_hash", F.col("t").isNotNull().alias("first"))
