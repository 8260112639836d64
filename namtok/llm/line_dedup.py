"""Operator 6: near-duplicate lines by a segment-partition edit join.

Lines are taken without the white space around them; empty ones don't count. They are ordered by
their first place in the corpus (document id, null last, then line number). All places of a line
but its first are removed, and its first too if an earlier line lies within ``edits`` (2) edits of
it. Lines of fewer than LEAST characters, of which two edits would change too much, have to be equal.

Of two lines within ``edits`` edits, the shorter, cut into edits + 1 segments, has one that lies
unchanged in the other, and close to its own place. So every line sends the hash of (length,
segment number, segment) for its own segments and of the few substrings that could equal a
segment of a line of its length or up to two less. Hashes meet in packed arrays, one for each
task and bucket, not as rows; only lines that share a hash with another line are joined to their
texts and verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namtok.llm.common import drop, join_unique, materialize, shuffle_partitions, slices, table

EDITS, LEAST = 2, 20
#: White space that is cut off both ends of a line.
SPACE = " \t\r\x0b\x0c"
#: Lines that one verification holds; larger groups become blocks that meet in pairs.
BLOCK = 1000
#: Distinct lines that a task gathers before it sends them on, and their characters.
GATHER, CHARACTERS = 100_000, 1 << 25
#: Characters that are hashed at once, and those of a line that is hashed by slices instead.
CHUNK, LONG = 1 << 19, 1 << 15
BASE = 0x9E3779B97F4A7C15


def segments(n: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, length) of a line's segments, of lengths that differ by one at most."""
    short, longer = divmod(n, edits + 1)
    lengths = [short + (i > edits - longer) for i in range(edits + 1)]
    return [(sum(lengths[:i]), length) for i, length in enumerate(lengths)]


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE modulo 2^64 and of its inverse."""
    steps = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        factors = np.full(CHUNK + LONG + 1, base, np.uint64)
        factors[0] = 1
        steps.append(np.cumprod(factors, dtype=np.uint64))
    return steps[0], steps[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)


def _places(n: np.ndarray, edits: int) -> Iterator[tuple[int, np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(side, length, segment, place, size, if it counts) of what lines of these lengths send: 1 own segments, 0 substrings."""
    for more in range(edits + 1):
        length = n - more
        short, longer = length // (edits + 1), length % (edits + 1)
        for i in range(edits + 1):
            size = short + (i > edits - longer)
            p = i * short + np.maximum(0, i - (edits + 1 - longer))
            if not more:
                yield 1, length, i, p, size, n > 0
            low = np.maximum(0, np.maximum(p - i, p + more - (edits - i)))
            high = np.minimum(n - size, np.minimum(p + i, p + more + (edits - i)))
            for shift in range(2 * edits + 1):
                yield 0, length, i, low + shift, size, (low + shift <= high) & (length > edits)


def keys(lines: list[str], edits: int = EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, line's number, side) of the lines' own segments (1) and of their substrings (0) that can be a segment of a line no longer."""
    n = np.array([len(x) for x in lines], np.int64)
    found = []

    def add(which: np.ndarray, digest) -> None:
        for side, length, i, at, size, good in _places(n[which], edits):
            own = np.flatnonzero(good)
            if len(own):
                tag = _mixed((length[own] * 64 + i).astype(np.uint64) * np.uint64(BASE))
                found.append((_mixed(digest(own, length[own], at[own], size[own]) ^ tag), which[own], np.full(len(own), side, np.uint8)))

    power, inverse = _powers()
    ends = np.cumsum(n * (n <= LONG))
    chunk = ends // CHUNK
    for k in np.unique(chunk[n <= LONG]):
        which = np.flatnonzero((chunk == k) & (n <= LONG))
        codes = _codes("".join([lines[j] for j in which.tolist()]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * inverse[: len(codes)], dtype=np.uint64)])
        first = np.cumsum(n[which]) - n[which]
        add(which, lambda own, length, at, size: (sums[first[own] + at + size] - sums[first[own] + at]) * power[first[own] + at])  # noqa: B023
    for j in np.flatnonzero(n > LONG).tolist():

        def sliced(own, length, at, size, line=lines[j]) -> np.ndarray:
            part = line[at[0] : at[0] + size[0]]
            return np.array([xxhash.xxh3_64_intdigest(part) if length[0] > LONG else int((_codes(part) * inverse[: len(part)]).sum(dtype=np.uint64))], np.uint64)

        add(np.array([j]), sliced)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    key, line, side = (np.concatenate(x) for x in zip(*found, strict=True))
    return key, line, side


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """If two strings are within so many edits.

    What both begin and end with is cut off. The states of a row of the edit matrix within the band
    of 2 * edits + 1 diagonals are the bits of an integer for each number of edits; a row costs a
    few operations on these, and the rows end when no state is left.
    """
    n, m = len(a), len(b)
    if abs(n - m) > edits:
        return False
    if a == b:
        return True
    shared = _same(a, b, min(n, m))
    a, b = a[shared:], b[shared:]
    if shared := _same(a[::-1], b[::-1], min(len(a), len(b))):
        a, b = a[:-shared], b[:-shared]
    n, m = len(a), len(b)
    if max(n, m) <= edits:
        return True
    band = (1 << (2 * edits + 1)) - 1
    states = [((2 << e) - 1) << edits & band for e in range(edits + 1)]
    for i, c in enumerate(a):
        equal = 0
        for j in range(max(0, i - edits), min(m, i + edits + 1)):
            if b[j] == c:
                equal |= 1 << (j - i + edits)
        inside = (1 << max(0, m - i + edits)) - 1 & band  # diagonals that don't leave b
        before, new = 0, []
        for e, state in enumerate(states):
            now = state & equal
            if e:
                now |= before & inside | before >> 1 | new[e - 1] | (new[e - 1] << 1) & inside & band
            before = state
            new.append(now)
        states = new
        if not states[edits]:
            return False
    return bool(states[edits] >> (m - n + edits) & 1)


def _same(a: str, b: str, n: int) -> int:
    """Characters that both begin with, of n at most."""
    low, step = 0, 8
    while low < n:
        if a[low : low + step] == b[low : low + step]:
            low, step = low + step, step * 2
        elif step == 1:
            return low
        else:
            step = max(1, step // 4)
    return n


def _lines(text: str | None) -> Iterator[tuple[int, str]]:
    for i, line in enumerate((text or "").split("\n")):
        line = line.strip(SPACE)
        if line:
            yield i, line


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to rows of a task's distinct lines with their first place and count."""
    found: dict[str, list] = {}
    size = 0

    def packed() -> pa.RecordBatch:
        raw = [line.encode() for line in found]
        columns = [
            pa.array([hashlib.md5(x).digest() for x in raw], pa.binary()), pa.array(np.array([xxhash.xxh64_intdigest(x, 42) for x in raw], np.uint64).astype(np.int64)), pa.array(raw, pa.binary()).cast(pa.string()),
            *(pa.array([x[0][k] for x in found.values()], t) for k, t in enumerate((pa.bool_(), pa.int64(), pa.int32()))), pa.array([x[1] for x in found.values()], pa.int64()),
        ]
        found.clear()
        return pa.RecordBatch.from_arrays(columns, ["line_hash", "handle", "line", "unnamed", "id", "number", "n"])

    for batch in slices(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for number, line in _lines(text):
                place = (doc is None, doc or 0, number)
                if old := found.get(line):
                    old[0], old[1] = min(old[0], place), old[1] + 1
                else:
                    found[line] = [place, 1]
                    size += len(line)
            if len(found) >= GATHER or size >= CHARACTERS:
                yield packed()
                size = 0
    yield packed()


def _hashes(buckets: int, edits: int):
    """Rows (handle, line) to rows (bucket, data): a task's keys of that bucket, sorted, with handles and sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            key, owner, side = keys(batch.column(1).to_pylist(), edits)
            handle = batch.column(0).to_numpy()[owner]
            bucket = (key >> np.uint64(32)) % np.uint64(buckets)
            key = key.astype(np.uint32)
            order = np.lexsort((key, bucket))
            key, side, handle, bucket = key[order], side[order], handle[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            names, data = [], []
            for k in np.flatnonzero(edges[1:] > edges[:-1]):
                at = slice(edges[k], edges[k + 1])
                steps = np.diff(key[at], prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
                names.append(k)
                data.append(zip_.compress(np.uint32(edges[k + 1] - edges[k]).tobytes() + steps.tobytes() + side[at].tobytes()) + handle[at].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

    return run


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    reader = zstandard.ZstdDecompressor().decompressobj()
    head = reader.decompress(data)
    n = int(np.frombuffer(head, np.uint32, 1)[0])
    steps = np.ascontiguousarray(np.frombuffer(head, np.uint8, 4 * n, 4).reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32), np.frombuffer(head, np.uint8, n, 4 + 4 * n), np.frombuffer(reader.unused_data, np.int64)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, data) in order of bucket to rows (group, handle, side) of lines that share a key with another line.

    Lines of a group with over BLOCK of them are dealt into blocks, and every two blocks are a group.
    """
    now, parts = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        key, side, handle = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((handle, key))
        key, side, handle = key[order], side[order], handle[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (handle[1:] != handle[:-1])])
        at = np.flatnonzero(new)  # one entry for each key and line
        own, probe = np.add.reduceat(side, at, dtype=np.int64) > 0, np.add.reduceat(1 - side.astype(np.int64), at) > 0
        key, handle = key[at], handle[at]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([begin, [len(key)]]))
        useful = (size > 1) & (np.add.reduceat(own, begin, dtype=np.int64) > 0) & (np.add.reduceat(probe, begin, dtype=np.int64) > 0)
        size_of, keep = np.repeat(size, size), np.repeat(useful, size)
        small = keep & (size_of <= BLOCK)
        yield of(np.char.add(f"{now}:", key[small].astype(str)), handle[small], own[small] + 2 * probe[small])
        for b, n in zip(begin[useful & (size > BLOCK)], size[useful & (size > BLOCK)], strict=True):
            blocks = -(-int(n) // (BLOCK // 2))
            block = np.arange(n) % blocks
            for i in range(blocks):
                for j in range(i + 1, blocks):  # two lines of a block meet wherever their block does
                    chosen = b + np.flatnonzero((block == i) | (block == j))
                    yield of(np.full(len(chosen), f"{now}:{key[b]}:{i}:{j}"), handle[chosen], own[chosen] + 2 * probe[chosen])

    def of(group: np.ndarray, handle: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(group.astype(object), pa.string()), pa.array(handle), pa.array(side.astype(np.int8))], ["group", "handle", "side"])

    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != now:
                yield from flush()
                now, parts = bucket, []
            parts.append(_unpack(data))
    yield from flush()


def _verify(edits: int):
    """Rows (group, hash, line, side) in order of group and place: hashes of lines with an earlier near line in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, earlier, gone = None, [], set()
        for batch in batches:
            new = set()
            for group, line_hash, line, side in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != now:
                    now, earlier = group, []
                # an own segment (1) meets a substring (2); the latest lines are often the nearest
                if line_hash not in gone and any((side & 1 and old & 2 or side & 2 and old & 1) and within(line, text, edits) for old, text in reversed(earlier)):
                    new.add(line_hash)
                    gone.add(line_hash)
                earlier.append((side, line))
            if len(gone) > 1 << 20:
                gone.clear()
            yield pa.RecordBatch.from_pydict({"line_hash": pa.array(sorted(new), pa.binary())})

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to a row (id, text_hash, number, line_hash) for each line."""
    for batch in slices(batches):
        ids, hashes, numbers, digests = [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = list(_lines(text))
            ids += [doc] * len(own)
            hashes += [xxhash.xxh64_intdigest(text, 42)] * len(own)
            numbers += [i for i, _ in own]
            digests += [hashlib.md5(line.encode()).digest() for _, line in own]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(hashes, np.uint64).astype(np.int64)), pa.array(numbers, pa.int32()), pa.array(digests, pa.binary())], ["id", "text_hash", "number", "line_hash"])


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(id, text_hash, removed): the numbers of the lines to remove, from 0, of every row that loses any.

    Rows with equal id and text have one entry. ``text_hash`` is the text's xxhash64.
    """
    spark, n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    name = f"lines_{uuid.uuid4().hex}"
    lines = rows.mapInArrow(_gather, "line_hash binary, handle long, line string, unnamed boolean, id long, number int, n long")
    lines = lines.repartition(n, "handle").groupBy("handle", "line_hash").agg(F.first("line").alias("line"), F.min(F.struct("unnamed", "id", "number")).alias("first"), F.sum("n").alias("n"))
    lines.write.bucketBy(n, "handle").option("compression", "zstd").saveAsTable(name)
    try:
        lines = spark.table(name)
        near = lines.filter(F.length("line") >= max(least, edits + 1))
        hashes = near.select("handle", "line").mapInArrow(_hashes(n, edits), "bucket int, data binary")
        groups = hashes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_groups, "group string, handle long, side byte")
        members = groups.join(near.select("handle", "line_hash", "line", "first"), "handle")
        members = members.repartition("group").sortWithinPartitions("group", "first", "line_hash").select("group", "line_hash", "line", "side")
        gone = materialize(members.mapInArrow(_verify(edits), "line_hash binary").distinct(), "lines-gone")
        marked = lines.select("line_hash", "first", "n").join(gone.withColumn("gone", F.lit(True)), "line_hash", "left").filter("n > 1 or gone")
        marked = materialize(marked, "lines-marked")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    drop(gone)
    places = rows.mapInArrow(_spread, "id long, text_hash long, number int, line_hash binary")
    total = marked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    place: Column = F.struct(F.col("id").isNull().alias("unnamed"), F.coalesce("id", F.lit(0)).alias("id"), F.col("number"))
    lost = join_unique(places, marked, "line_hash", "n", total).filter(F.col("gone") | (place != F.col("first")))
    return lost.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("number")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows with removed lines taken out of their texts.

    Empty lines stay, as do null and empty texts; a text may become empty. Texts and lines are taken
    whole whatever their length. Of
    repeated rows (equal id and text) each keeps the same lines. Other columns stay, whatever their
    names but the four that start with ``__line``. An empty table gives an empty result.
    """
    lost = materialize(removed_lines(docs, id_col, text_col), "lines-lost")
    lost = lost.select(F.col("id").alias("__line_id"), F.col("text_hash").alias("__line_text"), F.col("removed").alias("__line_removed"))
    text = F.col(text_col).cast("string")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__line_id")) & (F.xxhash64(text) == F.col("__line_text"))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(F.col("__line_removed"), i)), "\n")
    out = docs.join(lost, same, "left")
    return out.withColumn(text_col, F.when(F.col("__line_removed").isNull(), text).otherwise(kept)).select(docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, the lines that go, and their numbers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lost = materialize(removed_lines(docs), "lines-lost")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.join(lost.withColumnRenamed("id", "doc_id"), ["doc_id", "text_hash"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))
