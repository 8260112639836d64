"""Operator 4: removal of long repeated byte strings, by a sparse, distributed suffix sort.

Two kinds of strings are sought in the same passes (``Kind``): strings of 400 bytes, which are
removed, and strings of 51 words, i.e. passages of over 50 words, which are reported. For the
latter a text is the sequence of its words' 32-bit hashes, so its units are words instead of bytes.

Every string of ``window`` units chooses an anchor in it: the place of the least hash of ``gram``
units among its first ``reach`` places. The choice depends on the string's units alone, so equal
strings choose equal places in themselves, and only the suffixes at anchors need to be sorted.

1. Equal texts are merged; of each distinct text one copy is kept in a bucketed table, and a text
   with several copies is repeated whole if it is as long as the window.
2. Anchors are hashed over the ``context`` units that every string choosing them has at least behind
   its anchor. Those whose hash occurs once are dropped; equal units have equal hashes.
3. The suffixes (``window`` units at most) at the other anchors are sorted within each task, equal
   ones with equal left contexts joined, cut by splitters into ranges, front-coded and exchanged;
   a loser tree merges each range's runs without comparing known prefixes again.
4. Suffixes that share ``context`` units with a neighbour form a group, in which it is decided unit
   by unit, without hashing, which strings start more than once.
5. A text's repeated starts give its removed runs, which are joined to the table without a shuffle of texts.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namtok.llm.common import drop, join_unique, materialize, shuffle_partitions, slices, table
from namtok.llm.suffixes import common_prefix, decode, front_code, merge


class Kind(NamedTuple):
    """What is sought: length of the strings, of the context behind an anchor and of an anchor's gram in units, and bytes of a unit."""

    number: int
    window: int
    context: int
    gram: int
    unit: int

    @property
    def reach(self) -> int:
        """Places after its start at which a string's anchor can lie."""
        return self.window - self.context + 1


BYTES, WORDS = Kind(0, 400, 128, 32, 1), Kind(1, 51, 16, 6, 4)
KINDS = (BYTES, WORDS)
WINDOW = BYTES.window
#: Bytes of the shortest text that has a string of either kind.
SHORTEST = min(BYTES.window, 2 * WORDS.window - 1)
#: White space between words.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Ranges of a kind are numbered from its number times this.
RANGES = 1 << 20
#: Units that are hashed at once; longer texts are handled in pieces that overlap by a window.
PIECE = 1 << 21
BASE = 0x9E3779B97F4A7C15
MEMBER = "<16sqHH"
#: Neighbours that are compared pair by pair before a group is resolved by tables instead.
NEIGHBOURS = 24


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE modulo 2^64 and of its inverse."""
    n, steps = PIECE + 2 * WINDOW, []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        steps.append(np.cumprod(factors, dtype=np.uint64))
    return steps[0], steps[1]


def _sums(data: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers()[1][: len(data)], dtype=np.uint64)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours: of a block's end and the next block's beginning."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def coded(texts: list[bytes]) -> list[bytes]:
    """Each text as the 32-bit hashes of its words; a word is hashed once."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = BLANK[data]
    inside = ~blank
    begin = np.flatnonzero(inside & np.concatenate([[True], blank[:-1]]))
    end = np.flatnonzero(blank & np.concatenate([[False], inside[:-1]]))
    edges = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(data[inside])]).dictionary_encode()
    digests = np.array([xxhash.xxh32_intdigest(w) for w in own.dictionary.to_pylist()], "<u4")
    codes = digests[own.indices.to_numpy()] if len(begin) else np.zeros(0, "<u4")
    cuts = np.searchsorted(begin, np.cumsum(lengths + 1)[:-1]) if len(texts) else []
    return [c.tobytes() for c in np.split(codes, cuts)] if texts else []


def anchors(text: bytes, kind: Kind = BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """(place, first and last distance back to a string's start, hash of the context) of a text's anchors in units, piece by piece.

    Strings before and after a piece's edge can choose one place, so a piece's last anchor is held
    back and joined to the next piece's first if they are the same.
    """
    held: list[np.ndarray] = []
    units, window = np.frombuffer(text, f"<u{kind.unit}"), kind.window
    salt = np.uint64(kind.number * 0x9E3779B97F4A7C15)
    for start in range(0, len(units) - window + 1, PIECE):
        data = units[start : start + PIECE + window - 1]
        n, sums, power = len(data), _sums(data), _powers()[0]
        grams = _mixed((sums[kind.gram :] - sums[: -kind.gram]) * power[: n - kind.gram + 1])
        order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        chosen = (_least(order, kind.reach)[: n - window + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(chosen) - 1]])
        place = chosen[first]
        key = _mixed(((sums[place + kind.context] - sums[place]) * power[place]) ^ salt)
        found = [place + start, place - last, place - first, key]
        if held and held[0][0] == found[0][0]:
            found[2][0] = held[2][0]
        elif held:
            found = [np.concatenate(x) for x in zip(held, found, strict=True)]
        if start + PIECE <= len(units) - window:
            held = [x[-1:] for x in found]
            found = [x[:-1] for x in found]
        yield tuple(found)


def _read(texts: DataFrame) -> DataFrame:
    """(key, digest, kind, place, least, most, prefix) of every anchor; prefix is the suffix's first seven bytes as a number."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, owners = [], []
            digests, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for kind, sequences in ((BYTES, texts), (WORDS, coded(texts))):
                for digest, text in zip(digests, sequences, strict=True):
                    for place, least, most, key in anchors(text, kind):
                        data = np.frombuffer(text, np.uint8)
                        prefix = sum(data[place * kind.unit + i].astype(np.int64) << (8 * (6 - i)) for i in range(7))
                        out.append((key.astype(np.int64), np.full(len(place), kind.number, np.int8), place, least, most, prefix))
                        owners += [digest] * len(place)
            if out:
                key, kinds, place, least, most, prefix = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owners, pa.binary()), pa.array(kinds), pa.array(place), pa.array(least.astype(np.int16)), pa.array(most.astype(np.int16)), pa.array(prefix)], ["key", "digest", "kind", "place", "least", "most", "prefix"])

    return texts.mapInArrow(find, "key long, digest binary, kind byte, place long, least short, most short, prefix long")


def _runs(splitters: dict[int, list[int]]):
    """Rows (digest, text, anchors) to rows (range, front-coded run): one run for each range and task."""
    bounds = {k: np.array(sorted(set(splitters.get(k, []))), np.int64) for k in range(len(KINDS))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, dict[tuple[bytes, bytes], list[bytes]]] = defaultdict(lambda: defaultdict(list))
        size = 0
        for batch in slices(batches):
            digests, texts, found = (c.to_pylist() for c in batch.columns)
            for kind, sequences in ((BYTES, texts), (WORDS, coded(texts))):
                u, window = kind.unit, kind.window * kind.unit
                for digest, text, own in zip(digests, sequences, found, strict=True):
                    for a in own:
                        if a["kind"] != kind.number:
                            continue
                        at = a["place"] * u
                        suffix, left = text[at : at + window], text[max(0, at - (kind.reach - 1) * u) : at][::-1]
                        members = ranges[kind.number * RANGES + int(np.searchsorted(bounds[kind.number], a["prefix"], "right"))][suffix, left]
                        size += 64 if members else 64 + len(suffix) + len(left)
                        members.append(struct.pack(MEMBER, digest, a["place"], a["least"], a["most"]))
            if size > 1 << 26:  # bounds a run, and so the worker's memory
                yield from _packed(ranges)
                size = 0
        yield from _packed(ranges)

    return run


def _packed(ranges: dict) -> Iterator[pa.RecordBatch]:
    for k in sorted(ranges):
        run = front_code([(suffix, left, b"".join(members)) for (suffix, left), members in sorted(ranges[k].items())])
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([run], pa.large_binary())], ["range", "run"])
    ranges.clear()


def _entries(group: list[tuple[int, bytes, bytes, bytes]]) -> list[tuple[int, bytes, bytes, bytes]]:
    """The group with equal (suffix, left) joined and lefts in order among equal suffixes."""
    out: list[tuple[int, bytes, bytes, bytes]] = []
    same: dict[bytes, list[bytes]] = {}
    for i, (shared, suffix, left, members) in enumerate(group):
        if i and suffix != group[i - 1][1]:
            out += [(head if not k else len(old), old, x, b"".join(m)) for k, (x, m) in enumerate(sorted(same.items()))]
            same = {}
        if not same:
            head, old = shared, suffix
        same.setdefault(left, []).append(members)
    return out + [(head if not k else len(old), old, x, b"".join(m)) for k, (x, m) in enumerate(sorted(same.items()))]


def resolve(group: list[tuple[int, bytes, bytes, bytes]], kind: Kind = BYTES) -> Iterator[tuple[bytes, int, int]]:
    """(digest, first, last start) of the strings around a group's anchors that start more than once.

    Lengths are in units. A string that starts d before its anchor recurs at another entry if the two
    share d to the left and window - d to the right. Entries are met outwards from each one until what the best
    left and the best right allow is covered; what stays open after NEIGHBOURS is looked up in a
    table of all strings at each open d, so the work is linear in the group's size.
    """
    entries, size, u, window = _entries(group), struct.calcsize(MEMBER), kind.unit, kind.window
    n = len(entries)
    best_left = [0] * n
    order = sorted(range(n), key=lambda i: entries[i][2])
    for i, j in zip(order, order[1:], strict=False):
        shared = common_prefix(entries[i][2], entries[j][2]) // u
        best_left[i], best_left[j] = max(best_left[i], shared), max(best_left[j], shared)
    open_at: dict[int, tuple[set[int], set[int]]] = {}
    for i, (_, _, left, members) in enumerate(entries):
        several = len(members) > size
        lows, highs = zip(*(struct.unpack_from(MEMBER, members, at)[2:] for at in range(0, len(members), size)), strict=True)
        right = max(entries[i][0] if i else 0, entries[i + 1][0] if i + 1 < n else 0) // u
        need = set(range(max(min(lows), window - right), min(max(highs), best_left[i]) + 1)) if not several else set()
        covered: set[int] = set()
        for step in (-1, 1):
            j, shared = i, window
            for _ in range(NEIGHBOURS):
                if not need or not 0 <= j + step < n:
                    break
                shared = min(shared, entries[max(j, j + step)][0] // u)
                j += step
                if shared < kind.context:
                    break
                found = set(range(window - shared, common_prefix(left, entries[j][2]) // u + 1)) & need
                covered |= found
                need -= found
        if need and n > NEIGHBOURS:
            open_at[i] = need, covered
        else:
            yield from _starts(members, None if several else covered)
    for d in {d for need, _ in open_at.values() for d in need}:
        count: dict[tuple[bytes, bytes], int] = defaultdict(int)
        for _, suffix, left, _ in entries:
            if len(left) >= d * u and len(suffix) >= (window - d) * u:
                count[left[: d * u], suffix[: (window - d) * u]] += 1
        for i, (need, covered) in open_at.items():
            if d in need and count.get((entries[i][2][: d * u], entries[i][1][: (window - d) * u]), 0) > 1:
                covered.add(d)
    for i, (_, covered) in open_at.items():
        yield from _starts(entries[i][3], covered)


def _starts(members: bytes, distances: set[int] | None) -> Iterator[tuple[bytes, int, int]]:
    """Starts of each member's strings whose distance to the anchor is among these (None: all), as intervals."""
    for digest, place, low, high in struct.iter_unpack(MEMBER, members):
        begin = None
        for d in range(high, low - 2, -1):
            if d >= low and (distances is None or d in distances):
                begin = d if begin is None else begin
            elif begin is not None:
                yield digest, place - begin, place - d - 1
                begin = None


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, run) in order of range: merge each range's runs and resolve its groups."""
    runs, now, found = [], None, []

    def flush() -> None:
        group: list[tuple[int, bytes, bytes, bytes]] = []
        kind = KINDS[(now or 0) // RANGES]
        for entry in merge([decode(r) for r in runs]):
            if entry[0] < kind.context * kind.unit:
                settle(group, kind)
                group = []
            group.append(entry)
        settle(group, kind)

    def settle(group: list[tuple[int, bytes, bytes, bytes]], kind: Kind) -> None:
        if len(group) > 1 or group and len(group[0][3]) > struct.calcsize(MEMBER):
            found.extend((digest, kind.number, first, last) for digest, first, last in resolve(group, kind))

    def batch_of() -> pa.RecordBatch:
        digest, kind, first, last = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(kind, pa.int8()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["digest", "kind", "first", "last"])

    for batch in batches:
        for k, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != now:
                flush()
                yield batch_of()
                runs, now, found = [], k, []
            runs.append(run)
    flush()
    yield batch_of()


def _digests(docs: DataFrame) -> DataFrame:
    """(digest, id, n_bytes, text) of every row; the digest is XXH3's 128 bits of the whole text."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), batch.column(0)], ["digest", "id"])

    return docs.mapInArrow(add, "digest binary, id long")


def _texts(docs: DataFrame) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            digests = [xxhash.xxh3_128_digest(t) for t in texts]
            new = [i for i, d in enumerate(digests) if d not in seen and not seen.add(d)]
            if len(seen) > 1 << 20:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in new], pa.binary()), batch.column(0).take(pa.array(new, pa.int64()))], ["digest", "text"])

    return docs.mapInArrow(add, "digest binary, text binary")


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, text, copies, intervals of repeated starts) to what is left of each text."""
    for batch in slices(batches):
        out = []
        for digest, text, copies, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spans = _covered(found, BYTES, len(text), copies)
            passages = _covered(found, WORDS, len(text.split()) if copies > 1 else 0, copies)
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            out.append((digest, copies, len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans], sum(b - a for a, b in passages)))
        columns = zip(*out, strict=True) if out else [()] * 8
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["digest", "copies", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_passage_words"])


def _covered(found: list[dict] | None, kind: Kind, length: int, copies: int) -> list[list[int]]:
    """The maximal runs of units that repeated strings of a kind cover; a text with copies is covered whole if it is long enough."""
    if copies > 1:
        return [[0, length]] if length >= kind.window else []
    spans: list[list[int]] = []
    for first, last in sorted((x["first"], x["last"]) for x in found or () if x["kind"] == kind.number):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + kind.window)
        else:
            spans.append([first, last + kind.window])
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans`` (removed runs, start and end) and ``n_passage_words``.

    A byte is removed if a 400-byte string that covers it also starts anywhere else, in this
    row's text or another's; matches never cross rows. ``n_passage_words`` counts the words in passages
    of over 50 words that stand anywhere else too, whatever white space parts their words; passages
    of under 400 bytes are reported there and not removed. Texts are taken whole whatever their length. Null and empty texts have 0 bytes and keep
    them. Ids may be null or repeat; each row gives a row. Other columns are ignored. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    ids = materialize(_digests(docs.select(F.col(id_col).cast("long").alias("id"), text)), "repeats-ids")
    copies = ids.groupBy("digest").agg(F.count("*").alias("copies"))
    n = shuffle_partitions(spark)
    name = f"repeats_{uuid.uuid4().hex}"
    texts = _texts(docs.select(text)).repartition(n, "digest").dropDuplicates(["digest"])
    texts.write.bucketBy(n, "digest").option("compression", "zstd").saveAsTable(name)
    try:
        texts = spark.table(name)
        found = materialize(_read(texts.filter(F.octet_length("text") >= SHORTEST)), "repeats-anchors")
        again = materialize(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "repeats-keys")
        total = again.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        chosen = materialize(join_unique(found, again, "key", "n", total).drop("key"), "repeats-chosen")
        drop(found)
        drop(again)
        cuts = chosen.groupBy("kind").agg(F.percentile_approx("prefix", [i / n for i in range(1, n)], 2000).alias("cuts")).collect() if n > 1 else []
        lists = chosen.groupBy("digest").agg(F.collect_list(F.struct("kind", "place", "least", "most", "prefix")).alias("found"))
        runs = texts.join(lists, "digest").select("digest", "text", "found").mapInArrow(_runs({r.kind: r.cuts for r in cuts}), "range int, run binary")
        runs = runs.repartition("range").sortWithinPartitions("range")
        starts = materialize(runs.mapInArrow(_merged, "digest binary, kind byte, first long, last long"), "repeats-starts")
        starts = starts.groupBy("digest").agg(F.collect_list(F.struct("kind", "first", "last")).alias("starts"))
        done = texts.join(copies, "digest").join(starts, "digest", "left").select("digest", "text", "copies", "starts")
        schema = "digest binary, copies long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, n_passage_words long"
        done = materialize(done.mapInArrow(_results, schema), "repeats-done")
        drop(chosen)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    total = done.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    return join_unique(ids, done, "digest", "copies", total).drop("digest").withColumnRenamed("id", id_col)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
