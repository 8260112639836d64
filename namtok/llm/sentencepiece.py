"""Operator 9: SentencePiece encoding and decoding over a relational lattice.

The public model is a BPE model: its piece scores are merge ranks, and a Viterbi fold of them gives
other ids than the library. The lattice is built as named (substrings of bounded length, equi-join
to the piece table, edges grouped by word) and folded by Spark's ``aggregate``, but the fold applies
merges: edges come in the order of their scores, then places, and one is taken if it joins exactly
two of the pieces that the word then has. One pass in that order equals the library's queue of
merges for words of pieces that come out of it whole when encoded alone, which is tested for the
whole vocabulary (``unproven``): then what lies between a piece's ends is two pieces at its turn,
whatever stands around it.

1. Each task sends the distinct words of its documents, cut and told apart as arrays. A word begins
   at a space that follows something else; line feeds, which no piece holds, stand alone.
2. Distinct words of the corpus are exploded, joined to the broadcast piece table (bounded by the
   vocabulary), grouped without a further shuffle, and folded to their pieces.
3. Words go back with their ids, packed, to the tasks they came from, and a second scan of the
   documents looks its words up in them and writes ids. Texts are never shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namtok.llm.common import gathered, setting, shared_dir, table

SPACE = "▁"
MARK = SPACE.encode()
#: Characters of a word whose boundaries fit the fold's 64-bit masks; longer words are merged in the second scan.
LONGEST = 60
#: Bytes of texts that are cut at once, words of a task that are told apart at once, and words whose ids are packed together.
SLICE, GATHER, PACK = 1 << 23, 2_000_000, 150_000
#: Tasks whose words share a folder, and words whose edges a task gathers by hashing before it sorts.
FOLDER, LISTS = 32, 400_000


@cache
def pieces(path: str) -> tuple[dict[str, tuple[int, float]], list[bytes], int]:
    """({piece: (id, score)} of what merging can make, bytes that each id decodes to, id of byte 0)."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found, decoded, byte = {}, [], 0
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            byte = byte or i
            decoded.append(bytes([int(text[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            decoded.append(b"")
        else:
            found[text] = (i, model.get_score(i))
            decoded.append(text.replace(SPACE, " ").encode())
    return found, decoded, byte


def cut(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of some texts, words of each text). A space stands for SPACE; a text begins with one that isn't its own."""
    texts = [t and b" " + t.replace(MARK, b" ") for t in column.cast(pa.binary()).fill_null(b"").to_pylist()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    space, feed = data == 32, data == 10
    starts = feed.copy()
    starts[1:] |= feed[:-1] | space[1:] & ~space[:-1]
    first = np.cumsum(lengths) - lengths
    starts[first[lengths > 0]] = True
    at = np.append(np.flatnonzero(starts), len(data)).astype(np.int64)
    counts = np.diff(np.searchsorted(at[:-1], np.append(first, len(data))))
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)), counts


def fits(distinct: pa.Array, apart: list[str]) -> pa.Array:
    """Words that the lattice takes: of 2 to LONGEST characters and without an unproven piece."""
    n = pc.utf8_length(distinct)
    found = pc.and_(pc.greater(n, 1), pc.less_equal(n, LONGEST))
    for piece in apart:
        found = pc.and_not(found, pc.match_substring(distinct, piece.replace(SPACE, " ")))
    return found


def merge(word: str, found: dict[str, tuple[int, float]]) -> list[tuple[int, int]]:
    """(start, end) of a word's pieces by a queue of merges, for words that the fold can't take."""
    n = len(word)
    after, before, queue = list(range(1, n + 1)), list(range(-1, n - 1)), []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n and (piece := found.get(word[i : (end := after[after[i]])])):
            heapq.heappush(queue, (-piece[1], i, after[i], end))

    for i in range(n):
        offer(i)
    gone = [False] * n
    while queue:
        _, i, middle, end = heapq.heappop(queue)
        if not gone[i] and after[i] == middle and after[middle] == end:
            gone[middle] = True
            after[i] = end
            if end < n:
                before[end] = i
            offer(i)
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append((i, after[i]))
        i = after[i]
    return out


def fold(word: str, found: dict[str, tuple[int, float]], longest: int) -> list[tuple[int, int]]:
    """(start, end) of a word's pieces as the lattice's fold finds them."""
    n = len(word)
    edges = sorted((-piece[1], i, j) for i in range(n) for j in range(i + 2, min(n, i + longest) + 1) if (piece := found.get(word[i:j])))
    cuts = set(range(n + 1))
    for _, i, j in edges:
        if i in cuts and j in cuts and sum(k in cuts for k in range(i + 1, j)) == 1:
            cuts -= set(range(i + 1, j))
    return list(pairwise(sorted(cuts)))


@cache
def unproven(path: str) -> list[str]:
    """Pieces that the fold doesn't give for their own string; words that hold one are merged by the queue instead."""
    found = pieces(path)[0]
    longest = max(map(len, found), default=1)
    return [p for p in found if fold(p, found, longest) != [(0, len(p))]]


def ranks(found: dict[str, tuple[int, float]]) -> list[str]:
    """Pieces of two or more characters, the first to merge first."""
    return sorted((p for p in found if len(p) > 1), key=lambda p: (-found[p][1], found[p][0]))


def lattice(distinct: DataFrame, found: dict[str, tuple[int, float]]) -> DataFrame:
    """(word, spans) of distinct words: their pieces of two or more characters as rank * 4096 + start * 64 + end.

    Words have 2 to LONGEST characters. ``distinct`` is hash-partitioned by word, which grouping then
    needs no shuffle for.
    """
    longest = max(map(len, found), default=1)
    ranked = ranks(found)
    names = distinct.sparkSession.createDataFrame(pa.table({"piece": [p.replace(SPACE, " ") for p in ranked], "rank": pa.array(range(len(ranked)), pa.int64())}))
    n = F.length("word")
    at = distinct.select("word", F.explode(F.sequence(F.lit(0), n - 2)).alias("start"))
    at = at.select("word", "start", F.explode(F.sequence(F.col("start") + 2, F.least(n, F.col("start") + longest))).alias("end"))
    at = at.withColumn("piece", F.substring("word", F.col("start") + 1, F.col("end") - F.col("start")))
    edge = F.col("rank") * 4096 + F.col("start") * 64 + F.col("end")
    edges = at.join(F.broadcast(names), "piece").groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    # the fold's state has a bit for each boundary that is left; an edge is taken if its ends are and one bit lies between
    ends = lambda e: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(e, 6).bitwiseAND(F.lit(63)).cast("int")).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), e.bitwiseAND(F.lit(63)).cast("int")))
    above = lambda e: F.call_function("shiftleft", F.lit(-2).cast("bigint"), F.shiftright(e, 6).bitwiseAND(F.lit(63)).cast("int"))
    below = lambda e: F.call_function("shiftleft", F.lit(1).cast("bigint"), e.bitwiseAND(F.lit(63)).cast("int")) - 1
    inner = lambda e: above(e).bitwiseAND(below(e))
    joins = lambda cuts, e: (cuts.bitwiseAND(ends(e)) == ends(e)) & (F.bit_count(cuts.bitwiseAND(inner(e))) == 1)
    cuts = F.aggregate("edges", F.expr("shiftleft(1L, length(word) + 1) - 1"), lambda cuts, e: F.when(joins(cuts, e), cuts.bitwiseAND(F.bitwise_not(inner(e)))).otherwise(cuts))
    final = F.filter("edges", lambda e: (F.col("cuts").bitwiseAND(ends(e)) == ends(e)) & (F.col("cuts").bitwiseAND(inner(e)) == 0))
    return edges.withColumn("cuts", cuts).select("word", final.alias("spans"))


def _send(apart: list[str]):
    """Rows (text) to rows (part, word) of a task's distinct words that the lattice takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId(), [], 0

        def packed() -> pa.RecordBatch:
            found = pa.concat_arrays(held).unique() if held else pa.array([], pa.large_string())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), part, np.int32)), found.cast(pa.string())], ["part", "word"])

        for batch in pieces_of(batches):
            distinct = cut(batch.column(0))[0].unique()
            held.append(distinct.filter(fits(distinct, apart)))
            size += len(held[-1])
            if size >= GATHER:
                held[:] = [pa.concat_arrays(held).unique()]
                size = len(held[0])
                if size >= GATHER // 2:  # a further round tells few words apart
                    yield packed()
                    size = 0
        yield packed()

    return run


def pieces_of(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about so many bytes of their last column; a longer text stands alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def compose(own: pa.Array, spans: pa.ListArray, single: np.ndarray, ids_by_rank: np.ndarray, byte: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each word) of words from their spans; characters between spans by ``single`` (id by code, -1: none) or as bytes."""
    codes = np.frombuffer("".join(own.to_pylist()).encode("utf-32-le"), "<u4")
    lengths = pc.utf8_length(own).to_numpy().astype(np.int64)
    first = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(own)), lengths)
    ids = single[codes]
    flat = spans.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    begin = first[np.repeat(np.arange(len(own)), np.diff(spans.offsets.to_numpy()))] if len(flat) else np.zeros(0, np.int64)
    start, end = begin + (flat >> 6 & 63), begin + (flat & 63)
    ids[start] = ids_by_rank[flat >> 12]
    inner = np.zeros(len(codes) + 1, np.int32)
    inner[start + 1] += 1
    inner[end] -= 1
    at = np.flatnonzero(np.cumsum(inner[:-1]) == 0)
    ids, word, codes = ids[at], word[at], codes[at]
    if (ids < 0).any():
        raw = [chr(c).encode() if i < 0 else b"" for i, c in zip(ids.tolist(), codes.tolist(), strict=True)]
        times = np.array([max(1, len(r)) for r in raw])
        ids, word = np.repeat(ids, times), np.repeat(word, times)
        ids[ids < 0] = byte + np.frombuffer(b"".join(raw), np.uint8)
    return ids, np.bincount(word, minlength=len(own))


def _pack(path: str):
    """Rows (part, word, spans) to rows (folder, part, words): for each part its words from this task with their ids, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, _, byte = pieces(path)
        single = np.full(0x110000, -1, np.int32)
        for piece, (i, _) in found.items():
            if len(piece) == 1:
                single[ord(piece.replace(SPACE, " "))] = i
        ids_by_rank = np.array([found[p][0] for p in ranks(found)], np.int32)
        kept: list[tuple] = []

        def packed() -> pa.RecordBatch:
            part, count, ids, size, data = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            order, start, at = np.argsort(part, kind="stable"), np.cumsum(count) - count, np.cumsum(size) - size
            edges = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0, [True]]))
            parts, blobs, zip_ = [], [], zstandard.ZstdCompressor(level=3)
            for a, b in pairwise(edges):
                own = order[a:b]
                parts.append(int(part[own[0]]))
                blobs.append(zip_.compress(b"".join((np.array([len(own), size[own].sum()], "<u4").tobytes(), size[own].astype(np.uint8).tobytes(), count[own].astype(np.uint8).tobytes(), gathered(data, at[own], size[own]).tobytes(), gathered(ids, start[own], count[own]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()))))
            return pa.RecordBatch.from_arrays([pa.array([p // FOLDER for p in parts], pa.int32()), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["folder", "part", "words"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(1)
            spans = pc.fill_null(batch.column(2), pa.scalar([], pa.list_(pa.int64())))
            ids, count = compose(own, spans, single, ids_by_rank, byte)
            kept.append((batch.column(0).to_numpy(), count, ids, pc.binary_length(own).to_numpy(), np.frombuffer(b"".join(own.cast(pa.binary()).to_pylist()), np.uint8)))
            size += len(own)
            if size >= PACK:
                yield packed()
                size = 0
        if kept:
            yield packed()

    return run


class Encoder:
    """Ids of whole texts from the words that came back to a task; it holds them in arrays, not as objects."""

    def __init__(self, path: str, blobs: Iterable[bytes] = ()):
        self.found, self.decoded, self.byte = pieces(path)
        sizes, counts, data, ids = [], [], [], []
        for blob in map(zstandard.ZstdDecompressor().decompress, blobs):
            n, length = np.frombuffer(blob, "<u4", 2).tolist()
            sizes.append(np.frombuffer(blob, np.uint8, n, 8))
            counts.append(np.frombuffer(blob, np.uint8, n, 8 + n))
            data.append(blob[8 + 2 * n : 8 + 2 * n + length])
            ids.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, -1, 8 + 2 * n + length).reshape(4, -1).T).view("<u4").ravel())
        size = np.concatenate([[0], *sizes]).astype(np.int64)
        self.words = pa.LargeStringArray.from_buffers(len(size) - 1, pa.py_buffer(np.cumsum(size)), pa.py_buffer(b"".join(data)))
        self.ids_of = np.concatenate([*ids, np.zeros(0, "<u4")]).astype("<u4")
        self.count = np.concatenate([*counts, np.zeros(0, np.uint8)]).astype(np.int64)
        self.begin = np.cumsum(self.count) - self.count
        lengths = np.array([len(d) for d in self.decoded], np.int64)
        self.bytes_at, self.bytes_n, self.bytes_of = np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(self.decoded), np.uint8)
        self.slow: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        return [self.found[text][0]] if text in self.found else [self.byte + b for b in text.encode("utf-8", "replace")]

    def merged(self, word: str) -> list[int]:
        """Ids of a word that didn't come back (one character, too long or unproven), by merging; short ones are kept."""
        if word in self.slow:
            return self.slow[word]
        own = word.replace(" ", SPACE)
        ids = [k for i, j in merge(own, self.found) for k in self.piece(own[i:j])]
        if len(word) <= LONGEST and len(self.slow) < 100_000:
            self.slow[word] = ids
        return ids

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each, if decoding them gives the text)"""
        words, words_of = cut(column)
        coded = words.dictionary_encode()
        distinct, index = coded.dictionary, coded.indices.to_numpy()
        at = pc.index_in(distinct, value_set=self.words)
        rest = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        own = [self.merged(w) for w in distinct.take(pa.array(rest)).to_pylist()]
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        count = self.count[place] if len(self.count) else np.zeros(len(place), np.int64)
        begin = self.begin[place] if len(self.count) else np.zeros(len(place), np.int64)
        count[rest] = [len(x) for x in own]
        begin[rest] = len(self.ids_of) + np.cumsum(count[rest]) - count[rest]
        ids_of = np.concatenate([self.ids_of, np.array([i for x in own for i in x], "<u4")])
        # each word is decoded once: a text makes the round trip if its words do
        ids = gathered(ids_of, begin, count)
        text = gathered(self.bytes_of, self.bytes_at[ids], self.bytes_n[ids])
        size = np.add.reduceat(np.append(self.bytes_n[ids], 0), np.cumsum(count) - count) if len(count) else count
        good = size == pc.binary_length(distinct).to_numpy()
        if not good.all() or text.tobytes() != b"".join(distinct.cast(pa.large_binary()).to_pylist()):
            ends = np.cumsum(size)
            good = np.array([text[e - n : e].tobytes() == w for e, n, w in zip(ends.tolist(), size.tolist(), distinct.cast(pa.large_binary()).to_pylist(), strict=True)], bool)
        ends = np.concatenate([[0], np.cumsum(words_of)])
        total, bad = np.concatenate([[0], np.cumsum(count[index])]), np.concatenate([[0], np.cumsum(~good[index])])
        own_mark = pc.fill_null(pc.match_substring(column, SPACE), False).to_numpy(zero_copy_only=False)
        return gathered(ids_of, begin[index], count[index]), np.diff(total[ends]), (np.diff(bad[ends]) == 0) & ~own_mark


def decode_ids(ids: bytes, decoded: list[bytes]) -> str:
    """The text of ids; one leading space, which encoding added, goes."""
    return b"".join(map(decoded.__getitem__, np.frombuffer(ids, "<u4").tolist())).removeprefix(b" ").decode("utf-8", "replace")


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_pieces``, ``ids`` (little-endian unsigned 32-bit integers) and ``round_trip`` (decoding gives the text).

    The ids are those of the library for the whole text, without begin or end tokens. Null and
    empty texts have none and make the round trip. ``docs`` is scanned twice and should be a stored
    table: words go back to the number of the task that met them, and any that a task then lacks
    it merges by itself. Texts are taken whole whatever their length; a task holds about SLICE
    bytes of them, or one longer text, at once. Ids may be null or repeat, each row gives a row,
    other columns are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "pieces")
    found = pieces(model_path)[0]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = rows.select("text").mapInArrow(_send(unproven(model_path)), "part int, word string").filter("word is not null").repartition("word")
    # the distinct words keep a column of their own so that both sides read the same exchange
    distinct = sent.groupBy("word").agg(F.min("part").alias("any"))
    spans = lattice(distinct.filter("any >= 0").select("word"), found)
    back = sent.join(spans.hint("shuffle_hash"), "word", "left").select("part", "word", "spans").mapInArrow(_pack(model_path), "folder int, part int, words binary")
    with setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(LISTS)):
        back.repartition("part").write.partitionBy("folder").option("compression", "none").option("parquet.block.size", 1 << 20).parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        part, blobs = TaskContext.get().partitionId(), []
        at = f"{base}/folder={part // FOLDER}"
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            blobs = ds.dataset(at, filesystem=fs, format="parquet").to_table(columns=["words"], filter=ds.field("part") == part)["words"].to_pylist()
        encoder = Encoder(model_path, blobs)
        del blobs
        for batch in pieces_of(batches):
            ids, count, same = encoder.encode(batch.column(1))
            offsets = np.concatenate([[0], np.cumsum(count * 4)]).astype(np.int32)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), packed, pa.array(same)], ["id", "n_pieces", "ids", "round_trip"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_pieces long, ids binary, round_trip boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; a null gives a null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = pieces(model_path)[1]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if i is None else decode_ids(i, decoded) for i in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), "round_trip")
