"""Operator 8: cropped or edited copies of images in a media column, by local descriptors.

Equal bytes are one image. Of each image the workers describe the strongest multiscale corners of
every tile (``images.describe``). Two corners match if their descriptors of 256 bits differ in BITS
bits at most. A pair of images is a copy if one similarity explains VOTES of its matches. Copies
are reported by class.

Links are found in two rounds. First, images that share one of their SKETCH least descriptor hashes
are put to the geometric test by their equal descriptors, each with the first of its key and the
NEXT before it; that joins most copies without all pairs. Then images that aren't of one class yet
meet in blocks of classes, or of CLASS images of large ones: every pair of blocks is a task, so no
task grows with the input, but their number grows with its square over BLOCK. A task keeps one descriptor of each class and finds
corners that match in Hamming tables in its memory: a table's key is a window of the descriptor, as
long as the number of corners asks for, and there are as many tables as find RECALL of the corners
in which every tenth bit differs (``layout``). Two images of which MEET matches so found agree
roughly are candidates; all their corners are then compared, and the matches put to the geometric
test. Matches never leave the task, as there are far more of them than of images.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namtok.llm import images
from namtok.llm.common import gathered, join_unique, materialize, rows_per_batch, table
from namtok.llm.components import connected_components

WORDS, BITS, VOTES, NEXT, SKETCH = 4, 48, 6, 4, 4
#: Of the tables: least bits of a key, share of corners with a tenth of their bits changed that they find, and corners that must meet.
LEAST_BITS, RECALL, MEET = 16, 0.9, 3
#: Two matches agree roughly if one carries the other to so many pixels and radians: twice what the geometric test grants.
ROUGH = 8.0, 0.7
#: Corners of a block on average, least number of blocks, so that there are tasks enough, images of a class that are kept in one block, and rows that are compared at once.
BLOCK, LEAST_BLOCKS, CLASS, AT_ONCE = 600_000, 4, 1000, 1 << 20
#: Media that are sent to Python at once.
MEDIA_ROWS = 500


def pack(places: np.ndarray) -> np.ndarray:
    """x, y, angle and scale of corners in one integer each: 20 bits for a coordinate in eighths, 12 for an angle, 8 for the scale's number."""
    scale = np.array([images.SCALES.index(s) for s in places[:, 3]], np.int64)
    turn = np.rint((places[:, 2] + np.pi) / (2 * np.pi) * 4095).astype(np.int64)
    return np.rint(places[:, 0] * 8).astype(np.int64) << 40 | np.rint(places[:, 1] * 8).astype(np.int64) << 20 | turn << 8 | scale


def unpack(packed: np.ndarray) -> np.ndarray:
    turn = (packed >> 8 & 4095) / 4095 * 2 * np.pi - np.pi
    return np.stack([(packed >> 40) / 8, (packed >> 20 & 0xFFFFF) / 8, turn, np.array(images.SCALES)[packed & 255]], axis=1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, media) to rows (node, places, keys), one for each image; a task describes equal images once."""
    seen: set[int] = set()
    for batch in batches:
        nodes, places, keys = [], [], []
        for node, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node in seen:
                continue
            seen.add(node)
            place, bits = images.describe(images.decode(data))
            if len(bits):
                nodes.append(node)
                places.append(pack(place))
                keys.append(bits.reshape(len(bits) * WORDS, -1).copy().view(">i8")[:, 0].astype(np.int64))
        if len(seen) > 1 << 20:
            seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["node", "places", "keys"])


def layout(corners: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each table's window of a descriptor, for so many corners."""
    bits = min(40, max(LEAST_BITS, math.ceil(math.log2(corners + 1))))
    tables = max(16, math.ceil(math.log(1 - RECALL) / math.log(1 - 0.9**bits)))
    return [(images.TESTS * t // tables, bits) for t in range(tables)]


def _window(first: int, bits: int, words: list | None = None):
    """Bits of the descriptor from the first on, in a ring; of the columns w0 … w3, or of four arrays."""
    word, shift = divmod(first, 64)
    if words is not None:
        high = words[word] if not shift else words[word] << np.uint64(shift) | words[(word + 1) % WORDS] >> np.uint64(64 - shift)
        return high >> np.uint64(64 - bits)
    high = F.shiftleft(f"w{word}", shift)
    if shift:
        high = high.bitwiseOR(F.shiftrightunsigned(f"w{(word + 1) % WORDS}", 64 - shift))
    return F.shiftrightunsigned(high, 64 - bits)


def _hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each row of four words."""
    found = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        found = (found ^ words[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return found


def _lists(column: pa.Array, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists in rows of so many, and the number of rows in each list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), np.diff(column.offsets.to_numpy()) // width


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, places, keys) to a row (key, node, places, hashes) for each of an image's SKETCH least hashes."""
    for batch in batches:
        words, count = _lists(batch.column(2), WORDS)
        own = np.split(_hashes(words).view(np.int64), np.cumsum(count)[:-1]) if batch.num_rows else []
        keys = [np.unique(h)[:SKETCH] for h in own]
        row = np.repeat(np.arange(len(own)), [len(k) for k in keys])
        hashes = pa.array(own, pa.list_(pa.int64())).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else [], pa.int64()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), hashes], ["key", "node", "places", "hashes"])


class _Joined(dict):
    """Union-find of the nodes that a task has linked."""

    def root(self, x):
        while (up := self.get(x, x)) != x:
            self[x] = self.get(up, up)
            x = up
        return x

    def join(self, x, y):
        self[self.root(x)] = self.root(y)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, node, places, hashes) to links between images of one key, by their equal descriptors."""
    joined, last, met = _Joined(), None, []
    for batch in batches:
        links = []
        for key, node, places, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(joined) > 1 << 20:
                joined.clear()
            if key != last:
                last, met = key, []
            places, hashes = unpack(np.array(places, np.int64)), np.array(hashes, np.int64)
            for other, p, h in met:
                if joined.root(other) == joined.root(node):
                    continue
                i, j = np.nonzero(h[:, None] == hashes[None, :])
                if len(i) >= VOTES and images.inliers(np.hstack([p[i], places[j]]), enough=VOTES) >= VOTES:
                    joined.join(node, other)
                    links.append((other, node))
            met.append((node, places, hashes))
            if len(met) > 1 + NEXT:
                del met[1]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to so many at most, or hold one item."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and their end."""
    return np.r_[0, np.nonzero(values[1:] != values[:-1])[0] + 1, len(values)] if len(values) else np.zeros(1, int)


def _matches(words: np.ndarray, root: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Descriptors (i, j) of different roots, and sides if given, that differ in BITS at most and agree in a table's key."""
    found, tables = [], layout(len(words))
    columns = [np.ascontiguousarray(words[:, k]) for k in range(WORDS)]
    for t, (first, bits) in enumerate(tables):
        key = _window(first, bits, columns)
        order = np.argsort(key, kind="stable")
        starts = _starts(key[order])
        after = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(order)) - 1
        for at, end in _runs(after, AT_ONCE):
            for skip in range(0, int(after[at]) if end == at + 1 else 1, AT_ONCE):  # one descriptor may have more partners
                count = np.minimum(after[at:end] - skip, AT_ONCE) if end == at + 1 else after[at:end]
                i = np.repeat(np.arange(at, end), count)
                j = gathered(np.arange(len(order)), np.arange(at, end) + 1 + skip, count)
                i, j = order[i], order[j]
                keep = root[i] != root[j]
                if side is not None:
                    keep &= side[i] != side[j]
                i, j = i[keep], j[keep]
                differ = sum(np.bitwise_count(c[i] ^ c[j]).astype(np.int16) for c in columns)
                i, j = i[differ <= BITS], j[differ <= BITS]
                for before in tables[:t]:  # a match is kept where its first table finds it
                    new = _window(*before, [c[i] ^ c[j] for c in columns]) != 0
                    i, j = i[new], j[new]
                found.append((i.astype(np.int32), j.astype(np.int32)))
    i, j = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int32),) * 2
    swap = root[i] > root[j]
    return np.where(swap, j, i), np.where(swap, i, j)


def _agreeing(p: np.ndarray, q: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of runs of matches (places p and q), if MEET of a run agree roughly in what one of them proposes."""
    good = np.zeros(len(count), bool)
    begin = np.cumsum(count) - count
    for at, end in _runs(count * count, AT_ONCE):
        n = count[at:end]
        run = np.repeat(np.arange(end - at), n * n)
        k = np.arange(len(run)) - np.repeat(np.cumsum(n * n) - n * n, n * n)
        i, j = begin[at:end][run] + k // n[run], begin[at:end][run] + k % n[run]
        turn = q[:, 2] - p[:, 2]
        turn, ratio, bend = turn[i], p[i, 3] / q[i, 3], turn[j] - turn[i]
        c, s = ratio * np.cos(turn), ratio * np.sin(turn)
        dx, dy = p[j, 0] - p[i, 0], p[j, 1] - p[i, 1]
        off = np.hypot(q[i, 0] + c * dx - s * dy - q[j, 0], q[i, 1] + s * dx + c * dy - q[j, 1])
        near = (off <= ROUGH[0]) & (np.abs((bend + np.pi) % (2 * np.pi) - np.pi) < ROUGH[1])
        votes = np.add.reduceat(near, np.nonzero(k % n[run] == 0)[0])
        good[at:end] = np.maximum.reduceat(votes, np.cumsum(n) - n) >= MEET
    return good


def _between(task: pa.Table) -> pa.Table:
    """Rows (node, root, side, places, keys) of two blocks, or of one, to links between images of different roots."""
    node, root = task["node"].to_numpy(), np.unique(task["root"].to_numpy(), return_inverse=True)[1]
    side = task["side"].to_numpy()
    packed, count = _lists(task["places"])
    places, words = unpack(packed[:, 0]), _lists(task["keys"], WORDS)[0].view(np.uint64)
    image = np.repeat(np.arange(len(node)), count)
    begin = np.cumsum(count) - count
    # one descriptor for all corners of a class that have it
    one, own = np.unique(_hashes(np.hstack([words, root[image][:, None].astype(np.uint64)])), return_index=True, return_inverse=True)[1:]
    holders, holds = np.argsort(own, kind="stable"), np.bincount(own, minlength=len(one))
    first = np.cumsum(holds) - holds
    kind = root[image[one]]
    i, j = _matches(words[one], kind, side[image[one]] if side.any() else None)
    order = np.argsort(kind[i].astype(np.int64) * (root.max(initial=0) + 1) + kind[j], kind="stable")
    i, j = i[order], j[order]
    classes = _starts(kind[i].astype(np.int64) * (root.max(initial=0) + 1) + kind[j])

    links, joined = [], _Joined()
    for from_, to in _runs(np.add.reduceat(holds[i], classes[:-1]) if len(i) else np.zeros(0, int), AT_ONCE):
        u, v = i[classes[from_] : classes[to]], j[classes[from_] : classes[to]]
        a, v = gathered(holders, first[u], holds[u]), np.repeat(v, holds[u])
        # all matches of an image stand together
        order = np.lexsort((kind[v], image[a]))
        a, v = a[order], v[order]
        group = _starts(image[a].astype(np.int64) * (root.max(initial=0) + 1) + kind[v])
        for low, high in _runs(np.add.reduceat(holds[v], group[:-1]), AT_ONCE):
            x, y = a[group[low] : group[high]], v[group[low] : group[high]]
            x, y = np.repeat(x, holds[y]), gathered(holders, first[y], holds[y])
            pair = image[x].astype(np.int64) * len(node) + image[y]
            order = np.argsort(pair, kind="stable")
            starts = _starts(pair[order])
            size = np.diff(starts)
            many = size >= MEET
            if not many.any():
                continue
            pick = order[np.repeat(many, size)]
            good = _agreeing(places[x[pick]], places[y[pick]], size[many])
            for c in pair[order[starts[:-1][many][good]]].tolist():
                m, n = divmod(c, len(node))
                if joined.root(root[m]) == joined.root(root[n]):
                    continue
                if _is_copy(*(v[begin[k] : begin[k] + count[k]] for k in (m, n) for v in (places, words))):
                    joined.join(root[m], root[n])
                    links.append((m, n))
    return pa.table([pa.array(node[[x[k] for x in links]] if links else [], pa.int64()) for k in (0, 1)], ["a", "b"])


def _is_copy(p: np.ndarray, x: np.ndarray, q: np.ndarray, y: np.ndarray) -> bool:
    """If one similarity explains VOTES of the matches between all corners of two images."""
    pairs = []
    for at in range(0, len(x), 256):  # bounds memory for images of many corners
        differ = np.bitwise_count(x[at : at + 256, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
        i, j = np.nonzero(differ <= BITS)
        pairs.append((i + at, j))
    i, j = (np.concatenate(v) for v in zip(*pairs, strict=True))
    return len(i) >= VOTES and images.inliers(np.hstack([p[i], q[j]]), enough=VOTES) >= VOTES


def linked(features: DataFrame) -> DataFrame:
    """Rows (node, places, keys) to links (a, b) that give the components of all pairs that are copies."""
    sketches = features.select("node", "places", "keys").mapInArrow(_sketches, "key long, node long, places array<long>, hashes array<long>")
    first = sketches.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_near, "a long, b long")
    first = materialize(first.distinct(), "media-near")
    labels = connected_components(first, "media-near-links")

    number = features.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    blocks = max(LEAST_BLOCKS, math.ceil(number / BLOCK))
    labels = labels.join(labels.groupBy("root").agg(F.ceil(F.count("*") / CLASS).alias("parts")), "root").select("node", "root", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    rooted = features.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    block = F.pmod(F.xxhash64("root", F.coalesce("part", F.lit(0))), F.lit(blocks)).cast("int")  # a large class is dealt to several
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rooted.withColumn("own", block).withColumn("other", other)
    dealt = dealt.select("node", "root", (F.col("own") > F.col("other")).cast("int").alias("side"), "places", "keys", (F.least("own", "other") * blocks + F.greatest("own", "other")).alias("task"))
    second = dealt.groupBy("task").applyInArrow(_between, "a long, b long")
    return first.unionByName(second)


def copies(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Per row: id, ``class_id`` (the least id of its class) and ``n_features`` of its image.

    Null, empty or undecodable media have no features; such rows are a class with those of equal
    bytes only. Media are decoded whole whatever their size. Rows with a null id belong to a class but never name it. Other columns are ignored
    and an empty table gives an empty result.
    """
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(media_col), F.lit(b"")).alias("media")).withColumn("digest", F.unhex(F.sha2("media", 256)))
    with rows_per_batch(media.sparkSession, MEDIA_ROWS):
        ids = materialize(rows.select("id", "digest"), "media-ids")
    nodes = ids.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("node", F.xxhash64("digest"))
    nodes = materialize(nodes, "media-nodes")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    with rows_per_batch(media.sparkSession, MEDIA_ROWS):
        features = rows.select(F.xxhash64("digest").alias("node"), "media").mapInArrow(_features, "node long, places array<long>, keys array<long>")
        features = materialize(features.dropDuplicates(["node"]), "media-features")
    links = linked(features)
    labels = connected_components(links, "media-links")
    named = nodes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = features.select("node", F.size("places").alias("n_features"))
    classes = named.groupBy("root").agg(F.min("least").alias("class_id"))
    found = named.join(classes, "root").join(counts, "node", "left").select("digest", "n", "class_id", F.coalesce("n_features", F.lit(0)).cast("long").alias("n_features"))
    found = materialize(found, "media-classes")
    return join_unique(ids, found, "digest", "n", total).drop("digest").withColumnRenamed("id", id_col)


def render(vector: list[float] | None, variant: int, size: int = 128) -> bytes | None:
    """A scene of overlapping rectangles that a vector seeds, as a PGM; variants are edits of it.

    0 to 3: as it is; 4: cropped; 5: brighter with less contrast; 6: turned by a quarter; 7: cropped and darker.
    From 8 on the same again, less some columns and rows.
    """
    cut, variant = variant // 8, variant % 8
    if vector is None:
        return None
    rng = np.random.default_rng(xxhash.xxh64_intdigest(np.array(vector, np.float32).tobytes()))
    scene = np.full((size, size), 128.0)
    for x, y, w, h, grey in zip(rng.integers(-10, size, 70), rng.integers(-10, size, 70), rng.integers(6, 40, 70), rng.integers(6, 40, 70), rng.integers(20, 236, 70), strict=True):
        scene[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)] = grey
    if variant == 4:
        scene = scene[9 : size - 6, 12 : size - 4]
    elif variant == 5:
        scene = scene * 0.7 + 60
    elif variant == 6:
        scene = np.rot90(scene)
    elif variant == 7:
        scene = scene[5 : size - 11, 3 : size - 9] * 0.8
    return images.encode_pgm(np.clip(scene, 0, 255)[cut // 8 :, cut % 8 :])


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", variants: int = 8) -> DataFrame:
    """(id, media): the tables hold no images, so each row's vector seeds a scene and its id picks an edit of it."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                own = batch.slice(at, 500)
                media = [render(v, k) for v, k in zip(own.column(1).to_pylist(), own.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(media, pa.binary())], ["id", "media"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col), F.coalesce((F.crc32(F.col(id_col).cast("string")) % variants).cast("int"), F.lit(0)).alias("variant"))
    return rows.mapInArrow(draw, "id long, media binary").withColumnRenamed("id", id_col)


def scene(id_col: str = "vec_id") -> Column:
    """The number of the scene that a row of the query shows: a third of all rows show one, the others share one by ids that are close."""
    return F.when(F.col(id_col) % 3 == 0, 0).otherwise(1 + F.floor(F.col(id_col) / 24)).cast("long")


def op8_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors are all distinct, so scenes are seeded by number, and rows show them in up to 512 variants."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("embedding").isNotNull(), F.array(scene().cast("float"))))
    return copies(rendered(vectors, variants=512), "vec_id", "media")
