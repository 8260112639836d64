import gzip
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from namtok.llm import decontaminate, elias_fano, exact_substrings, images, language_id, line_dedup, media_copies, simhash, suffixes, token_counts, token_files, warc
from namtok.llm import sentencepiece as lattice
from namtok.llm.common import shared_dir
from namtok.llm.components import connected_components
from tests.llm import plain

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, id string, key int"
ODD = ["a<|endoftext|>b C’EST naïve é İstanbul ΣΑΣ ½ x²  z don't it's I'LL ''s\x85 \x1c日本 1234 ﬁ", "x" * 3000, "  \n\t<|startoftext|><|STARTOFTEXT|> ééÉ", "\0a  b", "", None]


def table(spark, rows, parts=3):
    """Documents with two more columns, of clashing names."""
    return spark.createDataFrame([(i, t, "z", 7) for i, t in rows], SCHEMA).repartition(parts)


def prose(rng, n, words=("the", "house", "Étude", "stands", "über", "all.", "of", "it,", "1984", "señor")):
    return " ".join(rng.choices(words, k=n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, prose(rng, rng.randint(0, 60)) + "\n" * (i % 3) + prose(rng, 9)) for i in range(40)]
    return out + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (7, out[7][1]), (5, "same id, other text")]


def test_token_counts(spark, rows):
    library = Tokenizer.from_file(BPE)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=str)
    got = token_counts.count_tokens(table(spark, rows), BPE, limit=20).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 20) for r in got)
    assert token_counts.count_tokens(table(spark, []), BPE).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5], [0, 0, 0], np.sort(rng.integers(0, 1 << 40, 2000)), np.sort(rng.integers(0, 3000, 2000)), [0] * 700 + [1 << 50]):
        coded = elias_fano.Sequence(elias_fano.encode(np.array(values, np.uint64)))
        assert coded.all().tolist() == list(values) == [coded[i] for i in range(len(coded))]


def test_token_files(spark, rows):
    library, folder = Tokenizer.from_file(BPE), shared_dir(spark, "ids")
    manifest = token_files.write_token_files(table(spark, rows), folder, BPE, end_id=2)
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    file = token_files.TokenFile(f"{folder}/{manifest[-1]['file']}")
    assert file.ids(file.n_docs - 1).tolist()[-1] == 2
    empty = shared_dir(spark, "ids")
    assert token_files.write_token_files(table(spark, []), empty, BPE, end_id=2) == []
    assert token_files.read_token_files(spark, empty).count() == 0


@pytest.mark.parametrize("tree", [4096, 3])
def test_simhash(spark, rows, monkeypatch, tree):
    monkeypatch.setattr(simhash, "TREE", tree)
    if tree == 3:
        monkeypatch.setattr(simhash, "shard_masks", lambda n, radius=4: [(1 << 64) - 1 - 0xFFF, 0xFFF] and [0])  # all in one shard
    rng = random.Random(1)
    near = [(200 + i, prose(rng, 3) + " " + "fixed words that stay in place for every copy of it " * 9) for i in range(25)]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, rows + near)).collect()), key=str)
    assert got == plain.simhash(rows + near)


def test_simhash_masks_and_empty(spark):
    for n in (10, 10**8, 10**11):
        masks = simhash.shard_masks(n)
        rng = random.Random(n)
        for _ in range(300):
            difference = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not difference & m for m in masks)
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_loser_tree():
    rng = random.Random(2)
    for _ in range(60):
        runs = [sorted((bytes(rng.choices(b"ab", k=rng.randint(0, 12))), b"", b"m") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 7))]
        out = list(suffixes.merge([suffixes.decode(suffixes.front_code(r)) for r in runs]))
        assert [x[1] for x in out] == sorted(x[0] for r in runs for x in r)
        assert all(b[0] == suffixes.common_prefix(a[1], b[1]) for a, b in zip(out, out[1:], strict=False))


@pytest.mark.parametrize("neighbours", [24, 1])
def test_repeats(spark, rows, monkeypatch, neighbours):
    monkeypatch.setattr(exact_substrings, "NEIGHBOURS", neighbours)
    rng = random.Random(2)
    base = "".join(rng.choices("abcdefghij é", k=2500))
    for i in range(80):
        a = rng.randint(0, 1500)
        part = list(base[a : a + rng.randint(300, 1000)])
        for _ in range(rng.randint(0, 2)):
            part[rng.randrange(len(part))] = "#"
        rows = [*rows, (1000 + i, prose(rng, 20) + "".join(part) + prose(rng, 20))]
    rows = [*rows, (2003, "a" * 1500), (2004, "ab" * 700), (2005, "q" * 399), (2006, "w" * 400), (2007, "w" * 400), (2007, "w" * 400)]
    got = exact_substrings.remove_repeats(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == plain.repeats(rows)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert sorted(((r.doc_id, r.n_passage_words) for r in got), key=str) == plain.passages(rows)


@pytest.mark.parametrize("neighbours", [24, 1])
def test_passages_of_over_fifty_words(spark, rows, monkeypatch, neighbours):
    monkeypatch.setattr(exact_substrings, "NEIGHBOURS", neighbours)
    rng = random.Random(13)
    base = rng.choices([f"w{k}" for k in range(40)], k=600)
    for i in range(90):
        at, n = rng.randrange(500), rng.randint(46, 80)
        rows = [*rows, (5000 + i, "\n ".join([f"u{i}", *base[at : at + n], f"v{i}"]) if i % 2 else prose(rng, 9) + " " + " ".join(base[at : at + n]))]
    rows = [*rows, (5200, "x " * 50), (5201, "x " * 51), (5202, "y " * 60), (5203, "z " * 51), (5203, " z" * 51)]
    got = exact_substrings.remove_repeats(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_passage_words) for r in got), key=str) == plain.passages(rows)
    assert any(r.n_passage_words and not r.n_removed for r in got)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == plain.repeats(rows)


def test_anchors_across_pieces(monkeypatch):
    text = random.Random(11).randbytes(20_000) + b"a" * 9000
    whole = [np.concatenate(x).tolist() for x in zip(*exact_substrings.anchors(text), strict=True)]
    for piece in (150, 3000, 4099):
        monkeypatch.setattr(exact_substrings, "PIECE", piece)
        assert [np.concatenate(x).tolist() for x in zip(*exact_substrings.anchors(text), strict=True)] == whole


def test_repeats_in_a_text_of_several_pieces(spark):
    rng = random.Random(12)
    edge, shared = exact_substrings.PIECE, "".join(rng.choices("mnopqr", k=700))
    long = "".join(rng.choices("abcdefgh", k=2 * edge + 5000))
    rows = [(1, long), (2, long[: edge - 300].upper() + shared + long[edge + 400 :].upper()), (3, "-" + shared + "-")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in exact_substrings.remove_repeats(table(spark, rows)).collect()}
    assert got == {1: [], 2: [(edge - 300, edge + 400)], 3: [(1, 701)]}


def test_repeats_empty(spark):
    assert exact_substrings.remove_repeats(table(spark, [])).count() == 0


def changed(rng, line, edits):
    line = list(line)
    for _ in range(edits):
        at, what = rng.randrange(len(line) + 1), rng.random()
        if what < 0.33 or at == len(line):
            line.insert(at, rng.choice("abc"))
        elif what < 0.66:
            line.pop(at)
        else:
            line[at] = rng.choice("abc")
    return "".join(line)


def test_edit_distance_and_keys():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choices("abc", k=rng.randint(1, 14)))
        b = changed(rng, a, rng.randint(0, 4))
        near = plain.distance(a, b) <= 2
        assert line_dedup.within(a, b) == near
        if near and min(len(a), len(b)) >= 3:
            longer, shorter = sorted((a, b), key=len, reverse=True)
            key, line, side = line_dedup.keys([longer, shorter])
            assert set(key[(line == 0) & (side == 0)]) & set(key[(line == 1) & (side == 1)])


def test_keys_of_long_lines_and_chunks(monkeypatch):
    rng = random.Random(4)
    lines = ["".join(rng.choices("abcdé日", k=rng.randint(3, 90))) for _ in range(200)]
    whole = line_dedup.keys(lines)
    want = [sorted(whole[0][whole[1] == i].tolist()) for i in range(len(lines))]
    monkeypatch.setattr(line_dedup, "CHUNK", 150)
    line_dedup._powers.cache_clear()
    key, line, _ = line_dedup.keys(lines)
    assert [sorted(key[line == i].tolist()) for i in range(len(lines))] == want
    monkeypatch.setattr(line_dedup, "LONG", 40)  # lines about the limit still meet
    for a in lines:
        b = changed(rng, a, 2)
        if min(len(a), len(b)) >= 3:
            longer, shorter = sorted((a, b), key=len, reverse=True)
            key, line, side = line_dedup.keys([longer, shorter])
            assert set(key[(line == 0) & (side == 0)]) & set(key[(line == 1) & (side == 1)])
    line_dedup._powers.cache_clear()


@pytest.mark.parametrize("block", [1000, 6])
def test_line_dedup(spark, rows, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(5)
    base = ["".join(rng.choices("abc de", k=rng.randint(20, 60))) for _ in range(12)]
    rows = rows + [(500 + i, "\n".join(f" {changed(rng, rng.choice(base), rng.randint(0, 4))}\t" for _ in range(rng.randint(1, 5)))) for i in range(60)]
    rows += [(None, base[0] + "\nshort"), (702, base[1]), (702, base[1]), (703, "short\n\n shirt \n"), (704, "short\n" + "long " * 60), (705, "long " * 59 + "lung")]
    out = line_dedup.dedup_lines(table(spark, rows))
    assert out.columns == ["doc_id", "text", "id", "key"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == plain.dedup_lines(rows)
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_decontaminate(spark, rows):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(6, 25), [f"w{k}" for k in range(30)] + ["the", "of"]) + ". Answer " + str(i)) for i in range(30)] + [(40, "tiny item"), (41, ""), (42, None)]
    docs = list(rows)
    for i in range(80):
        words = items[i % 31][1].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "zz"
        docs.append((3000 + i, prose(rng, rng.randint(0, 70)) + " " + " ".join(words[rng.randint(0, 2) :]) + " " + prose(rng, 30)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want: dict = {}
    for row in docs:  # ids repeat with other texts
        for k, v in plain.leaks([row], items).items():
            want[k] = sorted({*want.get(k, []), *v})
    for size in (1 << 24, 500):  # one index, and several
        decontaminate.INDEX_BYTES, before = size, decontaminate.INDEX_BYTES
        out = decontaminate.decontaminate(table(spark, docs), benchmark)
        assert out.columns == ["doc_id", "text", "id", "key", "matches"]
        ids = {}
        for r in out.collect():
            ids.setdefault(r.doc_id, set()).update(m.item_id for m in r.matches)
        decontaminate.INDEX_BYTES = before
        assert {k: sorted(v) for k, v in ids.items()} == want
    # a null and a repeated item id, whose texts meet in different indexes, give one match each
    odd = spark.createDataFrame([(None, items[0][1]), (None, items[1][1]), (9, items[2][1]), (9, items[2][1]), (9, items[3][1])], "item_id long, text string")
    decontaminate.INDEX_BYTES, before = 30, decontaminate.INDEX_BYTES
    out = decontaminate.decontaminate(table(spark, [(1, " ".join(t for _, t in items[:4])), (2, "clean")]), odd).collect()
    decontaminate.INDEX_BYTES = before
    assert {r.doc_id: [m.item_id for m in r.matches] for r in out} == {1: [9, None], 2: []}
    assert all(not r.matches for r in decontaminate.decontaminate(table(spark, docs), benchmark.limit(0)).collect())
    assert decontaminate.decontaminate(table(spark, []), benchmark).count() == 0


@pytest.mark.parametrize("compress", [False, True])
def test_warc(spark, compress):
    pages = spark.createDataFrame([(1, None, "u"), (2, "", None), (3, "x", "a b"), (4, "x", "u"), (5, "y\r\n\r\nWARC/1.1\r\n", "z"), (None, "x", "n"), (4, "x", "u")], "page_id long, html string, url string")
    folder = shared_dir(spark, "warc")
    warc.write_warc(pages, folder, compress=compress)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_pages(spark, folder).collect()), key=str)
    empty, x, y = warc.base32_sha1(b""), warc.base32_sha1(b"x"), warc.base32_sha1(b"y\r\n\r\nWARC/1.1\r\n")
    want = [(1, 0, empty, "response", None), (2, 0, empty, "revisit", 1), (3, 1, x, "response", None), (4, 1, x, "revisit", 3), (4, 1, x, "revisit", 3), (5, 15, y, "response", None), (None, 1, x, "revisit", 3)]
    assert got == sorted(want, key=str)
    read = spark.read.format("warc").option("payload", "false").option("header.X-Payload-Length", "1").load(folder).filter("record_type = 'response'")
    assert [(r.record_id, r.payload) for r in read.collect()] == [("urn:page:3", None)]
    assert "record_type#" in read._jdf.queryExecution().executedPlan().toString()
    empty_folder = shared_dir(spark, "warc")
    warc.write_warc(pages.limit(0), empty_folder)
    assert warc.read_pages(spark, empty_folder).count() == 0


def _warc_files(tmp_path, compress):
    """A file of three records and one that is cut off, has a bad length and a line that is no record."""
    made = [warc._record("response", f"urn:page:{i}", "u", "D", n, b"z" * n, None) for i, n in ((1, 5), (2, 300_000), (3, 7))]
    bad = [made[0].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: x", 1), b"stray\r\nlines\r\n", made[2]]
    pack = warc.packed if compress else bytes
    suffix = ".warc.gz" if compress else ".warc"
    (tmp_path / f"a{suffix}").write_bytes(b"".join(map(pack, made)))
    (tmp_path / f"b{suffix}").write_bytes(b"".join(map(pack, bad)) + pack(made[1])[:-150])
    return f"file://{tmp_path}", suffix


@pytest.mark.parametrize("compress", [False, True])
def test_malformed_archives(spark, tmp_path, compress):
    folder, _ = _warc_files(tmp_path, compress)
    warc.register(spark)
    read = spark.read.format("warc").load(folder)
    found = sorted((r.file[-1 - (8 if compress else 5) :][:1], r.record_type, r.record_id) for r in read.select("file", "record_type", F.coalesce("record_id", F.lit("")).alias("record_id")).collect())
    assert [f for f in found if f[1] == "response"] == [("a", "response", f"urn:page:{i}") for i in (1, 2, 3)] + [("b", "response", "urn:page:3")]
    assert sum(f[1] == warc.MALFORMED for f in found) == (3 if compress else 2) and all(f[0] == "b" for f in found if f[1] == warc.MALFORMED)
    assert {r.n for r in read.filter("record_type = 'response'").select(F.length("payload").alias("n")).collect()} == {5, 7, 300_000}
    assert read.filter(F.col("date").isin("1970-01-01T00:00:00Z", None) & (F.col("content_type") == "application/http; msgtype=response")).count() == 4


def test_skipped_members_are_not_inflated(tmp_path):
    folder, suffix = _warc_files(tmp_path, True)
    path = tmp_path / f"a{suffix}"
    data = bytearray(path.read_bytes())
    first = warc._member_bytes(io.BufferedReader(io.BytesIO(bytes(data))), 0)
    second = warc._member_bytes(io.BufferedReader(io.BytesIO(bytes(data))), first)
    data[first + second - 100 : first + second - 20] = b"\xff" * 80  # the end of the second payload can't be inflated
    path.write_bytes(bytes(data))
    ids = lambda payload: [h.get("warc-record-id") for _, h, _ in warc.records(f"{folder}/a{suffix}", {}, payload)]
    assert ids(False) == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    assert ids(True) == ["<urn:page:1>", None, "<urn:page:3>"]
    path.write_bytes(gzip.compress(warc._record("response", "urn:page:8", None, "D", 3, b"abc", None)) * 2)  # members of other writers
    assert ids(True) == ["<urn:page:8>"] * 2


def test_warc_repeated_and_null_ids(spark):
    rows = [(1, "x"), (2, "y"), (None, "x"), (None, "lone"), (None, "twin"), (None, "twin"), (4, "x"), (4, "own"), (4, "y"), (6, "own")]
    folder = shared_dir(spark, "warc")
    warc.write_warc(spark.createDataFrame([(i, t, "u") for i, t in rows], "page_id long, html string, url string").repartition(3), folder)
    got = [(r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_pages(spark, folder).collect()]
    first = {"x": 1, "y": 2, "own": 4}
    want = [(i, warc.base32_sha1(t.encode()), *(("response", None) if first.get(t) == i or t not in first else ("revisit", first[t]))) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_images():
    scene = images.decode(media_copies.render([1.0] * 64, 0))
    places, bits = images.describe(scene)
    assert len(places) == images.FEATURES
    for variant in range(1, 8):
        other, other_bits = images.describe(images.decode(media_copies.render([1.0] * 64, variant)))
        matches = [[*p, *q] for p, x in zip(places, bits, strict=True) for q, y in zip(other, other_bits, strict=True) if np.bitwise_count(x ^ y).sum() <= media_copies.BITS]
        assert images.inliers(np.array(matches)) >= media_copies.VOTES
    assert images.decode(b"nonsense") is None and images.decode(None) is None and images.decode(b"P5 9") is None


def agreeing(a, b):
    """Corners of two images that match and that one similarity explains."""
    (places, bits), (other, other_bits) = images.describe(a), images.describe(b)
    same = np.bitwise_count(bits[:, None, :] ^ other_bits[None, :, :]).sum(axis=2) <= media_copies.BITS
    return images.inliers(np.array([[*places[i], *other[j]] for i, j in np.argwhere(same)]).reshape(-1, 8))


def test_crops_of_a_large_image():
    whole = np.vstack([np.hstack([images.decode(media_copies.render([float(4 * i + j)] * 64, 0)) * (0.1 + 0.05 * (i + j)) + 60 for j in range(4)]) for i in range(4)])
    for x, y in ((0, 0), (70, 40), (200, 90), (40, 333), (350, 350), (180, 210)):
        assert agreeing(whole[y : y + 150, x : x + 150], whole) >= media_copies.VOTES


def test_png():
    import struct

    pixels = np.arange(48, dtype=np.uint8).reshape(6, 8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b""
    for y in range(6):
        kind, line, above = y % 3, pixels[y].astype(int), pixels[y - 1].astype(int) if y else np.zeros(8, int)
        left = np.concatenate([[0], line[:-1]])
        lines += bytes([kind]) + ((line - (0, left, above)[kind]) & 255).astype(np.uint8).tobytes()
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 6, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (images.decode(png) == pixels).all()


def test_media_copies(spark):
    rows = [(i, [float(i % 25)] * 64) for i in range(120)] + [(9001, None), (9002, None), (None, [3.0] * 64)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.class_id for r in media_copies.copies(media_copies.rendered(vectors), "vec_id", "media").collect()}
    assert got == {i: i % 25 for i in range(120)} | {9001: 9001, 9002: 9001, None: 3}
    assert media_copies.copies(media_copies.rendered(vectors.limit(0)), "vec_id", "media").count() == 0


def test_links_of_large_groups(spark):
    """Two classes of copies whose corners' keys many unrelated images share, other images for each corner."""
    rng = np.random.default_rng(13)
    shared = rng.integers(-(1 << 62), 1 << 62, (8, media_copies.WORDS))
    places = media_copies.pack(np.array([[10.0 + 13 * k, 20.0 + 7 * (k * k % 11), 0.5, 1.0] for k in range(8)]))
    nodes = {1000: shared, 2000: shared}
    nodes |= {k * 40 + i + base: shared[k : k + 1] for base in (0, 1100) for k in range(8) for i in range(40)}
    rows = [(n, places[: len(w)].tolist(), w.ravel().tolist()) for n, w in nodes.items()]
    features = spark.createDataFrame(rows, "node long, places array<long>, keys array<long>")
    assert {(r.a, r.b) for r in media_copies.linked(features).collect()} == {(1000, 2000)}


def block_coded(pixels, step):
    """Blocks of 8 by 8 whose cosine coefficients are rounded, as JPEG does."""
    k = np.arange(8)
    cosine = np.cos((2 * k + 1) * k[:, None] * np.pi / 16) / 2
    cosine[0] /= 2**0.5
    blocks = pixels.reshape(16, 8, 16, 8).transpose(0, 2, 1, 3)
    grid = step * (1 + k[:, None] + k)
    return (cosine.T @ (np.round(cosine @ blocks @ cosine.T / grid) * grid) @ cosine).transpose(0, 2, 1, 3).reshape(128, 128)


def test_media_edits(spark):
    rng, rows = np.random.default_rng(14), []
    for i in range(10):
        scene = images.decode(media_copies.render([i + 0.5] * 64, 0))
        edits = [scene, images._resize(scene, 0.9), images._resize(scene, 0.75), scene + rng.normal(0, 8, scene.shape), images._box(scene, 1) / 9, block_coded(scene, 10)]
        rows += [(100 * k + i, bytearray(images.encode_pgm(np.clip(np.rint(e), 0, 255)))) for k, e in enumerate(edits)]
    got = {r.id: r.class_id for r in media_copies.copies(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()}
    assert got == {i: i % 100 for i, _ in rows}


def test_strangers_are_no_copies():
    """Every two of 120 scenes, by all their corners."""
    found = [images.describe(images.decode(media_copies.render([3000.0 + i], 0))) for i in range(120)]
    words = [np.ascontiguousarray(bits).view(np.uint64) for _, bits in found]
    votes = []
    for a in range(120):
        for b in range(a):
            i, j = np.nonzero(np.bitwise_count(words[a][:, None, :] ^ words[b][None, :, :]).sum(axis=2) <= media_copies.BITS)
            if len(i) >= media_copies.VOTES:
                votes.append(images.inliers(np.hstack([found[a][0][i], found[b][0][j]])))
    assert max(votes, default=0) < media_copies.VOTES


def test_links_are_those_of_all_pairs(spark):
    """Edited and strange scenes: the classes are those of a comparison of all corners of every two images."""
    rng, nodes = np.random.default_rng(15), {}
    for i in range(24):
        scene = images.decode(media_copies.render([4000.0 + i], 0))
        edits = [scene, scene[30:120, 20:110] * 0.8, images._resize(scene, 0.7), np.rot90(scene) + rng.normal(0, 12, scene.shape)]
        nodes |= {10 * i + k: images.describe(np.clip(np.rint(e), 0, 255)) for k, e in enumerate(edits)}
    least = {n: n for n in nodes}
    for b in nodes:
        for a in range(b):
            if a in nodes and agreeing_corners(nodes[a], nodes[b]) >= media_copies.VOTES:
                old, least_of = least[b], least[a]
                least |= {n: min(old, least_of) for n in nodes if least[n] in (old, least_of)}
    assert sum(least[n] == n for n in nodes) < len(nodes) / 2
    rows = [(n, media_copies.pack(p).tolist(), b.reshape(len(b) * media_copies.WORDS, -1).copy().view(">i8")[:, 0].astype(np.int64).tolist()) for n, (p, b) in nodes.items()]
    links = media_copies.linked(spark.createDataFrame(rows, "node long, places array<long>, keys array<long>"))
    roots = {r.node: r.root for r in connected_components(links, "media-test").collect()}
    assert {n: roots.get(n, n) for n in nodes} == least


def test_large_classes_are_dealt_to_several_blocks(spark, monkeypatch):
    """40 equal images, joined in the first round, and one with a tenth of the bits changed, joined to them in the second."""
    monkeypatch.setattr(media_copies, "CLASS", 3)
    rng = np.random.default_rng(17)
    bits = rng.integers(0, 2, (8, images.TESTS), np.uint8)
    other = bits ^ (rng.random(bits.shape) < 0.1).astype(np.uint8)
    places = media_copies.pack(np.array([[10.0 + 13 * k, 20.0 + 7 * (k * k % 11), 0.5, 1.0] for k in range(8)])).tolist()
    keys = [np.packbits(b, axis=1).reshape(-1, 8).copy().view(">i8")[:, 0].astype(np.int64).tolist() for b in (bits, other)]
    tasks, between = spark.sparkContext.accumulator(0), media_copies._between

    def counted(task):
        tasks.add(task.num_rows > 0)
        return between(task)

    monkeypatch.setattr(media_copies, "_between", lambda task: counted(task))
    links = media_copies.linked(spark.createDataFrame([(n, places, keys[n == 40]) for n in range(41)], "node long, places array<long>, keys array<long>"))
    assert {r.root for r in connected_components(links, "media-test").collect()} == {0}
    assert tasks.value >= media_copies.LEAST_BLOCKS * (media_copies.LEAST_BLOCKS + 1) // 2  # one block meets LEAST_BLOCKS


def agreeing_corners(one, two):
    (places, bits), (other, other_bits) = one, two
    i, j = np.nonzero(np.bitwise_count(bits[:, None, :] ^ other_bits[None, :, :]).sum(axis=2) <= media_copies.BITS)
    return images.inliers(np.hstack([places[i], other[j]])) if len(i) else 0


def test_edits_that_share_half_of_an_image():
    """Scenes at 0.6 of their size, and crops of half their area: nine in ten crops and two in three small ones are found."""
    scenes = [images.decode(media_copies.render([5000.0 + i], 0)) for i in range(60)]
    whole = [images.describe(s) for s in scenes]
    share = lambda edit: np.mean([agreeing_corners(w, images.describe(np.clip(np.rint(edit(s)), 0, 255))) >= media_copies.VOTES for s, w in zip(scenes, whole, strict=True)])
    assert share(lambda s: s[30:120, 20:110] * 0.8) >= 0.9
    assert share(lambda s: images._resize(s, 0.6)) >= 0.65


def test_layout_of_tables(spark):
    for corners in (0, 100, 1 << 20, 1 << 36):
        tables = media_copies.layout(corners)
        bits = tables[0][1]
        assert 2**bits >= min(corners, 2**40) and 1 - (1 - 0.9**bits) ** len(tables) >= media_copies.RECALL
    rng = np.random.default_rng(3)
    words = rng.integers(-(2**63), 2**63, 4, np.int64)
    row = spark.createDataFrame([tuple(map(int, words))], "w0 long, w1 long, w2 long, w3 long")
    ring = "".join(f"{int(w) % 2**64:064b}" for w in words) * 2
    for first, bits in ((0, 16), (50, 16), (64, 21), (230, 40), (255, 33)):
        assert row.select(media_copies._window(first, bits)).first()[0] == int(ring[first : first + bits], 2)


def test_media_query_has_copies(spark, tmp_path):
    folder = str(tmp_path)
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("vec_id < 120").write.parquet(f"{folder}/embeddings.parquet")
    ids = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", media_copies.scene().alias("scene")).collect()
    least = {}
    for r in ids:
        least[r.scene] = min(least.get(r.scene, r.vec_id), r.vec_id)
    got = {r.vec_id: r.class_id for r in media_copies.op8_media_copies(spark, folder).collect()}
    assert got == {r.vec_id: least[r.scene] for r in ids}


def test_sentencepiece(spark, rows, tmp_path):
    model, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(1)
    bits = ["a", "b", "the", "  ", " ", "\n", "▁", "é", "日本", "\0", "-", "==", "<0x0A>", "\t", "İ", "ing", "tion"]
    rows = rows + [(4000 + i, "".join(rng.choices(bits, k=rng.randint(1, 60)))) for i in range(60)] + [(4100, " " * 40), (4101, "w" * 61 + " internationally" * 9)]
    table(spark, rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    encoded = lattice.encode(docs, PIECES)
    got = sorted(((r.doc_id, bytes(r.ids), r.n_pieces) for r in encoded.collect()), key=str)
    assert got == sorted(((i, np.array(model.encode(t or ""), "<u4").tobytes(), len(model.encode(t or ""))) for i, t in rows), key=str)
    back = {(r.doc_id, r.text) for r in lattice.decode(encoded, PIECES).collect()}
    assert back == {(i, model.decode(model.encode(t or ""))) for i, t in rows}
    trips = sorted(((r.doc_id, r.round_trip) for r in encoded.collect()), key=str)
    assert trips == sorted(((i, model.decode(model.encode(t or "")) == (t or "")) for i, t in rows), key=str)
    assert lattice.encode(docs.limit(0), PIECES).count() == 0


def test_sentencepiece_without_returned_words():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["the thing  with", None, "", " a\n\nb ", "日本 é", "\n", "▁x y", "z" * 70]
    ids, count, same = lattice.Encoder(PIECES).encode(pa.array(texts, pa.string()))
    assert [list(x) for x in np.split(ids, np.cumsum(count)[:-1])] == [model.encode(t or "") for t in texts]
    assert same.tolist() == [model.decode(model.encode(t or "")) == (t or "") for t in texts]


def test_fold_equals_merging():
    found = lattice.pieces(PIECES)[0]
    assert lattice.unproven(PIECES) == ["▁" * 16]
    rng = random.Random(8)
    for _ in range(3000):
        word = "▁" + "".join(rng.choices("theinonrstac-=.", k=rng.randint(1, 14)))
        assert lattice.fold(word, found, 16) == lattice.merge(word, found)


def test_language_id(spark):
    rng = random.Random(9)
    words = {"en": ["the", "house", "with", "thing"], "de": ["der", "über", "nicht", "haus"], "fr": ["été", "les", "maison", "que"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=20)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    test = [(1, None), (2, ""), (3, "12 34 !"), (4, "The thing with THE house" * 9), (None, "nicht über haus"), (5, "les été")]
    got = {r.doc_id: r for r in language_id.predict(table(spark, test), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, None, 5)] == ["und", "und", "und", "en", "de", "fr"]
    assert got[3].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.predict(table(spark, []), model).count() == 0
    unlearned = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(table(spark, test), unlearned).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language_id.op10_language_id(spark, "/root/testdata/sf0.001").filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95


def test_pieces_of_long_texts(monkeypatch):
    texts = ["the quick é brown fox 12 jumped" * 30, "", "ab"]
    whole = sorted(np.concatenate([b for _, b in language_id.ngrams(texts)]))
    monkeypatch.setattr(language_id, "PIECE", 37)
    assert sorted(np.concatenate([b for _, b in language_id.ngrams(texts)])) == whole
