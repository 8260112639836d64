"""Operator 5: token ids in binary files, with Elias-Fano document boundaries.

A file holds, in ascending document order:

- a header: magic, bytes an id, documents, of these without an id, ids, smallest document id;
- the ids of all documents one after the other, as little-endian unsigned 16- or 32-bit integers;
- the Elias-Fano sequence of the boundaries (documents + 1 offsets into the ids);
- the Elias-Fano sequence of the document ids less the smallest.

``manifest.json`` lists the files in order with their counts. Files are written under a name of
their attempt and renamed when whole, so a task that runs twice leaves one file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from namtok.llm import elias_fano, word_tokens
from namtok.llm.common import shared_dir, slices, table

HEADER = "<8sB7xQQQq"
SIZE = struct.calcsize(HEADER)
MAGIC = b"NTIDS001"
READ = 1 << 22


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class TokenFile:
    """Reads one file: ``ids(i)`` of any document by select, or every document in order."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        magic, width, self.n_docs, self.n_null, self.n_ids, self.least = struct.unpack(HEADER, self.file.read_at(SIZE, 0))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.dtype = np.dtype(f"<u{width}")
        at = SIZE + self.n_ids * width
        tail = self.file.read_at(self.file.size() - at, at)
        self.bounds = elias_fano.Sequence(tail)
        self.doc_ids = elias_fano.Sequence(tail[self.bounds.size :])

    def ids(self, i: int) -> np.ndarray:
        width, start = self.dtype.itemsize, self.bounds[i]
        return np.frombuffer(self.file.read_at((self.bounds[i + 1] - start) * width, SIZE + start * width), self.dtype)

    def documents(self) -> list[int | None]:
        return [None] * self.n_null + [int(x) + self.least for x in self.doc_ids.all()]

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        """(start, ids) of each document, read in pieces of READ ids or one document."""
        bounds, width, i = self.bounds.all().astype(np.int64), self.dtype.itemsize, 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + READ, "right")) - 1)
            piece = np.frombuffer(self.file.read_at(int(bounds[j] - bounds[i]) * width, SIZE + int(bounds[i]) * width), self.dtype)
            for k in range(i, j):
                yield int(bounds[k]), piece[bounds[k] - bounds[i] : bounds[k + 1] - bounds[i]]
            i = j


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode whole texts and write them to ``folder`` (a URI that all executors share); returns the manifest.

    Documents are range-partitioned and sorted by id (null ids first, equal ids by text), each
    partition streams into one file, and only a line per file comes to the driver. A null or
    empty text is the end id alone. An empty table gives an empty manifest.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((source, word_tokens.whole_tokens(Tokenizer.from_str(source))))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens.encoder(*shared.value)
        end, width, part = encoder.pack([end_id]), encoder.dtype.itemsize, TaskContext.get().partitionId()
        lengths, doc_ids, n_null, out, fs = [], [], 0, None, None
        name = f"part-{part:06d}.ids"
        for batch in slices(batches):
            if out is None and batch.num_rows:
                fs, base = _open(folder)
                fs.create_dir(base, recursive=True)
                attempt = f"{base}/.{name}.{uuid.uuid4().hex}"
                out = fs.open_output_stream(f"{attempt}.body")
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                packed = encoder.ids(text or b"") + end
                out.write(packed)
                lengths.append(len(packed) // width)
            n_null += batch.column(0).null_count
            doc_ids.append(batch.column(0).drop_null().to_numpy())
        if out is None:
            return
        out.close()
        bounds, ids = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate(doc_ids)
        least = int(ids[0]) if len(ids) else 0
        with fs.open_output_stream(attempt) as whole, fs.open_input_stream(f"{attempt}.body") as body:
            whole.write(struct.pack(HEADER, MAGIC, width, len(lengths), n_null, int(bounds[-1]), least))
            while piece := body.read(READ):
                whole.write(piece)
            whole.write(elias_fano.encode(bounds))
            whole.write(elias_fano.encode(ids.astype(np.uint64) - np.uint64(least % (1 << 64))))
        fs.delete_file(f"{attempt}.body")
        fs.move(attempt, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(lengths)], "n_ids": [int(bounds[-1])]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    manifest = sorted((r.asDict() for r in dealt.mapInArrow(write, "file string, n_docs long, n_ids long").collect()), key=lambda r: r["file"])
    start = 0
    for entry in manifest:
        entry["start"], start = start, start + entry["n_ids"]
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``."""
    fs, base = _open(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(f"{folder}/{name}")
                found = [(start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for at, ids in file]
                columns = [pa.array(file.documents(), pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, start long").repartition(max(1, len(manifest)))
    return files.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, folder)
