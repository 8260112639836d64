"""Operator 7: WARC archives as a PySpark data source, and a writer with revisit records.

``spark.read.format("warc").load(folder)`` after ``register(spark)``. Options:

- ``record_types``: comma-separated ``WARC-Type`` values to read;
- ``header.<Name>``: an exact value that this header must have;
- ``payload``: ``false`` leaves ``payload`` null.

Filters ``col("record_type") == …`` or ``isin(…)``, and the same on ``target_uri``, ``date`` and ``content_type``, are taken by
the reader. A record's headers are parsed first; the block of a record that isn't wanted is skipped by seeking, in plain files
and in gzip members whose header tells their length (the ``sl`` field that the writer sets), and is never inflated or decoded.
Other gzip members have to be inflated to find their end.

What isn't a whole record (no ``WARC/`` line, a bad or too large ``Content-Length``, a truncated member) gives a row of the
type ``malformed`` with the file and offset, and reading goes on at the next member or line that begins a record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from namtok.llm.common import join_unique, materialize, shared_dir, table

SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, content_length long, payload_digest string, refers_to string, headers map<string,string>, payload binary, file string, offset long"
#: Columns that equal a header's value as it stands.
COLUMNS = {"record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type"}
#: Type of the rows that tell of what isn't a whole record.
MALFORMED = "malformed"
#: Bytes after which the writer begins a further file, and bytes read at once.
FILE_BYTES, READ = 1 << 27, 1 << 20
#: Bytes of a gzip member that are read and inflated at once until its headers are whole.
HEAD = 4096


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _File(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _length(headers: dict[str, str]) -> int | None:
    """The block's length; None if it isn't a number."""
    text = headers.get("content-length", "0")
    return int(text) if re.fullmatch("[0-9]+", text) else None


def packed(record: bytes) -> bytes:
    """A record as a gzip member that tells its length, compressed and not, in its header's ``sl`` field."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    number = lambda *n: b"".join(x.to_bytes(4, "little") for x in n)
    head = b"\x1f\x8b\x08\x04" + number(0) + b"\0\xff" + b"\x0c\0" + b"sl\x08\0"
    return head + number(len(head) + 16 + len(body), len(record)) + body + number(zlib.crc32(record), len(record))


def _member_bytes(raw: io.BufferedReader, start: int) -> int | None:
    """Length of the gzip member that begins here, if its header tells it."""
    raw.seek(start)
    head = raw.read(12)
    if len(head) < 12 or head[:2] != b"\x1f\x8b" or not head[3] & 4:
        return None
    extra = raw.read(int.from_bytes(head[10:], "little"))
    while len(extra) >= 4:
        size = int.from_bytes(extra[2:4], "little")
        if extra[:2] == b"sl" and size == 8 and len(extra) >= 12:
            return int.from_bytes(extra[4:8], "little") or None
        extra = extra[4 + size :]
    return None


def _member(raw: io.BufferedReader, start: int, size: int, wanted, payload: bool) -> tuple[dict[str, str], bytes | None] | None:
    """Headers and block of one member's record; None if it isn't wanted. ValueError if it isn't whole."""
    raw.seek(start)
    inflate, data, rest, left = zlib.decompressobj(31), b"", b"", size
    while not (blank := re.search(rb"\r?\n\r?\n", data)):
        if not rest:
            rest = raw.read(min(left, HEAD))
            left -= len(rest)
            if not rest:
                raise ValueError("headers without an end")
        data = (data + inflate.decompress(rest, HEAD)).lstrip(b"\r\n")
        rest = inflate.unconsumed_tail
    first, *lines = data[: blank.start()].splitlines()
    headers = _headers(lines)
    length = _length(headers)
    if not first.startswith(b"WARC/") or length is None:
        raise ValueError("no record")
    if not wanted(headers):
        return None
    if not payload:
        return headers, None
    data = data[blank.end() :] + inflate.decompress(rest + raw.read(left))
    if len(data) < length or not inflate.eof:
        raise ValueError("truncated")
    return headers, data[:length]


def _stream(f, wanted, payload: bool, size: int | None) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """The records of a plain file (of so many bytes) or of what gzip members inflate to, one after the other."""
    bad = {"warc-type": MALFORMED}
    lost = False  # if what comes is already told of as malformed
    while True:
        offset = f.tell()
        try:
            line = f.readline(READ)
            if not line:
                return
            if line in (b"\r\n", b"\n"):
                continue
            if not line.startswith(b"WARC/"):
                if not lost and wanted(bad):
                    yield offset, bad, None
                lost = True
                continue
            lines = []
            while (line := f.readline()).rstrip(b"\r\n"):
                lines.append(line.rstrip(b"\r\n"))
            headers = _headers(lines)
            length = _length(headers)
            whole = bool(line) and length is not None and (size is None or f.tell() + length <= size)
            lost = not whole
            if not whole:
                if wanted(bad):
                    yield offset, bad, None
            elif not wanted(headers):
                f.seek(length, 1)
            else:
                block = f.read(length) if payload else None
                if block is None:
                    f.seek(length, 1)
                elif len(block) < length:
                    raise EOFError
                yield offset, headers, block
        except (EOFError, zlib.error, gzip.BadGzipFile):
            if wanted(bad):
                yield offset, bad, None
            return


def records(uri: str, wanted: dict[str, set[str]], payload: bool) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """(offset, headers, block or None) of the records in a file whose headers have a wanted value each.

    The offset is the member's in the file where gzip members tell their length, else the record's in what they inflate to.
    """
    fs, path = _open(uri)
    with fs.open_input_file(path) as file:
        size = file.size()
        raw = io.BufferedReader(file, READ)
        match = lambda headers: all(headers.get(name.lower()) in values for name, values in wanted.items())
        if not path.endswith(".gz"):
            yield from _stream(raw, match, payload, size)
            return
        at = 0
        while at < size:
            n = _member_bytes(raw, at)
            if n is None:  # from here on the members don't tell
                raw.seek(at)
                yield from _stream(gzip.GzipFile(fileobj=raw), match, payload, None)
                return
            try:
                found = _member(raw, at, n, match, payload)
                if at + n > size:
                    raise ValueError("truncated")
            except (ValueError, zlib.error):
                bad = {"warc-type": MALFORMED}
                found = (bad, None) if match(bad) else None
            if found:
                yield at, *found
            at += n


def http_body(block: bytes) -> bytes:
    """What follows the HTTP headers of a response's block."""
    head, found, body = block.partition(b"\r\n\r\n")
    return body if found and head.startswith(b"HTTP/") else block


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.wanted: dict[str, set[str]] = {k[7:]: {v} for k, v in options.items() if k.lower().startswith("header.")}
        if types := options.get("record_types"):
            self.wanted["WARC-Type"] = {t.strip() for t in types.split(",")}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = COLUMNS.get(f.attribute[0]) if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name is None:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) - {None}
            self.wanted[name] = self.wanted[name] & values if name in self.wanted else values

    def partitions(self) -> list[InputPartition]:
        """A partition for each file; the writer bounds their size."""
        fs, base = _open(self.folder)
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
        root = self.folder.rstrip("/")
        return [_File(root + x.path[len(base.rstrip("/")) :]) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition: _File | None) -> Iterator[tuple]:
        if partition is None:  # Spark asks once where there are no partitions
            return
        for offset, h, block in records(partition.uri, self.wanted, self.payload):
            body = None if block is None else http_body(block) if h.get("warc-type") in ("response", "revisit") else block
            digest, refers = h.get("warc-payload-digest"), h.get("warc-refers-to")
            yield (
                h.get("warc-record-id", "").strip("<>") or None, h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), _length(h),
                digest and digest.partition(":")[2], refers and refers.strip("<>"), h, body, partition.uri, offset,
            )


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known, and let Spark offer filters to Python sources, without which it refuses this one."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, record_id: str, uri: str | None, digest: str, length: int, payload: bytes, refers_to: str | None) -> bytes:
    """One record. A revisit keeps the HTTP headers alone; X-Payload-Length tells its payload's length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}", f"Content-Length: {len(block)}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + " ".join(uri.split()))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", least_bytes: int = 0, compress: bool = True) -> None:
    """Write a record per row to files of about FILE_BYTES in ``folder`` (a URI that all executors share).

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of ``least_bytes``
    or more, those with the smallest id are responses and the others are revisits of it; smaller
    payloads are all responses. A null id comes after all others; rows whose payload stands at no
    other id than null are responses. Ids may repeat with other payloads: a revisit's target is the
    response of its id and its payload's digest. An empty table gives no file. Payloads of any length are
    written whole. Files are gzip members, one a record, unless ``compress`` is off. Digests are grouped and joined without the
    payloads, hot ones by broadcast; rows meet their revisit by id and digest, which are spread evenly.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    digests = pages.select(F.sha1(html).alias("digest"), F.octet_length(html).alias("n"), F.col(id_col).cast("long").alias("id"))
    firsts = materialize(digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "warc-digests")
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    revisits = digests.filter(F.col("n") >= least_bytes).drop("n")
    revisits = join_unique(revisits, firsts, "digest", "n", total).filter("first is not null and (id is null or id <> first)").select(F.col("id").alias("key"), F.col("digest").alias("same"), "first").dropDuplicates(["key", "same"])
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), html.alias("html"), F.sha1(html).alias("digest"))
    rows = rows.join(revisits, rows["id"].eqNullSafe(revisits["key"]) & (rows["digest"] == revisits["same"]), "left").select("id", "uri", "html", "first")
    suffix = ".warc.gz" if compress else ".warc"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, n, files = TaskContext.get().partitionId(), 0, None, 0, []
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for page_id, uri, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    attempt = f"{base}/.{part}-{number}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(attempt, compression=None)
                    files.append((attempt, f"{base}/part-{part:06d}-{number:06d}{suffix}"))
                kind = "response" if first is None else "revisit"
                record = _record(kind, _id(page_id), uri, base32_sha1(payload), len(payload), payload, None if first is None else _id(first))
                out.write(packed(record) if compress else record)
                n += 1
                if out.tell() >= FILE_BYTES:
                    out.close()
                    out, number = None, number + 1
        if out is not None:
            out.close()
        for attempt, name in files:
            fs.move(attempt, name)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_pages(spark: SparkSession, folder: str, id_col: str = "page_id") -> DataFrame:
    """Per record: id, ``payload_bytes`` and ``payload_digest`` of the full payload, ``record_type``, ``refers_to``.

    A response's length and digest are taken from the payload that is read, a revisit's from its
    headers, without its block.
    """
    register(spark)
    responses = spark.read.format("warc").load(folder).filter("record_type = 'response'")
    revisits = spark.read.format("warc").option("payload", "false").load(folder).filter("record_type = 'revisit'")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in payloads], pa.int64()), pa.array([base32_sha1(x) for x in payloads])], ["record_id", "payload_bytes", "payload_digest"])

    number = lambda c: F.expr(f"nullif(substring({c}, 10), '')").cast("long")
    full = responses.select("record_id", "payload").mapInArrow(own, "record_id string, payload_bytes long, payload_digest string")
    full = full.select(number("record_id").alias(id_col), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = revisits.select(number("record_id").alias(id_col), F.col("headers")["x-payload-length"].cast("long").alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), number("refers_to").alias("refers_to"))
    return full.unionByName(again)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_pages(spark, folder)


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, ((i // 4) * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM m
"""
