"""WARC archives: written by tasks, indexed first, read back by coalesced byte ranges.

Each task writes one archive of gzip members, one member per record, under a name of its own,
and returns an index row per record: file, offset, length, URL, digest. The index is a written
table; only rows of tasks that ended well are in it, so an archive left by a lost executor is
never read. A later read selects index rows, sorts them by file and offset and fetches
neighbouring ranges with one read each.

Files go through ``pyarrow.fs``, so the shared folder may be any store it knows.

Defined cases: a null payload is empty, a null URL is an empty target. Of equal payloads of at
least ``min_bytes`` the smallest page_id is the response, others revisit it; rows that share
that page_id are responses as well, and so is a null page_id (it can't be referred to). An
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import binary_values, fresh_dir, staged

_INDEX_SQL = "page_id long, url string, record_type string, refers_to long, payload_digest string, file string, offset long, length long"
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_READ_SQL = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary"
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Spark's name for a store as Arrow knows it: the s3a and s3n schemes are s3 there."""
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One WARC 1.1 record; a revisit has the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, http, payload


def gz(raw: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _write(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, uri = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            rows = []
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to")]
            for page_id, url, refers, payload in zip(*cols, binary_values(batch, "payload")):
                if out is None:
                    fs, path = filesystem(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                digest = digest32(payload)
                member = gz(record(page_id, url or "", payload, digest, refers), level)
                out.write(member)
                rows.append((page_id, url, "response" if refers is None else "revisit", refers, digest, uri, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _INDEX)], schema=_INDEX)
        if out is not None:
            out.close()

    return run


def write(pages: DataFrame, min_bytes: int = 0, level: int = 1, folder: str | None = None) -> DataFrame:
    """Write a record per page; the index, as a written table.

    ``pages`` has page_id, url and html. Digests are grouped to find the response of each
    payload; only payloads that occur more than once are joined back, so a payload of a third
    of all pages costs one row.
    """
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    named = pages.select(F.col("page_id").cast("long"), "url", body.alias("payload"), F.sha1(body).alias("__sha1"))
    sizes = named.where(F.octet_length("payload") >= min_bytes) if min_bytes else named
    first = sizes.groupBy("__sha1").agg(F.min("page_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    marked = named.join(first, "__sha1", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("__first"), F.col("__first")))
    return staged(marked.select("page_id", "url", "refers_to", "payload").mapInArrow(_write(folder, level), _INDEX_SQL), "warc-index")


def _read(max_gap: int, max_span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] | None = None

        def fetch(uri: str, at: int, size: int) -> bytes:
            nonlocal opened
            if opened is None or opened[0] != uri:
                fs, path = filesystem(uri)
                opened = (uri, fs.open_input_file(path))
            opened[1].seek(at)
            return opened[1].read(size)

        def emit(group: list[tuple[str, int, int]]) -> pa.RecordBatch:
            uri, start = group[0][0], group[0][1]
            raw, rows = fetch(uri, start, group[-1][1] + group[-1][2] - start), []
            for _, offset, length in group:
                fields, _, payload = parse(zlib.decompress(raw[offset - start : offset - start + length], 31))
                ids = [fields.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("WARC-Record-ID", "WARC-Refers-To")]
                page, refers = (int(x) if x else None for x in ids)
                rows.append((page, fields["WARC-Target-URI"], fields["WARC-Type"], refers, fields["WARC-Payload-Digest"].removeprefix("sha1:"), payload if fields["WARC-Type"] == "response" else None))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _READ)], schema=_READ)

        group: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if group and (row[0] != group[0][0] or row[1] - group[-1][1] - group[-1][2] > max_gap or row[1] + row[2] - group[0][1] > max_span):
                    yield emit(group)
                    group = []
                group.append(row)
        if group:
            yield emit(group)

    return run


def read(index: DataFrame, max_gap: int = 65_536, max_span: int = 4 << 20) -> DataFrame:
    """The selected records of an index; a revisit's payload is null.

    Rows are dealt by file and offset, so that a task reads stretches of few files.
    """
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read(max_gap, max_span), _READ_SQL)


def digests(records: DataFrame) -> DataFrame:
    """What a read says of each record, revisits with the size of the payload they refer to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column("payload").to_pylist()
            stored = batch.column("payload_digest").to_pylist()
            own = [d if p is None else digest32(p) for p, d in zip(payloads, stored)]
            if own != stored:
                raise ValueError("a payload doesn't have the digest of its record")
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "payload_bytes": pa.array([None if p is None else len(p) for p in payloads], pa.int64()), "payload_digest": batch.column("payload_digest"), "record_type": batch.column("record_type"), "refers_to": batch.column("refers_to")})

    found = staged(records.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "warc-read")
    sizes = found.where("record_type = 'response'").join(found.where("record_type = 'revisit'").select("payload_digest").distinct(), "payload_digest", "left_semi").groupBy("payload_digest").agg(F.max("payload_bytes").alias("__bytes"))
    return found.join(sizes, "payload_digest", "left").select("page_id", F.coalesce("payload_bytes", "__bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
