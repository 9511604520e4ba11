"""WARC records in ZIP-packaged archives: a writer and a reader that never extracts.

An archive is a ZIP file with two stored members, ``archive/data.warc.gz`` (one gzip
member a record) and ``indexes/index.cdxj`` (a line a record with its offset and length).
The reader takes an archive's end of central directory, or its ZIP64 form, lists the
members, locates the stored WARC member and its index, and reads each record by its byte
range. Index entries are dealt out by archive and block, so a large archive is read by
many tasks.

``packaged`` writes a table of pages and ``read_back`` reads the archives. Archives are
written under names of their own for each attempt; only those of the attempts that Spark
kept are in the returned manifest.

Defined results: a null html is an empty payload; a null url leaves the target out; rows
with a null page_id keep it null and never become the record that others refer to unless
all are null; of repeated rows with the largest page_id all are responses; an empty table
gives no archive and an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

REVISIT_FROM, BROADCAST_ROWS = 1000, 200_000  # a row is some 60 bytes
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "1970-01-01T00:00:00Z"


def decided(pages: DataFrame, least: int = REVISIT_FROM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, payload, digest, bytes, refers_to); payload is null for revisits.

    Only ids and digests are shuffled to find payloads that repeat. What they refer to is
    broadcast up to ``broadcast_rows`` payloads; beyond that rows go to their digests, each
    small page to a key of its own.
    """
    whole = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", whole.alias("payload")).withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    large = F.col("bytes") >= least
    shared = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    shared = stored(shared.filter("_n > 1 and _last is not null").select(F.col("digest").alias("_key"), "_last"))
    if shared.count() <= broadcast_rows:
        shared = F.broadcast(shared)
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("small "), F.xxhash64("page_id", "digest").cast("string")))
    rows = rows.join(shared, key == F.col("_key"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))
    return rows.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "digest", "bytes", refers.alias("refers_to"))


def record(page: object, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: object) -> bytes:
    """One WARC record; a revisit has the HTTP header of the full payload and no body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = http + (payload or b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def packaged(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes the archives; returns their manifest (path, records), already materialised."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        index, at = [], 0
        with fs.open_output_stream(f"{base}/{name}") as raw, zipfile.ZipFile(_Forward(raw), "w", zipfile.ZIP_STORED) as archive:
            with archive.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
                batch = first
                while batch is not None:
                    for row in batch.to_pylist():
                        packer = zlib.compressobj(level, wbits=31)
                        one = record(row["page_id"], row["url"], row["payload"], row["digest"], row["bytes"], row["refers_to"])
                        one = packer.compress(one) + packer.flush()
                        data.write(one)
                        index.append(json.dumps({"url": row["url"], "offset": at, "length": len(one)}))
                        at += len(one)
                    batch = next(batches, None)
            with archive.open(zipfile.ZipInfo(INDEX), "w") as lines:
                lines.write("\n".join(index).encode())
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(index)], pa.int64())})

    return stored(decided(pages).mapInArrow(write, "path string, records long"))


class _Forward(io.RawIOBase):
    """A stream that can only be written, as object stores offer it."""

    def __init__(self, to):
        self.to = to

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.to.write(data)
        return len(data)


def members(file, size: int) -> dict[str, tuple[int, int, int, int]]:
    """name: (method, packed size, size, local header offset), from the central directory.

    ``file`` needs seek() and read(). ZIP64 end records and extra fields are followed
    wherever a 16- or 32-bit field is saturated.
    """
    tail_at = max(0, size - 65557)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if (count == 0xFFFF or 0xFFFFFFFF in (length, start)) and tail[end - 20 : end - 16] == b"PK\x06\x07":
        file.seek(struct.unpack("<Q", tail[end - 12 : end - 4])[0])
        wide = file.read(56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory where its locator points")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    file.seek(start)
    listing, found, at = file.read(length), {}, 0
    for _ in range(count):
        if listing[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", listing[at + 10 : at + 12])
        packed, plain, n, extra, comment = struct.unpack("<IIHHH", listing[at + 20 : at + 34])
        offset, = struct.unpack("<I", listing[at + 42 : at + 46])
        name = listing[at + 46 : at + 46 + n].decode()
        field, stop = at + 46 + n, at + 46 + n + extra
        while field + 4 <= stop:
            kind, width = struct.unpack("<HH", listing[field : field + 4])
            if kind == 1:  # 8-byte values of just the saturated fields, in this order
                values = iter(struct.unpack(f"<{width // 8}Q", listing[field + 4 : field + 4 + width // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                offset = next(values) if offset == 0xFFFFFFFF else offset
            field += 4 + width
        found[name] = (method, packed, plain, offset)
        at = stop + comment
    return found


def data_start(file, member: tuple[int, int, int, int]) -> int:
    """Where a member's bytes begin: its local header has name and extra lengths of its own."""
    file.seek(member[3])
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header where the central directory points")
    return member[3] + 30 + sum(struct.unpack("<HH", head[26:30]))


def _opened(path: str):
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    file = fs.open_input_file(at)
    return file, file.size()


def located(archives: DataFrame) -> DataFrame:
    """(path, offset, length) of every record, absolute in the archive, from the indexes."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                file, size = _opened(path)
                with file:
                    found = members(file, size)
                    if found[DATA][0] != zipfile.ZIP_STORED:
                        raise ValueError(f"{path}: {DATA} is compressed as a whole, so its records have no byte range")
                    begin = data_start(file, found[DATA])
                    file.seek(data_start(file, found[INDEX]))
                    lines = file.read(found[INDEX][1])
                    if found[INDEX][0] == zipfile.ZIP_DEFLATED:
                        lines = zlib.decompress(lines, -15)
                entries = [json.loads(x) for x in lines.splitlines()]
                for at in range(0, len(entries), 10_000):
                    part = entries[at : at + 10_000]
                    yield pa.RecordBatch.from_pydict({"path": [path] * len(part), "offset": pa.array([begin + e["offset"] for e in part], pa.int64()), "length": pa.array([e["length"] for e in part], pa.int64())})

    return archives.select("path").mapInArrow(locate, "path string, offset long, length long")


def parsed(raw: bytes) -> dict:
    """The headers and payload of one record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    sent = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(sent["Content-Length"])):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload isn't what its record says")
    page = lambda name: fields.get(name, "<urn:page:>")[10:-1] or None
    return {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None, "payload_bytes": int(sent["Content-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": page("WARC-Refers-To")}


_READ = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])


def read_back(archives: DataFrame, block: int = 32 << 20, records: int | None = None) -> DataFrame:
    """Every record of the archives by its byte range; ids as text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            rows, held = [], 0
            for to, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if to != path:
                    if file is not None:
                        file.close()
                    path, (file, _) = to, _opened(to)
                file.seek(offset)
                rows.append(parsed(zlib.decompress(file.read(length), 31)))
                held += rows[-1]["payload_bytes"]
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _READ)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, _READ)
        if file is not None:
            file.close()

    spans = located(archives.repartition("path")).repartition("path", F.floor(F.col("offset") / block)).sortWithinPartitions("path", "offset")
    return spans.mapInArrow(read, "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = dict(pages.dtypes)["page_id"]
    got = read_back(packaged(pages, f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"))
    return got.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages
), q AS (
  SELECT page_id, n, sha1(body) AS digest,
         CASE WHEN n >= {REVISIT_FROM} THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS last
  FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM q
"""
