"""WARC archives: writing, reading and revisit resolution.

Headers (id, payload digest, length) are shuffled by digest; of equal payloads one
record stays the response and the others become revisit records that refer to
it. Archives are written by the tasks into the shared folder, one gzip member per
record, with fresh headers. Each task writes files under names of its own and
reports their segments; the segment table, committed as Parquet, says which files
count, so files of failed or repeated attempts are never read.

Defined results
* A null payload is empty. Payloads are equal when SHA-1, length and a second
  64-bit hash agree. Below ``min_bytes`` every record is a response.
* Of equal payloads the largest id is the response; rows that repeat that id are
  responses too. A null id is a revisit of an original with an id; where all ids
  of a group are null, all are responses.
* A null url is written as ``urn:page:<id>``; control characters and spaces in
  urls are percent-encoded. Empty tables give an empty segment table and no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside.llm.common import fresh_path, stored

MIN_REVISIT_BYTES = 1000
SEGMENT_BYTES = 8 << 20    # compressed bytes that one reading task takes at a time
MAX_READERS = 50_000       # reading tasks; beyond it a task takes several segments
FILE_BYTES = 512 << 20     # compressed bytes after which a task starts a new file
GZIP_LEVEL = 5
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD_SPACE = uuid.UUID("6f1d6a52-3a41-5f0e-9f43-0d4c5bb1f1a7")
SEGMENT_SCHEMA = "path string, start long, length long, records long"
RECORD_SCHEMA = ("page_id long, record_id string, record_type string, url string, refers_record string, "
                 "payload_bytes long, payload_digest string, payload binary")


def headers(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, check): one row per input row."""
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"),
        F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body.cast("binary")).alias("payload_digest"),
        F.xxhash64(body).alias("check"))


def resolve_revisits(heads: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``heads`` with ``refers_to``: the id of the original of equal payload, null for responses.

    Only headers are grouped (with partial maxima), so a payload that a third of
    all rows share costs one row per task. The originals of repeated payloads are
    joined back by digest; Spark broadcasts them where small and splits hot digests.
    """
    key = ["payload_digest", "payload_bytes", "check"]
    # written, so that payloads are shuffled only where the repeated digests are too many to broadcast
    originals = stored(heads.filter(F.col("payload_bytes") >= min_bytes).groupBy(*key)
                       .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
                       .filter("n > 1 AND original IS NOT NULL").drop("n"), "warc-originals", "none")
    out = heads.join(originals, key, "left")
    own = F.col("page_id").eqNullSafe(F.col("original"))
    return out.withColumn("refers_to", F.when(F.col("original").isNotNull() & ~own, F.col("original"))).drop("original")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_RECORD_SPACE, f'{page_id}:{digest}')}>"


def _sha1_field(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _clean_url(url: str | None, page_id: int | None) -> str:
    if url is None:
        return f"urn:page:{page_id}"
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{x:02X}" for x in c.encode("utf-8", "replace"))
                   for c in url)


def record_bytes(page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record, response or revisit."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)),
              ("WARC-Date", DATE), ("WARC-Target-URI", _clean_url(url, page_id)),
              ("WARC-Payload-Digest", _sha1_field(digest)), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def write_archives(resolved: DataFrame, directory: str | None = None) -> DataFrame:
    """Write one record per row; returns the committed segment table (path, start, length, records)."""
    directory = directory or fresh_path(resolved.sparkSession, "warc")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(directory)
        fs.create_dir(base, recursive=True)
        out, name, at, start, records, done = None, "", 0, 0, 0, []

        def segment():
            nonlocal start, records
            if records:
                done.append((name, start, at - start, records))
            start, records = at, 0

        for b in batches:
            for page_id, url, payload, size, digest, refers_to in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    file = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, name, at, start = fs.open_output_stream(f"{base}/{file}", compression=None), f"{directory}/{file}", 0, 0
                pack = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                member = pack.compress(record_bytes(page_id, url, (payload or "").encode("utf-8", "surrogatepass"),
                                                    size, digest, refers_to)) + pack.flush()
                out.write(member)
                at, records = at + len(member), records + 1
                if at - start >= SEGMENT_BYTES:
                    segment()
                if at >= FILE_BYTES:
                    segment()
                    out.close()
                    out = None
        if out is not None:
            segment()
            out.close()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("path", "start", "length", "records"), x)) for x in done],
            schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("records", pa.int64())]))

    rows = resolved.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
                           "payload_bytes", "payload_digest", "refers_to")
    return stored(rows.mapInArrow(task, SEGMENT_SCHEMA), "warc-segments")


def parse_records(stream, length: int | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of a (gzipped) WARC stream, one at a time."""
    buf, packed, plain, left = b"", b"", None, length
    unzip = zlib.decompressobj(31)

    def more() -> bool:
        nonlocal buf, packed, plain, left, unzip
        data = packed
        if not data:
            data = stream.read(1 << 18 if left is None else min(1 << 18, left))
            if left is not None:
                left -= len(data)
        packed = b""
        if not data:
            return False
        if plain is None:
            plain = data[:2] != b"\x1f\x8b"
        if plain:
            buf += data
            return True
        buf += unzip.decompress(data)
        if unzip.eof:
            packed, unzip = unzip.unused_data, zlib.decompressobj(31)
        return True

    while True:
        buf = buf.lstrip(b"\r\n")
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                if buf:
                    raise ValueError("truncated WARC record")
                return
            buf = buf.lstrip(b"\r\n")
        lines = buf[:end].decode("utf-8", "surrogatepass").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size, buf = int(fields["content-length"]), buf[end + 4:]
        parts, have = [buf], len(buf)
        while have < size + 4:
            buf = b""
            if not more():
                raise ValueError("truncated WARC block")
            parts.append(buf)
            have += len(buf)
        whole = b"".join(parts)
        buf = whole[size + 4:]
        yield fields, whole[:size]


def read_archives(segments: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archive segments (``RECORD_SCHEMA``); payload and its length are null for revisits.

    Digests of responses are taken from the payload that was read, those of
    revisits from their headers.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
                           ("url", pa.string()), ("refers_record", pa.string()), ("payload_bytes", pa.int64()),
                           ("payload_digest", pa.string()), ("payload", pa.binary())])
        rows, size = [], 0
        for b in batches:
            for path, start, length in zip(*[c.to_pylist() for c in b.columns]):
                fs, name = _file_system(path)
                with fs.open_input_file(name) as f:
                    f.seek(start)
                    for fields, block in parse_records(f, length):
                        kind, digest, n, payload = fields["warc-type"], None, None, None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        elif kind == "revisit":
                            digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                        page = fields.get("x-page-id")
                        rows.append((None if page is None else int(page), fields["warc-record-id"], kind,
                                     fields.get("warc-target-uri"), fields.get("warc-refers-to"), n, digest,
                                     payload if with_payload else None))
                        size += len(block) if with_payload else 200
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kinds)], schema=kinds)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kinds)], schema=kinds)

    # a given number of partitions is not merged, however small the segment table is
    n = max(1, min(segments.count(), MAX_READERS))
    return segments.select("path", "start", "length").repartition(n).mapInArrow(task, RECORD_SCHEMA)


def join_revisits(records: DataFrame) -> DataFrame:
    """Each record with the id and payload length of the response it refers to.

    Responses that were written twice (a repeated row) are one target.
    """
    origin = (records.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_record"))
              .agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("origin_bytes")))
    return records.join(origin, "refers_record", "left").select(
        "page_id", F.coalesce("payload_bytes", "origin_bytes").alias("payload_bytes"), "payload_digest",
        "record_type", "refers_to", "url", "record_id")
