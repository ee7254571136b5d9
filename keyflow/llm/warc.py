"""WARC archives, written one gzip member a record and read back in byte ranges.

Writing: of records with equal payloads of at least `REVISIT_BYTES` bytes, those with the largest id are responses
and the others revisits without payload. A task turns its records into gzip members, and Spark's text writer puts
them end to end: its separator is the zero byte with which a member's stored length ends, and a member of 16 MB or
more is followed by an empty one. The files are thus committed like any other output of Spark, on any file system.

Reading: the files' listing is cut into byte ranges. A task looks for gzip's magic bytes from its range's start,
takes a candidate for a member only if it decodes to a WARC version line and headers that name a type, an id and a
length, reads records one after another from there (past the range's end if the last needs it), and owns those that
start inside. A member with such headers that then ends early, doesn't inflate, or is shorter than its length says, is a
row of type `broken` with what its headers say, without payload and digest; the search goes on behind its first byte.
Empty members hold no record.

Defined results: null html is an empty payload; ids that repeat with equal payloads are responses if they are the
largest; a null id is smaller than any other; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES, RANGE_BYTES = 1000, 4 << 20
MAGIC = b"\x1f\x8b\x08"
#: Bytes read at a time, those inflated at a time before the headers are whole, and the most that headers may have.
_READ, _FIRST, _HEAD = 1 << 18, 512, 1 << 16
_VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
NEEDED = ("warc-type", "warc-record-id", "content-length")


def member(data: bytes) -> bytes:
    """One gzip member whose last byte is zero (large ones are followed by an empty member), without that byte."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(data) + pack.flush()
    if out[-1]:
        empty = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += empty.flush()
    return out[:-1]


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str = "1970-01-01T00:00:00Z") -> bytes:
    uri = quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Archive page_id, url, html under `path`; all records have one date, by default the present."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).alias("size"), F.sha1(payload).alias("digest"))
    # payloads are equal if their lengths and both digests are
    keys = ["size", "digest", "strong"]
    pages = pages.withColumn("strong", F.when(F.col("size") >= REVISIT_BYTES, F.xxhash64("payload")))
    first = pages.where(F.col("size") >= REVISIT_BYTES).groupBy(*keys).agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pages = pages.join(first, keys, "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))

    def members(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in common.slices(batches, 200):
            out = [member(record(*x, date)) for x in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    packed = pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(members, "member binary")
    packed.select(F.expr("CAST(member AS STRING)").alias("value")).write.option("lineSep", "\0").text(path)


def opened(path: str):
    """A seekable Arrow file for a local path or a URI that Arrow's file systems know."""
    from pyarrow import fs

    if "://" not in path:
        path = path.removeprefix("file:")
        return fs.LocalFileSystem().open_input_file(path)
    found, inner = fs.FileSystem.from_uri(path)
    return found.open_input_file(inner)


class Window:
    """Bytes of a file from a position on, read in pieces as they are asked for."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data, self.ended = file, at, b"", False

    def more(self) -> bool:
        if not self.ended:
            got = self.file.read_at(_READ, self.at + len(self.data))
            self.ended = not got
            self.data += got
        return not self.ended

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def headers(data: bytes) -> dict[str, str] | None:
    """The fields of a record's headers, names lowered; None if they aren't whole or lack what all records have."""
    head, end, _ = data.partition(b"\r\n\r\n")
    if not end or not _VERSION.match(data):
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields if all(fields.get(k) for k in NEEDED) and fields["content-length"].isdecimal() else None


def inflate(window: Window) -> tuple[dict[str, str], bytes | None, int] | None:
    """Of the member at the window's start: the record's headers, its block, and the member's length. The block is None
    and the length 1 if the member is broken; None if no member with a record's headers is there."""
    unpack, out, fed, size, head = zlib.decompressobj(31), [], 0, 0, None
    try:
        while not unpack.eof and (fed < len(window.data) or window.more()):
            part = window.data[fed : fed + (_FIRST if head is None else _READ)]
            out.append(unpack.decompress(part))
            fed += len(part)
            size += len(out[-1])
            if head is None and (size >= 5 or unpack.eof):
                begun = b"".join(out)
                if not begun.startswith(b"WARC/") or (head := headers(begun)) is None and (unpack.eof or size > _HEAD):
                    return None
    except zlib.error:
        pass
    if head is None:
        return None
    block = b"".join(out).partition(b"\r\n\r\n")[2]
    n = int(head["content-length"])
    return (head, block[:n], fed - len(unpack.unused_data)) if unpack.eof and len(block) >= n else (head, None, 1)


def records(file, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and blocks of the records that start in [start, end)."""
    window = Window(file, start)
    while window.at < end:
        while (k := window.data.find(MAGIC)) < 0 and window.at + len(window.data) < end + 2 and window.more():
            window.drop(max(0, len(window.data) - 2 - _READ))
        if k < 0 or window.at + k >= end:
            return
        window.drop(k)
        if found := inflate(window):
            yield found[:2]
            window.drop(found[2])
        else:
            window.drop(1)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """record_type, record_id, refers_to, url, payload, payload_digest (as computed, or a revisit's header)."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the listing: contents aren't read
    ranges = files.where("length > 0").select("path", F.explode(F.expr(f"sequence(0L, length - 1, {range_bytes}L)")).alias("start"))
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")

    def rows(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                out: list[tuple] = []
                with opened(path) as file:
                    for head, block in records(file, start, start + range_bytes):
                        kind, payload, digest = head["warc-type"], None, None
                        if block is None:
                            kind = "broken"
                        elif kind == "revisit":
                            digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
                        else:
                            payload = block.partition(b"\r\n\r\n")[2]
                            digest = hashlib.sha1(payload).hexdigest()
                        out.append((kind, head["warc-record-id"], head.get("warc-refers-to"), head.get("warc-target-uri"), payload, digest))
                        if len(out) == 200:
                            yield batch_of(out)
                            out = []
                yield batch_of(out)

    def batch_of(out):
        import pyarrow as pa

        kinds = [pa.string()] * 4 + [pa.binary(), pa.string()]
        columns = list(zip(*out)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["record_type", "record_id", "refers_to", "url", "payload", "payload_digest"])

    return ranges.mapInArrow(rows, "record_type string, record_id string, refers_to string, url string, payload binary, payload_digest string")


def page_number(column: str):
    return F.expr(f"try_cast(regexp_extract({column}, '<urn:page:(-?[0-9]+)>', 1) AS BIGINT)")


def archived(pages: DataFrame) -> DataFrame:
    """Write `pages` to the shared folder and read them back; a revisit's length is that of the response it refers to."""
    import uuid

    spark = pages.sparkSession
    path = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    found = read(spark, path).select(
        page_number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("own_bytes"), F.col("payload_digest"), "record_type", page_number("refers_to").alias("refers_to")
    )
    found = common.materialize(found, "warc-read")
    # a response that records refer to, once each: the side that can be large is the revisits'
    lengths = found.where("record_type = 'response'").select(F.col("page_id").alias("of_id"), F.col("payload_digest").alias("of_digest"), F.col("own_bytes").alias("of_bytes")).distinct()
    same = (found["refers_to"] == lengths["of_id"]) & (found["payload_digest"] == lengths["of_digest"])
    return found.join(lengths, same, "left").select("page_id", F.coalesce("own_bytes", "of_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(common.table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM m
"""
