"""WARC archives: a writer that goes through Spark's own commit, and a splittable reader.

Every record is a gzip member of its own. The reader cuts the archives into byte ranges; the task of
a range looks for the gzip magic, validates a candidate by decoding the head of its record, and owns
the records that start inside the range, the last of which may reach beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, table

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 4 << 20
#: Ranges that a task reads when there are more than the cores can have at once.
RANGES_TOGETHER = 16
READ_BYTES = 1 << 20
#: What every record begins with.
HEAD = b"WARC/"
GZIP_LEVEL = 4
#: A fixed date: archives of the same pages are the same.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None, number: int = 0) -> str:
    """A page's name; a page without an id is told from others by a record number."""
    return f"<urn:record:{number}>" if page_id is None else f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, number: int = 0) -> bytes:
    """One WARC record. A revisit holds the response's head only, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, number)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Truncated: length"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


_EMPTY_MEMBER = _member(b"")


def ending_in_zero(member: bytes) -> bytes:
    """``member``, followed by an empty one if its last byte (the high one of its length) isn't zero."""
    return member if member[-1] == 0 else member + _EMPTY_MEMBER


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> None:
    """Write a record per row into gzipped archives under ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes that with the smallest id holds the
    payload and the others revisit it; shorter payloads are always held. A null html is an empty
    payload and a null url an empty one. Of rows with the smallest id each holds the payload. A row with
    a null id is a record of its own, named by a number; it revisits a page with an id, and no record revisits it. Further
    columns are ignored.

    Files are written by the text writer, and so through the file system and the commit protocol
    of the cluster: the members' bytes are its lines, and its line separator is the zero byte in
    which every member ends. Repeated payloads are found on their digests, partially aggregated before
    the shuffle.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    digests = rows.where(F.col("bytes") >= min_bytes).select("id", "sha")
    repeated = digests.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    joined = rows.join(repeated, "sha", "left")
    refers = F.when((F.col("bytes") >= min_bytes) & (F.col("id").isNull() | (F.col("first") < F.col("id"))), F.col("first"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            size = 0
            html = batch.column(2).cast(pa.binary())
            for i in range(batch.num_rows):
                payload = html[i].as_py()
                digest = base64.b32encode(bytes.fromhex(batch.column(3)[i].as_py())).decode()
                member = ending_in_zero(_member(record(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), payload, digest, batch.column(4)[i].as_py(), batch.column(5)[i].as_py())))
                out.append(member[:-1])
                size += len(member)
                if size > READ_BYTES * 8:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    members = joined.select("id", "url", "html", "sha", refers.alias("refers_to"), F.monotonically_increasing_id().alias("number")).mapInArrow(pack, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


class _Range:
    """A file's bytes from a place on, read block by block; ``at`` is the place of the first byte held."""

    def __init__(self, read_at: Callable[[int, int], bytes], at: int, size: int):
        self.read_at, self.at, self.size, self.data = read_at, at, size, b""

    def more(self, used: int = 0) -> bool:
        """Read on, and let go of the first ``used`` bytes."""
        self.data = self.data[used:]
        self.at += used
        at = self.at + len(self.data)
        block = self.read_at(at, min(READ_BYTES, self.size - at)) if at < self.size else b""
        self.data += block
        return bool(block)


def _decode(src: _Range, pos: int) -> tuple[bytes, int] | None:
    """The record of the member at ``pos`` of the range's data, and the member's end there.

    None if it doesn't decode, ends early or its head isn't a WARC record's.
    """
    unpack = zlib.decompressobj(31)
    out: list[bytes] = []
    feed, valid = 4096, False
    try:
        while not unpack.eof:
            if pos >= len(src.data) and not src.more():
                return None
            fed = src.data[pos : pos + feed]
            out.append(unpack.decompress(fed))
            pos += len(fed)
            feed = min(feed * 2, READ_BYTES)
            if not valid:
                head = b"".join(out)[: len(HEAD)]
                if not HEAD.startswith(head):
                    return None
                valid = head == HEAD
    except zlib.error:
        return None
    return (b"".join(out), pos - len(unpack.unused_data)) if valid else None


def members(read_at: Callable[[int, int], bytes], start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the members that start in [start, end) and decode to a WARC record.

    After a record the search goes on at its end, so magic inside a record is passed over. Empty members
    and bytes that don't decode are skipped.
    """
    src, pos = _Range(read_at, start, size), 0
    while src.at + pos < end:
        found = src.data.find(MAGIC, pos)
        if found < 0:
            rest = max(pos, len(src.data) - len(MAGIC) + 1)
            pos = 0
            if not src.more(rest):
                return
            continue
        if src.at + found >= end:
            return
        made = _decode(src, found)
        if made is None:
            pos = found + 1
            continue
        yield src.at + found, made[0]
        pos = made[1]


def parse(data: bytes) -> dict | None:
    """Header fields (lower-case names) and block of a record; None if it is malformed."""
    head, found, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not found or not length.isdigit() or len(rest) < int(length):
        return None
    return {"fields": fields, "block": rest[: int(length)]}


def _opener(path: str):
    """A random-access file of any file system that Arrow knows, local ones included."""
    from pyarrow import fs

    if path.startswith("file:"):
        system, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    elif "://" in path:
        system, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    else:
        system, name = fs.LocalFileSystem(), path
    return system.open_input_file(name)


RECORDS = "file string, offset long, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def dealt_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, size, start): the byte ranges of all files under ``path``, dealt to tasks in their order.

    A task takes neighbouring ranges: one each while there are no more than tasks, and about as many as any other else.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    n_ranges = files.agg(F.sum(F.ceil(F.col("length") / range_bytes)).alias("n")).first()["n"] or 1
    tasks = max(math.ceil(n_ranges / RANGES_TOGETHER), min(n_ranges, 4 * spark.sparkContext.defaultParallelism))
    ranges = files.where("length > 0").select("path", F.col("length").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    return ranges.repartitionByRange(tasks, "path", "start")


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of all archives under ``path``.

    ``payload_bytes`` is the full payload's length, which a revisit states although its ``payload`` is
    null. Malformed records and bytes between members are passed over. No files give no rows.

    Ranges are small rows, so the number of tasks is set by the bytes that they stand for: one for every ``RANGES_TOGETHER`` of
    them, or a range each until there is work for every core.
    """
    ranges = dealt_ranges(spark, path, range_bytes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), *[(n, pa.string()) for n in ("warc_type", "record_id", "target_uri", "refers_to", "payload_digest")], ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                rows: list[dict] = []
                held = 0
                with _opener(row["path"]) as f:
                    for offset, data in members(lambda at, n, f=f: f.read_at(n, at), row["start"], min(row["start"] + range_bytes, row["size"]), row["size"]):
                        made = parse(data)
                        if made is None:
                            continue
                        fields, (http, _, payload) = made["fields"], made["block"].partition(b"\r\n\r\n")
                        stated = [line.partition(b":")[2].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
                        kept = fields.get("warc-type") != "revisit"
                        rows.append(
                            {
                                "file": row["path"],
                                "offset": offset,
                                "warc_type": fields.get("warc-type"),
                                "record_id": fields.get("warc-record-id"),
                                "target_uri": fields.get("warc-target-uri"),
                                "refers_to": fields.get("warc-refers-to"),
                                "payload_digest": fields.get("warc-payload-digest"),
                                "payload_bytes": len(payload) if kept else int(stated[0]) if stated and stated[0].isdigit() else None,
                                "payload": payload if kept else None,
                            }
                        )
                        held += len(data)
                        if held > READ_BYTES * 8:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return ranges.select("path", "size", "start").mapInArrow(read, RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path)
    number = r"^<urn:page:(-?\d+)>$"
    return found.select(
        F.regexp_extract("record_id", number, 1).try_cast("long").alias("page_id"),
        "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.regexp_extract("refers_to", number, 1).try_cast("long").alias("refers_to"),
    )


#: Four base32 digits from every five hex digits of the digest.
SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p
)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda i:
    array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, i * 5 + 1, 5))::BIGINT >> s) & 31) + 1)::BIGINT, 1)), '')), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM d
"""
