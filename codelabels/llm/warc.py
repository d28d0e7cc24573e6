"""Web archives: WARC records as gzip members, written and read by Spark tasks.

Writing: records that share a payload of `min_revisit` bytes or more are stored once;
the one with the smallest id is the response, the others are revisits that point to it.
Each record is one gzip member, and files are concatenations of members.

Reading is splittable. Files are cut into byte ranges, and every range is a row that any
task can take. A task looks for the gzip magic in its range and takes a place for the
start of a record if the bytes from there inflate to a record header, and if the member
they form ends at another magic or at the end of the file. It owns the records that
start inside its range and reads on past the range's end to finish the last of them.
Compressed data that looks like a magic does not inflate to a header and is passed over.

Tasks open archives by pyarrow's file systems, so their address must be one these know
(file, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle

MAGIC, EMPTY_DIGEST = b"\x1f\x8b\x08", hashlib.sha256(b"").hexdigest()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
RANGE_BYTES, READ_BYTES, MIN_REVISIT = 8 << 20, 1 << 18, 100
RANGES = 16  # ranges a task reads at most, if there are more than cores
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _member(head: bytes, block: bytes) -> bytes:
    """A gzip member less its last byte, which is zero: that byte is the separator of the written rows.

    The last byte is the highest of the length. Where it is not zero (16 MiB and
    more), an empty member follows, which readers pass over.
    """
    def packed(data: bytes) -> bytes:
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        return squeeze.compress(data) + squeeze.flush()

    data = packed(head + block + b"\r\n\r\n")
    if data[-1]:
        data += packed(b"")
    return data[:-1]


def _record(page: str | None, uri: str | None, payload: bytes, digest: str, first: str | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{page or ''}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {quote(uri, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{first or ''}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return _member("\r\n".join(head).encode("utf-8"), block)


def marked(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Per row: id, uri, body (payload in UTF-8, null as empty), digest, revisit and first.

    Only ids and digests are shuffled to find repeats; a digest that very many rows
    share meets a written table of one row per digest, a join Spark can split. A row
    without id is a response unless a row with id holds its payload.
    """
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    large = settle(rows.filter(F.octet_length("body") >= min_revisit).select("id", "digest"), "warc-digests")
    firsts = settle(large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n"), "warc-firsts")
    again = settle(large.join(firsts, "digest").filter(~F.col("id").eqNullSafe(F.col("first"))).distinct(), "warc-revisits")
    again = again.withColumnsRenamed({"id": "again_id", "digest": "again_digest"})
    found = rows.join(again, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    return found.select("id", "uri", "body", "digest", F.col("first").isNotNull().alias("revisit"), "first")


def write(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes rows of `marked` as archives in a new folder, one file per task."""

    @F.arrow_udf("binary")
    def member(ids: pa.Array, uris: pa.Array, bodies: pa.Array, digests: pa.Array, revisits: pa.Array, firsts: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (ids, uris, bodies, digests, revisits, firsts)), strict=True)
        return pa.array([_record(None if i is None else str(i), u, b, d, None if f is None else str(f), r, date) for i, u, b, d, r, f in rows], pa.binary())

    columns = [F.col("id"), F.col("uri"), F.col("body"), F.col("digest"), F.col("revisit"), F.col("first")]
    # The text writer puts bytes down as they are; its separator is the byte the members lack.
    records.select(member(*columns).cast("string").alias("value")).write.option("lineSep", "\0").text(folder)


class _Source:
    """A file read in blocks, of which the last one is at hand."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.block = file, size, 0, b""

    def at(self, place: int, least: int = 1) -> tuple[bytes, int]:
        """A block with `least` bytes from place on, fewer only at the end of the file, and where in it they begin."""
        offset = place - self.start
        if not 0 <= offset or (offset + least > len(self.block) and self.start + len(self.block) < self.size):
            self.file.seek(place)
            self.start, self.block, offset = place, self.file.read(max(0, min(READ_BYTES, self.size - place))), 0
        return self.block, offset


def _inflated(source: _Source, place: int) -> tuple[bytes, int] | None:
    """The record that starts at a place and where it ends; None if there is none.

    Only as much is inflated as shows that no header begins here. Pieces grow, so
    short records do not pass on whole blocks and long ones cost linear time.
    """
    inflate, out, at, size = zlib.decompressobj(31), [], place, 1 << 12
    while not inflate.eof:
        block, offset = source.at(at)
        piece = memoryview(block)[offset : offset + size]
        if not len(piece):
            return None
        try:
            out.append(inflate.decompress(piece, 64) if at == place else inflate.decompress(piece))
            if at == place and not inflate.eof:
                if not b"WARC/".startswith(out[0][:5]) and not out[0].startswith(b"WARC/"):
                    return None
                out.append(inflate.decompress(inflate.unconsumed_tail))
        except zlib.error:
            return None
        at, size = at + len(piece), min(2 * size, READ_BYTES)
    end, text = at - len(inflate.unused_data), b"".join(out)
    block, offset = source.at(end, 2)
    if not text.startswith(b"WARC/") or not MAGIC.startswith(block[offset : offset + 2]):
        return None
    return text, end


def _records(source: _Source, place: int, end: int) -> Iterator[bytes]:
    """The records that start from place on and before `end`."""
    while place < end:
        block, offset = source.at(place, len(MAGIC))
        hit = block.find(MAGIC, offset)
        if hit < 0:
            # The last two bytes may begin a magic.
            if source.start + len(block) >= source.size:
                return
            place = source.start + len(block) - 2
            continue
        place = source.start + hit
        if place >= end:
            return
        found = _inflated(source, place)
        if found is None:
            place += 1
        else:
            yield found[0]
            place = found[1]


def _fields(record: bytes) -> tuple:
    head, _, block = record.partition(b"\r\n\r\n")
    named = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        named[name.strip().lower()] = value.strip()
    if (length := named.get("content-length", ""))[:18].isdecimal() and len(length) <= 18:
        block = block[: int(length)]
    kind, size, payload = named.get("warc-type"), None, block
    if named.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        for line in http.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit() and len(value.strip()) <= 18:
                size = int(value)
    digest = named.get("warc-payload-digest", "")
    bare = lambda v: v[1:-1] if v and v.startswith("<") else v
    return bare(named.get("warc-record-id")), kind, named.get("warc-target-uri"), bare(named.get("warc-refers-to")), digest.rpartition(":")[2] or None, len(payload) if size is None else size, None if kind == "revisit" else payload


def read(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of all archives in a folder: ids, type, addresses, digest, payload.

    Other files and empty ones give no rows. A revisit has no payload; its
    payload_bytes is the length that its HTTP header states.
    """
    kind = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(kind)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    rows, held = [], 0
                    for record in _records(_Source(file, size), start, min(start + range_bytes, size)):
                        rows.append(_fields(record))
                        held += len(record)
                        if held > 8 << 20:
                            yield out(rows)
                            rows, held = [], 0
                    yield out(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length").filter("length > 0")
    # file:/a names the same place as file:///a, the form that all readers know.
    path = F.regexp_replace("path", "^file:/+", "file:///")
    ranges = files.select(path.alias("path"), "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    # A stated number, which AQE keeps: it would merge the few bytes of addresses into one task.
    n = ranges.count()
    tasks = max(1, -(-n // RANGES), min(n, spark.sparkContext.defaultParallelism))
    return ranges.repartition(tasks).mapInArrow(scan, SCHEMA)


def number(urn: Column) -> Column:
    """The id within a record id; null where there is none."""
    return F.nullif(F.regexp_extract(urn, f"^{URN}(-?[0-9]+)$", 1), F.lit("")).cast("long")
