"""WARC archives: monolithic gzip files, their normalisation to a gzip member for each record, and a sidecar offset index.

Spark's text sink writes the archives, through its commit protocol and to any store that Spark writes to: a record is a row, the line
separator is the blank lines that end a WARC record, and the gzip codec makes one stream of each file. The normaliser inflates such a
stream once, in pieces, and rewrites each record as its own member. Members go out by the same sink: the last byte of a member is zero
(its size is under 16 MiB, or an empty member follows it), and that byte is the line separator.

A null html is an empty payload; a null url is written as urn:page:<page_id>; control characters in a url are percent-encoded. Rows of
the smallest page_id of a payload are all its response. A null or repeated page_id is a revisit where its payload has a response of
another page, else a response. Records of like size share files, as many as `file_bytes` hold, which bounds what the normaliser reads at
once; a very long payload has a file of its own. Normalised archives are renamed to *.warc.gz. An empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch, small

#: Payloads under so many bytes are always written whole.
LEAST_REVISIT = 100
#: Bytes of payload in a file, and the sizes up to which payloads share files with others like them.
FILE_BYTES = 64 << 20
SIZES = (16 << 10, 256 << 10, 4 << 20)
#: Up to so many revisits are broadcast to the pages (48 bytes each); beyond, both are shuffled.
BROADCAST_REVISITS = 200_000
PIECE = 1 << 20
INDEX = "path string, offset long, length long, record_id string, record_type string, page_id long, payload_bytes long, payload_digest string, refers_to long"


def _urn(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-"))][:-1], F.lit(">"))


def plan_revisits(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """pages with url, body, payload_bytes, payload_digest, refers_to (null for responses) and written, the bytes of body that are written."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body.cast("binary"), 256).alias("payload_digest"))
    keys = scratch.table(rows.filter(F.col("payload_bytes") >= LEAST_REVISIT).select("page_id", F.unhex("payload_digest").alias("payload_digest"), "payload_bytes"), "keys")
    first = keys.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n")
    later = scratch.table(keys.join(first, "payload_digest").filter("page_id is null or page_id > first").select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), F.col("first").alias("refers_to")).distinct(), "later")
    later = F.broadcast(later) if small(later, BROADCAST_REVISITS) else later
    out = rows.join(later, rows["page_id"].eqNullSafe(F.col("p")) & (F.unhex(rows["payload_digest"]) == F.col("d")), "left").drop("p", "d")
    return out.withColumn("written", F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0))


def record_text(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A WARC record (value), without the blank lines that end it, for each row of plan_revisits(), and its `written`."""
    revisit = F.col("refers_to").isNotNull()
    page = F.col("page_id").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(page, F.lit("")))), "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1F]", "%00")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    none = F.lit("")
    return pages.select(
        F.concat(
            F.lit("WARC/1.0\r\n"),
            line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID", _urn(F.col("page_id"))),
            line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", url),
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
            F.when(page.isNotNull(), line("X-Page-ID", page)).otherwise(none),
            line("X-Payload-Length", F.col("payload_bytes").cast("string")),
            F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", _urn(F.col("refers_to"))), line("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(none),
            F.lit("Content-Type: application/http; msgtype=response\r\n"),
            line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))).cast("string")),
            F.lit("\r\n"),
            http,
            F.when(revisit, none).otherwise(F.col("body")),
        ).alias("value"),
        "written",
    )


def write_monolithic(records: DataFrame, path: str, largest: int, file_bytes: int = FILE_BYTES) -> None:
    """Archives of one gzip stream each. largest: that of `written`, or more."""
    low = -1
    for high in (*SIZES, None):
        some = records.filter((F.col("written") > low) & (F.lit(True) if high is None else F.col("written") <= high))
        if low < largest:
            some.select("value").write.mode("append").option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, file_bytes // high) if high else 1).text(path)
        low = high


def inflate(content: memoryview) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, in pieces; zero bytes between members are passed over."""
    at, d = 0, zlib.decompressobj(31)
    while at < len(content):
        if d.eof:
            while at < len(content) and content[at] == 0:
                at += 1
            d = zlib.decompressobj(31)
            continue
        piece = d.decompress(content[at : at + PIECE])
        at = min(at + PIECE, len(content)) - len(d.unused_data)
        if piece:
            yield piece
    if not d.eof and len(content):
        raise ValueError("a gzip stream breaks off")


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a WARC stream, each with the blank lines that end it."""
    buf = bytearray()
    need = 0
    for piece in pieces:
        buf += piece
        at = 0
        while len(buf) - at >= max(need, 4):
            head = buf.find(b"\r\n\r\n", at)
            if head < 0:
                break
            size = re.search(rb"\r\ncontent-length:\s*(\d+)", buf[at:head], re.I)
            if not size:
                raise ValueError("a WARC record without Content-Length")
            need = head - at + 8 + int(size[1])
            if len(buf) - at < need:
                break
            yield bytes(buf[at : at + need])
            at, need = at + need, 0
        del buf[:at]
    if buf.strip():
        raise ValueError("a WARC record breaks off")


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member of the record whose last byte is zero."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = c.compress(record) + c.flush()
    return out if out[-1] == 0 else out + (e := zlib.compressobj(1, zlib.DEFLATED, 31)).compress(b"") + e.flush()


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0):
            out, size = [], 0
            for record in split_records(inflate(memoryview(content.as_buffer()))):
                out.append(member(record)[:-1])
                size += len(out[-1])
                if size > 4 * PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def normalise(spark, source: str, path: str) -> None:
    """Rewrite the archives in source, each record as its own member; the archives are named by number."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("content")
    files.mapInArrow(_normalise, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\u0000").text(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(name for x in system.listStatus(folder) if (name := x.getPath().getName()).startswith("part-"))
    for k, name in enumerate(parts):  # a file operation for each archive
        system.rename(jvm.org.apache.hadoop.fs.Path(folder, name), jvm.org.apache.hadoop.fs.Path(folder, f"{k:08d}.warc.gz"))


def members(content: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each member that isn't empty."""
    at = 0
    while at < len(content):
        d, start, out = zlib.decompressobj(31), at, []
        while not d.eof and at < len(content):
            out.append(d.decompress(content[at : at + (1 << 14)]))
            at = min(at + (1 << 14), len(content)) - len(d.unused_data)
        if not d.eof:
            raise ValueError("a gzip member breaks off")
        if record := b"".join(out):
            yield start, at - start, record


def parse_record(record: bytes) -> dict:
    """Fields of the index, and the payload; a response's digest and size are those of its payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]
    out = {"record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None, "refers_to": int(fields["x-refers-to-page"]) if "x-refers-to-page" in fields else None}
    stated = fields["warc-payload-digest"].partition(":")[2]
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": int(fields["x-payload-length"]), "payload_digest": stated, "payload": None}
    out |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload}
    if out["payload_digest"] != stated:
        raise ValueError(f"the payload of {out['record_id']} does not have its digest")
    return out


_INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            out = []
            for offset, length, record in members(memoryview(content.as_buffer())):
                out.append({"path": path, "offset": offset, "length": length} | {k: v for k, v in parse_record(record).items() if k != "payload"})
            yield pa.RecordBatch.from_pylist(out, _INDEX)


def offset_index(spark, path: str) -> DataFrame:
    """Reads normalised archives back: file, offset and length of each record, with its type, page and payload."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "content").mapInArrow(_index, INDEX)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content, wanted in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            data, out = memoryview(content.as_buffer()), []
            for x in wanted:
                r = parse_record(zlib.decompressobj(31).decompress(data[x["offset"] : x["offset"] + x["length"]]))
                out.append((r["page_id"], r["payload"]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["page_id", "payload"])


def fetch(spark, path: str, index: DataFrame) -> DataFrame:
    """page_id and payload of the records in the index rows: only their members are inflated."""
    wanted = index.groupBy("path").agg(F.collect_list(F.struct("offset", "length")).alias("at"))  # no more than the records of a file
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.join(wanted, "path").select("content", "at").mapInArrow(_fetch, "page_id long, payload binary")


def write_archives(pages: DataFrame, scratch: Scratch, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Writes, normalises and indexes pages: the folder of the normalised archives, and the sidecar index. Both are the scratch folder's."""
    whole, path = f"{scratch.path}/monolithic", f"{scratch.path}/archives"
    records = record_text(plan_revisits(pages, scratch))
    largest = pages.sparkSession.read.parquet(f"{scratch.path}/keys").agg(F.max("payload_bytes")).head()[0] or 0
    write_monolithic(records, whole, largest, file_bytes)
    normalise(pages.sparkSession, whole, path)
    scratch.drop("monolithic")
    return path, scratch.table(offset_index(pages.sparkSession, path), "sidecar")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    with Scratch(spark, pages) as scratch:
        _, index = write_archives(pages.select("page_id", "url", "html"), scratch)
        return scratch.keep(index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
