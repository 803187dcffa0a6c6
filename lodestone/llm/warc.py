"""WARC archives: a normaliser for monolithic gzip files, with writing and reading around it.

A monolithic archive is one gzip stream over many records, so no record can be reached without
inflating all before it. normalise() inflates each such stream once, in chunks, and rewrites
every record as a gzip member of its own; index_of() gives the sidecar index: archive, offset,
length and header fields of each record. read_records() then inflates single members.

Files go through Spark's own writers to the shared folder, so that its commit protocol covers
lost and repeated tasks. The text writer ends each row with a separator: for monolithic archives
it is the two line ends that close a WARC record, for members one zero byte, which gzip readers
skip between members and which the index leaves out.

Null html: an empty payload. Null url: no target header. Records with equal payloads of at least
min_bytes: the largest page_id is the response (null ids are smaller than any), the others are
revisits; repeated rows with that page_id are all responses. Empty table: no archive, empty
result. Other columns of the pages are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, spool, table

#: Records in an archive, of up to RECORD_BYTES each; of longer ones as many fewer, so that an archive's bytes are bounded too.
RECORDS_PER_ARCHIVE, RECORD_BYTES = 2000, 1 << 17
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
FIELDS = "archive string, offset long, length long, record_id string, record_type string, target_uri string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1: five hex digits make four base32 digits."""
    hexed = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records_of(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """record: a WARC record (without the closing line ends) per page; size: bytes of its html.

    Only digests that repeat, with their responses, are joined to the pages: a small table in most
    collections, which Spark then broadcasts (it is stored, so its size is known), and html stays where it lies.
    """
    page = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    page = page.withColumn("digest", base32_sha1(F.encode("html", "UTF-8")))
    size = F.octet_length("html")
    first = page.filter(size >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first"))
    page = page.join(spool(first.filter("n > 1").select("digest", "first"), "responses"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.when(again, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Payload-Bytes: "), size.cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.when(again, 0).otherwise(size) + len(HTTP)).cast("string")),
    )
    return page.select(F.concat(head, F.lit("\r\n\r\n" + HTTP), F.when(again, "").otherwise(F.col("html"))).alias("record"), size.alias("size"))


def write_monolithic(records: DataFrame, path: str) -> None:
    """Archives of records of like size, doubling from class to class: the longer, the fewer to an archive."""
    size_class = F.ceil(F.log2(F.ceil(F.greatest(F.col("size"), F.lit(1)) / RECORD_BYTES).cast("double"))).cast("int")
    classes = sorted(r[0] for r in records.select(size_class.alias("k")).distinct().collect())
    for k in classes or [0]:
        some = records.filter(size_class == k).select("record").write.mode("append").option("compression", "gzip").option("lineSep", "\r\n\r\n")
        some.option("maxRecordsPerFile", max(1, RECORDS_PER_ARCHIVE >> k)).text(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """archive (its name), content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def inflated(content: bytes) -> Iterator[bytes]:
    """The records of a gzip stream (or several), inflated once in chunks."""
    buffer, stream, at, step = bytearray(), zlib.decompressobj(31), 0, 1 << 16
    view = memoryview(content)
    while at < len(view):
        buffer += stream.decompress(view[at : at + step])
        at += step
        while stream.eof and (rest := stream.unused_data.lstrip(b"\0")):
            stream = zlib.decompressobj(31)
            buffer += stream.decompress(rest)
        if stream.eof:
            stream = zlib.decompressobj(31) if at < len(view) else stream
            while at < len(view) and view[at] == 0:
                at += 1
        done = 0
        while (record := _record_end(buffer, done)) is not None:
            yield bytes(buffer[done:record])
            done = record
        del buffer[:done]
    if buffer.strip(b"\r\n"):
        raise ValueError("an archive ends inside a record")


def _record_end(buffer: bytearray, start: int) -> int | None:
    """Where the record that begins at start ends (with its two line ends), if the buffer has all of it."""
    head = buffer.find(b"\r\n\r\n", start)
    if head < 0:
        return None
    at = buffer.find(b"\r\nContent-Length: ", start, head + 2)
    if at < 0:
        raise ValueError("a record has no Content-Length")
    size = int(buffer[at + 18 : buffer.find(b"\r\n", at + 2)])
    end = head + 4 + size + 4
    return end if end <= len(buffer) else None


def header_of(record: bytes) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name, and where the block begins."""
    end = record.index(b"\r\n\r\n")
    lines = record[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrites each monolithic archive below source as one with a gzip member for every record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["archive"], b["content"], strict=True):
                members, size = [], 0
                for record in inflated(content):
                    made = zlib.compressobj(6, zlib.DEFLATED, 31)
                    members.append(made.compress(record) + made.flush())
                    size += len(members[-1])
                    if size > 4 << 20:
                        yield pd.DataFrame({"archive": name, "member": members})
                        members, size = [], 0
                if members:
                    yield pd.DataFrame({"archive": name, "member": members})

    rows = archives(spark, source).mapInPandas(run, "archive string, member binary")
    rows.select(F.col("member").cast("string").alias("value"), F.regexp_replace("archive", r"\.txt\.gz$", "").alias("archive")).write.partitionBy("archive").option(
        "lineSep", "\0"
    ).option("maxRecordsPerFile", 0).text(target)


def normalised(spark: SparkSession, path: str) -> DataFrame:
    """archive, content of normalised archives."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_extract("path", r"archive=([^/]+)/", 1).alias("archive"), "content")


def members_of(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each gzip member."""
    at, view = 0, memoryview(content)
    while at < len(view):
        stream, fed, record = zlib.decompressobj(31), at, bytearray()
        while not stream.eof:
            if fed >= len(view):
                raise ValueError("an archive ends inside a member")
            record += stream.decompress(view[fed : fed + 16384])
            fed = min(fed + 16384, len(view))
        end = fed - len(stream.unused_data)
        yield at, end - at, bytes(record)
        at = end
        while at < len(view) and view[at] == 0:
            at += 1


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar index of the archives below path, a row for each record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["archive"], b["content"], strict=True):
                rows = []
                for at, size, record in members_of(content):
                    fields, _ = header_of(record)
                    rows.append((name, at, size, fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri")))
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in FIELDS.split(", ")])

    return normalised(spark, path).mapInPandas(run, FIELDS)


def _number(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").rpartition(":")[2]
    return int(value) if value.lstrip("-").isdigit() else None


def parse(record: bytes) -> tuple:
    """The fields of RECORD; a response's payload is checked against its digest."""
    fields, at = header_of(record)
    block = record[at : at + int(fields["content-length"])]
    kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2], int(fields["payload-bytes"])
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest:
            raise ValueError(f"{fields['warc-record-id']}: the payload doesn't match its digest")
    return _number(fields["warc-record-id"]), size, digest, kind, _number(fields.get("warc-refers-to")), fields.get("warc-target-uri")


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def read_records(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """The records that index names, each inflated alone by its offset."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, spans in zip(b.column("content"), b.column("spans"), strict=True):
                view = memoryview(content.as_buffer())
                spans = spans.as_py()
                for k in range(0, len(spans), 500):
                    yield _batch([parse(zlib.decompress(view[s["offset"] : s["offset"] + s["length"]], 31)) for s in spans[k : k + 500]], kinds, names)

    spans = index.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("spans"))
    return normalised(spark, path).join(spans.hint("merge"), "archive").select("content", "spans").mapInArrow(run, RECORD)


def op1_warc_normaliser(spark, sf_dir: str) -> DataFrame:
    """Writes monolithic archives of all pages, normalises and indexes them, and reads back every record that the index has."""
    home = shared_path(spark, "warc")
    write_monolithic(records_of(table(spark, sf_dir, "pages")), f"{home}/monolithic")
    normalise(spark, f"{home}/monolithic", f"{home}/members")
    index_of(spark, f"{home}/members").write.parquet(f"{home}/index")
    index = spark.read.schema(FIELDS).parquet(f"{home}/index")
    return read_records(spark, f"{home}/members", index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc_normaliser": op1_warc_normaliser}
ORACLES: dict[str, str] = {}
