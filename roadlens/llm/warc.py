"""Web archives with a Zstandard dictionary of their own.

Each archive begins with a skippable frame that holds a dictionary, built from all of the archive's own records; every
record after it is a frame by itself, so that any record can be read given its place and the dictionary.
Payloads that were archived before become revisit records.

Archives are written by Spark's text writer, so that they land, by its commit protocol, in any store Spark can
write: a lost task leaves nothing behind. The writer ends each piece with a line feed; the eight bytes before
it are the header of a skippable frame of one byte, which takes the line feed in.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.llm.common import fresh_path, join_groups, ship, write_out

#: Frame types of the format.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
LINE_FEED_FRAME = struct.pack("<II", 0x184D2A50, 1)

DICTIONARY_BYTES = 64 << 10
#: Bytes of records after which an archive is closed and the next one begins: what a task holds in memory. A record
#: is never split, so a larger one is an archive by itself.
ARCHIVE_BYTES = 32 << 20
LEVEL = 6
URN = "urn:roadlens:page:"
#: Repeated payloads that are broadcast, by digest; beyond that payloads are shuffled to them.
BROADCAST_PAYLOADS = 200_000

RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, original: of equal payloads of ``min_bytes`` or more the smallest page_id, else null.

    The least id of a payload is a map-side minimum over its digest and length. Payloads stay where they are:
    only the repeated ones' digests come to them, if their number is within BROADCAST_PAYLOADS; otherwise those of
    a large share of the pages do, which are few, and the rest is a join of digests that can spill.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.select("*", F.sha1("payload").alias("digest"), F.length("payload").alias("size"))
    least = keyed.filter(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    repeated = write_out(least.filter("n > 1"), "repeated-payloads")
    if repeated.count() <= BROADCAST_PAYLOADS:
        joined = keyed.join(F.broadcast(repeated.drop("n")), ["digest", "size"], "left")
    else:
        known = join_groups(keyed, repeated, ["digest", "size"], "n")
        joined = known.unionByName(keyed.join(repeated.select("digest", "size"), ["digest", "size"], "left_anti").withColumn("original", F.lit(None).cast("long")))
    return joined.select("page_id", "url", "payload", "original")


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url)


def information(name: str, date: str) -> bytes:
    """The record that an archive begins with."""
    block = b"software: roadlens\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:roadlens:archive:{name}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, original: int | None, date: str, name: str = "") -> bytes:
    """One record: an HTTP response with its payload, or, if ``original`` is another page, its head only. ``name``
    tells a record without page_id from others."""
    revisit = original is not None and original != page_id
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{f'urn:roadlens:unnamed:{name}' if page_id is None else f'{URN}{page_id}'}>",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {_uri(url)}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <{URN}{original}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple | None:
    """The columns of RECORDS from a record, None from one about the archive; a response's payload is held against
    its length and digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(x[1 + len(URN) : -1]) if (x := fields.get(name, "")).startswith(f"<{URN}") else None
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), size, digest, kind, number("WARC-Refers-To"), payload if kind == "response" else None


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; of too few records to train on, their last bytes."""
    if not records:
        return b""
    try:
        return zstandard.train_dictionary(size, records, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


def compressed(records: list[bytes]) -> list[bytes]:
    """The frames of one archive, the dictionary's first, which is built from all of the records."""
    if not records:
        return []
    trained = build_dictionary(records)
    data = zstandard.ZstdCompressionDict(trained)
    data.precompute_compress(level=LEVEL)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True)
    return [struct.pack("<II", DICTIONARY_FRAME, len(trained)) + trained, *map(compressor.compress, records)]


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive. A further dictionary frame replaces the one before, so archives may be joined."""
    view, at = memoryview(data), 0
    decompressor = zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            if magic == DICTIONARY_FRAME:
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        frame, out = decompressor.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ValueError("the last frame is cut off")
            step = view[at : at + (16 << 10)]
            out.append(frame.decompress(step))
            at += len(step)
        at -= len(frame.unused_data)
        yield b"".join(out)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> None:
    """Writes ``pages`` (page_id, url, html) to new archives in ``path``, each of about ``archive_bytes`` of records.

    Null html is an empty payload, null ids and addresses are left out of the record. Rows that repeat the
    smallest page_id of a payload are all responses. An empty table gives no archive. Other columns are ignored.
    ``date`` (now, if not given) is that of all records.
    """
    ship(pages.sparkSession)
    date = date or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, archives = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            out = b"".join([*compressed([information(f"{part}-{archives}", date), *held]), LINE_FEED_FRAME])
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["archive"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = record(*row, date, f"{part}-{n}")
                n += 1
                if held and size + len(made) > archive_bytes:
                    yield archive()
                    held, size, archives = [], 0, archives + 1
                held.append(made)
                size += len(made)
        if held:
            yield archive()

    written = with_originals(pages, min_bytes).mapInArrow(run, T.StructType([T.StructField("archive", T.BinaryType())]))
    # The bytes pass through a string column as they are; each row is a file.
    lines = written.select(F.col("archive").cast("string").alias("value")).write.option("compression", "none").option("lineSep", "\n")
    lines.option("maxRecordsPerFile", 1).text(path)
    _rename(pages.sparkSession, path)


def _rename(spark: SparkSession, path: str) -> None:
    """Gives the archives their usual ending: metadata only, a call for each archive."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            store.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.zst"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the pages in all archives in ``path``, with the columns of RECORDS; an archive is read by one task.

    Payload lengths and digests are those the record tells, held against the payload where it is there.
    """

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for data in frames(content.as_py()):
                    if (row := parse(data)) is None:
                        continue
                    rows.append(row)
                    held += len(data)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=RECORDS.names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=RECORDS.names)

    found = spark.read.format("binaryFile").load(path).select("content")
    return found.mapInArrow(run, RECORDS)


def op10(pages: DataFrame) -> DataFrame:
    """Writes the archives in the shared folder, reads them back, and returns the contract's columns.

    A null html is an empty payload; a row without page_id, repeated rows and ties are those of ``write_archives``; an
    empty table gives no rows; payloads are written whole, however long; other columns are ignored.
    """
    path = fresh_path(pages.sparkSession, "archives")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
with p as (select row_number() over () as rid, page_id, coalesce(html, '') as h from pages),
d as (select rid, page_id, strlen(h) as n, sha1(h) as x from p),
c as (select rid, i, ('0x' || substr(x, 1 + 5 * i, 5))::bigint as v from d cross join (select unnest(range(0, 8)) as i)),
b as (select rid, string_agg(
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + (v // 32768) % 32 as bigint), 1) ||
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + (v // 1024) % 32 as bigint), 1) ||
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + (v // 32) % 32 as bigint), 1) ||
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + v % 32 as bigint), 1), '' order by i) as digest
      from c group by rid),
f as (select x, n, min(page_id) as first_id, count(*) as k from d group by x, n)
select d.page_id, cast(d.n as bigint) as payload_bytes, b.digest as payload_digest,
       case when f.k > 1 and f.first_id is not null and (d.page_id is null or d.page_id <> f.first_id) then 'revisit' else 'response' end as record_type,
       case when f.k > 1 and f.first_id is not null and (d.page_id is null or d.page_id <> f.first_id) then f.first_id end as refers_to
from d join b on d.rid = b.rid join f on d.x = f.x and d.n = f.n
"""
