"""WARC archives as chunked record tables.

An archive is a table of chunk rows: (archive, record, chunk, data) with the CRC-32 of the payload up to and with that
chunk.  In order of record and chunk the data of one archive are a valid .warc.gz file: every record is a gzip member of
its own, and its chunks are consecutive pieces of it.  A payload goes through in pieces of CHUNK bytes on both ways; what is
carried from chunk to chunk are the states of the compression and the digests and a count, never the record.

Reading asks for the chunks of a record from 0 to the last, each once.  A record with chunks missing, doubled, cut or changed is an
error that names the record.

Which record a payload belongs to is found from digests before anything is written: the smallest id with a payload of
at least ``least`` bytes is the response, others with the same bytes revisit it.  Spark's writer commits the table,
so a repeated task leaves nothing behind, and the folder can be in any store that Spark reaches.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm.shared import IdFilter, attach, cut

CHUNK = 1 << 15  # payload bytes in a chunk
ROWS = 128  # chunk rows in an output batch
VERSION = b"WARC/1.1\r\n"
_SCHEMA = "archive int, record long, chunk int, last boolean, crc32 long, data binary"
_NAMES = ["archive", "record", "chunk", "last", "crc32", "data"]
_KINDS = (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
DATE = b"1970-01-01T00:00:00Z"  # no table has a time of capture


def roles(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """id, digest and refers_to of each row; equal payloads have equal SHA-256 and length."""
    size = F.coalesce(F.octet_length(payload_col), F.lit(0))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(F.coalesce(F.encode(payload_col, "utf-8"), F.lit(b"")), 256).alias("digest"), size.alias("size"))
    repeated = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(F.col("id") != F.col("first"), F.col("first"))
    return rows.join(repeated, ["digest", "size"], "left").select("id", "digest", refers.alias("refers_to"))


def _headers(id_: int | None, url: str | None, digest: str, refers_to: int | None, length: int) -> bytes:
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    url = "".join(c for c in (url or "") if c.isprintable() and c != " ")
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(id_)}",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {DATE.decode()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {length}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n"


def _writer(archives: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for record, id_, url, payload, digest, refers_to in zip(*batch.columns, strict=True):
                id_, refers_to = id_.as_py(), refers_to.as_py()
                # a view of the Arrow buffer: no copy of the whole payload
                view = memoryview(b"") if payload.as_buffer() is None else memoryview(payload.as_buffer())
                own = view if refers_to is None else view[:0]  # a revisit has no payload of its own
                number, archive, crc = record.as_py(), record.as_py() % archives, 0
                head = _headers(id_, url.as_py(), digest.as_py(), refers_to, len(own))
                chunks = max(1, -(-len(own) // CHUNK))
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                for k in range(chunks):
                    part = own[k * CHUNK : (k + 1) * CHUNK]
                    crc = zlib.crc32(part, crc)
                    data = (head if k == 0 else b"") + bytes(part) + (b"\r\n\r\n" if k == chunks - 1 else b"")
                    # a chunk can be unpacked as soon as those before it are there
                    packed = packer.compress(data) + packer.flush(zlib.Z_FINISH if k == chunks - 1 else zlib.Z_SYNC_FLUSH)
                    rows.append((archive, number, k, k == chunks - 1, crc, packed))
                    if len(rows) >= ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    return write


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def write_archives(pages: DataFrame, to: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, archives: int = 64) -> None:
    """Write a record per row of ``pages`` to the archive table ``to``.

    Null payloads are empty.  Payloads of fewer than ``least`` bytes are always responses.  Rows that repeat an id give a
    record each, null ids too; they refer to nothing but others may not refer to them either.  An empty table writes no rows.
    """
    attach(pages)
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.col(payload_col).cast("string"), "utf-8").alias("payload"))
    known = roles(pages.where(F.col(id_col).isNotNull()), id_col, payload_col, least).where("refers_to is not null").groupBy("id", "digest").agg(F.min("refers_to").alias("refers_to"))
    known = cut(known)
    revisits = IdFilter(known, "id")
    payload = F.coalesce("payload", F.lit(b""))
    own = own.select((F.monotonically_increasing_id() * 2).alias("record"), "id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))

    def some(may_revisit: bool):
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(1)
                may = revisits(np.asarray(ids.fill_null(0))) & np.asarray(ids.is_valid())
                yield b.filter(pa.array(may == may_revisit))

        return own.mapInArrow(choose, own.schema)

    # only rows that may be revisits are shuffled, to learn what they refer to
    plain = some(False).withColumn("refers_to", F.lit(None).cast("long"))
    looked_up = some(True).join(known, ["id", "digest"], "left").select((F.col("record") + 1).alias("record"), "id", "url", "payload", "digest", "refers_to")
    plain.union(looked_up).mapInArrow(_writer(archives), _SCHEMA).write.mode("errorifexists").parquet(to)


class Reader:
    """Parse one record from its chunks, in order; holds its headers and the states of unpacking and digests."""

    def __init__(self) -> None:
        self.unpacker = zlib.decompressobj(31)
        self.head, self.fields, self.left = b"", None, 0
        self.sha, self.crc, self.bytes = hashlib.sha256(), 0, 0

    def feed(self, data: bytes, crc: int, last: bool) -> bytes:
        """The payload that the chunk holds."""
        data = self.unpacker.decompress(data)
        if self.unpacker.eof != last or self.unpacker.unused_data:
            raise ValueError("record is cut short" if last else "record ends before its last chunk")
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                if last:
                    raise ValueError("record is cut short")
                return b""
            if not self.head.startswith(VERSION):
                raise ValueError("not a WARC record")
            lines = self.head[len(VERSION) : end].decode().split("\r\n")
            self.fields = dict(x.split(": ", 1) for x in lines)
            self.left, data, self.head = int(self.fields["Content-Length"]), self.head[end + 4 :], b""
        part = data[: self.left]
        self.left -= len(part)
        self.bytes += len(part)
        self.sha.update(part)
        self.crc = zlib.crc32(part, self.crc)
        if self.crc != crc:
            raise ValueError("chunk digest does not match")
        if last and (self.left or data[len(part) :] != b"\r\n\r\n"):
            raise ValueError("record is cut short")
        return part


def _id(name: str | None) -> int | None:
    value = None if name is None else name.removeprefix("<urn:page:").removesuffix(">")
    return None if value in (None, "none") else int(value)


def _in_order(batches: Iterator[pa.RecordBatch], each) -> Iterator:
    """What ``each(state, chunk, last, ...)`` makes of the chunks of every record, in order and each once; it gets a new Reader with chunk 0.

    Rows are (record, chunk, last, crc32, data) sorted by record and chunk.
    """
    now, wanted, reader = None, None, None  # wanted: the next chunk of an open record
    for batch in batches:
        for record, chunk, last, crc, data in zip(*batch.columns, strict=True):
            record, chunk, last = record.as_py(), chunk.as_py(), last.as_py()
            if wanted is not None and record != now:
                raise ValueError(f"record {now} lacks chunk {wanted}")
            if record == now and chunk != wanted:
                raise ValueError(f"record {record} has chunk {chunk} where {'its end' if wanted is None else wanted} was expected")
            if record != now:
                if chunk:
                    raise ValueError(f"record {record} lacks chunk 0")
                now, reader = record, Reader()
            try:
                yield each(reader, record, chunk, last, reader.feed(data.as_py(), crc.as_py(), last))
            except (ValueError, zlib.error) as e:
                raise ValueError(f"record {record}: {e}") from e
            wanted = None if last else chunk + 1
    if wanted is not None:
        raise ValueError(f"record {now} lacks chunk {wanted}")


def _finished(reader: Reader, record: int, chunk: int, last: bool, part: bytes) -> tuple | None:
    if not last:
        return None
    f = reader.fields
    declared = f["WARC-Payload-Digest"].removeprefix("sha256:")
    if f["WARC-Type"] == "response" and reader.sha.hexdigest() != declared:
        raise ValueError("payload digest does not match")
    return (_id(f["WARC-Record-ID"]), f["WARC-Target-URI"], f["WARC-Type"], _id(f.get("WARC-Refers-To")), declared, reader.sha.hexdigest(), reader.bytes)


def _batches(rows: Iterator[tuple | None], names: list[str], kinds: tuple, most: int) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*waiting, strict=True), kinds, strict=True)], names=names)

    for row in rows:
        if row is not None:
            waiting.append(row)
        if len(waiting) >= most:
            yield batch()
            waiting = []
    if waiting:
        yield batch()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["id", "url", "record_type", "refers_to", "declared", "digest", "length"], (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    yield from _batches(_in_order(batches, _finished), names, kinds, 4096)


def _ordered(spark: SparkSession, at: str) -> DataFrame:
    chunks = spark.read.schema(_SCHEMA).parquet(at)
    attach(chunks)
    return chunks.repartition("record").sortWithinPartitions("record", "chunk").select("record", "chunk", "last", "crc32", "data")


def read_archives(spark: SparkSession, at: str) -> DataFrame:
    """id, url, record_type, refers_to, payload_digest and payload_bytes of each record, read from the archives.

    Chunks of a record are brought together in order and checked against their running CRC-32, responses also against
    the declared SHA-256.  A revisit's digest and size are those of the full payload, the record it refers to.
    """
    found = _ordered(spark, at).mapInArrow(_read, "id long, url string, record_type string, refers_to long, declared string, digest string, length long")
    return found.select("id", "url", "record_type", "refers_to", F.col("declared").alias("payload_digest"), "length")


def with_sizes(records: DataFrame) -> DataFrame:
    """Records with payload_bytes of the full payload: a revisit's are those of the response it refers to."""
    full = records.where("record_type = 'response'").select(F.col("id").alias("__to"), F.col("payload_digest").alias("__digest"), F.col("length").alias("__bytes")).distinct()
    same = (F.col("refers_to") == F.col("__to")) & (F.col("payload_digest") == F.col("__digest"))
    return records.join(full, same, "left").withColumn("payload_bytes", F.coalesce("__bytes", "length")).drop("__to", "__digest", "__bytes", "length")


def payloads(spark: SparkSession, at: str) -> DataFrame:
    """record, chunk and payload bytes of each chunk, for readers that want the content."""

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _in_order(batches, lambda reader, record, chunk, last, part: (record, chunk, part))
        yield from _batches(rows, ["record", "chunk", "payload"], (pa.int64(), pa.int32(), pa.binary()), ROWS)

    return _ordered(spark, at).mapInArrow(content, "record long, chunk int, payload binary")
