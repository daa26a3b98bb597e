"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole records of about FRAME_BYTES, then a
skippable frame with the record index (record id, frame, offset in the decompressed frame, length), then the seek table of the
Zstandard seekable format. A reader finds a record from the end of the file: footer, seek table, index, one frame.

Bundles are written by Spark's file writer, one bundle per row and file, with its commit protocol and on any file
system it knows: the text writer puts a row's bytes out as they are, and its line separator is the four bytes
of the footer's magic number. They are read with Spark's binary reader.

Of records with equal payloads of at least MIN_REVISIT bytes, the largest page_id is the response, the others are
revisits of it; smaller ones are all responses. Defined results: a null html is an empty payload, a null url is left out;
repeated rows are written each; a null page_id is a record without number (a revisit where the payload has a numbered
response); an empty table gives no bundle and no rows. Other columns than page_id, url and html are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import arrow_map, join_hot, key_bitmap, map_batches, maybe_flag, table
from pairlens.session import scratch_path, written

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 23
MIN_REVISIT = 1000
DATE = "1970-01-01T00:00:00Z"
SKIPPABLE, SEEK_TABLE, MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    number = identifier.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    block = _HTTP % len(payload) + (b"" if is_revisit else payload)
    heads = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"] if is_revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(heads).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, payload and its full length of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rsplit(b"Content-Length: ", 1)[1])
    return {"fields": fields, "payload": payload, "length": length}


class Bundle:
    """Collects records; `close` gives the file without the last four bytes, which the writer adds."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes = frame_bytes
        self.frames, self.sizes, self.index, self.open, self.raw = [], [], [], [], 0
        self.size = 0
        self.packer = zstandard.ZstdCompressor(level=3)

    def add(self, identifier: str, record: bytes) -> None:
        self.index.append(f"{identifier}\t{len(self.frames)}\t{self.raw}\t{len(record)}")
        self.open.append(record)
        self.raw += len(record)
        self.size += len(record)
        if self.raw >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.open:
            self.frames.append(self.packer.compress(b"".join(self.open)))
            self.sizes.append(self.raw)
            self.open, self.raw = [], 0

    def close(self) -> bytes:
        self._flush()
        index = zlib.compress("\n".join(self.index).encode())
        entries = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.sizes, strict=True))
        footer = struct.pack("<IB", len(self.frames), 0)
        return b"".join(
            [*self.frames, struct.pack("<II", SKIPPABLE, len(index)), index, struct.pack("<II", SEEK_TABLE, len(entries) + 9), entries, footer]
        )


class Reader:
    """Random access to the records of one bundle."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        count, descriptor, magic = struct.unpack("<IBI", self.data[-9:])
        if magic != MAGIC or descriptor:
            raise ValueError("no seek table at the end")
        table_at = len(data) - 9 - 8 * count - 8
        if struct.unpack("<II", self.data[table_at : table_at + 8]) != (SEEK_TABLE, 8 * count + 9):
            raise ValueError("the seek table does not fit its footer")
        self.sizes, self.starts, at = [], [], 0
        for packed, raw in struct.iter_unpack("<II", self.data[table_at + 8 : table_at + 8 + 8 * count]):
            self.starts.append((at, packed))
            self.sizes.append(raw)
            at += packed
        kind, length = struct.unpack("<II", self.data[at : at + 8])
        if kind != SKIPPABLE or at + 8 + length != table_at:
            raise ValueError("the index does not lie between frames and seek table")
        lines = zlib.decompress(self.data[at + 8 : table_at]).decode().split("\n") if count else []
        self.index = [(i, int(f), int(o), int(n)) for i, f, o, n in (x.split("\t") for x in lines)]
        self.cached: tuple[int, bytes] = (-1, b"")

    def frame(self, number: int) -> bytes:
        if self.cached[0] != number:
            at, packed = self.starts[number]
            self.cached = (number, zstandard.ZstdDecompressor().decompress(self.data[at : at + packed], max_output_size=self.sizes[number]))
        return self.cached[1]

    def record(self, frame: int, offset: int, length: int) -> dict:
        return parse_record(self.frame(frame)[offset : offset + length])


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, refers_to, is_revisit) of every page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    keys = pages.where(F.octet_length("html") >= min_bytes).select("page_id", F.sha2("html", 256).alias("payload"))
    keys = written(keys, "payload_keys")
    shared = written(keys.groupBy("payload").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL"), "shared_payloads")
    again = join_hot(keys, shared, ["payload"], "n", "inner").where("page_id IS NULL OR page_id < refers_to").distinct()
    again = written(again.select(F.coalesce("page_id", F.lit(-(1 << 63))).alias("pairlens_page"), F.col("payload").alias("pairlens_payload"), "refers_to"), "revisits")
    flagged = maybe_flag(pages.withColumn("pairlens_key", F.coalesce("page_id", F.lit(-(1 << 63)))), "pairlens_key", key_bitmap(again.select(F.col("pairlens_page").alias("key"))))
    doubtful = flagged.where("pairlens_maybe").join(again, (F.col("pairlens_key") == F.col("pairlens_page")) & (F.sha2("html", 256) == F.col("pairlens_payload")), "left")
    columns = ["page_id", "url", "html", "digest", "refers_to", F.col("refers_to").isNotNull().alias("is_revisit")]
    return doubtful.select(*columns).unionByName(flagged.where("NOT pairlens_maybe").withColumn("refers_to", F.lit(None).cast("long")).select(*columns))


def write_bundles(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Write pages as bundles below path."""

    def run(batches):
        bundle = Bundle(frame_bytes)
        for batch in batches:
            for page_id, url, html, digest, refers_to, is_revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle.add(record_id(page_id), make_record(page_id, url, html.encode(), digest, refers_to, is_revisit))
                if bundle.size >= bundle_bytes:
                    yield table(["bundle"], [[bundle.close()]], [pa.binary()])
                    bundle = Bundle(frame_bytes)
        if bundle.index:
            yield table(["bundle"], [[bundle.close()]], [pa.binary()])

    bundles = arrow_map(with_revisits(pages, min_bytes), run, "bundle binary").select(F.col("bundle").cast("string").alias("value"))
    ending = struct.pack("<I", MAGIC).decode("latin-1")
    bundles.write.option("encoding", "ISO-8859-1").option("lineSep", ending).option("maxRecordsPerFile", 1).text(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Per record: record_id, page_id, record_type, refers_to, payload_bytes, payload_digest, payload, bundle, frame, frame_offset, length."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")
    names = ["record_id", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "bundle", "frame", "frame_offset", "length"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def build():
        def work(batch):
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader, rows = Reader(content.as_buffer()), []
                for identifier, frame, offset, length in reader.index:
                    record = reader.record(frame, offset, length)
                    fields, payload = record["fields"], record["payload"]
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind, refers = fields["WARC-Type"], fields.get("WARC-Refers-To")
                    if fields["WARC-Record-ID"] != identifier or kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != record["length"]):
                        raise ValueError(f"{name}: record {identifier} is damaged")
                    rows.append((identifier, page_of(identifier), kind, page_of(refers) if refers else None, record["length"], digest, payload if kind == "response" else None, name, frame, offset, length))
                    if len(rows) == 200:
                        yield table(names, [list(c) for c in zip(*rows, strict=True)], types)
                        rows = []
                if rows:
                    yield table(names, [list(c) for c in zip(*rows, strict=True)], types)

        return work

    schema = "record_id string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, bundle string, frame int, frame_offset long, length long"
    return map_batches(files, build, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to a fresh folder below the shared one and read the records back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_bundles(pages, path)
    return read_bundles(pages.sparkSession, path)
