"""WARC records in seekable Zstandard bundles, written and read through Spark's own file access.

A bundle is a file of independent Zstandard frames, each with whole WARC
records; then a skippable frame with the record index (record id, frame, offset
in the unpacked frame, length); then a skippable frame with the seek table,
whose footer ends the file. Any Zstandard tool unpacks it to a plain WARC file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tentpole.llm.common import lookup_join, saved, scratch_path

#: Unpacked bytes from which a frame, and a bundle, is closed. A larger record is a frame by itself.
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 32 * 1024 * 1024
LEVEL = 3
#: Magic numbers of skippable frames with the record index and the seek table, and of the seek table's footer (fixed values).
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, bundle string, frame long, offset long"
ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("payload", pa.binary()), ("bundle", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()),
    ]
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The text sink ends each row with this, which makes the footer's magic number the end of the file.
FILE_END = struct.pack("<I", FOOTER_MAGIC).decode("latin-1")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record with an HTTP response block; a revisit has its header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parsed(data: bytes) -> dict:
    """A record's type, ids, URL, digest, full payload size and payload."""
    head, _, block = data.partition(b"\r\n\r\n")
    named = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    return {
        "page_id": page_of(named["WARC-Record-ID"]), "url": named.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": named["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": named["WARC-Type"], "refers_to": page_of(named.get("WARC-Refers-To")), "payload": payload if named["WARC-Type"] == "response" else None,
    }


class Bundle:
    """Collects records into frames; ``done`` gives the whole file."""

    def __init__(self, level: int = LEVEL):
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple] = []
        self.part: list[bytes] = []
        self.fill = self.total = 0

    def add(self, page_id: int | None, data: bytes, frame_bytes: int = FRAME_BYTES) -> None:
        if self.part and self.fill + len(data) > frame_bytes:
            self.close()
        self.index.append((page_id, len(self.frames), self.fill, len(data)))
        self.part.append(data)
        self.fill += len(data)
        self.total += len(data)

    def close(self) -> None:
        if self.part:
            plain = b"".join(self.part)
            self.frames.append(self.packer.compress(plain))
            self.sizes.append((len(self.frames[-1]), len(plain)))
            self.part, self.fill = [], 0

    def done(self) -> bytes:
        self.close()
        index = self.packer.compress(json.dumps(self.index).encode())
        index = struct.pack("<II", INDEX_MAGIC, len(index)) + index
        sizes = [*self.sizes, (len(index), 0)]
        table = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, FOOTER_MAGIC)
        return b"".join(self.frames) + index + struct.pack("<II", SEEK_MAGIC, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, packed size, unpacked size) of each frame, from the footer at the end of the file."""
    n, descriptor, magic = struct.unpack("<IBI", data[-9:])
    if magic != FOOTER_MAGIC or descriptor & 0x80:
        raise ValueError("no seek table of this kind at the end of the file")
    start = len(data) - 9 - 8 * n
    if struct.unpack("<II", data[start - 8 : start]) != (SEEK_MAGIC, 8 * n + 9):
        raise ValueError("the seek table's frame is damaged")
    out, at = [], 0
    for k in range(n):
        packed, plain = struct.unpack("<II", data[start + 8 * k : start + 8 * k + 8])
        out.append((at, packed, plain))
        at += packed
    return out


def record_index(data: bytes) -> list[tuple[int | None, int, int, int]]:
    """(page id, frame, offset in the unpacked frame, length) of each record of a bundle."""
    at, packed, _ = seek_table(data)[-1]
    return [tuple(x) for x in json.loads(zstandard.ZstdDecompressor().decompress(data[at + 8 : at + packed]))]


def frame(data: bytes, table: list[tuple[int, int, int]], k: int) -> bytes:
    """Frame ``k`` unpacked, without reading any other."""
    at, packed, plain = table[k]
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=plain)


def with_revisits(pages: DataFrame, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload`` (null markup: empty), ``digest`` and ``first``: the smallest page id with an equal payload.

    ``first`` is null for payloads of under ``least_bytes`` and for those that
    only one row has. Payloads are compared by SHA-1.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(markup).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    again = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    again = saved(again.where("rows > 1"), "digests")
    heavy = [r[0] for r in again.where("rows >= 20000").orderBy(F.desc("rows")).limit(1000).select("digest").collect()]
    return lookup_join(rows, again.drop("rows"), "digest", "left", heavy)


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, **columns: str) -> None:
    """Write a record for every row into bundles below ``path``, one bundle a file.

    Of rows with equal payloads, those with the smallest page id are responses
    and the others revisit it; null ids come last. A row without an id gets a
    record without a number. Goes through Spark's text sink, so any file system
    that Spark can write, and its commit protocol, hold. An empty table gives
    no bundle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = Bundle()
        whole = lambda: pa.RecordBatch.from_arrays([pa.array([bundle.done()[:-4]], pa.binary())], names=["data"])
        for b in batches:
            for p, u, x, d, first in zip(*(c for c in b.columns), strict=True):
                p, u, x, d, first = (v.as_py() for v in (p, u, x, d, first))
                revisit = first is not None and p != first
                bundle.add(p, record(p, u, x, base64.b32encode(bytes.fromhex(d)).decode(), first, revisit, date), frame_bytes)
                if bundle.total >= bundle_bytes:
                    yield whole()
                    bundle = Bundle()
        if bundle.total:
            yield whole()

    rows = with_revisits(pages, least_bytes, **columns).select("page_id", "url", "payload", "digest", "first")
    bundles = rows.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value"))
    bundles.write.option("lineSep", FILE_END).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select(F.col("path").alias("bundle"), "content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the bundles below ``path``: what :func:`parsed` gives, with its bundle, frame and offset there.

    Payload digests of responses are checked; a wrong one ends the read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                data = content.as_py()
                table, rows, size, now, plain = seek_table(data), [], 0, -1, b""
                for _, k, at, n in record_index(data):
                    if k != now:
                        now, plain = k, frame(data, table, k)
                    r = parsed(plain[at : at + n])
                    if r["payload"] is not None and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != r["payload_digest"]:
                        raise ValueError(f"{name.as_py()}: the payload at frame {k}, offset {at} does not match its digest")
                    rows.append(r | {"bundle": name.as_py(), "frame": k, "offset": at})
                    size += n
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)

    return _bundles(spark, path).mapInArrow(run, RECORD)


def index(spark: SparkSession, path: str) -> DataFrame:
    """Where each record is: ``page_id``, ``bundle``, ``frame``, ``offset``, ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                found = record_index(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([name.as_py()] * len(found), pa.string()), *(pa.array([r[k] for r in found], pa.int64()) for k in (1, 2, 3))], names=["page_id", "bundle", "frame", "offset", "length"])

    return _bundles(spark, path).mapInArrow(run, "page_id long, bundle string, frame long, offset long, length long")


def fetch(spark: SparkSession, path: str, ids: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The records of the page ids in ``ids`` (column ``page_id``), unpacking only the frames they are in.

    ``known`` is the result of :func:`index` if it has been stored.
    """
    wanted = (index(spark, path) if known is None else known).join(ids.select("page_id").distinct(), "page_id").groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content, at in zip(*b.columns, strict=True):
                data = content.as_py()
                table, now, plain, rows = seek_table(data), -1, b"", []
                for w in sorted(at.as_py(), key=lambda x: (x["frame"], x["offset"])):
                    if w["frame"] != now:
                        now, plain = w["frame"], frame(data, table, w["frame"])
                    rows.append(parsed(plain[w["offset"] : w["offset"] + w["length"]]) | {"bundle": name.as_py(), "frame": now, "offset": w["offset"]})
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    return _bundles(spark, path).join(wanted, "bundle").select("bundle", "content", "at").mapInArrow(run, RECORD)


def archived(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the pages to bundles and read them back: one row for each page, without the payloads."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(pages, path, **options)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", F.regexp_extract("bundle", "[^/]*$", 0).alias("bundle"), "frame", "offset")
