"""Zstandard WARC archives: a dictionary in a leading skippable frame, then one frame for each record.

Archives are written by the tasks that hold the pages, each of a bounded size, through pyarrow's file systems, so that any
store that those know will do. Rows are sorted within their partition first: a task that runs again writes the same files.
Archives are read back with Spark's binaryFile source; every record's headers, lengths and digests are checked.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from .common import materialize, new_path, pieces

ARCHIVE_BYTES = 8 << 20
#: Pages that the dictionary is trained on, the bytes taken of each, and the dictionary's size.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 65_536, 32_768
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The upper halves of record ids: of a page's number, and of no number.
NUMBERED, UNNUMBERED = 0x6B1F0C2E5D5A4C3A, 0x6B1F0C2E5D5A4C3B
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class WarcError(ValueError):
    """An archive that breaks the format; names the file and the offset."""


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(UNNUMBERED << 64) if page is None else (NUMBERED << 64) | (page & (2**64 - 1)))}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = n & (2**64 - 1)
    return None if n >> 64 != NUMBERED else low - (1 << 64) if low >> 63 else low


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": f"sha1:{sha1_32(payload)}",
        "WARC-Block-Digest": f"sha1:{sha1_32(block)}",
    }
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to)}
    headers["Content-Length"] = str(len(block))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def decode_record(data: bytes) -> dict:
    """A record's fields; raises WarcError where a header is missing or a length or digest is wrong."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if first != "WARC/1.1" or not sep:
        raise WarcError("no WARC/1.1 header")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"header line {line!r}")
        headers[name.strip().lower()] = value.strip()
    if lost := {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys():
        raise WarcError(f"no header {', '.join(sorted(lost))}")
    block = rest[:-4]
    if not headers["content-length"].isdigit() or int(headers["content-length"]) != len(block) or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {headers['content-length']} for a block of {len(block)} bytes")
    if headers.get("warc-block-digest", "").removeprefix("sha1:") != sha1_32(block):
        raise WarcError("block digest")
    http, sep, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length: (\d+)", http)
    if not sep or not length:
        raise WarcError("HTTP header")
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (int(length[1]) != len(payload) or digest != sha1_32(payload)):
        raise WarcError("payload length or digest")
    if kind == "revisit" and (payload or headers.get("warc-profile") != PROFILE or "warc-refers-to" not in headers):
        raise WarcError("revisit record")
    return {
        "page_id": page_of(headers["warc-record-id"]),
        "url": headers.get("warc-target-uri"),
        "payload_bytes": int(length[1]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page_of(headers["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def train(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary of at most DICTIONARY_BYTES; plain content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in samples if s]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at this offset ends, from its block headers."""
    params = zstandard.get_frame_parameters(data[at : at + 18])
    end = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        if end + 3 > len(data):
            raise WarcError("cut frame")
        header = int.from_bytes(data[end : end + 3], "little")
        kind, size = header >> 1 & 3, header >> 3
        if kind == 3:
            raise WarcError("reserved block")
        end += 3 + (1 if kind == 1 else size)
        if header & 1:
            break
    end += 4 * params.has_checksum
    if end > len(data):
        raise WarcError("cut frame")
    return end


def decode_archive(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame after the dictionary's."""
    data, at, dictionary = memoryview(content), 0, None
    if len(data) >= 8 and int.from_bytes(data[:4], "little") == DICTIONARY_MAGIC:
        at = 8 + int.from_bytes(data[4:8], "little")
        if at > len(data):
            raise WarcError("cut dictionary")
        raw = bytes(data[8:at])
        raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME_MAGIC else raw
        dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        if bytes(data[at : at + 4]) != FRAME_MAGIC:
            raise WarcError(f"no frame at {at}")
        end = frame_end(data, at)
        yield at, reader.decompress(data[at:end])
        at = end


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) below folder and returns (file, records, bytes), written.

    Of rows with equal payloads the one with the smallest page_id is a response and the others revisit it; rows that repeat
    that page_id are responses too. A row without page_id is a response. A null html is an empty payload, a null url an
    empty target. No rows give no archive. Extra columns are ignored.
    """
    spark = pages.sparkSession
    prepare(spark)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    least = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to != last").select("digest", "refers_to")
    revisits = rows.select("page_id", "digest").join(materialize(least, "repeated"), "digest").filter("page_id != refers_to").distinct()
    rows = rows.join(materialize(revisits, "revisits"), ["page_id", "digest"], "left")
    ids = pages.select(F.col("page_id").cast("long")).orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES)
    sample = pages.join(F.broadcast(materialize(ids.distinct(), "sample")), "page_id").select("page_id", F.substring("html", 1, SAMPLE_BYTES).alias("html"))
    sample = sample.orderBy("page_id").limit(SAMPLE_PAGES).collect()
    dictionary = train([(r.html or "").encode()[:SAMPLE_BYTES] for r in sample])
    lead = dictionary_frame(dictionary)

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True, write_content_size=True)
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        made = 0

        def closed(parts: list[bytes]) -> pa.RecordBatch:
            nonlocal made
            name, made = f"part-{task.partitionId():06d}-{made:04d}.warc.zst", made + 1
            hidden = f"{base}/_{name}.{task.taskAttemptId()}"
            with store.open_output_stream(hidden) as out:
                for p in parts:
                    out.write(p)
            store.move(hidden, f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "records": [len(parts) - 1], "bytes": [sum(map(len, parts))]})

        parts, size = [lead], len(lead)
        for b in pieces(batches, "payload"):
            for page, url, payload, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                parts.append(packer.compress(encode_record(page, url, payload, refers, refers is not None)))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield closed(parts)
                    parts, size = [lead], len(lead)
        if len(parts) > 1:
            yield closed(parts)

    ordered = rows.sortWithinPartitions("page_id", "digest", "url").select("page_id", "url", "payload", "refers_to")
    return materialize(ordered.mapInArrow(archives, "file string, records long, bytes long"), "manifest")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in folder; see RECORD for the columns. A broken archive fails the query with its place."""
    prepare(spark)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "content"):
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows, at = [], 0
                try:
                    for at, data in decode_archive(content):
                        row = decode_record(data)
                        rows.append(row if payloads else row | {"payload": None})
                except (WarcError, zstandard.ZstdError, UnicodeDecodeError) as e:
                    raise WarcError(f"{path} at {at}: {e}") from e
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(records, RECORD)


_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    folder = new_path(spark, "archives")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    if not manifest.head(1):
        return spark.createDataFrame([], RECORD).drop("payload", "url")
    return read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
