"""WARC archives with Zstandard: writer and reader.

An archive starts with a skippable frame that holds its dictionary; each record is a frame of its own that was compressed
with it. Tasks write one archive per partition (several if it gets large) into a shared folder: first under a temporary
name, then moved to the final one, so a task that is lost or runs twice leaves whole archives only. The reader takes
archives from any store that Spark reads, loads the dictionary, decodes frame by frame, and validates headers, lengths
and digests.
"""

from __future__ import annotations

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
from pyspark.sql import types as T

from noticeloom.llm.common import saved, scratch_path, table

# Fixed values of the formats.
DICTIONARY_FRAME, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Payloads below this size are never revisits.
LEAST_REVISIT = 100
DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLES = 16 << 10, 2 << 20, 500
ARCHIVE_BYTES, LEVEL = 64 << 20, 3
URN = "urn:noticeloom:page:"


class BadArchive(ValueError):
    """A frame, header or length that isn't as it must be."""


# -- writing ---------------------------------------------------------------------------------------------------------


def record_bytes(row: dict) -> bytes:
    """One record. ``row``: page_id, url, payload (None in a revisit), payload_bytes, digest, refers_to."""
    revisit = row["payload"] is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (b"" if revisit else row["payload"])
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{URN}{'' if row['page_id'] is None else row['page_id']}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "")),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        headers[4:4] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{row['refers_to']}>")]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from the first records of an archive (at most SAMPLES and SAMPLE_BYTES), if they are enough."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return None


def archive(records: Iterator[bytes]) -> Iterator[bytes]:
    """The archive's bytes, frame by frame."""
    first: list[bytes] = []
    size = 0
    for record in records:
        first.append(record)
        size += len(record)
        if size >= SAMPLE_BYTES or len(first) >= SAMPLES:
            break
    dictionary = train([r[:SAMPLE_BYTES] for r in first])
    if dictionary:
        data = dictionary.as_bytes()
        yield struct.pack("<II", DICTIONARY_FRAME, len(data)) + data
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
    for record in first:
        yield compressor.compress(record)
    for record in records:
        yield compressor.compress(record)


WRITABLE = "page_id bigint, url string, payload binary, payload_bytes bigint, digest string, refers_to bigint"


def prepare(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as rows for :func:`write_archives`.

    Of the records with equal payloads of at least LEAST_REVISIT bytes, those of the smallest page_id are responses and
    the others revisits of it (rows that repeat that page_id too are all responses; null ids are never smallest unless all
    are null). Only payloads that occur more than once are looked up, by an equi-join that adaptive execution can split.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha2("payload", 256))
    shared = (
        rows.where(F.col("payload_bytes") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, "digest", "left").select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        "digest",
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes ``rows`` (columns of WRITABLE) as archives into ``folder``; returns path, records and bytes of each."""
    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(folder)
        part, done = TaskContext.get().partitionId(), []
        every = (record_bytes(row) for batch in batches for row in batch.to_pylist())
        record = next(every, None)
        while record is not None:
            hidden = f"{place}/_writing-{uuid.uuid4().hex}"
            written = [0, 0]

            def upto(first: bytes, most: list[int] = written) -> Iterator[bytes]:
                nonlocal record
                record = first
                while record is not None and most[1] < ARCHIVE_BYTES:
                    most[0] += 1
                    yield record
                    record = next(every, None)

            with store.open_output_stream(hidden) as out:
                for frame in archive(upto(record)):
                    out.write(frame)
                    written[1] += len(frame)
            done.append((hidden, f"{place}/part-{part:06d}-{len(done):04d}.warc.zst", *written))
        for hidden, final, *_ in done:
            store.move(hidden, final)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done]) for i in (1, 2, 3)], names=["path", "records", "bytes"])

    ordered = rows.sortWithinPartitions("page_id", "digest")
    return saved(ordered.mapInArrow(work, "path string, records bigint, bytes bigint"), "warc-manifest")


# -- reading ---------------------------------------------------------------------------------------------------------


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its header and block sizes."""
    if at + 8 > len(data):
        raise BadArchive(f"a frame is cut off at {at}")
    magic, size = struct.unpack_from("<II", data, at)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        end = at + 8 + size
    elif magic == FRAME:
        checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
        end = at + zstandard.frame_header_size(data[at : at + 18])
        last = False
        while not last:
            if end + 3 > len(data):
                raise BadArchive(f"a frame is cut off at {at}")
            head = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
            end += 3 + (1 if kind == 1 else size)
        end += 4 * checksum
    else:
        raise BadArchive(f"no frame at {at}")
    if end > len(data):
        raise BadArchive(f"a frame is cut off at {at}")
    return end


def dictionary_of(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, if there is one, and where the records start."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_FRAME:
        return None, 0
    end = frame_end(data, 0)
    raw = bytes(data[8:end])
    if raw[:4] == struct.pack("<I", FRAME):
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return zstandard.ZstdCompressionDict(raw), end


def records(data: bytes) -> Iterator[bytes]:
    """One record per frame; other skippable frames are passed over."""
    view = memoryview(data)
    dictionary, at = dictionary_of(view)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        end = frame_end(view, at)
        if struct.unpack_from("<I", view, at)[0] == FRAME:
            try:
                yield decompressor.decompressobj().decompress(view[at:end])
            except zstandard.ZstdError as error:
                raise BadArchive(f"the frame at {at} doesn't decode: {error}") from error
        at = end


def headers_of(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise BadArchive(f"not a header: {line[:80]!r}")
        out[name.decode().lower()] = value.strip().decode()
    return out


def parse(record: bytes) -> dict:
    """A record's fields, validated."""
    head, ends, rest = record.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not ends or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise BadArchive(f"no WARC record: {record[:40]!r}")
    headers = headers_of(lines)
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys()
    if missing:
        raise BadArchive(f"headers are missing: {', '.join(sorted(missing))}")
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise BadArchive(f"Content-Length is {length}, the block with its end has {len(rest)} bytes")
    out = {"record_type": headers["warc-type"], "record_id": headers["warc-record-id"].strip("<>"), "url": headers.get("warc-target-uri"), "refers_to": None, "payload": None, "payload_bytes": None, "payload_digest": None}
    if out["record_type"] in ("response", "revisit"):
        http, ends, payload = rest[:-4].partition(b"\r\n\r\n")
        status, _, lines = http.partition(b"\r\n")
        if not ends or not status.startswith(b"HTTP/"):
            raise BadArchive("no HTTP headers in the block")
        stated = headers_of(lines).get("content-length", "")
        kind, _, digest = headers.get("warc-payload-digest", "").partition(":")
        if not stated.isdigit() or kind != "sha256" or not re.fullmatch("[0-9a-f]{64}", digest):
            raise BadArchive("no payload length or no SHA-256 digest")
        if out["record_type"] == "response":
            if len(payload) != int(stated) or hashlib.sha256(payload).hexdigest() != digest:
                raise BadArchive("the payload isn't of its stated length or digest")
            out["payload"] = payload
        else:
            out["refers_to"] = headers.get("warc-refers-to", "").strip("<>")
            if payload or not out["refers_to"]:
                raise BadArchive("a revisit has a payload, or refers to nothing")
        out |= {"payload_bytes": int(stated), "payload_digest": digest}
    return out


RECORDS = "record_type string, record_id string, url string, refers_to string, payload binary, payload_bytes bigint, payload_digest string"


def read_archives(spark: SparkSession, path: str, *, keep_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``; revisits have a null payload. A broken archive fails the job."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    names = [f.name for f in T._parse_datatype_string(RECORDS).fields]
    kinds = [pa.string()] * 4 + [pa.binary(), pa.int64(), pa.string()]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for one in batches:
            for content in one.column("content"):
                for record in records(content.as_py()):
                    row = parse(record)
                    if not keep_payload:
                        row["payload"] = None
                    held.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 8 << 20:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    return files.select("content").mapInArrow(work, RECORDS)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_archives(prepare(table(spark, sf_dir, "pages")), folder)
    page = lambda c: F.expr(f"try_cast(nullif(substring({c}, {len(URN) + 1}), '') as bigint)")
    return read_archives(spark, folder, keep_payload=False).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
