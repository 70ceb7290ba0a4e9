import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from noticeloom.llm.common import scratch_path
from noticeloom.llm.warc import BadArchive, archive, parse, prepare, read_archives, record_bytes, records, write_archives


def row(i, payload):
    return {"page_id": i, "url": f"http://a/{i} x", "payload": payload, "payload_bytes": len(payload), "digest": hashlib.sha256(payload).hexdigest(), "refers_to": None}


ROWS = [row(i, f"<html>{'page ' * (i % 50)} number {i} é</html>".encode()) for i in range(300)]


def test_round_trip_with_dictionary():
    data = b"".join(archive(iter([record_bytes(r) for r in ROWS])))
    assert struct.unpack_from("<I", data)[0] == 0x184D2A5D
    got = [parse(x) for x in records(data)]
    assert [g["payload"] for g in got] == [r["payload"] for r in ROWS]
    assert got[3]["record_id"] == "urn:noticeloom:page:3"
    assert got[3]["url"] == "http://a/3%20x"


def test_small_archives_have_no_dictionary():
    data = b"".join(archive(iter([record_bytes(ROWS[0])])))
    assert struct.unpack_from("<I", data)[0] == 0xFD2FB528
    assert [parse(x)["payload"] for x in records(data)] == [ROWS[0]["payload"]]


def test_compressed_dictionary_and_foreign_frames():
    plain = b"".join(archive(iter([record_bytes(r) for r in ROWS])))
    size = struct.unpack_from("<I", plain, 4)[0]
    packed = zstandard.ZstdCompressor().compress(plain[8 : 8 + size])
    data = struct.pack("<II", 0x184D2A5D, len(packed)) + packed + struct.pack("<II", 0x184D2A50, 3) + b"abc" + plain[8 + size :]
    assert sum(1 for _ in records(data)) == len(ROWS)


@pytest.mark.parametrize(
    "change",
    [
        lambda d: d[:-3],
        lambda d: d[:-40] + bytes(40),
        lambda d: d[: len(d) // 2],
        lambda d: b"junk" + d,
        lambda d: d[:8] + b"\xff" * 4 + d[12:],
    ],
)
def test_broken_archives_fail(change):
    data = b"".join(archive(iter([record_bytes(r) for r in ROWS])))
    with pytest.raises((BadArchive, zstandard.ZstdError)):
        [parse(x) for x in records(change(data))]


@pytest.mark.parametrize("old, new", [(b"WARC/1.1", b"WARC/9.9"), (b"WARC-Type", b"X-Type"), (b"page", b"pagf"), (b"Content-Length: ", b"Content-Length: 9"), (b"sha256:", b"md5:"), (b"HTTP/1.1", b"HTTQ/1.1")])
def test_broken_records_fail(old, new):
    record = record_bytes(ROWS[7])
    with pytest.raises(BadArchive):
        parse(record.replace(old, new))


def test_revisits_nulls_and_repeated_rows(spark):
    big, small = "é" * 60, "x" * 99
    rows = [(5, big), (3, big), (9, big), (3, big), (None, big), (1, small), (2, small), (7, None), (8, ""), (None, None), (10, "y" * 100), (11, "Y" * 100)]
    pages = spark.createDataFrame([(i, None if i == 1 else f"http://x/{i}", h) for i, h in rows], "page_id bigint, url string, html string").repartition(4)
    folder = scratch_path(spark, "test-warc")
    manifest = write_archives(prepare(pages), folder)
    assert sum(r["records"] for r in manifest.collect()) == len(rows)
    got = read_archives(spark, folder).collect()
    assert len(got) == len(rows)
    by = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_bytes"]) for r in got)
    urn = "urn:noticeloom:page:"
    expected = []
    for i, h in rows:
        revisit = h == big and i != 3
        expected.append((f"{urn}{'' if i is None else i}", "revisit" if revisit else "response", f"{urn}3" if revisit else "", len((h or "").encode())))
    assert by == sorted(expected)
    assert all(r["payload_digest"] == hashlib.sha256(bytes(r["payload"])).hexdigest() for r in got if r["record_type"] == "response")


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    folder = scratch_path(spark, "test-warc-empty")
    write_archives(prepare(pages), folder)
    assert read_archives(spark, folder).count() == 0


def test_clashing_names(spark, tmp_path):
    """Columns of the archives' own names in the table of pages do no harm."""
    html = "<p>long enough to be a payload that others can revisit</p>" * 3
    pages = spark.createDataFrame([(1, "https://a/1", html, "x", "y"), (2, "https://a/2", html, "x", "y"), (3, None, None, None, None)], "page_id bigint, url string, html string, payload string, first string").withColumn("digest", F.lit(7))
    write_archives(prepare(pages), f"file://{tmp_path}")
    rows = {r["record_id"][-1]: r for r in read_archives(spark, f"file://{tmp_path}").collect()}
    assert {k: r["record_type"] for k, r in rows.items()} == {"1": "response", "2": "revisit", "3": "response"}
    assert bytes(rows["1"]["payload"]) == html.encode() and rows["2"]["payload"] is None
