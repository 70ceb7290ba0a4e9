import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import noticeloom.llm.media as module
from noticeloom.llm.media import (
    ALAW, BLOCK_CODES, CODECS, INDEX_STEPS, MULAW, STEPS, TABLES, decode, decode_blocks, decode_media, encode_media, encode_wav, feature_of, op10_media, padded,
    payload_of, read_wav, resample,
)
from tests.llm.conftest import EDGES


def plain_mulaw(code):
    code = ~code & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return -size if code & 128 else size


def plain_alaw(code):
    code ^= 0x55
    e, m = code >> 4 & 7, (code & 15) << 4
    size = m + 8 if e == 0 else (m + 0x108) << (e - 1)
    return size if code & 128 else -size


def plain_adpcm(block):
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            sample = max(-32768, min(32767, sample + (-change if code & 8 else change)))
            index = max(0, min(88, index + int(INDEX_STEPS[code])))
            out.append(sample)
    return out


def test_tables():
    assert TABLES[MULAW].tolist() == [plain_mulaw(c) for c in range(256)]
    assert TABLES[ALAW].tolist() == [plain_alaw(c) for c in range(256)]
    assert (TABLES[MULAW][0], TABLES[MULAW][128], TABLES[MULAW][255]) == (-32124, 32124, 0)


def test_blocks_equal_sequential_decoding():
    r = random.Random(3)
    blocks = np.array([[r.randrange(256) for _ in range(40)] for _ in range(7)], np.uint8)
    assert decode_blocks(blocks).tolist() == [plain_adpcm(bytes(b)) for b in blocks]


@pytest.mark.parametrize("codec", CODECS)
@pytest.mark.parametrize("n", [576, 576 * 5])
def test_round_trip(codec, n):
    payload = random.Random(n).randbytes(n)
    media = encode_wav(payload, codec)
    assert payload_of(media) == payload
    tag, align, data = read_wav(media)
    assert tag == CODECS[codec]
    pcm = decode([media, media])
    assert pcm[0].tolist() == pcm[1].tolist()
    if codec == "adpcm":
        assert pcm[0].tolist() == [s for i in range(0, len(data), align) for s in plain_adpcm(data[i : i + align])]


def test_wrong_files_fail():
    media = encode_wav(bytes(576), "mulaw")
    for bad in (media[:-1], b"RIFX" + media[4:], media[:20] + b"\x63" + media[21:], b""):
        with pytest.raises((ValueError, Exception)):
            read_wav(bad)
    with pytest.raises(ValueError):
        encode_wav(b"x" * (BLOCK_CODES + 1), "adpcm")


def test_resample():
    assert resample(np.array([0, 100, 200], np.int16), 8000, 16000).tolist() == [0, 50, 100, 150, 200, 200]
    assert resample(np.array([5, 6, 7, 8], np.int16), 8000, 4000).tolist() == [5, 7]
    assert resample(np.zeros(0, np.int16), 8000, 16000).tolist() == []


def test_long_samples_are_worked_off_in_parts(monkeypatch):
    pcm = np.random.default_rng(1).integers(-32768, 32768, 1000).astype("<i2")
    whole, feature = resample(pcm, 8000, 11_025), feature_of(pcm, "alaw", 8000)
    monkeypatch.setattr(module, "SAMPLES", 7)
    assert resample(pcm, 8000, 11_025).tolist() == whole.tolist()
    assert feature_of(pcm, "alaw", 8000) == feature
    values = pcm.tolist()
    crossings = sum((a < 0) != (b < 0) for a, b in zip(values, values[1:]))
    assert feature == f"codec=alaw;rate=8000;samples=1000;peak={max(map(abs, values))};crossings={crossings};mean_square={sum(v * v for v in values) // 1000};pcm_crc32={zlib.crc32(pcm.tobytes())}"


def plain_wav(payload, codec):
    """By the struct of the format, field by field."""
    if codec == "adpcm":
        data = b"".join(bytes(4) + payload[i : i + 288] for i in range(0, len(payload), 288))
        form, count = (17, 1, 8000, 8000 * 292 // 577, 292, 4, 2, 577), len(payload) // 288 * 577
    else:
        data, form, count = payload, ({"mulaw": 7, "alaw": 6}[codec], 1, 8000, 8000, 1, 8, 0), len(payload)
    widths = [2, 2, 4, 4, 2, 2, 2, 2][: len(form)]
    head = b"".join(v.to_bytes(w, "little") for v, w in zip(form, widths))
    chunks = b"".join(n + len(c).to_bytes(4, "little") + c for n, c in ((b"fmt ", head), (b"fact", count.to_bytes(4, "little")), (b"data", data)))
    return b"RIFF" + (len(chunks) + 4).to_bytes(4, "little") + b"WAVE" + chunks


def plain_pcm(payload, codec):
    if codec == "adpcm":
        one = [s for i in range(0, len(payload), 288) for s in plain_adpcm(bytes(4) + payload[i : i + 288])]
    else:
        one = [(plain_mulaw if codec == "mulaw" else plain_alaw)(c) for c in payload]
    return [v for a, b in zip(one, [*one[1:], one[-1]]) for v in (a, (a + b) // 2)]


def test_spark_round_trip_on_edges(edges, empty):
    payloads = edges.select("doc_id", padded(F.col("text")).alias("payload"), F.lit("keep").alias("pcm2"))
    for codec in CODECS:
        stored = encode_media(payloads.withColumn("codec", F.lit(codec)))
        rows = decode_media(stored, outputs=("payload", "pcm", "feature", "digest")).collect()
        assert len(rows) == len(EDGES)
        got = sorted((r["doc_id"] or -1, bytes(r["payload"])) for r in rows)
        expected = []
        for e in EDGES:
            data = (e[1] or "").encode()
            expected.append((e[0] or -1, data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))))
        assert got == sorted(expected)
        for r in rows:
            assert r["digest"]["payload_sha256"] == hashlib.sha256(r["payload"]).hexdigest()
            assert r["digest"]["tail_crc32"] == zlib.crc32(r["payload"][-32:])
            pcm = np.frombuffer(r["pcm"], "<i2")
            assert pcm.tolist() == resample(decode([encode_wav(r["payload"], codec)])[0], 8000, 16_000).tolist()
            assert r["feature"] == feature_of(pcm, codec, 16_000)
    nothing = encode_media(payloads.withColumn("codec", F.lit("alaw")).withColumn("payload", F.lit(None).cast("binary")))
    assert decode_media(nothing).where("payload IS NOT NULL OR feature IS NOT NULL").count() == 0
    assert encode_media(empty.select("doc_id", F.lit(b"").alias("payload"), F.lit("alaw").alias("codec"))).count() == 0


def test_clashing_names(edges):
    clashing = {c: F.lit(c) for c in ("media", "pcm", "digest", "feature", "row")}
    rows = edges.select("doc_id", padded(F.col("text")).alias("payload"), F.lit("alaw").alias("codec")).withColumns(clashing)
    decoded = decode_media(encode_media(rows), outputs=("digest", "pcm", "feature"))
    assert sorted(decoded.columns) == sorted(["doc_id", "codec", "row", "digest", "pcm", "feature"])
    assert decoded.where("row = 'row' AND feature LIKE 'codec=alaw%'").count() == len(EDGES)


def test_query(spark):
    documents = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op10_media(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in rows} == set(documents) and len(rows) == len(documents)
    assert {r["feature"].split(";")[0] for r in rows} == {f"codec={c}" for c in CODECS}
    for r in rows:
        text = documents[r["doc_id"]]
        data = text + b"\xff" * (max(1, -(-len(text) // 576)) * 576 - len(text))
        codec = list(CODECS)[zlib.crc32(data) % 3]
        wav = plain_wav(data, codec)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(text), len(data), hashlib.sha256(data).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(data[-32:]), len(wav), hashlib.sha256(wav).hexdigest())
        if len(data) < 20_000:
            pcm = plain_pcm(data, codec)
            assert np.frombuffer(r["pcm"], "<i2").tolist() == pcm
            assert r["feature"].startswith(f"codec={codec};rate=16000;samples={len(pcm)};peak={max(map(abs, pcm))};")
            assert r["feature"].endswith(f"mean_square={sum(v * v for v in pcm) // len(pcm)};pcm_crc32={zlib.crc32(np.array(pcm, '<i2').tobytes())}")
