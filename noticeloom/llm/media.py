"""Media columns: telephony audio.

A payload of bytes is kept as 8-bit mu-law or A-law samples, or as the 4-bit codes of IMA ADPCM blocks, in a WAV file of
8 kHz; the bytes read back from it are the payload again. Decoding expands mu-law and A-law by lookup tables of 256
entries. ADPCM is sequential inside a block, so numpy steps through the samples of all blocks of a batch at once. PCM is
resampled linearly and is a column of 16-bit samples in the result, beside the features computed from it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.llm.common import saved, table

RATE, UNIT = 8000, 576
#: WAV format tags.
MULAW, ALAW, IMA_ADPCM = 7, 6, 17
CODECS = {"mulaw": MULAW, "alaw": ALAW, "adpcm": IMA_ADPCM}
#: An ADPCM block: its first sample (16 bits), step index and a zero, then codes, two in a byte, low one first.
BLOCK_HEAD, BLOCK_CODES = 4, 288
#: Blocks decoded, and samples resampled, at once.
BLOCKS, SAMPLES = 16_384, 1 << 20
# Fixed values of the IMA ADPCM format.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
        1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
        8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    dtype=np.int32,
)


def mulaw_table() -> np.ndarray:
    """G.711: codes are stored inverted; 3 bits of exponent, 4 of mantissa, a bias of 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711: every other bit of a code is stored inverted; the sign bit is set for positive samples."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_blocks(blocks: np.ndarray) -> np.ndarray:
    """PCM of ADPCM blocks (rows of bytes), a row each: the head's sample and one per code."""
    heads, codes = blocks[:, :BLOCK_HEAD], blocks[:, BLOCK_HEAD:]
    sample = heads[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(heads[:, 2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((2 * codes.shape[1] + 1, len(blocks)), dtype=np.int16)
    out[0] = sample
    columns = np.ascontiguousarray(codes.T)
    for i in range(out.shape[0] - 1):
        code = (columns[i >> 1] >> (4 * (i & 1))) & 15
        step = STEPS[index]
        change = step >> 3
        change += np.where(code & 4, step, 0)
        change += np.where(code & 2, step >> 1, 0)
        change += np.where(code & 1, step >> 2, 0)
        sample += np.where(code & 8, -change, change)
        np.clip(sample, -32768, 32767, out=sample)
        index += INDEX_STEPS[code]
        np.clip(index, 0, len(STEPS) - 1, out=index)
        out[i + 1] = sample
    return out.T


def encode_wav(payload: bytes, codec: str) -> bytes:
    """A WAV file that holds the payload's bytes as samples (or as the codes of ADPCM blocks)."""
    tag = CODECS[codec]
    if tag == IMA_ADPCM:
        if not payload or len(payload) % BLOCK_CODES:
            raise ValueError(f"ADPCM takes multiples of {BLOCK_CODES} bytes")
        codes = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK_CODES)
        data = np.hstack([np.zeros((len(codes), BLOCK_HEAD), np.uint8), codes]).tobytes()
        align, samples, bits = BLOCK_HEAD + BLOCK_CODES, 2 * BLOCK_CODES + 1, 4
        per_second = RATE * align // samples
        extra = struct.pack("<HH", 2, samples)
    else:
        data, align, bits, per_second, extra = payload, 1, 8, RATE, struct.pack("<H", 0)
    count = len(data) // align * (samples if tag == IMA_ADPCM else 1)
    form = struct.pack("<HHIIHH", tag, 1, RATE, per_second, align, bits) + extra
    pad = b"\0" * (len(data) % 2)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, block size and data, with headers and lengths checked."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or struct.unpack_from("<I", media, 4)[0] != len(media) - 8:
        raise ValueError("not a WAV file of its stated length")
    at, tag, align, data, count = 12, None, 0, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            raise ValueError("a chunk passes the file's end")
        if name == b"fmt ":
            tag, align = struct.unpack_from("<H", media, at + 8)[0], struct.unpack_from("<H", media, at + 20)[0]
        elif name == b"fact":
            count = struct.unpack_from("<I", media, at + 8)[0]
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if tag not in CODECS.values() or data is None:
        raise ValueError("no known format or no data")
    if len(data) % align or count != len(data) // align * (2 * (align - BLOCK_HEAD) + 1 if tag == IMA_ADPCM else 1):
        raise ValueError("the data isn't of the stated number of samples")
    return tag, align, data


def payload_of(media: bytes) -> bytes:
    tag, align, data = read_wav(media)
    return np.frombuffer(data, np.uint8).reshape(-1, align)[:, BLOCK_HEAD:].tobytes() if tag == IMA_ADPCM else data


def decode(media: list[bytes]) -> list[np.ndarray]:
    """16-bit PCM of each WAV file. The ADPCM blocks of all files are decoded together, ``BLOCKS`` at a time."""
    out: list = [None] * len(media)
    waiting, held = [], 0

    def together() -> None:
        nonlocal held
        if waiting:
            rows = np.concatenate([b for _, b in waiting])
            pcm = np.concatenate([decode_blocks(rows[i : i + BLOCKS]) for i in range(0, len(rows), BLOCKS)])
            start = 0
            for i, b in waiting:
                out[i] = pcm[start : start + len(b)].reshape(-1)
                start += len(b)
            waiting.clear()
            held = 0

    for i, m in enumerate(media):
        tag, align, data = read_wav(m)
        codes = np.frombuffer(data, np.uint8)
        if tag == IMA_ADPCM:
            waiting.append((i, codes.reshape(-1, align)))
            held += len(codes) // align
            if held >= BLOCKS:
                together()
        else:
            out[i] = TABLES[tag][codes]
    together()
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers, so that every machine gives the same samples."""
    out = np.empty(len(pcm) * to // rate, dtype="<i2")
    for start in range(0, len(out), SAMPLES):
        place = np.arange(start, min(start + SAMPLES, len(out)), dtype=np.int64) * rate
        left, part = place // to, place % to
        a = pcm[left].astype(np.int64)
        b = pcm[np.minimum(left + 1, len(pcm) - 1)].astype(np.int64)
        out[start : start + SAMPLES] = (a * (to - part) + b * part) // to
    return out


def feature_of(pcm: np.ndarray, codec: str, rate: int) -> str:
    peak = crossings = square = 0
    for start in range(0, len(pcm), SAMPLES):
        wide = pcm[max(0, start - 1) : start + SAMPLES].astype(np.int64)  # with the sample before
        crossings += int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
        own = wide[min(start, 1) :]
        peak, square = max(peak, int(abs(own).max(initial=0))), square + int((own * own).sum())
    return f"codec={codec};rate={rate};samples={len(pcm)};peak={peak};crossings={crossings};mean_square={square // max(1, len(pcm))};pcm_crc32={zlib.crc32(pcm.tobytes())}"


def encode_media(df: DataFrame, *, payload_col: str = "payload", codec_col: str = "codec") -> DataFrame:
    """``df`` with ``media``, the payload as a WAV file of the row's codec (mulaw, alaw or adpcm), in place of the payload.
    A null payload has null media; an unknown codec or a payload that doesn't fit it fails the job."""
    names = [c for c in df.columns if c not in (payload_col, "media")]
    given = df.select(F.col(f"`{payload_col}`").alias("payload"), F.col(f"`{codec_col}`").alias("codec"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    schema = T.StructType([given.schema["row"], T.StructField("media", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("payload"), batch.column("codec").to_pylist(), strict=True)
            media = pa.array([encode_wav(p.as_py(), c) if p.is_valid else None for p, c in pairs], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), media], names=["row", "media"])

    return given.mapInArrow(work, schema).select("row.*", "media")


def decode_media(df: DataFrame, *, media_col: str = "media", to_rate: int = 16_000, outputs: tuple[str, ...] = ("payload", "pcm", "feature")) -> DataFrame:
    """``df`` without its media but with what ``outputs`` names: ``payload`` (the bytes read back), ``pcm`` (little-endian
    16-bit samples resampled to ``to_rate``), ``feature`` (codec, samples, peak, zero crossings, mean square and checksum
    of the PCM), ``digest`` (struct of payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256).

    Null media give nulls. Files with wrong headers or lengths fail the job. Input columns of the outputs' names are
    replaced. An empty table gives no rows.
    """
    kinds = {"payload": "binary", "pcm": "binary", "feature": "string", "digest": "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string>"}
    names = [c for c in df.columns if c != media_col and c not in outputs]
    given = df.select(F.col(f"`{media_col}`").alias("media"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    schema = T.StructType([given.schema["row"], *T._parse_datatype_string(", ".join(f"{o} {kinds[o]}" for o in outputs)).fields])
    digest = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])
    arrow = {"payload": pa.binary(), "pcm": pa.binary(), "feature": pa.string(), "digest": digest}
    codec_of, decoded = {tag: name for name, tag in CODECS.items()}, "pcm" in outputs or "feature" in outputs

    def one(media: bytes, pcm: np.ndarray | None) -> dict:
        payload = payload_of(media)
        out: dict = {"payload": payload}
        if decoded:
            again = resample(pcm, RATE, to_rate)
            out |= {"pcm": again.tobytes(), "feature": feature_of(again, codec_of[read_wav(media)[0]], to_rate)}
        if "digest" in outputs:
            out["digest"] = {
                "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
                "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
            }
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media"):
                media = [m.as_py() for m in batch.column("media")]
                there = [m for m in media if m is not None]
                pcm = iter(decode(there) if decoded else [None] * len(there))
                found = [{} if m is None else one(m, next(pcm)) for m in media]
                columns = [pa.array([x.get(o) for x in found], arrow[o]) for o in outputs]
                yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names=["row", *outputs])

    return given.mapInArrow(work, schema).select("row.*", *outputs)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of a column, as PCM takes several times the room."""
    sizes = np.cumsum([0 if not m.is_valid else len(m.as_buffer()) for m in batch.column(column)])
    start, before = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(start, end - start)
        start, before = end, int(sizes[end - 1])


def padded(text, unit: int = UNIT):
    """The UTF-8 bytes of a text (null: none), filled up with bytes 255 to a positive multiple of ``unit``."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(data)
    fill = F.greatest(F.lit(unit), F.ceil(size / unit) * unit) - size
    return F.concat(data, F.unhex(F.repeat(F.lit("FF"), fill.cast("int"))))


def op10_media(spark, sf_dir: str) -> DataFrame:
    """Stores each payload in the codec that its checksum picks, in a table of media, and reads the table back. The
    resampled PCM is the result's last column."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), padded(F.col("text")).alias("payload"))
    codec = F.element_at(F.array(*map(F.lit, CODECS)), (F.crc32("payload") % len(CODECS) + 1).cast("int"))
    stored = saved(encode_media(documents.withColumn("codec", codec)), "media")
    return decode_media(stored, outputs=("digest", "feature", "pcm")).select("doc_id", "n_bytes", "digest.*", "feature", "pcm")
