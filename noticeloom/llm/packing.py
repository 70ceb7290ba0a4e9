"""Best-fit packing by hierarchical residual packing.

Each partition tokenizes its documents, cuts the long ones, and packs the pieces by best-fit into sequences. Nearly full
sequences are final. Underfull ones travel on as single items of (id, fill): in each round of a tree they are dealt out to
fewer tasks, of at most ``TASK_ITEMS`` items each, and packed by best-fit again, until one task has taken all that were
left, or a round has joined under 2 % of them: then hardly any two of a task's items fit into one sequence, and others
dealt at random won't either. Rounds are written to the shared folder, so each is computed once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.llm.common import saved, table
from noticeloom.llm.token_counts import PLAIN, load_tokenizer, runs

TASK_ITEMS = 20_000
BLOCK_PIECES = 100_000
NEARLY_FULL = 0.995
MAX_ROUNDS = 16


class ByteIds:
    """Token ids as little-endian 32-bit numbers.

    ``path`` is the vocabulary for tokenizers. Where ``ranks`` gives the same vocabulary for tiktoken, which is several
    times as fast, that takes the plain texts, on which both libraries split alike; all others go to tokenizers.
    """

    def __init__(self, path: str, ranks: str | None):
        self.tokenizer = load_tokenizer(path)
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                found = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})

    def ids(self, text: str) -> bytes:
        if self.fast and "<|" not in text and PLAIN.fullmatch(text):
            return b"".join(np.array(self.fast.encode_ordinary(run), dtype="<u4").tobytes() for run in runs(text))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_IDS: dict[tuple, ByteIds] = {}


def byte_ids(path: str, ranks: str | None) -> ByteIds:
    """One per Python worker."""
    if (path, ranks) not in _IDS:
        _IDS[path, ranks] = ByteIds(path, ranks)
    return _IDS[path, ranks]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, by best-fit decreasing: the fullest bin that still takes an item gets it.

    Open bins stand in stacks by the room they have left; the bits of ``rooms`` tell which stacks aren't empty, so the
    smallest room that is enough is a bit operation away.
    """
    bins: list[list[int]] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            stacks[left].append(b)
            rooms |= 1 << left
    return bins


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than the capacity if there are several."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, length, capacity)]


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, bin bigint, offset bigint, fill bigint"
MOVES = "bin bigint, into bigint, shift bigint, fill bigint"


def pack(
    df: DataFrame,
    path: str,
    *,
    ranks: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the id column, ``piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for,
    ``ids`` (little-endian 32-bit numbers).

    A document is its token ids and ``end_id``; null texts are empty, so each row has at least one piece. Rows that
    repeat are packed each for itself; ids may be null; other columns don't matter. An empty table gives no rows.
    """
    given = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    closed = int(capacity * NEARLY_FULL)
    schema = T.StructType([given.schema["doc_id"], *T._parse_datatype_string(PIECES).fields])
    arrow = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, made = byte_ids(path, ranks), end_id.to_bytes(4, "little"), TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        most = BLOCK_PIECES // 10 if with_ids else BLOCK_PIECES

        def packed() -> pa.RecordBatch:
            nonlocal made
            out = []
            for members in best_fit([p[3] for p in held], capacity):
                fill, offset = sum(held[i][3] for i in members), 0
                for i in members:
                    out.append((*held[i], made, offset, fill))
                    offset += held[i][3]
                made += 1
            held.clear()
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *arrow], strict=True)], names=schema.names)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = memoryview(ids.ids(text or "") + end)
                for n, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    part = data[4 * start : 4 * (start + length)]
                    held.append((doc_id, n, start, length, zlib.crc32(part), bytes(part) if with_ids else None))
                if len(held) >= most:
                    yield packed()
        if held:
            yield packed()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, fills, out = [], [], []
        for batch in batches:  # of about TASK_ITEMS rows in all
            names += batch.column("bin").to_pylist()
            fills += batch.column("fill").to_pylist()
        for members in best_fit(fills, capacity):
            total, shift = sum(fills[i] for i in members), 0
            for i in members:
                out.append((names[i], names[members[0]], shift, total))
                shift += fills[i]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["bin", "into", "shift", "fill"])

    placed = saved(given.mapInArrow(local, schema), "pack-local")
    open_bins = placed.where((F.col("offset") == 0) & (F.col("fill") < closed)).select("bin", "fill")
    count, moves = open_bins.count(), None
    for turn in range(MAX_ROUNDS):
        if count < 2:
            break
        tasks = -(-count // TASK_ITEMS)
        dealt = open_bins.repartition(1) if tasks == 1 else open_bins.repartition(tasks, F.xxhash64("bin", F.lit(turn)))
        moved = saved(dealt.mapInArrow(merge, MOVES), f"pack-merge-{turn}")
        if moves is None:
            moves = moved.select("bin", "into", "shift")
        else:
            later = moved.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moves = moves.join(later, "into", "left").select(
                "bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
            )
        heads = moved.where(F.col("shift") == 0)
        after = heads.count()
        if tasks == 1 or after > 0.98 * count:
            break
        open_bins = heads.where(F.col("fill") < closed).select(F.col("into").alias("bin"), "fill")
        count = open_bins.count()
    out = [F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    if moves is None:
        return placed.select(*out, F.col("bin").alias("sequence_id"), "offset")
    return placed.join(moves, "bin", "left").select(
        *out, F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), path, ranks=ranks)
