"""Alignment of two tokenizers' tokens by their bytes, and how often each pair of their ids is linked in a corpus.

Both tokenizations of a text cover the same bytes. Where a token of A and one of B end at the same byte, a group ends; all
tokens of A in a group are linked to all of B in it. Most groups hold one token of each, with the same bytes: a table
made once gives A's id the id of B with its bytes, and such pairs are counted in one vector over A's vocabulary a task.
Only the pairs of other groups are counted by a shuffle.

Links then get their pair's count. The vector and the highest count of each A id are as long as the vocabulary, and pairs
that hold over 1 / ``HOT_PAIRS`` of all occurrences number at most ``HOT_PAIRS``; these are broadcast. Links of rarer pairs
are joined by pair, where none is hot.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.llm.common import saved, table
from noticeloom.llm.packing import ByteIds
from noticeloom.llm.token_counts import BYTE_CHARACTERS, runs

#: Characters that are aligned at once.
CHUNK = 1_000_000
#: Links that are spelled out at once, and of one group.
LINKS, GROUP_LINKS = 2_000_000, 65_536
HOT_PAIRS = 300_000


class Vocabularies:
    """The bytes of all tokens of a byte-level BPE (A) and a SentencePiece model (B), and A's ids with a namesake in B."""

    def __init__(self, path_a: str, path_b: str, ranks: str | None):
        import sentencepiece

        self.a = ByteIds(path_a, ranks)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        as_byte = {c: b for b, c in BYTE_CHARACTERS.items()}
        entries = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.bytes_a[i] = bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        is_byte = [re.fullmatch("<0x[0-9A-F]{2}>", p) for p in pieces]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(pieces, is_byte, strict=True)]
        ids = {data: i for i, data in reversed(list(enumerate(self.bytes_b))) if not is_byte[i]}
        ids = {data: i for i, data in enumerate(self.bytes_b)} | ids
        self.same = np.array([ids.get(data, -1) for data in self.bytes_a])
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        #: Ids as text, with room for what follows; zeros are left out later.
        width = len(str(max(self.size_a, self.size_b)))
        self.digits = np.array([[*str(i).encode().rjust(width, b"\0"), 0] for i in range(max(self.size_a, self.size_b))], dtype=np.uint8)

    def encoded(self, text: str, first: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Both tokenizations of a run of a text (which starts with a space unless it is the first); None if their bytes
        aren't the text's."""
        plain = " " + text if first else text
        data = plain.encode()
        b = self.b.encode(text if first else text[1:])
        if b"".join(map(self.bytes_b.__getitem__, b)) != data:
            return None
        a = np.frombuffer(self.a.ids(plain), dtype="<u4").astype(np.int64)
        return (a, np.array(b, dtype=np.int64)) if b"".join(map(self.bytes_a.__getitem__, a.tolist())) == data else None


_VOCABULARIES: dict[tuple, Vocabularies] = {}


def vocabularies(*paths: str | None) -> Vocabularies:
    """One per process."""
    if paths not in _VOCABULARIES:
        _VOCABULARIES[paths] = Vocabularies(*paths)
    return _VOCABULARIES[paths]


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    out = np.zeros(len(found), dtype=np.int64)
    np.add.at(out, at, np.concatenate(counts))
    return found, out


class Aligned:
    """Groups and links of runs of texts, one after the other. ``n_a``, ``n_b``, ``n_groups`` and ``n_links`` are by run, ``spelled`` is
    the text of each run's groups, ``pairs`` are (run * size_a + a) * size_b + b with their links."""

    def __init__(self, v: Vocabularies, runs_: list[tuple[np.ndarray, np.ndarray]]):
        a, b = (np.concatenate([r[i] for r in runs_]) for i in (0, 1))
        self.n_a, self.n_b = (np.array([len(r[i]) for r in runs_]) for i in (0, 1))
        ends_a, ends_b = np.cumsum(v.lengths_a[a]), np.cumsum(v.lengths_b[b])
        total = int(ends_a[-1]) + 1
        at_a, at_b = np.zeros(total, dtype=bool), np.zeros(total, dtype=bool)
        at_a[ends_a], at_b[ends_b] = True, True
        last_a, last_b = at_b[ends_a], at_a[ends_b]  # the tokens with which a group ends
        stop_a, stop_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        width_a, width_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        run = np.repeat(np.arange(len(runs_)), self.n_a)[stop_a - 1]
        self.n_groups = np.bincount(run, minlength=len(runs_))
        self.n_links = np.zeros(len(runs_), dtype=np.int64)
        np.add.at(self.n_links, run, width_a * width_b)
        self.spelled = self._spelled(v, a, b, last_a, last_b, width_a, width_b, run)
        self._pair(v, a, b, stop_a - width_a, stop_b - width_b, width_a, width_b, run)

    def _spelled(self, v, a, b, last_a, last_b, width_a, width_b, run) -> list[bytes]:
        before_b = np.repeat(np.cumsum(width_b) - width_b, width_a)
        before_a = np.repeat(np.cumsum(width_a), width_b)
        out = np.empty((len(a) + len(b), v.digits.shape[1]), dtype=np.uint8)
        place_a, place_b = np.arange(len(a)) + before_b, np.arange(len(b)) + before_a
        out[place_a], out[place_b] = v.digits[a], v.digits[b]
        out[place_a, -1] = np.where(last_a, ord("|"), ord(","))
        out[place_b, -1] = np.where(last_b, ord(";"), ord(","))
        used = (out != 0).sum(axis=1)
        ends = np.cumsum(used)[np.cumsum(self.n_a + self.n_b) - 1]
        data = out[out != 0].tobytes()
        return [data[start:end] for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _pair(self, v, a, b, start_a, start_b, width_a, width_b, run) -> None:
        single = (width_a == 1) & (width_b == 1)
        single[single] = v.same[a[start_a[single]]] == b[start_b[single]]
        # The fast path: one token each, of the same bytes. The others are spelled out, so many links at once.
        codes = [run[single] * v.size_a + a[start_a[single]]]
        counts = [np.ones(len(codes[0]), dtype=np.int64)]
        others, other_counts = [], []

        def add(code: np.ndarray, n: np.ndarray) -> None:
            pair_a, pair_b = code // v.size_b % v.size_a, code % v.size_b
            same = v.same[pair_a] == pair_b
            codes.append(code[same] // v.size_b)
            counts.append(n[same])
            others.append(code[~same])
            other_counts.append(n[~same])

        links = width_a * width_b
        small = np.flatnonzero(~single & (links <= GROUP_LINKS))
        for part in np.split(small, np.flatnonzero(np.diff(np.cumsum(links[small]) // LINKS)) + 1) if len(small) else []:
            group = np.repeat(part, links[part])
            k = np.arange(len(group)) - np.repeat(np.cumsum(links[part]) - links[part], links[part])
            code = (run[group] * v.size_a + a[start_a[group] + k // width_b[group]]) * v.size_b + b[start_b[group] + k % width_b[group]]
            add(*np.unique(code, return_counts=True))
        for g in np.flatnonzero(~single & (links > GROUP_LINKS)):
            ids_a, n_a = np.unique(a[start_a[g] : start_a[g] + width_a[g]], return_counts=True)
            ids_b, n_b = np.unique(b[start_b[g] : start_b[g] + width_b[g]], return_counts=True)
            step = max(1, LINKS // len(ids_b))
            for i in range(0, len(ids_a), step):
                add((((run[g] * v.size_a + ids_a[i : i + step]) * v.size_b)[:, None] + ids_b).ravel(), (n_a[i : i + step, None] * n_b).ravel())
        self.same = summed(codes, counts)
        self.other = summed(others, other_counts) if others else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def of_run(self, i: int, v: Vocabularies) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """The ids of A linked to their namesakes, and the other pairs (a * size_b + b), of one run, with their links."""
        out = []
        for (codes, counts), base in ((self.same, v.size_a), (self.other, v.size_a * v.size_b)):
            x, y = np.searchsorted(codes, [i * base, (i + 1) * base])
            out.append((codes[x:y] - i * base, counts[x:y]))
        return out[0], out[1]


class Text:
    """What is known of one text, of one or more runs."""

    def __init__(self):
        self.failed, self.n, self.digest, self.tail = False, np.zeros(4, dtype=np.int64), hashlib.sha256(), b""
        self.same, self.other = [], []

    def add(self, found: Aligned, i: int, v: Vocabularies) -> None:
        self.n += [found.n_a[i], found.n_b[i], found.n_groups[i], found.n_links[i]]
        self.digest.update(self.tail + found.spelled[i][:-1])
        self.tail = b";"
        same, other = found.of_run(i, v)
        self.same.append(same)
        self.other.append(other)

    def row(self) -> tuple:
        none = (np.zeros(0, dtype=np.int64),) * 2
        if self.failed or not self.tail:
            return (0, 0, 0, 0, "", *none, *none)
        same, other = (x[0] if len(x) == 1 else summed([c for c, _ in x], [n for _, n in x]) for x in (self.same, self.other))
        return (*self.n.tolist(), self.digest.hexdigest(), *same, *other)


def aligned_texts(texts: list[str], v: Vocabularies) -> list[tuple]:
    """Per text (n_a, n_b, n_groups, n_links, digest of the groups, ids linked to namesakes, links, other pairs, links)."""
    out = [Text() for _ in texts]
    waiting, size = [], 0

    def align() -> None:
        if waiting:
            found = Aligned(v, [r for _, r in waiting])
            for i, (text, _) in enumerate(waiting):
                if not out[text].failed:
                    out[text].add(found, i, v)
        waiting.clear()

    for i, text in enumerate(texts):
        for k, run in enumerate(runs(text) if text else ()):
            encoded = v.encoded(run, k == 0)
            if encoded is None:
                out[i].failed = True
                break
            waiting.append((i, encoded))
            size += len(run)
            if size >= CHUNK:
                align()
                size = 0
    align()
    return [t.row() for t in out]


COUNTED = ("n_a", "n_b", "n_groups", "n_links")


def align(df: DataFrame, path_a: str, path_b: str, *, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """A row (id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of ``df``.

    A pair's count is in how many rows it is linked; ``n_best`` are links whose count is the highest of their A id, ``count_sum``
    sums the counts of all links. Rows of null or empty texts, or of texts that the tokens don't spell (with a space before them),
    have zeros and ''. Repeated rows count as often as they stand; ids may be null or repeat; further columns are ignored; an
    empty table gives no rows. Texts are tokenized in runs; the distinct pairs of one text are held by one task.
    """
    spark = df.sparkSession
    paths = (path_a, path_b, ranks)
    v = vocabularies(*paths)
    size_a, size_b = v.size_a, v.size_b
    given = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = given.schema["id"].dataType.simpleString()
    arrays = ("same_ids", "same_n", "pairs", "pair_n")
    types = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = vocabularies(*paths), TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.slice(start, 1000)
                found = aligned_texts(part["text"].to_pylist(), known)
                columns = [pa.array(range(row, row + len(part)), pa.int64()), part["id"], *[pa.array([f[i] for f in found], pa.int64()) for i in range(4)], pa.array([f[4] for f in found], pa.string())]
                columns += [pa.array([f[5 + i] for f in found], t) for i, t in enumerate(types)]
                row += len(part)
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", *COUNTED, "groups_sha256", *arrays])

    schema = f"row long, id {id_type}, " + ", ".join(f"{c} long" for c in COUNTED) + ", groups_sha256 string, same_ids array<int>, same_n array<long>, pairs array<long>, pair_n array<long>"
    texts = saved(given.mapInArrow(first, schema), "align-texts")

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size_a, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(batch["same_ids"].flatten().to_numpy(zero_copy_only=False), minlength=size_a)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["a", "n"])

    same_counts, best = np.zeros(size_a, dtype=np.int64), np.zeros(size_a, dtype=np.int64)
    for r in texts.select("same_ids").mapInArrow(vector, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        same_counts[r.a] = best[r.a] = r.n
    pairs = saved(texts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "align-pairs")
    for r in pairs.groupBy(F.floor(F.col("pair") / size_b).alias("a")).agg(F.max("n").alias("n")).collect():  # at most the vocabulary
        best[r.a] = max(best[r.a], r.n)
    least = max(2, -(-(pairs.agg(F.sum("n")).first()[0] or 0) // hot_pairs))
    hot = pairs.where(F.col("n") >= least).toArrow()  # at most hot_pairs rows
    order = np.argsort(hot["pair"].to_numpy())
    sent = spark.sparkContext.broadcast((same_counts, best, hot["pair"].to_numpy()[order], hot["n"].to_numpy()[order]))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same_counts, best, hot, hot_n = sent.value
        for batch in batches:
            rows = len(batch)
            n_best, count_sum = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)

            def add(row: np.ndarray, a: np.ndarray, count: np.ndarray, links: np.ndarray) -> None:
                np.add.at(count_sum, row, count * links)
                np.add.at(n_best, row, np.where(count == best[a], links, 0))

            values = lambda c: batch[c].flatten().to_numpy(zero_copy_only=False)
            row_of = lambda c: np.repeat(np.arange(rows), batch[c].value_lengths().to_numpy(zero_copy_only=False))
            ids = values("same_ids")
            add(row_of("same_ids"), ids, same_counts[ids], values("same_n"))
            pair, row, links = values("pairs"), row_of("pairs"), values("pair_n")
            at = np.minimum(np.searchsorted(hot, pair), max(len(hot) - 1, 0))
            known = hot[at] == pair if len(hot) else np.zeros(len(pair), dtype=bool)
            add(row[known], pair[known] // size_b, hot_n[at[known]], links[known])
            cold = ~known
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[cold], minlength=rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[cold])) for x in (pair, links)]
            columns = [*[batch[c] for c in ("row", "id", *COUNTED, "groups_sha256")], pa.array(n_best), pa.array(count_sum), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", *COUNTED, "groups_sha256", "n_best", "count_sum", "pairs", "pair_n"])

    schema = f"row long, id {id_type}, " + ", ".join(f"{c} long" for c in COUNTED) + ", groups_sha256 string, n_best long, count_sum long, pairs array<long>, pair_n array<long>"
    met = saved(texts.mapInArrow(second, schema), "align-met")
    highest = F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(best) if n], "a long, best long"))  # at most the vocabulary
    rare = pairs.where(F.col("n") < least).withColumn("a", F.floor(F.col("pair") / size_b)).join(highest, "a")
    links = met.select("row", F.explode(F.arrays_zip("pairs", "pair_n")).alias("x")).select("row", "x.pairs", F.col("x.pair_n").alias("links")).withColumnRenamed("pairs", "pair")
    more = links.join(rare, "pair").groupBy("row").agg(F.sum(F.col("links") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("n") == F.col("best"), F.col("links")).otherwise(0)).alias("more_best"))
    total = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    return met.drop("pairs", "pair_n").join(more, "row", "left").select(F.col("id").alias(id_col), *COUNTED, total("n_best", "more_best"), total("count_sum", "more_sum"), "groups_sha256")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return align(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), ranks=P.path("byte_bpe_50k.tiktoken"))
