"""Scores of texts by a weighted backoff automaton of smoothed n-grams.

States are the contexts of up to n-1 tokens that occur in the training texts. A state has an arc for each token that
followed it there, with the token's smoothed log-probability, and one failure arc, with the weight of backing off, to the
state of its context without the first token; the empty context has an arc for every token. A text is read once from left
to right: at each token arcs of the state at hand, or failure arcs and an arc of a shorter state, are followed. The
smoothing is hierarchical Dirichlet, p(w | h) = (c(hw) + k p(w | h')) / (c(h) + k), which adds up to 1 in every state.

The automaton grows with the corpus and stands nowhere as a whole. Texts are written once as blocks of token numbers. Each block
sends the n-grams it has, packed, to buckets by their hash; a bucket adds up what all blocks have and answers each block
with those counts that aren't the block's own alone. With them a block builds the part of the automaton that its texts
can reach, which is bounded by the block, and follows it.

Words are compared as they are, longer n-grams by 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.llm.common import saved, shuffle_partitions, table

ORDER = 3
#: Pseudo-counts k of the n-grams of 2, 3, ... tokens.
STRENGTHS = (4.0, 8.0)
BLOCK_TOKENS = 2_000_000
#: N-grams a bucket, about.
BUCKET_NGRAMS = 2_000_000
#: Texts are split into words in slices of about so many bytes.
SLICE = 1 << 20
#: What stands before and after the words of a text; no word is empty or has a space.
BEGIN, END = b"", b" "


# -- packing ---------------------------------------------------------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed."""
    return pa.Codec("zstd").compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), asbytes=True)


def unpacked(data: bytes, n: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    plain = pa.Codec("zstd").decompress(data, decompressed_size=n * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(size, n).T).reshape(-1).view(dtype)


def packed_words(words: list[bytes]) -> bytes:
    data = b"\n".join(words)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def unpacked_words(data: bytes) -> list[bytes]:
    return pa.Codec("zstd").decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True).split(b"\n")


# -- blocks ----------------------------------------------------------------------------------------------------------


def words_of(text: str) -> Iterator[list[bytes]]:
    data, start = text.encode().lower(), 0  # lower() of bytes is that of A-Z alone, split() that at ASCII's white space
    while len(data) - start > SLICE:
        cut = data.find(b" ", start + SLICE)
        if cut < 0:
            break
        yield data[start:cut].split()
        start = cut
    yield data[start:].split()


def blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Blocks of texts of ``docs`` (id, train, text): (block, ids, train, lengths, n, tokens, words). Numbers 0 and 1 are the
    begin and the end of a text, the others count the block's words in sorted order; lengths count words and end."""
    names = ["block", "ids", "train", "lengths", "n", "tokens", "words"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__  # a new word gets the next number
        parts, lengths, ids, train, held = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal made, held
            words = sorted(known)
            number = np.empty(len(words), dtype=np.uint32)
            number[np.fromiter((known[w] for w in words), dtype=np.int64, count=len(words))] = np.arange(2, len(words) + 2)
            found = np.concatenate(parts)
            tokens = np.where(found >= 0, number[found] if len(words) else 0, 1).astype("<u4")
            columns = [
                pa.array([first + made]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(ids)), pa.array([train], pa.list_(pa.bool_())),
                pa.array([lengths], pa.list_(pa.int32())), pa.array([len(tokens)]), pa.array([packed(tokens)]), pa.array([packed_words(words)]),
            ]
            made, held = made + 1, 0
            for x in (known, parts, lengths, ids, train):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            flags = batch["train"].to_pylist()
            for i, text in enumerate(batch["text"].to_pylist()):
                before = held
                for words in words_of(text or ""):
                    parts.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
                    held += len(words)
                parts.append(np.array([-1]))
                held += 1
                lengths.append(held - before)
                ids.append(batch["id"].slice(i, 1))
                train.append(flags[i])
                if held >= block_tokens:
                    yield block()
        if held:
            yield block()

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(work, f"block long, ids array<{id_type}>, train array<boolean>, lengths array<int>, n long, tokens binary, words binary")


def combined(before: np.ndarray, last: np.ndarray, order: int) -> np.ndarray:
    """Hashes of n-grams from those of their first tokens and of the last one."""
    h = before * np.uint64(0x9E3779B97F4A7C15) + last + np.uint64(order)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Ngrams:
    """The n-grams of one block. ``places[k]``: the positions of the text with begins where one of k tokens ends;
    ``of[k]``: its number there (-1 elsewhere); ``one[k]``: the position of one of each number; ``own[k]``: how
    often each stands in the block's training texts; ``hashes[k]``."""

    def __init__(self, row: dict, order: int):
        lengths = np.array(row["lengths"], dtype=np.int64)
        self.words = [BEGIN, END, *(unpacked_words(row["words"]) if row["words"][:8] != bytes(8) else [])]
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        s = np.zeros(int((lengths + 1).sum()), dtype=np.int64)
        inside = np.ones(len(s), dtype=bool)
        inside[starts] = False
        s[inside] = unpacked(row["tokens"], row["n"], "<u4")
        self.tokens, self.inside, self.starts, self.lengths = s, inside, starts, lengths
        train = np.repeat(np.array(row["train"], dtype=bool), lengths + 1)
        width = np.int64(len(self.words))
        self.of, self.one, self.own, self.hashes = {1: s}, {}, {1: np.bincount(s[train], minlength=width)}, {}
        self.hashes[1] = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), dtype=np.uint64, count=len(self.words))
        there = inside
        for k in range(2, order + 1):
            places = np.flatnonzero(there)
            code = self.of[k - 1][places - 1] * width + s[places]
            order_ = np.argsort(code)
            new = np.diff(code[order_], prepend=-1) != 0
            at = np.cumsum(new) - 1
            self.of[k] = np.full(len(s), -1, dtype=np.int64)
            self.of[k][places[order_]] = at
            self.one[k] = places[order_[new]]
            self.own[k] = np.bincount(at[train[places[order_]]], minlength=len(self.one[k]))
            self.hashes[k] = combined(self.hashes[k - 1][self.of[k - 1][self.one[k] - 1]], self.hashes[1][s[self.one[k]]], k)
            there = there & np.concatenate([[False], there[:-1]])  # one more token before it

    def dealt(self, k: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """The numbers of the n-grams of each bucket, which is a range of hashes, in the order of these."""
        order = np.argsort(self.hashes[k])
        bucket = ((self.hashes[k][order] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        found, starts = np.unique(bucket, return_index=True)
        yield from zip(found.tolist(), np.split(order, starts[1:]), strict=True)


# -- counts of the corpus --------------------------------------------------------------------------------------------


def requests(made: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, block, k, n, keys, counts): the n-grams of each block with their counts in its training texts."""
    names = ["bucket", "block", "k", "n", "keys", "counts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Ngrams(row, order)
                for k in range(1, order + 1):
                    out = []
                    for bucket, numbers in grams.dealt(k, buckets):
                        keys = packed_words([grams.words[i] for i in numbers]) if k == 1 else packed(np.diff(grams.hashes[k][numbers], prepend=np.uint64(0)))
                        out.append((bucket, row["block"], k, len(numbers), keys, packed(grams.own[k][numbers].astype("<u4"))))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=names)

    return made.select("block", "train", "lengths", "n", "tokens", "words").mapInArrow(work, "bucket int, block long, k int, n long, keys binary, counts binary")


def answered(group: pa.Table) -> pa.Table:
    """What one bucket answers: to each block the corpus counts of the n-grams whose count isn't the block's own; and, of words,
    a row (block null) with their number and the sum of their counts."""
    k = group["k"][0].as_py()
    sizes, blocks_ = group["n"].to_pylist(), group["block"].to_pylist()
    counts = [unpacked(c.as_py(), n, "<u4") for c, n in zip(group["counts"], sizes, strict=True)]
    if k == 1:
        number: dict[bytes, int] = {}
        packs = [[number.setdefault(w, len(number)) for w in unpacked_words(p.as_py())] for p in group["keys"]]
        at, n = np.concatenate([np.array(p, dtype=np.int64) for p in packs]), len(number)
    else:
        keys, at = np.unique(np.concatenate([np.cumsum(unpacked(p.as_py(), m, "<u8"), dtype=np.uint64) for p, m in zip(group["keys"], sizes, strict=True)]), return_inverse=True)
        n = len(keys)
    totals = np.bincount(at, weights=np.concatenate(counts), minlength=n).astype(np.int64)  # exact up to 2**53
    out, start = [], 0
    for block, own in zip(blocks_, counts, strict=True):
        found = totals[at[start : start + len(own)]]
        start += len(own)
        other = np.flatnonzero(found != own)
        if len(other):
            out.append((block, k, len(other), packed(np.diff(other.astype("<u4"), prepend=np.uint32(0))), packed(found[other]), None, None))
    if k == 1:
        real = np.ones(n, dtype=bool)
        if BEGIN in number:
            real[number[BEGIN]] = False
        out.append((None, k, 0, b"", b"", int((totals[real] > 0).sum()), int(totals[real].sum())))
    bucket = group["bucket"][0].as_py()
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
    return pa.Table.from_arrays([columns[0], pa.array([bucket] * len(out), pa.int32()), *columns[1:]], names=["block", "bucket", "k", "n", "places", "totals", "distinct", "whole"])


# -- the automaton ---------------------------------------------------------------------------------------------------


class Automaton:
    """The states and arcs of the n-grams of one block. ``weight[k]``: the log10 probability at each n-gram's last token, by its
    own arc where training has the n-gram, by the failure arc of its context and the arc of a shorter one where not."""

    def __init__(self, grams: Ngrams, totals: dict[int, np.ndarray], whole: int, distinct: int, strengths: tuple[float, ...]):
        s = grams.tokens
        probability = (totals[1] + 1) / (whole + distinct + 1)
        self.weight = {1: np.log10(probability)}
        for k in range(2, len(totals) + 1):
            strength, last = strengths[k - 2], grams.one[k]
            context = totals[k - 1][grams.of[k - 1][last - 1]]
            lower = grams.of[k - 1][last]
            shorter = probability[lower]
            failure = np.where(context > 0, np.log10(strength / (context + strength)), 0.0)  # no such state: the shorter one it is
            arc = np.where(context > 0, (totals[k] + strength * shorter) / (context + strength), shorter)
            self.weight[k] = np.where(totals[k] > 0, np.log10(arc), failure + self.weight[k - 1][lower])
            probability = arc
        self.grams, self.known = grams, totals[1][s] > 0

    def follow(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the sums of weights, of the weights of single tokens, and the number of known tokens. The arcs that a
        walk from left to right takes at a token depend on the last n tokens alone, so all are looked up at once."""
        g, taken = self.grams, np.zeros(len(self.grams.tokens))
        for k in sorted(self.weight):
            there = np.flatnonzero(g.inside if k == 1 else g.of[k] >= 0)
            taken[there] = self.weight[k][g.of[k][there]]
        single = np.where(g.inside, self.weight[1][g.tokens], 0.0)
        return np.add.reduceat(taken, g.starts), np.add.reduceat(single, g.starts), np.add.reduceat((self.known & g.inside).astype(np.int64), g.starts)


def scores(
    df: DataFrame,
    train: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    strengths: tuple[float, ...] = STRENGTHS,
    block_tokens: int = BLOCK_TOKENS,
    bucket_ngrams: int = BUCKET_NGRAMS,
) -> DataFrame:
    """A row (id_col, trained, n_tokens, n_known, train_tokens, base_score, score) per row of ``df``, learned from those for
    which ``train`` is true (null: false).

    Tokens are words between ASCII white space, A-Z in lower case, and an end, so null and empty texts have one token.
    Repeated rows are scored, and count, as often as they stand; ids may be null or repeat; further columns are ignored. Without
    training texts all tokens have probability 1; an empty table gives no rows. A text is held by one task as
    token numbers, some 50 bytes a token.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(f"`{text_col}`").alias("text"))
    made = saved(blocks(docs, block_tokens), "lm-blocks")
    tokens = made.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * shuffle_partitions(df.sparkSession), -(-tokens * order // bucket_ngrams))
    asked = requests(made, order, buckets)
    answers = saved(asked.groupBy("bucket", "k").applyInArrow(answered, "block long, bucket int, k int, n long, places binary, totals binary, distinct long, whole long"), "lm-answers")
    distinct, whole = answers.where("block is null").agg(F.sum("distinct"), F.sum("whole")).first()
    distinct, whole = distinct or 0, whole or 0

    schema = T.StructType([T.StructField(id_col, docs.schema["id"].dataType), T.StructField("trained", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])

    def walk(block: pa.Table, answers_: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        grams = Ngrams(row, order)
        totals = {k: own.astype(np.int64) for k, own in grams.own.items()}
        given = {(a["bucket"], a["k"]): a for a in answers_.to_pylist()}
        for k in totals:
            for bucket, numbers in grams.dealt(k, buckets):
                if a := given.get((bucket, k)):
                    places = np.cumsum(unpacked(a["places"], a["n"], "<u4"), dtype=np.int64)
                    totals[k][numbers[places]] = unpacked(a["totals"], a["n"], "<i8")
        score, base, known = Automaton(grams, totals, whole, distinct, strengths).follow()
        columns = [block["ids"].combine_chunks().flatten(), pa.array(row["train"], pa.bool_()), pa.array(grams.lengths), pa.array(known), pa.array(np.full(len(known), whole, dtype=np.int64)), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(columns, names=schema.names)

    return made.groupBy("block").cogroup(answers.where("block is not null").drop("distinct", "whole").groupBy("block")).applyInArrow(walk, schema)


def op13_lm_scores(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    trained = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
    scored = scores(documents, trained)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: The query's defaults: three tokens, pseudo-counts 4 and 8.
OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, text FROM documents),
bytes AS (
  SELECT r, list_transform(range(1, length(key) + 1), lambda i: ord(substr(key, i, 1))) AS of FROM docs),
crcs AS (
  SELECT r, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(of, lambda b: b::UBIGINT)), lambda c, b:
    list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) AS inverted
  FROM bytes),
split AS (
  SELECT r, doc_id, xor(inverted, 4294967295::UBIGINT) % 7 = 2 AS held_out,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS words
  FROM docs JOIN crcs USING (r)),
tokens AS (
  SELECT r, held_out, i, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] ELSE '' END AS v, CASE WHEN i > 2 THEN words[i - 2] WHEN i = 2 THEN '' END AS u
  FROM (SELECT r, held_out, words, unnest(range(1, len(words) + 1)) AS i FROM split)),
c1 AS (SELECT w, count(*) AS n FROM tokens WHERE NOT held_out GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM tokens WHERE NOT held_out GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM tokens WHERE NOT held_out AND u IS NOT NULL GROUP BY u, v, w),
h1 AS (SELECT v, sum(n) AS n FROM c2 GROUP BY v),
h2 AS (SELECT u, v, sum(n) AS n FROM c3 GROUP BY u, v),
whole AS (SELECT coalesce(sum(n), 0)::DOUBLE AS total, count(*)::DOUBLE AS distinct_ FROM c1),
single AS (
  SELECT t.*, coalesce(c1.n, 0) AS known, (coalesce(c1.n, 0) + 1) / (total + distinct_ + 1) AS p1 FROM tokens t LEFT JOIN c1 USING (w), whole),
paired AS (
  SELECT s.*, CASE WHEN h1.n > 0 THEN (coalesce(c2.n, 0) + 4.0::DOUBLE * p1) / (h1.n::DOUBLE + 4.0::DOUBLE) ELSE p1 END AS p2
  FROM single s LEFT JOIN h1 USING (v) LEFT JOIN c2 ON c2.v = s.v AND c2.w = s.w),
tripled AS (
  SELECT p.*, CASE WHEN h2.n > 0 THEN (coalesce(c3.n, 0) + 8.0::DOUBLE * p2) / (h2.n::DOUBLE + 8.0::DOUBLE) ELSE p2 END AS p3
  FROM paired p LEFT JOIN h2 ON h2.u = p.u AND h2.v = p.v LEFT JOIN c3 ON c3.u = p.u AND c3.v = p.v AND c3.w = p.w)
SELECT any_value(doc_id) AS doc_id, any_value(t.held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (WHERE known > 0) AS n_known,
       CAST(any_value(total) AS BIGINT) AS train_tokens, sum(log10(p1)) AS base_score, sum(log10(p3)) AS score
FROM tripled t JOIN split USING (r), whole GROUP BY r
"""
