"""How the sources of a language differ in their words: an exact recount into minimal perfect hashes.

The first pass counts in how many documents of a language each term stands, and keeps the frequent ones. They are dealt by
hash to shards of about ``SHARD_TERMS`` terms; a task a shard makes a minimal perfect hash of them (levels of bits, in each
of which a key that has its bit to itself is placed) and stores the terms in the order of their slots. The shards are
broadcast, and the second pass looks each term of a text up: the slot comes from the bits, the stored term there tells
whether it is this one, and the slot of the text's (language, source) group is incremented. What all tasks have counted is
summed by slot.

Memory: shards are broadcast in rounds of at most ``BROADCAST_BYTES`` of terms, each a pass over the texts, so that a
vocabulary of any size is recounted; groups' slots are handed on whenever they take ``DENSE_BYTES``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import saved, table

SHARD_TERMS = 1024
BROADCAST_BYTES = 64 << 20
DENSE_BYTES = 64 << 20
#: Terms that a task counts before it hands its counts on.
HELD_TERMS = 500_000
#: Sources a side of one tile of pairs.
TILE = 256
#: Sources that are joined by broadcast; more are joined by shuffle.
MOST_GROUPS = 50_000
#: Texts are split into terms in slices of about so many bytes.
SLICE = 1 << 20
SCALE = 1_000_000_000
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in slices: letters A-Z (in lower case) and all that isn't ASCII."""
    plain, start = text.encode().translate(TABLE), 0
    while len(plain) - start > SLICE:
        cut = plain.find(b" ", start + SLICE)
        if cut < 0:
            break
        yield plain[start:cut].split()
        start = cut
    yield plain[start:].split()


# -- minimal perfect hashes ------------------------------------------------------------------------------------------


def hashed(keys: list[bytes]) -> np.ndarray:
    """Spark's xxhash64 of a string column."""
    return np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), dtype=np.uint64, count=len(keys))


def remixed(hashes: np.ndarray, level: int) -> np.ndarray:
    """Independent hashes for each level."""
    h = hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def built(keys: list[bytes]) -> tuple[list[int], bytes, list[int], list[int]]:
    """A minimal perfect hash: bits a level, the bits of all levels, the number of the key at each slot, and the numbers
    of keys without a slot, whose 64-bit hash another key has."""
    hashes = hashed(keys)
    _, first = np.unique(hashes, return_index=True)
    left, sizes, bits, order = np.sort(first), [], [], []
    while len(left):
        size = -(-len(left) * 2 // 64) * 64
        at = (remixed(hashes[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        order += left[placed][np.argsort(at[placed])].tolist()
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little").tobytes())
        left = left[~placed]
    twins = sorted(set(range(len(keys))) - set(first.tolist()))
    return sizes, b"".join(bits), order, twins


class Directory:
    """The shards of one language, for lookups of many terms at once. Slots follow shards."""

    def __init__(self, shards: int, rows: list[dict]):
        depth = max(len(r["sizes"]) for r in rows)
        self.shards = shards
        self.sizes = np.zeros((depth, shards), dtype=np.uint64)
        self.starts = np.zeros((depth, shards), dtype=np.int64)
        self.base = np.zeros(shards + 1, dtype=np.int64)
        self.twins: dict[bytes, int] = {}
        start, stored, bits, counts = 0, [], [], np.zeros(shards, dtype=np.int64)
        for row in sorted(rows, key=lambda r: r["shard"]):
            for level, size in enumerate(row["sizes"]):
                self.sizes[level, row["shard"]], self.starts[level, row["shard"]] = size, start
                start += size
            bits.append(row["bits"])
            counts[row["shard"]] = len(row["terms"])
            stored += row["terms"]
        np.cumsum(counts, out=self.base[1:])
        self.words = np.frombuffer(b"".join(bits), dtype="<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        # Terms without a bit (twins) stand last in their shard; slots counted by bits are moved over those of shards before.
        unplaced = np.zeros(shards, dtype=np.int64)
        for row in rows:
            unplaced[row["shard"]] = row["unplaced"]
            for i in range(row["unplaced"]):
                self.twins[row["terms"][len(row["terms"]) - 1 - i].encode()] = int(self.base[row["shard"] + 1]) - 1 - i
        self.moved = np.concatenate([[0], np.cumsum(unplaced)[:-1]])
        self.stored = pa.array(stored, pa.large_string()).cast(pa.large_binary())

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each term, -1 for terms that aren't kept."""
        hashes = hashed(keys)
        shard = (hashes & np.uint64(self.shards - 1)).astype(np.int64)
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level in range(len(self.sizes)):
            size = self.sizes[level][shard[open_]]
            open_, size = open_[size > 0], size[size > 0]
            if not len(open_):
                break
            at = (remixed(hashes[open_], level) % size).astype(np.int64) + self.starts[level][shard[open_]]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = ((word >> bit) & np.uint64(1)).astype(bool)
            lower = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[at >> 6] + lower)[hit] + self.moved[shard[open_[hit]]]
            open_ = open_[~hit]
        found = np.flatnonzero(out >= 0)
        same = pc.equal(self.stored.take(pa.array(out[found])), pa.array([keys[i] for i in found], pa.large_binary()))
        out[found[~same.to_numpy(zero_copy_only=False)]] = -1
        if self.twins:
            for i in np.flatnonzero(out < 0):
                out[i] = self.twins.get(keys[i], -1)
        return out


# -- the two passes --------------------------------------------------------------------------------------------------


def frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, n): the number of documents of the language with the term, of ``docs`` (lang, source, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(counts)), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "term", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(set().union(*terms(text)))
                if len(held[lang]) >= HELD_TERMS:
                    yield from handed()
            if sum(map(len, held.values())) >= HELD_TERMS:
                yield from handed()
        yield from handed()

    parts = docs.select("lang", "text").mapInArrow(work, "lang string, term string, n long")
    return parts.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def shards_of(kept: DataFrame, shards: int) -> DataFrame:
    """(lang, shard, sizes, bits, terms, unplaced, bytes): a minimal perfect hash of each shard's terms."""
    schema = "lang string, shard int, sizes array<long>, bits binary, terms array<string>, unplaced int, bytes long"

    def work(group: pa.Table) -> pa.Table:
        found = sorted(t.encode() for t in group["term"].to_pylist())
        sizes, bits, order, twins = built(found)
        ordered = [found[i] for i in [*order, *twins]]
        row = {"lang": group["lang"][0].as_py(), "shard": group["shard"][0].as_py(), "sizes": sizes, "bits": bits, "terms": [t.decode() for t in ordered], "unplaced": len(twins), "bytes": sum(map(len, found)) + 16 * len(found)}
        return pa.Table.from_pylist([row], pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("terms", pa.list_(pa.string())), ("unplaced", pa.int32()), ("bytes", pa.int64())]))

    placed = kept.select("lang", "term", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"))
    return placed.groupBy("lang", "shard").applyInArrow(work, schema)


def recounted(docs: DataFrame, rows: list[dict], shards: int) -> DataFrame:
    """(lang, source, shard, place, n): occurrences in ``docs`` of the terms of the given shards, in parts."""
    given: dict[str, list[dict]] = {}
    for row in rows:
        given.setdefault(row["lang"], []).append(row)
    sent = docs.sparkSession.sparkContext.broadcast({lang: Directory(shards, of) for lang, of in given.items()})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directories = sent.value
        dense: dict[tuple[str, str], np.ndarray] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                slots = np.flatnonzero(counts)
                base = directories[lang].base
                shard = np.searchsorted(base, slots, side="right") - 1
                columns = [pa.array(shard.astype(np.int32)), pa.array((slots - base[shard]).astype(np.int32)), pa.array(counts[slots])]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(slots)), pa.repeat(pa.scalar(source), len(slots)), *columns], names=["lang", "source", "shard", "place", "n"])
            dense.clear()

        for batch in batches:
            counted: dict[tuple[str, str], Counter] = {}
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if lang in directories:
                    counts = counted.setdefault((lang, source), Counter())
                    for found in terms(text):
                        counts.update(found)
            for group, counts in counted.items():
                directory = directories[group[0]]
                slots = directory.slots(list(counts))
                if group not in dense:
                    if 8 * (sum(map(len, dense.values())) + directory.base[-1]) > DENSE_BYTES:
                        yield from handed()
                    dense[group] = np.zeros(directory.base[-1], dtype=np.int64)
                known = slots >= 0
                dense[group][slots[known]] += np.fromiter(counts.values(), dtype=np.int64, count=len(counts))[known]
        yield from handed()

    return docs.mapInArrow(work, "lang string, source string, shard int, place int, n long")


# -- divergences -----------------------------------------------------------------------------------------------------


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 size)), exact."""
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), (total + 2 * size).cast("decimal(20,0)"))).cast("long")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """As :func:`share`, of counts (+ 2) below totals (+ 2 V) of up to 9 * 10^15, by long division."""
    out, rest = np.divmod(counts, totals)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + digit
    return out + 1


def tile_sums(group: pa.Table, tile: int) -> pa.Table:
    """Sums over one shard's terms of the distances of all pairs of sources of two tiles (or of one)."""
    one = {c: group[c][0].as_py() for c in ("lang", "size", "v", "ta", "tb")}
    idx, place, n, total = (group[c].to_numpy() for c in ("idx", "place", "n", "total"))
    ids, at = np.unique(idx, return_inverse=True)
    totals = np.zeros(len(ids), dtype=np.int64)
    totals[at] = total + 2 * one["v"]
    counts = np.full((len(ids), one["size"]), 2, dtype=np.int64)
    np.add.at(counts, (at, np.maximum(place, 0)), n)
    p = shares(counts, totals[:, None])
    left, right = np.flatnonzero(ids // tile == one["ta"]), np.flatnonzero(ids // tile == one["tb"])
    a, b, values = [], [], []
    for i in left:
        to = right[right > i]
        gap = p[to] - p[i]
        values.append((gap * gap // (p[to] + p[i])).sum(axis=1))
        a.append(np.full(len(to), ids[i]))
        b.append(ids[to])
    joined = [pa.array(np.concatenate(x).astype(np.int64)) for x in (a, b, values)]
    return pa.Table.from_arrays([pa.repeat(pa.scalar(one["lang"]), len(joined[0])), *joined], names=["lang", "a", "b", "value"])


def few(df: DataFrame) -> DataFrame:
    """``df`` (a row a group), broadcast in joins while it has at most ``MOST_GROUPS`` rows and 8 MB of names."""
    n, size = df.agg(F.count("*"), F.sum(F.octet_length("lang") + F.octet_length("source"))).first()
    return F.broadcast(df) if n <= MOST_GROUPS and (size or 0) <= 8 << 20 else df


def audit(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10, broadcast_bytes: int = BROADCAST_BYTES, tile: int = TILE) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of all (language, source) groups of ``df``.

    ``pair``: the distance of the group's shares of all kept terms from those of each other source of its language;
    ``term``: the ``top`` kept terms that the group has more of than its language. Nulls count as ''. A language
    without kept terms gives pairs of value 0 and no terms; rows of empty texts make groups; repeated rows count as often as they
    stand; further columns are ignored; an empty table gives no rows. Ties follow the item's bytes.
    """
    spark = df.sparkSession
    named = [(lang_col, "lang"), (source_col, "source"), (text_col, "text")]
    docs = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in named])
    kept = saved(frequencies(docs).where(F.col("n") >= min_docs).select("lang", "term"), "audit-terms")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    largest = sizes.agg(F.max("v")).first()[0] or 0
    shards = 1 << max(0, -(-largest // SHARD_TERMS) - 1).bit_length()
    made = saved(shards_of(kept, shards), "audit-shards")

    rounds, whole = 1, made.agg(F.sum("bytes")).first()[0] or 0
    dealt = lambda: F.pmod(F.xxhash64("lang", "shard"), F.lit(rounds))
    while whole > broadcast_bytes and rounds < 1 << 20 and made.groupBy(dealt()).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).where(f"b > {broadcast_bytes} and n > 1").take(1):
        rounds *= 2
    counts = None
    for k in range(rounds):
        rows = [r.asDict() for r in made.where(dealt() == k).collect()]
        if rows or counts is None:
            found = recounted(docs, rows, shards)
            counts = found if counts is None else counts.unionByName(found)
    counts = saved(counts.groupBy("lang", "source", "shard", "place").agg(F.sum("n").alias("n")), "audit-counts")

    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = Window.partitionBy("lang")
    sources = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"),
        (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long").alias("idx"),
        F.count("*").over(by_lang).alias("s"), F.sum(F.coalesce("total", F.lit(0))).over(by_lang).alias("lang_total"),
    )
    sources = saved(sources, "audit-sources")
    near = few(sources)

    filled = counts.join(near, ["lang", "source"]).select("lang", "shard", "idx", "place", "n", "total", "v", "s")
    bounds = made.select("lang", "shard", F.size("terms").alias("size"))
    marks = bounds.join(near, "lang").select("lang", "shard", "size", "idx", F.lit(-1).alias("place"), F.lit(0).cast("long").alias("n"), "total", "v", "s")
    facts = filled.join(bounds, ["lang", "shard"]).select(marks.columns).unionByName(marks).where("s > 1")
    tiles = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("s") - 1) / tile)))
    tiled = facts.select("*", F.floor(F.col("idx") / tile).alias("own"), tiles.alias("other")).withColumns({"ta": F.least("own", "other"), "tb": F.greatest("own", "other")})
    sums = tiled.groupBy("lang", "shard", "ta", "tb").applyInArrow(lambda group: tile_sums(group, tile), "lang string, a long, b long, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    names = sources.select("lang", "idx", "source")
    pairs = names.select("lang", F.col("idx").alias("a"), "source").join(names.select("lang", F.col("idx").alias("b"), F.col("source").alias("item")), "lang").where("a < b")
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    terms_ = made.select("lang", "shard", F.posexplode("terms").alias("place", "term"))
    words = counts.groupBy("lang", "shard", "place").agg(F.sum("n").alias("lang_n")).join(terms_, ["lang", "shard", "place"])
    more = counts.join(words, ["lang", "shard", "place"]).join(near, ["lang", "source"])
    more = more.withColumns({"p": share(F.col("n"), F.col("total"), F.col("v")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("v"))}).where("p > q")
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(more.withColumn("rank", rank).where(F.col("rank") <= top))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
occurring AS (SELECT r, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term FROM occurring GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS n FROM occurring JOIN kept USING (lang, term) GROUP BY ALL),
grouped AS (SELECT DISTINCT lang, source FROM docs),
totals AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total, any_value(coalesce(v, 0))::HUGEINT AS v
  FROM grouped g LEFT JOIN counted c USING (lang, source) LEFT JOIN sizes s ON s.lang = g.lang GROUP BY g.lang, g.source),
shared AS (
  SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v) AS p
  FROM totals t JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
langs AS (
  SELECT k.lang, k.term, 1 + 1000000000::HUGEINT * (sum(n) + 2) // (any_value(whole) + 2 * any_value(v)) AS q
  FROM counted k JOIN sizes USING (lang) JOIN (SELECT lang, sum(n) AS whole FROM counted GROUP BY lang) USING (lang) GROUP BY k.lang, k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shared x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shared y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
rows_ AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, (p - q) * (p - q) // (p + q) FROM shared s JOIN langs l ON l.lang = s.lang AND l.term = s.term WHERE n > 0 AND p > q),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM rows_)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM placed WHERE part = 'pair' OR rank <= 10
"""
