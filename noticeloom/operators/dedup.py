"""Duplicates within and across sources."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.functions import dates
from noticeloom.functions.scratch import written
from noticeloom.functions.text import dedup_title, digit_signature, view_title
from noticeloom.functions.values import FUZZY_DICE, MIN_CANONICAL
from noticeloom.operators import blocks


#: Stands for an end that isn't known.
NO_DAY = -(1 << 31)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, first in the order; Catalyst prunes to it before and after the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def public_view(notices: DataFrame, today: Column) -> DataFrame:
    """What users see: per content hash the row of the first source (latest, largest id), unless an earlier source has
    the same title (of at least ten kept characters) and the same deadline, or none as well."""
    best = first_per(notices, ["content_hash"], [F.asc("source_id"), F.desc("updated_at"), F.desc("id")])
    best = best.withColumn("_title", view_title(F.col("title")))
    # The first source per title and deadline decides, so the anti join meets one row per key.
    earlier = best.where(F.length("_title") >= MIN_CANONICAL).groupBy("_title", "apply_end").agg(F.min("source_id").alias("_first"))
    earlier = earlier.select(F.col("_title").alias("_t"), F.col("apply_end").alias("_e"), "_first")
    hidden = (F.col("_title") == F.col("_t")) & F.col("apply_end").eqNullSafe(F.col("_e")) & (F.col("_first") < F.col("source_id"))
    return best.join(earlier, hidden, "left_anti").drop("_title").withColumn("status", dates.status(F.col("apply_end"), today))


def keyed(df: DataFrame, canonical) -> DataFrame:
    """Rows with a title of at least ten kept characters, and that title."""
    return df.withColumn("canonical", canonical(F.col("title"))).where(F.length("canonical") >= MIN_CANONICAL)


def exact_duplicates(candidates: DataFrame, preferred: DataFrame, canonical=dedup_title) -> DataFrame:
    """Ids of ``candidates`` that have a title of ``preferred``, whatever the deadlines; an equi-join of titles."""
    known = keyed(preferred.select("title"), canonical).select("canonical").distinct()
    return keyed(candidates.select("id", "title"), canonical).join(known, "canonical", "left_semi").select("id", F.lit("exact").alias("how"))


#: Titles of either side that one group compares, groups of each class of lengths at least (of as many titles), pairs whose bits are compared
#: at once, pairs kept for counting, entries counted at once.
SIDE, LEAST_GROUPS, LEAST_TITLES, AT_ONCE, COUNTED, KINDS = 1 << 16, 8, 512, 1 << 15, 1 << 20, 1 << 22


def _bigrams(titles: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bigrams of all titles as numbers, in order in each title, which occurrence each is, and where each title's begin (and the last one's end)."""
    sizes = pc.utf8_length(titles).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(titles.to_pylist()).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    within = np.ones(len(points), dtype=bool)
    within[np.cumsum(sizes) - 1] = False
    ordered = np.sort((np.repeat(np.arange(len(sizes)), sizes - 1) << 42) | (points[:-1] << 21 | points[1:])[within[:-1]])
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    occurrence = np.arange(len(ordered)) - np.repeat(first, np.diff(np.append(first, len(ordered))))
    return ordered & (1 << 42) - 1, occurrence, np.concatenate([[0], np.cumsum(sizes - 1)])


def _bits(titles: pa.Array, words: int) -> np.ndarray:
    """By word of 64 bits and title: the bits that an odd number of the title's numbered bigrams hash to. Titles differ in no more bits than bigrams."""
    grams, occurrence, starts = _bigrams(titles)
    mixed = (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ occurrence.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    place = (mixed >> np.uint64(64 - int(math.log2(64 * words)))).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(len(titles)) * 64 * words, np.diff(starts)) + place, minlength=len(titles) * 64 * words) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8").reshape(len(titles), words).T.copy()


def _numbered(titles: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each title's bigrams with their occurrence numbers, as numbers from 0 on, and where each title's begin."""
    grams, occurrence, starts = _bigrams(titles)
    (kinds,) = blocks.numbers(pa.array(grams))
    (numbered,) = blocks.numbers(pa.array(kinds.astype(np.int64) << 32 | occurrence))
    return numbered, starts


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places from each start on, as many as its size says."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _near(sizes: np.ndarray, bits: np.ndarray, k_sizes: np.ndarray, k_bits: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of two sides (their numbers of digits and bigrams, ascending) that may score the threshold, as their digits, lengths and bits say; the
    own ones in order, each in one part."""
    kinds, starts = np.unique(sizes, return_index=True)
    small = np.uint8 if len(bits) < 4 else np.uint16
    differ = lambda one, other: reduce(np.add, (np.bitwise_count(a ^ b).astype(small, copy=False) for a, b in zip(one, other, strict=True)))
    # Every pair is compared by half the words, as two folded to one differ in no more.
    folded, k_folded = (b if len(b) == 1 else b[::2] ^ b[1::2] for b in (bits, k_bits))
    for kind, start, end in zip(kinds.tolist(), starts.tolist(), [*starts[1:].tolist(), len(sizes)]):
        digits, n = kind >> 32 << 32, kind & 0xFFFFFFFF
        low = np.searchsorted(k_sizes, digits | int(n * threshold / (2 - threshold)))
        high = np.searchsorted(k_sizes, digits | min(0xFFFFFFFF, int(n * (2 - threshold) / threshold) + 1), "right")
        if low == high:
            continue
        # What doesn't count as common on either side.
        most = np.minimum((1 - threshold) * (n + (k_sizes[low:high] & 0xFFFFFFFF)) + 1e-6, 64 * len(bits)).astype(small)
        step = max(1, AT_ONCE // (high - low))
        for at in range(start, end, step):
            few = differ(folded[:, at : min(end, at + step), None], k_folded[:, None, low:high]) <= most
            i, j = np.divmod(np.flatnonzero(few), high - low)
            if len(i):
                near = np.flatnonzero(differ(bits[:, i + at], k_bits[:, j + low]) <= most[j])
                if len(near):
                    yield i[near] + at, j[near] + low


def _count_out(threshold: float, schema: T.StructType):
    """Titles (canonical, digits) of two blocks, the preferred (with ends, open) and those that may repeat them (with key): of the latter those
    that score the threshold with any, with each end of these once (null where one is open)."""

    def work(theirs: pa.Table, own: pa.Table) -> pa.Table:
        if not theirs.num_rows or not own.num_rows:
            return blocks.empty(schema)
        digits = blocks.numbers(theirs["digits"].combine_chunks(), own["digits"].combine_chunks())
        sizes = [pc.utf8_length(t["canonical"]).to_numpy().astype(np.int64) - 1 for t in (theirs, own)]
        longest = int(sizes[0].max())
        words = 1 << math.ceil(math.log2(min(256, max(1, longest / (32 if longest < 256 else 16)))))  # long titles are more alike by chance
        sides = []
        for table, d, n in zip((theirs, own), digits, sizes, strict=True):
            kinds = d.astype(np.int64) << 32 | n
            order = np.argsort(kinds, kind="stable")
            table = table.take(pa.array(order)).combine_chunks()
            titles = table["canonical"].combine_chunks()
            step = max(1, blocks.LEFT // (4 * int(n.max())))
            sides.append((table, titles, kinds[order], np.concatenate([_bits(titles.slice(k, step), words) for k in range(0, len(titles), step)], axis=1)))
        (theirs, k_titles, k_kinds, k_bits), (own, titles, kinds, bits) = sides
        days, day_starts = blocks.flat(theirs, "ends")
        days, open_ = days.to_numpy(zero_copy_only=False).astype(np.int64), theirs["open"].to_numpy()
        out = []

        def count(i: np.ndarray, j: np.ndarray) -> None:
            """The bigrams in common of these pairs, and the ends that own titles get of those that score the threshold; some pairs at once."""
            mine, i = np.unique(i, return_inverse=True)
            known, j = np.unique(j, return_inverse=True)
            grams, starts = _numbered(pa.concat_arrays([k_titles.take(pa.array(known)), titles.take(pa.array(mine))]))
            k_starts, starts = starts[: len(known) + 1], starts[len(known) :]
            sizes, d_sizes, kinds = np.diff(k_starts)[j], np.diff(day_starts)[known[j]], int(grams.max()) + 1
            rows, ends = max(1, KINDS // kinds), np.cumsum(sizes + d_sizes)
            has = np.zeros(rows * kinds, dtype=bool)
            at = 0
            while at < len(i):
                to = max(at + 1, min(np.searchsorted(i, i[at] + rows), np.searchsorted(ends, ends[at] + KINDS)))
                first, last = i[at], i[to - 1] + 1
                own_grams = np.repeat(np.arange(last - first) * kinds, np.diff(starts[first : last + 1])) + grams[starts[first] : starts[last]]
                has[own_grams] = True
                met, n = slice(at, to), sizes[at:to]
                common = has[grams[_places(k_starts[j[met]], n)] + np.repeat((i[met] - first) * kinds, n)]
                common = np.add.reduceat(common.astype(np.int64), np.cumsum(n) - n)
                has[own_grams] = False
                alike = at + np.flatnonzero(2.0 * common / (n + np.diff(starts)[i[met]]) >= threshold)
                row, other = mine[i[alike]], known[j[alike]]
                found = np.concatenate([days[_places(day_starts[other], d_sizes[alike])], np.full(int(open_[other].sum()), NO_DAY)])
                out.append(np.unique(np.concatenate([np.repeat(row, d_sizes[alike]), row[open_[other]]]) << 32 | (found - NO_DAY)))
                at = to

        waiting, pairs = [], 0
        for near in _near(kinds, bits, k_kinds, k_bits, threshold):
            waiting.append(near)
            pairs += len(near[0])
            if pairs >= COUNTED:
                count(*map(np.concatenate, zip(*waiting)))
                waiting, pairs = [], 0
        if waiting:
            count(*map(np.concatenate, zip(*waiting)))
        if not out:
            return blocks.empty(schema)
        found = np.unique(np.concatenate(out))
        i, found = found >> 32, (found & 0xFFFFFFFF) + NO_DAY
        return pa.table({"key": own["key"].take(pa.array(i)), "end": pa.array(found, pa.int32(), mask=found == NO_DAY)})

    return work


def _ends_of_similar(titles: DataFrame, threshold: float) -> DataFrame:
    """(key, end as a day's number) of own titles and the ends of their titles like these, with repetitions.

    Titles are classed by length so that similar ones are one class apart at most. A class's preferred titles meet the own ones of three classes, in a
    grid of blocks whose size is bounded by titles and characters: only where a class has several blocks are titles sent more than once.
    """
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("end", T.IntegerType())])
    size = F.length("canonical") - 1
    classed = titles.withColumn("class", F.floor(F.log(size) / (math.log((2 - threshold) / threshold) + 0.01)).cast("int"))
    theirs = classed.where("theirs = 1").select("class", "canonical", "digits", "ends", "open")
    own = classed.where("own = 1").select(F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])).alias("class"), "canonical", "digits", "key")

    def loads(df: DataFrame, most: int) -> dict[int, tuple[float, int]]:
        """By class, of which there are under 80, the blocks that titles ask for, and their number."""
        return {r[0]: r[1:] for r in df.groupBy("class").agg(F.sum(F.greatest(F.lit(1 / SIDE), size / most)), F.count("*")).collect()}

    known, asking = loads(theirs, blocks.RIGHT), loads(own, blocks.LEFT)
    grid = {}
    for c in sorted(known.keys() & asking.keys()):
        n = math.ceil(known[c][0])
        grid[c] = n, max(math.ceil(asking[c][0]), min(-(-LEAST_GROUPS // n), -(-asking[c][1] // LEAST_TITLES)))
    if not grid:
        return titles.sparkSession.createDataFrame([], schema)
    count = lambda place: F.element_at(F.create_map(*[F.lit(x) for c, counts in grid.items() for x in (c, counts[place])]), F.col("class"))
    dealt = lambda df, name, place: df.where(F.col("class").isin(*grid)).withColumn(name, F.pmod(F.xxhash64("canonical"), count(place)).cast("int"))
    every = lambda df, name, place: df.withColumn(name, F.explode(F.sequence(F.lit(0), count(place) - 1)))
    sides = every(dealt(theirs, "block", 0), "part", 1), every(dealt(own, "part", 1), "block", 0)
    a, b = (df.repartition(sum(n * m for n, m in grid.values()), "class", "block", "part").groupBy("class", "block", "part") for df in sides)
    return a.cogroup(b).applyInArrow(_count_out(threshold, schema), schema)


def preferred_duplicates(candidates: DataFrame, preferred: DataFrame, canonical=dedup_title, threshold: float = FUZZY_DICE) -> DataFrame:
    """Ids of ``candidates`` (id, title, apply_end) that repeat a title of ``preferred`` (title, apply_end): exactly,
    whatever the deadlines, or with a bigram similarity of at least ``threshold``, the same digit runs, and deadlines that
    don't differ. Titles under ten kept characters repeat nothing. ``how`` tells which.

    The similar ones are compared by blocks of bounded size of either side, so that pairs aren't shuffled. Titles that score t
    have like lengths, their sizes' ratio at most (2 - t) / t, and differ in at most (1 - t) of their bigrams. Within a block, titles with the same digit
    runs and such lengths are compared by a few words of bits, and only those are counted out that differ in no more.
    """

    left = keyed(candidates.select("id", "title", "apply_end"), canonical)
    known = keyed(preferred.select("title", "apply_end"), canonical).select("canonical", "apply_end").distinct()
    exact = exact_duplicates(candidates, preferred, canonical)
    rest = left.join(exact.select("id"), "id", "left_anti").select("id", "canonical", "apply_end")
    # Titles go by a digest, so that what is found doesn't carry the title.
    titles = rest.select("canonical", F.lit(1).alias("own"), F.lit(None).cast("date").alias("end")).unionByName(known.select("canonical", F.lit(0).alias("own"), F.col("apply_end").alias("end")))
    open_ = F.max((F.col("own") == 0) & F.col("end").isNull()).alias("open")
    titles = titles.groupBy("canonical").agg(F.max("own").alias("own"), F.min("own").alias("theirs"), F.collect_set(F.unix_date("end")).alias("ends"), open_)
    titles = titles.select(F.md5(F.col("canonical").cast("binary")).alias("key"), "canonical", "own", (1 - F.col("theirs")).alias("theirs"), "ends", "open", digit_signature(F.col("canonical")).alias("digits"))
    titles = written(titles, "titles")  # or titles would be made again for each use
    # Similar titles have the same digits, so those whose digits the other side lacks needn't be compared.
    shared = titles.groupBy("digits").agg(F.max("own").alias("own"), F.max("theirs").alias("theirs")).where("own = 1 and theirs = 1").select("digits")
    titles = written(titles.join(shared, "digits", "left_semi"), "titles-shared")
    # By title the ends of all titles like it, and whether one is open, so that a title's notices meet one row.
    ends = _ends_of_similar(titles, threshold).groupBy("key").agg(F.collect_set(F.date_from_unix_date("end")).alias("ends"), F.max(F.col("end").isNull()).alias("open"))
    may = F.col("apply_end").isNull() | F.col("open") | F.array_contains("ends", F.col("apply_end"))
    found = rest.withColumn("key", F.md5(F.col("canonical").cast("binary"))).join(ends, "key").where(may)
    return exact.unionByName(found.select("id", F.lit("similar").alias("how")).distinct())


def first_seen(df: DataFrame, arrival: Column, canonical=dedup_title) -> DataFrame:
    """The first arrival of each canonical title."""
    seen = df.withColumn("_canonical", canonical(F.col("title")))
    return first_per(seen, ["_canonical"], [arrival.asc()]).drop("_canonical")


def ingest_candidates(candidates: DataFrame, preferred: DataFrame, cutoff: Column, canonical=dedup_title) -> DataFrame:
    """What an ingest of the ministry's notices takes: no repetition of a preferred source, the first of equal titles,
    and only then nothing expired, so an expired first one hides later ones. ``candidates`` has an ``arrival``."""
    fresh = candidates.join(preferred_duplicates(candidates, preferred, canonical).select("id"), "id", "left_anti")
    return first_seen(fresh, F.col("arrival"), canonical).where(F.col("apply_end").isNull() | (F.col("apply_end") >= cutoff))
