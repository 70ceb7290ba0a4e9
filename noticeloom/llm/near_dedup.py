"""MinHash near-duplicates from bottom-k sketches of one hash function.

1. Every text gets its set of five-word shingles (as 64-bit hashes), the set's size, a 128-bit digest of the set, and the
   ``K`` smallest hashes: its bottom-k sketch. Texts with equal sets form one class; classes alone go on.
2. Retained values form inverted lists. A pair with a Jaccard similarity of 0.75 or more shares about three quarters of
   its sketches, at least ``NEED`` of ``K`` beyond any practical doubt. A list of more than ``HOT`` classes is hot. A class
   with so few hot values that a similar one must share a value that isn't hot is found by the short lists; pairs are
   formed in these alone, so their number is at most HOT per retained value.
3. Pairs are filtered by the similarity estimated from the bottom-k sketch of the union, and verified by the exact
   Jaccard similarity of the full sets.
4. Classes made of hot values mostly (families of thousands of near copies, texts that are little more than passages that
   many share) get lists of runs: keys of neighbouring retained values, of which similar classes share some (`run_keys`).
   Short lists of runs give pairs as in step 2. Classes with a common run in a long list form a block. Blocks are searched
   in squares of at most about ``SQUARE`` by ``SQUARE`` classes, which carry ids, sizes and the ``WIDE`` smallest hashes:
   sets of up to WIDE shingles whole, so that the square itself compares them exactly, and wider sketches of others,
   whose pairs are verified by their texts. First parts of a block are searched by themselves, then one class of each
   joined group, then squares of the parts whose classes aren't joined yet. So a family of n costs about n links, and no
   link that matters to the components is lost.
5. Components of the links give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import LOWER, UPPER, saved, table
from noticeloom.llm.components import components

WORDS, K, HOT, SQUARE = 5, 64, 24, 400
SIMILARITY = 75  # per cent
#: Of K retained values, those that a pair of the stated similarity shares at least: 48 on average, less 3.5 deviations.
NEED = 36
#: Estimates below this are turned away: 0.75 less five deviations.
ESTIMATE = 0.48
#: Hashes of a class in squares (8 KB at most).
WIDE = 1024
#: Lengths of runs of retained values, and from and below which set size they are taken.
RUNS = [(2, 2, 9), (3, 7, 32), (4, 24, 1 << 62)]
MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
RUN, CACHE_WORDS = 1 << 22, 500_000
SPACES = b" \t\n\r\x0b\x0c"


class Shingler:
    def __init__(self):
        self.known: dict[bytes, bytes] = {}

    def _add(self, word: bytes) -> bytes:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        found = self.known[word] = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")
        return found

    def hashes(self, text: bytes) -> np.ndarray:
        """The set of a text's shingles as sorted 64-bit hashes. A long text is worked off in runs of words."""
        get, add, parts, carry, start = self.known.get, self._add, [], b"", 0
        while start < len(text) or start == 0:
            end = start + RUN
            while end < len(text) and text[end] not in SPACES:
                end += 1
            last = end >= len(text)
            words = text[start:end].translate(TO_LOWER).split()
            data = carry + b"".join([get(w) or add(w) for w in words])
            h = np.frombuffer(data, dtype="<u8")
            if len(h) >= WORDS:
                n = len(h) - WORDS + 1
                parts.append(np.unique(mixed(sum(h[j : n + j] * MULTIPLIERS[j] for j in range(WORDS)))))
            elif last and len(h) and not parts:
                parts.append(mixed(np.array([sum(int(x) * int(m) for x, m in zip(h, MULTIPLIERS)) + len(h) & (1 << 64) - 1], dtype=np.uint64)))
            carry, start = data[-8 * (WORDS - 1) :], end
            if last:
                break
        if not parts:
            return np.zeros(0, np.uint64)
        return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact: 100 x intersection >= SIMILARITY x union."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if not len(small) or 100 * len(small) < SIMILARITY * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= SIMILARITY * (len(a) + len(b) - both)


def needed(size: Column) -> Column:
    """How many of its retained values a class shares with a similar one: of a whole set, three quarters."""
    return F.ceil(size * F.lit(NEED / K)).cast("int")


def sketches(texts: DataFrame) -> DataFrame:
    """``doc_id, text_hash`` with n_shingles, digest (binary) and sketch (array of long), of ``doc_id, text``."""
    given = texts.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    given = given.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = dict(texts.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.hashes(t.as_py()) for t in batch.column("text")]
            kept = [s[:K] for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.uint64), *kept]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                ],
                names=["doc_id", "text_hash", "n_shingles", "digest", "sketch"],
            )

    return given.mapInArrow(work, f"doc_id {kind}, text_hash bigint, n_shingles bigint, digest binary, sketch array<bigint>")


def short_list_pairs(shared: DataFrame) -> DataFrame:
    """Pairs of classes (a < b) with fitting sizes that stand in one list of at most HOT."""
    lists = shared.where(F.col("length") <= HOT).groupBy("value").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("l"))
    each = F.explode(F.sequence(F.lit(1), F.size("l") - 1))
    pairs = lists.where(F.size("l") > 1).select(each.alias("i"), "l").select(F.element_at("l", F.col("i")).alias("x"), F.explode(F.slice("l", F.col("i") + 1, F.size("l"))).alias("y"))
    fit = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * SIMILARITY
    return pairs.where(fit).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose union sketch estimates a high enough similarity."""
    members = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = saved(classes.select("id", "sketch").join(members, "id", "left_semi"), "near-sketches")
    for end in ("a", "b"):
        pairs = pairs.join(wanted.select(F.col("id").alias(end), F.col("sketch").alias(f"s_{end}")), end)
    # Order of the hashes as unsigned numbers, by which the sketches were taken.
    unsigned = lambda x: F.transform(x, lambda v: v.bitwiseXOR(F.lit(-(1 << 63))))
    pairs = pairs.select("a", "b", unsigned(F.col("s_a")).alias("s_a"), unsigned(F.col("s_b")).alias("s_b"))
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, K)
    both = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), union))
    return pairs.where(both >= F.size(union) * F.lit(ESTIMATE)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar. ``texts``: id, text (binary), one row per class."""
    for end in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("id").alias(end), F.col("text").alias(f"t_{end}")), end)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last = Shingler(), (None, None)
        for batch in batches:
            names, keep = [batch.column(c).to_pylist() for c in ("a", "b")], []
            for i, (b, t_a, t_b) in enumerate(zip(names[1], batch.column("t_a"), batch.column("t_b"), strict=True)):
                if last[0] != b:  # the join on b leaves its pairs together
                    last = (b, shingler.hashes(t_b.as_py()))
                if similar(shingler.hashes(t_a.as_py()), last[1]):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([n[i] for i in keep], pa.binary()) for n in names], names=["a", "b"])

    return pairs.select("a", "b", "t_a", "t_b").mapInArrow(work, "a binary, b binary")


def run_keys(size: Column, sketch: Column) -> Column:
    """Keys of the runs of neighbouring retained values by which classes of a similarity of 0.75 find each other.

    In the ordered union of two such sets a quarter of the values at most is of one set only, so it has runs of shared
    values, and these stand side by side in both sketches. Unions of 9 values or more have a run of three for certain,
    smaller ones a run of two; from 32 on there is a run of four but with a probability of 2e-5. A class takes the lengths
    that it shares with every size that may be similar.
    """
    keys = lambda r: F.transform(F.sequence(F.lit(1), F.size(sketch) - (r - 1)), lambda i: F.xxhash64(F.lit(r), F.slice(sketch, i, r)))
    none = F.array().cast("array<bigint>")
    return F.concat(*[F.when((size >= least) & (size < below), keys(r)).otherwise(none) for r, least, below in RUNS])


def open_pairs(sizes: np.ndarray, kept: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """Which pairs of a square share a run and have fitting sizes (a matrix). Only pairs of different sides count, if there
    are two sides."""
    n = len(kept)
    open_ = np.zeros((n, n), bool)
    for r, least, below in RUNS:
        with_runs = np.flatnonzero((sizes >= least) & (sizes < below))
        if not len(with_runs):
            continue
        found = [mixed(sum(s[j : len(s) - r + 1 + j] * MULTIPLIERS[j] for j in range(r))) for s in (kept[x][:K] for x in with_runs)]
        places = np.unique(np.concatenate(found), return_inverse=True)[1]
        order = np.argsort(places, kind="stable")
        rows = np.repeat(with_runs, [len(f) for f in found])[order]
        edges = np.concatenate([[0], np.cumsum(np.bincount(places))])
        for at in np.flatnonzero(np.diff(edges) > 1):
            members = rows[edges[at] : edges[at + 1]]
            open_[members[:, None], members] = True
    open_ &= np.minimum.outer(sizes, sizes) * 100 >= np.maximum.outer(sizes, sizes) * SIMILARITY
    if side.min() != side.max():
        open_ &= side[:, None] != side[None, :]
    np.fill_diagonal(open_, False)
    return open_


def settle_whole(open_: np.ndarray, sizes: np.ndarray, kept: list[np.ndarray], label: np.ndarray, wide: int) -> list[tuple[int, int]]:
    """Links (other, hub) of open pairs whose sets are kept whole: exact, and only as many as join all that such pairs join.
    ``label`` follows the links. Of the pairs with a set of over ``wide`` hashes, those stay open whose estimate from so many
    is at most five deviations below 0.75."""
    enough = 0.75 - 5 * (0.75 * 0.25 / wide) ** 0.5
    values, places = np.unique(np.concatenate(kept), return_inverse=True)
    edges = np.concatenate([[0], np.cumsum([len(s) for s in kept])])
    own = [places[a:b] for a, b in zip(edges[:-1], edges[1:])]
    held, links = np.zeros(len(values), np.int64), []
    # Hubs first: what is similar to many joins many at once.
    for hub in np.argsort(-open_.sum(axis=1), kind="stable"):
        near = np.flatnonzero(open_[hub] & (label != label[hub]))
        if not len(near):
            continue
        held[own[hub]] = 1
        both = np.add.reduceat(held[np.concatenate([own[x] for x in near])], np.concatenate([[0], np.cumsum([len(own[x]) for x in near])[:-1]]))
        held[own[hub]] = 0
        whole = np.maximum(sizes[near], sizes[hub]) <= wide
        good = whole & (100 * both >= SIMILARITY * (sizes[near] + sizes[hub] - both))
        maybe = ~whole & (both >= enough * wide)
        for at in np.flatnonzero(maybe):
            union = np.union1d(kept[hub], kept[near[at]])[:wide]
            shared = np.intersect1d(kept[hub], kept[near[at]], assume_unique=True)
            maybe[at] = np.count_nonzero(shared <= union[-1]) >= enough * len(union)
        shut = near[~maybe]
        open_[hub, shut] = open_[shut, hub] = False
        joined, first = np.unique(label[near[good]], return_index=True)
        links += [(int(near[good][f]), int(hub)) for f in first]
        label[np.isin(label, joined)] = label[hub]
    return links


def forest(open_: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Open pairs (other, hub) that join all that open pairs join, beyond what bears one label. They are closed."""
    label, links = label.copy(), []
    for hub in np.argsort(-open_.sum(axis=1), kind="stable"):
        near = np.flatnonzero(open_[hub] & (label != label[hub]))
        if len(near):
            joined, first = np.unique(label[near], return_index=True)
            links += [(int(near[f]), int(hub)) for f in first]
            label[np.isin(label, joined)] = label[hub]
    for other, hub in links:
        open_[other, hub] = open_[hub, other] = False
    return links


def candidates(rows: pd.DataFrame, seen: pd.DataFrame | None, layers: int, wide: int) -> pd.DataFrame:
    """The links of a square that are sure, and the next pairs to verify: ``layers`` forests of pairs that aren't ``seen``
    (p, q, ok) and that neither labels nor links join."""
    rows = rows.sort_values("id")
    ids = rows["id"].tolist()
    label = np.unique(np.array([x.hex() for x in rows["label"]]), return_inverse=True)[1]
    kept, sizes = [np.frombuffer(s, "<u8") for s in rows["wide"]], rows["n"].to_numpy()
    sure: list[tuple[int, int]] = []
    links: list[tuple[int, int]] = []
    if label.min() != label.max():
        open_ = open_pairs(sizes, kept, rows["side"].to_numpy())
        if seen is not None:
            p, q, ok = (seen[c].to_numpy() for c in ("p", "q", "ok"))
            open_[p, q] = open_[q, p] = False
            for x, y in zip(p[ok], q[ok], strict=True):
                label[label == label[y]] = label[x]
        sure = settle_whole(open_, sizes, kept, label, wide)
        for _ in range(layers):
            if not (some := forest(open_, label)):
                break
            links += some
    first, both = rows.iloc[0], sure + links
    found = {"block": first["block"], "i": first["i"], "j": first["j"], "p": [p for p, _ in both], "q": [q for _, q in both]}
    found |= {"a": [ids[p] for p, _ in both], "b": [ids[q] for _, q in both], "sure": [True] * len(sure) + [False] * len(links)}
    return pd.DataFrame(found, columns=["block", "i", "j", "p", "q", "a", "b", "sure"])


def settled(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (a, b) that join what is similar in squares. ``dealt``: block, i, j (the square), side, id, n, wide, label.

    Sets that are kept whole are settled in the square. Of longer ones a round takes candidates by their sketches and
    verifies them by joins with the texts. A square all of whose candidates are similar is done, as they join all that
    may be similar. The others go on, with four times as many candidates a class in each round, without what is joined
    or was turned away.
    """
    square, layers, width, seen, links = ["block", "i", "j"], 1, WIDE, None, []
    kind = "block binary, i string, j string, p int, q int, a binary, b binary, sure boolean"
    dealt = dealt.repartition(*square)  # a partitioning by block, from a join before, would do for the grouping, but not spread it
    while True:
        if seen is None:
            pairs = dealt.groupBy(*square).applyInPandas(lambda rows: candidates(rows, None, layers, width), kind)
        else:
            pairs = dealt.groupBy(*square).cogroup(seen.groupBy(*square)).applyInPandas(lambda rows, old: candidates(rows, old, layers, width), kind)
        pairs = saved(pairs, "near-candidates")
        links.append(pairs.where("sure").select("a", "b"))
        if pairs.where("not sure").isEmpty():
            break
        good = saved(verified(pairs.where("not sure").select("a", "b").distinct(), texts), "near-verified")
        links.append(good)
        marked = pairs.join(good.withColumn("ok", F.lit(True)), ["a", "b"], "left")
        marked = saved(marked.select(*square, "p", "q", (F.col("sure") | F.coalesce("ok", F.lit(False))).alias("ok")), "near-marked")
        going = marked.where(~F.col("ok")).select(*square).distinct()
        if going.isEmpty():
            break
        seen = (marked if seen is None else seen.unionByName(marked)).join(going, square, "left_semi")
        dealt, seen, layers = saved(dealt.join(going, square, "left_semi"), "near-squares"), saved(seen, "near-seen"), 4 * layers
    return reduce(DataFrame.unionByName, links)


def parts_of(members: DataFrame) -> DataFrame:
    """``members`` with ``count``, that of its block, and a random ``part`` of about SQUARE or fewer classes."""
    counts = members.groupBy("block").agg(F.count(F.lit(1)).alias("count"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / SQUARE)).cast("string")
    return members.join(counts, "block").where("count > 1").withColumn("part", part)


def squares_between(members: DataFrame) -> DataFrame:
    """``members`` dealt to squares in which all pairs of different labels meet. Parts hold one large label or small
    ones only, and two parts of one label don't meet."""
    labels = members.groupBy("block", "label").agg(F.count(F.lit(1)).alias("c")).withColumn("large", F.col("c") * 2 > SQUARE)
    small = labels.where("not large").groupBy("block").agg(F.sum("c").alias("rest"))
    sized = members.drop("count", "part").join(labels, ["block", "label"]).join(small, "block", "left")
    deal = lambda size: F.pmod(F.xxhash64("id"), F.ceil(F.col(size) / SQUARE)).cast("string")
    placed = sized.withColumn("pure", F.when(F.col("large"), F.hex("label")).otherwise(""))
    placed = placed.withColumn("part", F.when(F.col("large"), F.concat("pure", F.lit(":"), deal("c"))).otherwise(deal("rest")))
    placed = saved(placed.select("block", "part", "pure", "id", "n", "wide", "label"), "near-placed")
    parts = placed.select("block", "part", "pure").distinct()
    ends = [parts.select("block", F.col("part").alias(e), F.col("pure").alias(f"{e}_pure")) for e in ("i", "j")]
    squares = ends[0].join(ends[1], "block").where("i <= j and (i_pure <> j_pure or i_pure = '')").select("block", "i", "j")
    left = squares.withColumn("part", F.col("i")).withColumn("side", F.lit(0))
    right = squares.where("i < j").withColumn("part", F.col("j")).withColumn("side", F.lit(1))
    return placed.drop("pure").join(left.unionByName(right), ["block", "part"]).drop("part")


def wide_sketches(texts: DataFrame) -> DataFrame:
    """``id, wide``: the WIDE smallest shingle hashes, eight bytes each, of ``id, text`` (binary)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            wide = [shingler.hashes(t.as_py())[:WIDE].tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(wide, pa.binary())], names=["id", "wide"])

    return texts.select("id", "text").mapInArrow(work, "id binary, wide binary")


def family_links(long: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among the classes of ``long`` (id, value: runs that more than HOT classes have). Squares carry ids, sizes and
    bounded sets; texts meet in ``verified`` alone."""
    blocks = components(long.select(F.col("id").alias("a"), F.unhex(F.lpad(F.hex("value"), 16, "0")).alias("b")), "near-blocks")
    members = classes.select("id", "n").join(blocks.withColumnRenamed("node", "id"), "id").select("id", "n", F.col("label").alias("block"))
    members = members.join(wide_sketches(texts.join(members.select("id"), "id", "left_semi")), "id")
    members = saved(parts_of(members.withColumn("label", F.col("id"))), "near-families")
    inside = lambda placed: placed.select("block", F.col("part").alias("i"), F.col("part").alias("j"), F.lit(0).alias("side"), "id", "n", "wide", "label")
    links = settled(inside(members), texts)
    wide = members.where(F.col("count") > SQUARE).drop("count", "part")
    if wide.isEmpty():
        return links

    def contracted(rows: DataFrame, turn: int) -> DataFrame:
        joined = components(links, f"near-joined-{turn}").select(F.col("node").alias("id"), F.col("label").alias("to"))
        return saved(rows.drop("label").join(joined, "id", "left").withColumn("label", F.coalesce("to", "id")).drop("to"), f"near-labels-{turn}")

    # What parts have joined meets by one class each; then only pairs that are still apart are searched in squares.
    wide = contracted(wide, 0)
    links = links.unionByName(settled(inside(parts_of(wide.where("id = label"))), texts))
    return links.unionByName(settled(squares_between(contracted(wide, 1)), texts))


def near_groups(texts: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``texts`` (doc_id, text) and its ``text_hash``.

    Links join texts whose sets of distinct 5-word shingles (A-Z lower-cased, words between ASCII white space; of fewer
    words, the whole sequence) have a Jaccard similarity of at least 0.75. ``component_id`` is the smallest doc_id that
    links reach. Null texts and texts without words have no shingles and are linked with nothing. Null ids count as no
    id: they take part, but are nobody's smallest unless nothing else is there. An empty table gives no rows.
    """
    documents = saved(sketches(texts), "near-documents")
    classes = (
        documents.where("n_shingles > 0")
        .groupBy(F.col("digest").alias("id"))
        .agg(
            F.min("doc_id").alias("top"),
            F.min(F.struct("doc_id", "text_hash")).alias("sample"),
            F.any_value("n_shingles").alias("n"),
            F.any_value("sketch").alias("sketch"),
        )
    )
    classes = saved(classes, "near-classes")
    postings = classes.select("id", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    lengths = saved(postings.groupBy("value").agg(F.count(F.lit(1)).alias("length")).where("length > 1"), "near-lengths")
    shared = saved(postings.join(lengths, "value"), "near-postings")

    hot = shared.where(F.col("length") > HOT).select("id", needed(F.col("size")).alias("need"))
    mostly = hot.groupBy("id", "need").agg(F.count(F.lit(1)).alias("count")).where("count >= need").select("id")
    runs = saved(classes.join(mostly, "id", "left_semi").select("id", "n", F.explode(run_keys(F.col("n"), F.col("sketch"))).alias("value")), "near-runs")
    run_lengths = runs.groupBy("value").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    runs = saved(runs.join(run_lengths, "value"), "near-run-lists")

    pairs = short_list_pairs(shared).unionByName(short_list_pairs(runs)).distinct()
    pairs = saved(estimated(pairs, classes), "near-pairs")
    hot = runs.where(F.col("length") > HOT).select("id", "value")

    members = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(hot.select("id")).distinct()
    wanted = classes.select("id", "sample.*").join(members, "id", "left_semi")
    given = texts.select(F.col("doc_id").alias("d"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    given = given.withColumn("h", F.xxhash64("text"))
    found = given.join(wanted, (F.col("h") == F.col("text_hash")) & F.col("d").eqNullSafe(F.col("doc_id")))
    found = saved(found.select("id", "text").dropDuplicates(["id"]), "near-texts")

    links = verified(pairs, found)
    if not hot.isEmpty():
        links = links.unionByName(family_links(hot, classes, found))
    groups = components(links, "near")
    tops = groups.join(classes.select(F.col("id").alias("node"), "top"), "node")
    least = tops.groupBy("label").agg(F.min("top").alias("least"))
    reached = saved(tops.join(least, "label").select(F.col("node").alias("digest"), "least"), "near-reached")
    alone = classes.select(F.col("id").alias("digest"), "top")
    # Written, so that the join below stands alone and adaptive execution can split a digest that a third of all rows have.
    by_class = saved(alone.join(reached, "digest", "left").select("digest", F.coalesce("least", "top").alias("component_id")), "near-by-class")
    return (
        documents.join(by_class, "digest", "left")
        .select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def near_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``df`` that stay: one of each group, that of the smallest id; rows that repeat id and
    group stay once. Rows without shingles all stay."""
    texts = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    groups = near_groups(texts)
    stay = saved(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash", "n_shingles").distinct(), "near-stay")
    # Keys without nulls, alike in join and window, so that rows are dealt once.
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k"), F.col("doc_id").isNull().alias("k_null")]
    stay = stay.select(*key, F.col("text_hash").alias("h"), "n_shingles")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(row, F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")).alias("h"))
    kept = rows.select("row", *key, "h").join(stay, ["k", "k_null", "h"])
    once = F.row_number().over(Window.partitionBy("k", "k_null", "h").orderBy(F.xxhash64("row")))
    return kept.withColumn("once", once).where("once = 1 OR n_shingles = 0").select("row.*")


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
