"""Searches by likeness (trigrams) and by relevance (BM25), over inverted lists that are stored and kept up to date.

Both indexes are tables: lists are sorted by key, so a search reads the row groups of its own keys only. Searches take a table of
queries; one query is a table of one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.functions.scratch import written
from noticeloom.functions.text import once
from noticeloom.operators import blocks
from noticeloom.operators.merge import numbered

#: Up to so many queries read the lists of their own keys. The lists of more queries are most of the index, and their pairs with
#: texts grow as both do, so they are compared by blocks.
FEW = 100

WORD = r"[\p{L}\p{N}]+"


def words(c: Column) -> Column:
    """Runs of letters and digits, in lower case; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


# -- trigrams --------------------------------------------------------------------------------------------------------


def _grams_of(word: Column) -> Column:
    """All three neighbouring characters, in time linear in the word."""
    characters = F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))
    triple = lambda ch: F.transform(F.sequence(F.lit(0), F.size(ch) - 3), lambda i: F.concat(F.get(ch, i), F.get(ch, i + 1), F.get(ch, i + 2)))
    return once(characters, lambda ch: F.when(F.size(ch) >= 3, triple(ch)).otherwise(F.array().cast("array<string>")))


def trigrams(c: Column) -> Column:
    """The set of trigrams of a text's words, each word with two spaces before and one after it."""
    return F.array_distinct(F.flatten(F.transform(words(c), lambda w: _grams_of(F.concat(F.lit("  "), w, F.lit(" "))))))


def similarity(a: Column, b: Column) -> Column:
    """Common trigrams by all trigrams of two texts; 0 where neither has one."""
    both, either = F.size(F.array_intersect(trigrams(a), trigrams(b))), F.size(F.array_union(trigrams(a), trigrams(b)))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


@dataclass
class TrigramIndex:
    """``postings`` (gram, id, n: the trigrams of the text), sorted by gram; ``texts`` (id, n, grams); ``counts`` (gram, texts)."""

    postings: DataFrame
    texts: DataFrame
    counts: DataFrame

    def write(self, path: str) -> TrigramIndex:
        """The index as three tables below ``path``. Lists are dealt by ranges of (gram, id), so one of a hot gram is split."""
        for name in ("postings", "texts", "counts"):
            df = getattr(self, name)
            keys = {"postings": ["gram", "n", "id"], "texts": ["id"], "counts": ["gram"]}[name]
            df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/{name}")
        return TrigramIndex.read(self.postings.sparkSession, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> TrigramIndex:
        return TrigramIndex(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "texts", "counts")])


def trigram_index(df: DataFrame, id_col: str = "id", text_col: str = "title") -> TrigramIndex:
    """Of the texts of ``df``, whose ids are its keys. Texts without a trigram are in no list."""
    texts = df.select(F.col(id_col).alias("id"), trigrams(F.col(text_col)).alias("grams")).where(F.size("grams") > 0).select("id", F.size("grams").alias("n"), "grams")
    texts = written(texts, "trigram-texts")  # or all three tables would seek trigrams again
    postings = texts.select(F.explode("grams").alias("gram"), "id", "n")
    return TrigramIndex(postings, texts, postings.groupBy("gram").agg(F.count("*").alias("texts")))


def reindexed(index: TrigramIndex, changed: DataFrame, id_col: str = "id", text_col: str = "title") -> TrigramIndex:
    """The index after upserts of ``changed``; a null text takes a row out. Only lists' rows of changed ids are replaced, and
    counts move by what goes and comes."""
    new = trigram_index(changed, id_col, text_col)
    ids = changed.select(F.col(id_col).alias("id"))
    gone = index.texts.join(ids, "id", "left_semi").select(F.explode("grams").alias("gram"), F.lit(-1).alias("by"))
    moved = gone.unionByName(new.counts.select("gram", F.col("texts").alias("by"))).unionByName(index.counts.select("gram", F.col("texts").alias("by")))
    counts = moved.groupBy("gram").agg(F.sum("by").alias("texts")).where("texts > 0")
    kept = lambda old, added: old.join(ids, "id", "left_anti").select(*old.columns).unionByName(added)
    return TrigramIndex(kept(index.postings, new.postings), kept(index.texts, new.texts), counts)


def _alike_by_lists(index: TrigramIndex, asked: DataFrame, threshold: float, slack: float) -> DataFrame:
    grams = asked.select("query", "q_n", F.explode("q_grams").alias("gram")).join(index.counts, "gram", "left")
    order = Window.partitionBy("query").orderBy(F.coalesce("texts", F.lit(0)), "gram")
    grams = grams.withColumn("place", F.row_number().over(order))
    read = (F.col("q_n") - F.ceil(F.col("q_n") * threshold - slack) + 1).cast("int")
    chosen = grams.where((F.col("place") <= read) & F.col("texts").isNotNull()).select("query", "q_n", "gram", (F.col("q_n") - read).alias("unread"))
    met = chosen.join(index.postings, "gram").where((F.col("n") >= F.col("q_n") * threshold - slack) & (F.col("n") <= F.col("q_n") / threshold + slack))
    met = met.groupBy("query", "id", "q_n", "n", "unread").agg(F.count("*").alias("met"))
    needed = (F.col("q_n") + F.col("n")) * (threshold / (1 + threshold)) - slack
    close = met.where(F.col("met") + F.col("unread") >= needed).select("query", "id", "n", "q_n")
    compared = close.join(index.texts.select("id", "grams"), "id").join(asked.select("query", "q_grams"), "query")
    common = F.size(F.array_intersect("grams", "q_grams"))
    return compared.select("query", "id", "n", "q_n", common.alias("common")).withColumn("similarity", F.col("common") / (F.col("n") + F.col("q_n") - F.col("common"))).where(F.col("similarity") >= threshold)


def alike(index: TrigramIndex, queries: DataFrame, threshold: float = 0.3, k: int | None = None, few: int = FEW) -> DataFrame:
    """(query, id, common, similarity, place) of the texts whose similarity with a query (query, text) is ``threshold`` or
    more, best first (ties by id), ``k`` at most per query if given.

    A text of similarity t with a query of n trigrams shares at least t n of them. So it stands in the list of one of any
    n - t n + 1 of them, and the rarest are read; the hottest trigrams are never joined. What has too few in common with these to
    make up for it with the rest, or the wrong size, goes before the exact comparison of whole sets.

    More than ``few`` queries are compared with all texts by blocks, whose pairs aren't shuffled.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    slack = 1e-9  # bounds may keep too much, never too little
    asked = queries.select("query", trigrams(F.col("text")).alias("q_grams")).withColumn("q_n", F.size("q_grams")).where("q_n > 0")
    asked = written(asked, "asked-grams")
    found = _alike_in_blocks(index, asked, threshold) if asked.count() > few else _alike_by_lists(index, asked, threshold, slack)
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id")))
    found = found if k is None else found.where(F.col("place") <= k)
    return found.select("query", "id", "common", "similarity", "place")


def _compare(threshold: float, schema: T.StructType):
    """Texts (id, grams) and queries (query, q_grams) of two blocks, as pairs of at least the similarity."""

    def work(texts: pa.Table, asked: pa.Table) -> pa.Table:
        if not texts.num_rows or not asked.num_rows:
            return blocks.empty(schema)
        (grams, starts), (q_grams, q_starts) = blocks.flat(texts, "grams"), blocks.flat(asked, "q_grams")
        values, q_values = blocks.numbers(grams, q_grams)
        lists = blocks.Lists(q_values, q_starts, int(max(values.max(), q_values.max())) + 1)
        sizes, out = np.diff(q_starts), []
        for i in range(texts.num_rows):
            own = values[starts[i] : starts[i + 1]]
            both = np.bincount(lists.rows[lists.of(own)], minlength=len(sizes))
            found = np.flatnonzero(both)
            likeness = both[found] / (sizes[found] + len(own) - both[found])
            near = likeness >= threshold
            if near.any():
                found = found[near]
                out.append((np.full(len(found), i), found, both[found], likeness[near]))
        if not out:
            return blocks.empty(schema)
        i, q, common, likeness = map(np.concatenate, zip(*out))
        return pa.table({"query": asked["query"].take(q), "id": texts["id"].take(i), "common": pa.array(common, pa.int32()), "similarity": pa.array(likeness, pa.float64())})

    return work


def _alike_in_blocks(index: TrigramIndex, asked: DataFrame, threshold: float) -> DataFrame:
    types = [T.StructField("query", asked.schema["query"].dataType), T.StructField("id", index.texts.schema["id"].dataType)]
    schema = T.StructType([*types, T.StructField("common", T.IntegerType()), T.StructField("similarity", T.DoubleType())])
    texts, asked = index.texts.select("id", "grams"), asked.select("query", "q_grams")
    return blocks.compared(texts, asked, ("id", "query"), ("size(grams)", "size(q_grams)"), _compare(threshold, schema), schema)


def pattern_grams(pattern: str) -> list[str]:
    """The trigrams that each text ILIKE ``pattern`` has within its words."""
    found = []
    for part in re.split(r"[%_]", pattern.lower()):
        for word in re.findall(r"[^\W_]+", part):
            found += [word[i : i + 3] for i in range(len(word) - 2)]
    return list(dict.fromkeys(found))


def like(index: TrigramIndex, rows: DataFrame, pattern: str, id_col: str = "id", text_col: str = "title") -> DataFrame:
    """Rows of ``rows`` (of which the index is) whose text is ILIKE ``pattern``. The lists of the pattern's trigrams tell
    which texts to read; without three letters in a row all are read."""
    rows = rows.where(F.col(text_col).ilike(pattern))
    grams = pattern_grams(pattern)
    if not grams:
        return rows
    rarest = [r["gram"] for r in index.counts.where(F.col("gram").isin(grams)).orderBy("texts", "gram").limit(len(grams)).collect()]
    if len(rarest) < len(grams):
        return rows.limit(0)
    ids = index.postings.where(F.col("gram").isin(rarest[:4])).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == min(4, len(rarest)))
    return rows.join(ids.select(F.col("id").alias(id_col)), id_col, "left_semi")


# -- relevance -------------------------------------------------------------------------------------------------------

#: BM25's saturation and normalisation by length; weights are whole numbers of 1 / UNIT, so sums don't depend on their order.
K1, B, UNIT = 1.2, 0.75, 1_000_000_000
#: Texts a block of lists, and the places of a list's weights that are kept as bounds.
BLOCK_TEXTS, BOUNDS = 1024, [1, 10, 100]


@dataclass
class RankedIndex:
    """``lists`` (term, block, top: the highest weight, entries of id and weight), sorted by term; ``bounds`` (term, texts,
    nth: the weights at the places of BOUNDS in the term's whole list, 0 where it is shorter)."""

    lists: DataFrame
    bounds: DataFrame

    def write(self, path: str) -> RankedIndex:
        for name, keys in (("lists", ["term", "block"]), ("bounds", ["term"])):
            getattr(self, name).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/{name}")
        return RankedIndex.read(self.lists.sparkSession, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> RankedIndex:
        return RankedIndex(*[spark.read.parquet(f"{path}/{name}") for name in ("lists", "bounds")])


def ranked_index(df: DataFrame, id_col: str, text_cols: list[str], block_texts: int = BLOCK_TEXTS) -> RankedIndex:
    """Of the words of all ``text_cols`` together. Texts of like length share blocks, as their weights are alike; a text
    without words is in no list. The number of texts and their mean length count texts with words."""
    text = F.concat_ws(" ", *[F.col(c) for c in text_cols])
    told = df.select(F.col(id_col).alias("id"), words(text).alias("words")).withColumn("length", F.size("words")).where("length > 0")
    placed = numbered(told.orderBy("length", "id"), "ranked-texts").withColumn("block", F.floor((F.col("place") - 1) / block_texts))
    n, mean = placed.agg(F.count("*"), F.sum("length") / F.count("*")).first()
    counted = placed.select("id", "block", "length", F.explode("words").alias("term")).groupBy("term", "block", "id", "length").agg(F.count("*").alias("times"))
    counted = written(counted, "ranked-terms")
    texts = counted.groupBy("term").agg(F.count("*").alias("texts"))
    rarity = F.log1p((F.lit(n) - F.col("texts") + 0.5) / (F.col("texts") + 0.5))
    shorter = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(mean))
    weight = F.round(rarity * (F.col("times") * F.lit(K1 + 1) / (F.col("times") + shorter)) * UNIT).cast("long")
    weighed = counted.join(texts, "term").select("term", "texts", "block", "id", weight.alias("weight"))
    lists = weighed.groupBy("term", "block").agg(F.max("weight").alias("top"), F.collect_list(F.struct("id", "weight")).alias("entries"), F.first("texts").alias("texts"))
    lists = written(lists, "ranked-lists")
    # A block's highest weights are enough for the term's highest ones.
    highest = lists.select("term", "texts", F.explode(F.slice(F.sort_array(F.transform("entries", lambda e: e["weight"]), asc=False), 1, BOUNDS[-1])).alias("weight"))
    ranked = highest.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("weight")))).where(F.col("place").isin(BOUNDS))
    nth = F.transform(F.array(*map(F.lit, BOUNDS)), lambda p: F.coalesce(F.element_at("at", p), F.lit(0).cast("long")))
    bounds = ranked.groupBy("term").agg(F.first("texts").alias("texts"), F.map_from_entries(F.collect_list(F.struct("place", "weight"))).alias("at"))
    return RankedIndex(lists.drop("texts"), bounds.select("term", "texts", nth.alias("nth")))


def _score(k: int, schema: T.StructType):
    """Lists (term, entries) of a block of texts and queries' terms (query, term, floor), as each query's ``k`` best texts."""

    def work(lists: pa.Table, asked: pa.Table) -> pa.Table:
        if not lists.num_rows or not asked.num_rows:
            return blocks.empty(schema)
        entries, starts = blocks.flat(lists, "entries")
        weights = entries.field("weight").to_numpy(zero_copy_only=False).astype(np.float64)  # whole numbers whose sums stay exact
        ids = entries.field("id").dictionary_encode()
        order = pa.compute.sort_indices(ids.dictionary)
        place = np.empty(len(order), dtype=np.int64)
        place[order.to_numpy()] = np.arange(len(order))  # texts by their ids' order, for ties
        texts = place[ids.indices.to_numpy(zero_copy_only=False)]
        terms, q_terms = blocks.numbers(lists["term"].combine_chunks(), asked["term"].combine_chunks())
        known = blocks.Lists(np.repeat(terms, np.diff(starts)), np.arange(len(weights) + 1), int(max(terms.max(), q_terms.max())) + 1)
        texts, weights = texts[known.order], weights[known.order]
        (queries,) = blocks.numbers(asked["query"].combine_chunks())
        by_query = np.argsort(queries, kind="stable")
        floors, out = asked["floor"].to_numpy(), []
        for rows in np.split(by_query, np.flatnonzero(np.diff(queries[by_query])) + 1):
            at = known.of(q_terms[rows])
            if not len(at):
                continue
            sums = np.bincount(texts[at], weights=weights[at], minlength=len(order))
            here = np.zeros(len(order), dtype=bool)
            here[texts[at]] = True
            best = np.flatnonzero(here & (sums >= floors[rows[0]]))
            best = best[np.argsort(-sums[best], kind="stable")[:k]]
            out.append((np.full(len(best), rows[0]), best, sums[best]))
        if not out:
            return blocks.empty(schema)
        q, best, sums = map(np.concatenate, zip(*out))
        return pa.table({"query": asked["query"].take(q), "id": ids.dictionary.take(order.take(pa.array(best))), "sum": pa.array(sums.astype(np.int64))})

    return work


def _scores_in_blocks(index: RankedIndex, known: DataFrame, k: int) -> DataFrame:
    id_ = index.lists.schema["entries"].dataType.elementType["id"].dataType
    schema = T.StructType([T.StructField("query", known.schema["query"].dataType), T.StructField("id", id_), T.StructField("sum", T.LongType())])
    lists = index.lists.select("block", "term", "entries")
    return blocks.compared(lists, known.select("query", "term", "floor"), ("block", "query"), ("size(entries)", "1"), _score(k, schema), schema)


def _scores_by_lists(index: RankedIndex, known: DataFrame) -> DataFrame:
    heads = known.join(index.lists.select("term", "block", "top"), "term")
    blocks = heads.groupBy("query", "block").agg(F.sum("top").alias("most"), F.first("floor").alias("floor")).where("most >= floor").select("query", "block")
    parts = known.select("query", "term").join(blocks, "query").join(index.lists, ["term", "block"]).select("query", F.inline("entries"))
    return parts.groupBy("query", "id").agg(F.sum("weight").alias("sum"))


def ranked(index: RankedIndex, queries: DataFrame, k: int = 10, few: int = FEW) -> DataFrame:
    """(query, id, score, place): the ``k`` texts of the highest BM25 score for each query (query, text), ties by id.

    The k-th highest weight in one term's list is a floor of the k-th score. A block whose highest weights for the query's
    terms add up to less can't hold one of the k texts and its lists stay unread; the test takes the blocks' highest weights alone.
    More than ``few`` queries read all lists, by blocks of texts, and each keeps its k best of a block, so that no other sums are shuffled.
    """
    asked = queries.select("query", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    place = next((i for i, p in enumerate(BOUNDS) if p >= k), None)
    floor = F.get("nth", F.lit(place)) if place is not None else F.lit(0).cast("long")
    known = asked.join(index.bounds, "term").select("query", "term", floor.alias("floor"))
    known = known.withColumn("floor", F.max("floor").over(Window.partitionBy("query")))
    known = written(known, "asked-terms")
    many = known.select("query").distinct().count() > few
    scores = _scores_in_blocks(index, known, k) if many else _scores_by_lists(index, known)
    placed = scores.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sum"), "id"))).where(F.col("place") <= k)
    return placed.select("query", "id", (F.col("sum") / UNIT).alias("score"), "place")
