"""Trigram and ranked search against plain versions, stored and brought up to date."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noticeloom.operators import search


def plain_words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def plain_grams(t):
    return {g for w in plain_words(t) for p in [f"  {w} "] for g in (p[i : i + 3] for i in range(len(p) - 2))}


def plain_alike(rows, queries, threshold, k=None):
    out = set()
    for q, text in queries:
        a, found = plain_grams(text), []
        for i, t in rows:
            b = plain_grams(t)
            if a & b and len(a & b) / len(a | b) >= threshold:
                found.append((-len(a & b) / len(a | b), i, len(a & b)))
        out |= {(q, i, n, -s, place) for place, (s, i, n) in enumerate(sorted(found)[:k], 1)}
    return out


def titles(rng, n):
    words = ["notice", "notices", "창업", "창업지원", "support", "Supports", "ab", "x", "programme", "é", "2026"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5))) or None) for i in range(n)]


def table(spark, rows, id_="id", text="title"):
    return spark.createDataFrame(rows, f"{id_} long, {text} string").repartition(3)


def test_trigrams(spark):
    given = ["Cat", "a cat, a CAT_x", "", None, "가 나다", "😀", "x" * 100_000]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    found = [set(r[0]) for r in df.orderBy("i").select(search.trigrams(F.col("v"))).collect()]
    assert found == [plain_grams(v) for v in given]
    assert found[0] == {"  c", " ca", "cat", "at "}
    pair = spark.createDataFrame([("word", "two words"), ("", "")], "a string, b string")
    assert [r[0] for r in pair.select(search.similarity(F.col("a"), F.col("b"))).collect()] == [4 / 11, 0.0]


@pytest.mark.parametrize(("threshold", "k"), [(0.3, None), (0.5, 3), (1.0, None), (0.05, 2)])
def test_alike_equals_brute_force(spark, tmp_path, threshold, k):
    rng = random.Random(3)
    rows, queries = titles(rng, 150), [*titles(rng, 12), (99, "!!")]
    index = search.trigram_index(table(spark, rows)).write(str(tmp_path))
    found = search.alike(index, table(spark, queries, "query", "text"), threshold, k)
    assert {tuple(r) for r in found.collect()} == plain_alike(rows, queries, threshold, k)


def test_hot_trigrams_are_not_joined(spark):
    """A trigram that stands in all texts is among those a query needn't read."""
    rows = [(i, f"common {'abcdefghij'[i % 10]}{i}zq") for i in range(300)]
    index = search.trigram_index(table(spark, rows))
    query = table(spark, [(1, rows[7][1])], "query", "text")
    hot = {r["gram"] for r in index.counts.where("texts = 300").collect()}
    reads = search.TrigramIndex(index.postings.where(~F.col("gram").isin(list(hot))), index.texts, index.counts)
    threshold = 0.75  # needs more of the query's trigrams than are rare
    assert {tuple(r) for r in search.alike(reads, query, threshold).collect()} == plain_alike(rows, [(1, rows[7][1])], threshold)


def test_reindexed_equals_a_new_index(spark):
    rng = random.Random(8)
    rows = dict(titles(rng, 60))
    changes = {3: "창업 notice", 70: "new support", 5: None, 9: "!", **{i: rows[i] for i in (1, 2)}}
    index = search.reindexed(search.trigram_index(table(spark, list(rows.items()))), table(spark, list(changes.items())))
    whole = search.trigram_index(table(spark, list((rows | changes).items())))
    for name, keys in (("postings", ("gram", "id", "n")), ("texts", ("id", "n")), ("counts", ("gram", "texts"))):
        assert sorted(map(tuple, getattr(index, name).select(*keys).collect())) == sorted(map(tuple, getattr(whole, name).select(*keys).collect()))


@pytest.mark.parametrize("pattern", ["%otic%", "%창업지%", "%x%", "%support%notice%", "a_", "%nosuch%", "Supports%", "%t_ce%"])
def test_like_equals_ilike(spark, pattern):
    rows = table(spark, titles(random.Random(2), 120))
    found = search.like(search.trigram_index(rows), rows, pattern)
    assert sorted(found.collect(), key=repr) == sorted(rows.where(F.col("title").ilike(pattern)).collect(), key=repr)


def plain_ranked(rows, queries, k):
    texts = {i: plain_words(t) for i, t in rows}
    texts = {i: w for i, w in texts.items() if w}
    n, mean = len(texts), sum(map(len, texts.values())) / max(1, len(texts))
    df = Counter(t for w in texts.values() for t in set(w))
    for q, text in queries:
        scores = {}
        for i, w in texts.items():
            counts = Counter(w)
            terms = [t for t in set(plain_words(text)) if counts[t]]
            weight = lambda t: math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * counts[t] * 2.2 / (counts[t] + 1.2 * (0.25 + 0.75 * len(w) / mean))  # noqa: B023, E731
            if terms:
                scores[i] = sum(round(weight(t) * search.UNIT) for t in terms)
        for place, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            yield (q, i, s / search.UNIT, place)


@pytest.mark.parametrize("k", [1, 7, 200])
def test_ranked_equals_brute_force(spark, tmp_path, k):
    rng = random.Random(5)
    rows, queries = titles(rng, 200), [*titles(rng, 10), (50, "notice notice absent"), (51, ""), (52, "absent")]
    index = search.ranked_index(table(spark, rows), "id", ["title"], block_texts=16).write(str(tmp_path))
    found = sorted(map(tuple, search.ranked(index, table(spark, queries, "query", "text"), k).collect()))
    expected = sorted(plain_ranked(rows, queries, k))
    assert [(q, i, p) for q, i, _, p in found] == [(q, i, p) for q, i, _, p in expected]
    assert all(math.isclose(a[2], b[2], abs_tol=1e-8) for a, b in zip(found, expected, strict=True))


def test_blocks_below_the_floor_stay_unread(spark):
    """Long texts weigh less; lists of their blocks may be missing where the short ones hold all of the best."""
    rows = [(i, "word" if i < 20 else "word " + "filler " * 40) for i in range(100)]
    index = search.ranked_index(table(spark, rows), "id", ["title"], block_texts=10)
    short = search.RankedIndex(index.lists.withColumn("entries", F.when(F.col("block") < 2, F.col("entries"))), index.bounds)
    query = table(spark, [(1, "word")], "query", "text")
    assert [r["id"] for r in search.ranked(short, query, 10).orderBy("place").collect()] == list(range(10))


def test_searches_of_nothing(spark):
    none = table(spark, [(1, "x")]).where("id < 0")
    queries = table(spark, [(1, "word")], "query", "text")
    assert search.alike(search.trigram_index(none), queries).collect() == []
    assert search.ranked(search.ranked_index(none, "id", ["title"]), queries).collect() == []


@pytest.mark.parametrize(("threshold", "k"), [(0.3, None), (0.5, 3), (1.0, None), (0.05, 2)])
def test_many_queries_equal_brute_force(spark, monkeypatch, threshold, k):
    """More queries than few are compared by blocks, however small these are; no inverted list is read for them."""
    monkeypatch.setattr(search.blocks, "RIGHT", 40)
    rng = random.Random(3)
    rows, queries = titles(rng, 150), [*titles(rng, 30), (99, "!!")]
    index = search.trigram_index(table(spark, rows))
    unread = search.TrigramIndex(index.postings.limit(0), index.texts, index.counts.limit(0))
    assert {tuple(r) for r in search.alike(unread, table(spark, queries, "query", "text"), threshold, k, few=5).collect()} == plain_alike(rows, queries, threshold, k)


@pytest.mark.parametrize("k", [1, 7, 200])
def test_many_ranked_queries_equal_few(spark, monkeypatch, k):
    """The same rows, of which a block hands on no more than k for each query."""
    monkeypatch.setattr(search.blocks, "RIGHT", 5)
    rng = random.Random(5)
    rows, queries = titles(rng, 200), [*titles(rng, 30), (50, "notice notice absent"), (51, ""), (52, "absent")]
    index = search.ranked_index(table(spark, rows), "id", ["title"], block_texts=16)
    asked = table(spark, queries, "query", "text")
    assert sorted(search.ranked(index, asked, k, few=5).collect()) == sorted(search.ranked(index, asked, k).collect())
