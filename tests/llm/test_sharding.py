import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeloom.llm.sharding import communication_matrix, draw_hypergeometric, exact_sizes, op1_sharding, shard
from tests.llm.conftest import EDGES


def test_matrix_has_its_margins():
    counts, sizes = [5, 0, 17, 100, 3], exact_sizes(125, 7)
    matrix = communication_matrix(counts, sizes, seed=3)
    assert matrix.sum(axis=1).tolist() == counts
    assert matrix.sum(axis=0).tolist() == sizes
    assert (matrix >= 0).all()


def test_large_draws_follow_the_distribution(monkeypatch):
    import noticeloom.llm.sharding as module

    rng = np.random.default_rng(1)
    exact = [draw_hypergeometric(rng, 300, 700, 100) for _ in range(4000)]
    monkeypatch.setattr(module, "NUMPY_POPULATION", 0)
    inverted = [draw_hypergeometric(rng, 300, 700, 100) for _ in range(4000)]
    assert abs(np.mean(exact) - np.mean(inverted)) < 0.3
    assert abs(np.std(exact) - np.std(inverted)) < 0.3
    assert draw_hypergeometric(rng, 40_000_000_000 // 40, 39_000_000_000, 600_000) == pytest.approx(15_000, abs=1500)


def check(rows, n, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert sum(sizes) == n
    assert max(sizes) - min(sizes) <= 1
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_shards_are_exact_and_whole(edges, shards):
    rows = shard(edges, shards).collect()
    check(rows, len(EDGES), shards)
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((e[0], e[1]) for e in EDGES)


def test_reruns_agree_whatever_the_partitioning(edges):
    one = {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in shard(edges, 4).collect()}
    assert one == {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in shard(edges.repartition(7), 4).collect()}


def test_order_is_uniform(spark):
    rows = shard(spark.range(4000).withColumnRenamed("id", "doc_id"), 4).collect()
    check(rows, 4000, 4)
    per = np.array([[sum(1 for r in rows if r["shard"] == s and r["doc_id"] // 1000 == q) for s in range(4)] for q in range(4)])
    assert ((per - 250) ** 2 / 250).sum() < 30  # chi-squared, 9 degrees of freedom
    first = [r["doc_id"] for r in rows if r["slot"] < 100]
    assert 1700 < np.mean(first) < 2300


def test_empty_and_clashing_names(empty, edges):
    assert shard(empty, 5).count() == 0
    clashing = edges.withColumn("shard", F.lit("x")).withColumn("part", F.lit(1)).withColumn("h", F.lit(2)).withColumn("row", F.lit(3))
    check(shard(clashing, 3).collect(), len(EDGES), 3)


def test_too_many_shards_are_refused(edges):
    with pytest.raises(ValueError):
        shard(edges, 40_001)


def test_query(spark):
    documents = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op1_sharding(spark, "/root/testdata/sf0.001").collect()
    check(rows, 200, 40)
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, len(t) + 16, zlib.crc32(t)) for i, t in documents.items()}
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
