import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import noticeloom.llm.mixing as module
from noticeloom.llm.mixing import mix, plan_mix
from tests.llm.conftest import EDGES


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """By resharing the excess round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / whole
        left = sum(max(0.0, target[s] - cap * sizes[s]) for s in names)
        for s in names:
            if target[s] >= cap * sizes[s]:
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def coin(doc_id, text, seed=7):
    digest = hashlib.md5((text or "").encode()).hexdigest()
    return int(hashlib.md5(f"{seed}|{'' if doc_id is None else doc_id}|{digest}".encode()).hexdigest()[:13], 16) / 2**52


def test_plan_equals_brute_force(edges):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for e in EDGES:
        sizes[e[2] if len(e) > 2 else "src0"] += size(e[1])
    targets = brute_targets(sizes)
    rows = plan_mix(edges).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        assert r["mix_size"] == size(r["text"])
        assert r["mix_source_size"] == sizes[r["source"]]
        assert r["mix_target"] == pytest.approx(targets[r["source"]])
        rate = r["mix_target"] / r["mix_source_size"] if r["mix_source_size"] else 0
        assert r["mix_copies"] == int(rate) + (coin(r["doc_id"], r["text"]) < rate - int(rate))
        assert r["mix_copies"] <= 2


def test_mix_emits_copies(edges):
    planned = Counter()
    for r in plan_mix(edges).collect():
        planned[r["doc_id"], r["text"]] += r["mix_copies"]
    emitted = mix(edges)
    assert emitted.columns == edges.columns
    assert Counter((r["doc_id"], r["text"]) for r in emitted.collect()) == +planned


def test_many_sources_come_near_their_targets(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.repeat(F.lit("x "), (F.col("id") % 30).cast("int"))).alias("text"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    taken = plan_mix(rows).groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.first("mix_target").alias("target")).collect()
    for r in taken:
        assert r["taken"] == pytest.approx(r["target"], rel=0.1)


def test_empty_table_and_names(empty, edges):
    assert plan_mix(empty).count() == 0 == mix(empty).count()
    clashing = {c: F.lit(i) for i, c in enumerate(["mix_note", "mix_copies", "rate", "coin", "row", "of", "copies", "size", "target", "source_size"])}
    mixed = mix(edges.withColumns(clashing))
    assert mixed.columns == [*edges.columns, *clashing]
    assert Counter(map(tuple, mixed.collect())) == Counter((*r, *range(len(clashing))) for r in mix(edges).collect())
    planned = plan_mix(edges.withColumns(clashing))
    assert planned.columns == [*edges.columns, *[c for c in clashing if c != "mix_copies"], *module.ADDED]


@pytest.mark.parametrize("most", [100_000, 1])
def test_texts_are_not_shuffled_within_the_bound(edges, monkeypatch, most):
    monkeypatch.setattr(module, "MOST_SOURCES", most)
    mixed = mix(edges.withColumn("rate", F.lit(1)))
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (most > 1)
    assert Counter(map(tuple, mixed.drop("rate").collect())) == Counter(map(tuple, mix(edges).collect()))
