import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeloom.llm.quality import MANY, classify, collected, estimated_prior, featured, features, fit, fit_risk, op6_quality, placed, risk, whole_scale
from tests.llm.conftest import EDGES


def test_features_of_odd_texts():
    for t in (b"", b" ", b"\0", "é".encode() * 10, b"a" * 100_000, b"....", b"\n\n"):
        f = features(t)
        assert f.shape == (MANY,)
        assert np.isfinite(f).all()


def test_risk_separates_without_negatives():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (3000, 3)), rng.normal(-2, 1, (600, 3))
    model = fit_risk(good[:1000], np.vstack([good[1000:], bad]), prior=2000 / 2600)
    assert (model.score(good) >= 0.3).mean() > 0.97
    order = np.searchsorted(np.sort(model.score(bad)), model.score(good)).mean() / len(bad)
    assert order > 0.98  # the area under the curve, without one labelled negative


def plain_risk(weights, bias, p, u, prior):
    """Row by row, from the definition."""
    z = lambda x: sum(a * b for a, b in zip(x, weights)) + bias
    loss = lambda x, sign: math.log(1 + math.exp(-sign * z(x)))
    mean = lambda values: sum(values) / len(values)
    return prior * mean([loss(x, 1) for x in p]), mean([loss(x, -1) for x in u]) - prior * mean([loss(x, -1) for x in p])


def test_risk_and_slopes_equal_a_plain_version():
    rng = np.random.default_rng(7)
    for _ in range(5):
        p, u, weights, bias, prior = rng.normal(size=(20, 3)), rng.normal(size=(30, 3)), rng.normal(size=3), rng.normal(), rng.uniform(0.1, 0.9)
        first, second, of_first, of_second = risk(weights, bias, p, u, prior)
        assert (first, second) == pytest.approx(plain_risk(weights, bias, p, u, prior))
        step = 1e-6
        for i in range(4):
            move = np.eye(4)[i] * step
            more, less = (plain_risk(weights + s * move[:3], bias + s * move[3], p, u, prior) for s in (1, -1))
            assert of_first[i] == pytest.approx((more[0] - less[0]) / (2 * step), abs=1e-5)
            assert of_second[i] == pytest.approx((more[1] - less[1]) / (2 * step), abs=1e-5)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_the_prior_is_estimated_without_negatives(share):
    rng = np.random.default_rng(2)
    good, bad = rng.normal(1, 1, (4000, 3)), rng.normal(-2, 1, (4000, 3))
    n = int(3000 * share)
    unlabelled = rng.permutation(np.vstack([good[1000 : 1000 + n], bad[: 3000 - n]]))
    assert estimated_prior(good[:1000], unlabelled) == pytest.approx(share, abs=0.06)


def test_labelled_rows_are_bounded_and_all_texts_learnt_from(spark):
    repeated = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    nulls = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    for texts in (repeated, nulls, repeated.unionByName(nulls)):
        told = featured(placed(texts))
        n, mean, scale = whole_scale(told)
        rows = np.array([features(r["text"].encode()) for r in texts.collect()])
        assert n == len(rows) and np.allclose(mean, rows.mean(axis=0), atol=1e-4) and np.allclose(scale, rows.std(axis=0) + 1e-3, atol=1e-3)
        assert len(collected(told, 100)) == 100
        assert np.array_equal(collected(told, 100), collected(told.repartition(7), 100))
    model = fit(repeated, spark.createDataFrame([(7, 1)], "doc_id bigint, quality int"), sample=500)
    assert 0 < model.prior < 1


def test_blocks_average_to_the_risk_of_all(spark):
    """Models of several blocks, averaged, lower the risk over all rows, and decide as one model of all does."""
    sf = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    one, many = fit(documents, labels, prior=0.85), fit(documents, labels, prior=0.85, sample=350)
    told = featured(placed(documents.select("doc_id", "text"))).collect()
    known = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    rows = np.array([np.frombuffer(r["features"], np.float32) for r in told], dtype=float)
    trusted = np.array([r["doc_id"] in known for r in told])

    def whole(model):
        scaled = np.clip((rows - model.mean) / model.scale, -8, 8)
        first, second, _, _ = risk(model.weights, model.bias, scaled[trusted], scaled, 0.85)
        return first + max(0, second)

    assert np.allclose(one.mean, many.mean) and np.allclose(one.scale, many.scale)
    assert whole(many) < whole(fit(documents, labels.limit(0), prior=0.85)) / 2
    assert np.mean((one.score(rows) >= 0.3) == (many.score(rows) >= 0.3)) > 0.97


def test_scores_equal_a_plain_recomputation(spark):
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in classify(documents, model).collect():
        x = features(texts[r["doc_id"]].encode())
        z = sum(w * min(8, max(-8, (v - m) / s)) for w, v, m, s in zip(model.weights, x, model.mean, model.scale)) + model.bias
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_held_out_accuracy_and_use_of_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op6_quality(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(rows[r["doc_id"]], r["quality"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] for r, _ in held)
    assert np.mean([r["predicted"] == q for r, q in held]) >= 0.95
    assert all(r["predicted"] == 1 for r, q in held if q == 1)
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in rows.values())


def test_held_out_labels_are_not_read(spark):
    sf = "/root/testdata/sf0.001"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = fit(documents, labels), fit(documents, other)
    assert a.weights == pytest.approx(b.weights)
    assert a.prior == b.prior


def test_edges_and_nothing_to_learn(spark, edges, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = fit(edges, none)
    assert {r["score"] for r in classify(edges, model).collect()} == {0.5}
    model = fit(edges, spark.createDataFrame([(i, 1) for i in range(1, 12)] + [(1, None), (None, 0)], "doc_id bigint, quality int"))
    rows = classify(edges.withColumn("score", F.lit("x")), model).collect()
    assert len(rows) == len(EDGES)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert classify(empty, model).count() == 0
    assert 0 < fit(empty, none).prior < 1
