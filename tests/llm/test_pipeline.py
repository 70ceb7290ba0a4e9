"""The pipeline's stages against brute force on a small fixture."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from noticeloom.llm.exact_dedup import exact_dedup
from noticeloom.llm.quality import THRESHOLD, features, fit
from tests.llm.test_exact_dedup import normal
from tests.llm.test_near_dedup import brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        out.append(docs)
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(spark, stages):
    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [s.columns == names for s in stages] == [True] * 4 + [False]


def test_quality_keeps_clean_documents(spark, stages):
    left = {i for i, _ in rows(stages[0])}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels[i] == 1 and i not in left for i in labels) <= 0.02 * len(labels)
    # Two hundred documents teach little; the stage must do what the model says, which test_quality measures.
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert left == {i for i, t in rows(docs) if model.score(features((t or "").encode())) >= THRESHOLD}


def test_exact_duplicates(stages):
    best = defaultdict(list)
    for i, t in rows(stages[0]):
        best[normal(t)].append(i)
    assert Counter(i for i, _ in rows(stages[1])) == Counter(max(ids) for ids in best.values())


def test_near_duplicates(stages):
    before = rows(stages[1])
    assert Counter(i for i, _ in rows(stages[2])) == Counter(d for d, n, c in brute_groups(before) if d == c)


def test_mixture_takes_documents_of_its_input(stages):
    before, after = Counter(rows(stages[2])), Counter(rows(stages[3]))
    assert set(after) <= set(before)
    assert max(after.values()) <= 2


def test_packing_covers_the_mixture(stages):
    pieces, docs = stages[4].collect(), Counter(i for i, _ in rows(stages[3]))
    assert Counter(p["doc_id"] for p in pieces if p["piece"] == 0) == docs
    fill = defaultdict(int)
    for p in pieces:
        fill[p["sequence_id"]] += p["length"]
    assert max(fill.values()) <= 2048
    assert len(fill) <= -(-sum(fill.values()) // 2048) + 2


def test_run_and_empty_input(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[4].count()
    nothing = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0


def test_repeated_rows_leave_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    doubled = docs.unionByName(docs)
    assert exact_dedup(doubled).where("kept").groupBy("doc_id").count().where(F.col("count") > 1).isEmpty()
