"""Quality classifier by positive-unlabelled learning.

A linear model on statistics of the whole text minimises the non-negative unbiased risk

    prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])

with the logistic loss, trusted positives P (label 1 in the training fold), unlabelled web text U, and a class prior that
is estimated from P and U alone: labels 0 aren't used. All texts are learnt from: their features are written once and dealt to
blocks of about ``sample`` rows, a task minimises its block's risk against the trusted rows, and the blocks' models, which
share one scale of the features, are averaged by their rows. Of the labelled rows at most ``sample`` are taken (a parameter of
:func:`fit`; those with the smallest hashes of id and text) and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.llm.common import saved, table

SAMPLE = 12_000
THRESHOLD = 0.3
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MANY = 24 + len(PUNCTUATION)


def features(text: bytes) -> np.ndarray:
    """Square roots of shares of characters, words and repetitions, and logarithms of sizes."""
    n = max(1, len(text))
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(bytes_[65:91].sum() + bytes_[97:123].sum()))
    words = text.split()
    count = max(1, len(words))
    ends = sum(1 for w in words if not (w[-1] >= 0x80 or chr(w[-1]).isalnum() or w[-1:] in b".,"))
    doubled = sum(1 for w in words if len(w) > 1 and w[-1] == w[-2] and w[-1] < 0x80 and not chr(w[-1]).isalnum())
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 0
    parts = [p.strip() for p in text.replace(b"\n", b".").split(b".")]
    parts = [p for p in parts if p]
    unique = sum(map(len, set(parts)))
    total = max(1, sum(map(len, parts)))
    known: dict[bytes, int] = {}
    for p in parts:
        known[p] = known.get(p, 0) + 1
    most = max((len(p) * c for p, c in known.items() if c > 1), default=0)
    lines = text.split(b"\n")
    shares = [
        bytes_[65:91].sum() / letters,
        bytes_[48:58].sum() / n,
        bytes_[[9, 11, 12, 13, 32]].sum() / n,
        bytes_[10] / n,
        bytes_[128:].sum() / n,
        bytes_[:9].sum() / n,
        ends / count,
        doubled / count,
        len(set(words)) / count,
        1 - (pairs + 1) / count,
        1 - unique / total,
        most / total,
        sum(1 for w in words if len(w) == 1) / count,
        sum(1 for w in words if w.isupper()) / count,
        sum(1 for line in lines if len(line) < 20) / len(lines),
        float(bytes_.max()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / count,
    ]
    sizes = [np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), np.log1p(n / count), np.log1p(total / max(1, len(parts)))]
    out = np.zeros(MANY)
    out[: len(shares)] = np.sqrt(np.maximum(0.0, shares))
    out[len(shares) : len(shares) + len(sizes)] = sizes
    out[len(shares) + len(sizes)] = float(not words)
    out[MANY - len(PUNCTUATION) :] = np.sqrt(bytes_[list(PUNCTUATION)] / n)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def risk(weights: np.ndarray, bias: float, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The risk's two parts, of positives and of negatives (which may be below zero), and their slopes (the bias last)."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    softplus = lambda z: np.logaddexp(0, z)
    slope = lambda x, d: np.append(x.T @ d, d.sum()) / len(d)
    zp, zu = p @ weights + bias, u @ weights + bias
    sp, su = sigmoid(zp), sigmoid(zu)
    positive, negative = prior * softplus(-zp).mean(), softplus(zu).mean() - prior * softplus(zp).mean()
    return positive, negative, prior * slope(p, sp - 1), slope(u, su) - prior * slope(p, sp)


def scale_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return rows.mean(axis=0), rows.std(axis=0) + 1e-3


def fit_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, penalty: float = 1e-4, scale: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """Full-batch Adam on the non-negative risk, of features in the given scale (else in that of these rows). While its second part is negative, the step goes up that part's slope
    instead, so that the model unlearns what made it so."""
    mean, scale = scale or scale_of(np.vstack([positive, unlabelled]))
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    weights, bias = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    for step in range(1, steps + 1):
        _, negative, of_positive, of_negative = risk(weights, bias, p, u, prior)
        gradient = of_positive + of_negative if negative >= 0 else -of_negative
        gradient[:-1] += penalty * weights
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Model(mean, scale, weights, bias, prior)


def remainder(id_: Column) -> Column:
    """crc32 of the id as text, mod 5 (null as the empty text); rows with 0 are held out."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5


def least_ratio(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives among the unlabelled, from the scores of both.

    Above any score lie a share p of the positives and a share u of the unlabelled, of which at least prior * p are
    positives: prior <= u / p. The bound is taken at the score where it is least, allowing for chance in both shares
    (``doubt`` is the probability of being off by more), so that few rows at the top don't decide.
    """
    above = np.sort(positive)[::-1]
    share = np.arange(1, len(above) + 1) / len(above)
    of_all = 1 - np.searchsorted(np.sort(unlabelled), above, side="left") / len(unlabelled)
    chance = sum(np.sqrt(np.log(4 / doubt) / 2 / len(x)) for x in (positive, unlabelled))
    whole = np.append(above[1:] != above[:-1], True)  # equal scores count together
    at = int(np.argmin(np.where(whole, (of_all + chance) / share, np.inf)))
    return float(np.clip(of_all[at] / share[at], 0.02, 0.98))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, scale: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """The class prior of the unlabelled rows. Each half of the rows is scored by a model of the other half; a better prior
    gives better scores, and these a better prior."""
    prior = 0.5
    if min(len(positive), len(unlabelled)) < 2:
        return prior
    for _ in range(3):
        found = []
        for half in (0, 1):
            trial = fit_risk(positive[1 - half :: 2], unlabelled[1 - half :: 2], prior, steps=300, scale=scale)
            found.append(least_ratio(trial.score(positive[half::2]), trial.score(unlabelled[half::2])))
        prior = sum(found) / 2
    return prior


def featured(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` but the text, with ``features`` (bytes of :func:`features`); null texts count as empty."""
    names = [c for c in df.columns if c not in ("features", text_col)]
    given = df.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"), F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in names]).alias("row"))
    schema = T.StructType([given.schema["row"], T.StructField("features", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features(t.as_py()).astype(np.float32).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), found], names=["row", "features"])

    return given.mapInArrow(work, schema).select(*[F.col(f"row.`{c}`") for c in names], "features")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), MANY).astype(np.float64)


def collected(told: DataFrame, sample: int) -> np.ndarray:
    """Features of the ``sample`` rows (place, features) with the smallest places."""
    found = told.select("place", "features").orderBy("place", "features").limit(sample).toArrow()
    return matrix(found["features"])


def whole_scale(told: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of rows, and the means and deviations of their features."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros((2, MANY))
        for batch in batches:
            rows = matrix(batch.column("features"))
            n, sums = n + len(rows), sums + [rows.sum(axis=0), (rows**2).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * MANY + 1), pa.int32()), pa.array([float(n), *sums.ravel()])], names=["i", "x"])

    parts = told.select("features").mapInArrow(work, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    n = int(parts[0]["x"]) if parts else 0
    mean, square = np.array([r["x"] for r in parts[1:]]).reshape(2, MANY) / max(1, n) if parts else np.zeros((2, MANY))
    return n, mean, np.sqrt(np.maximum(0.0, square - mean**2)) + 1e-3


def fit_featured(told: DataFrame, labels: DataFrame, *, prior: float | None = None, sample: int = SAMPLE) -> Model:
    """:func:`fit` from a written table (doc_id, place, features), where place is a hash of id and text."""
    known = labels.select("doc_id", "quality").where((remainder(F.col("doc_id")) != 0) & (F.col("quality") == 1))
    positive = collected(told.join(known.select("doc_id").distinct(), "doc_id", "left_semi"), sample)
    n, mean, scale = whole_scale(told)
    if not len(positive) or not n:
        prior = 0.5 if prior is None else prior
        return Model(np.zeros(MANY), np.ones(MANY), np.zeros(MANY), float(np.log(prior / (1 - prior))), prior)
    blocks, sent = -(-n // sample), told.sparkSession.sparkContext.broadcast(positive)

    def work(block: pa.Table) -> pa.Table:
        own = prior
        rows = matrix(block["features"])
        if own is None:
            own = estimated_prior(sent.value, rows, (mean, scale))
        model = fit_risk(sent.value, rows, own, scale=(mean, scale))
        found = np.array([1.0, own, model.bias, *model.weights]) * len(rows)
        return pa.Table.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found)], names=["i", "x"])

    # Rows are dealt by their number, as equal texts have equal hashes.
    dealt = told.select("features", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"))
    sums = dealt.groupBy("block").applyInArrow(work, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    found = np.array([r["x"] for r in sums])
    found = found[1:] / found[0]
    return Model(mean, scale, found[2:], float(found[1]), float(found[0]))


def placed(documents: DataFrame) -> DataFrame:
    return documents.withColumn("place", F.xxhash64("doc_id", "text"))


def fit(documents: DataFrame, labels: DataFrame, *, prior: float | None = None, sample: int = SAMPLE) -> Model:
    """``documents``: doc_id, text. ``labels``: doc_id, quality (others ignored), of which the held-out fold isn't read.

    All texts are learnt from as unlabelled, and at most ``sample`` positives. Without a positive row to learn from, or
    without documents, all texts score the prior (0.5 if none is given).
    """
    return fit_featured(saved(featured(placed(documents.select("doc_id", "text"))), "quality-features"), labels, prior=prior, sample=sample)


def classified(told: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """:func:`classify` of rows with ``features``, which go."""
    names = [c for c in told.columns if c not in ("score", "predicted", "features")]
    given = told.select(F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in names]).alias("row"), "features")
    schema = T.StructType([given.schema["row"], T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.score(matrix(batch.column("features"))))], names=["row", "score"])

    scored = given.mapInArrow(work, schema)
    return scored.select(*[F.col(f"row.`{c}`") for c in names], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(df: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """All rows of ``df`` with ``score`` (0 to 1, higher is better) and ``predicted`` (1 from the threshold on).

    Only the text decides; null counts as empty, and empty texts have scores too. Input columns of the result's names are
    replaced. An empty table gives no rows.
    """
    names = [c for c in df.columns if c not in ("score", "predicted") and (keep_text or c != text_col)]
    given = df.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"), F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in names]).alias("row"))
    schema = T.StructType([given.schema["row"], T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t.as_py()) for t in batch.column("text")], dtype=np.float32).reshape(batch.num_rows, MANY).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.score(rows))], names=["row", "score"])

    scored = given.mapInArrow(work, schema)
    return scored.select(*[F.col(f"row.`{c}`") for c in names], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    told = saved(featured(placed(table(spark, sf_dir, "documents").select("doc_id", "text"))), "quality-features")
    model = fit_featured(told, table(spark, sf_dir, "labels"))
    return classified(told.withColumn("held_out", remainder(F.col("doc_id")) == 0), model).select("doc_id", "held_out", "score", "predicted")
