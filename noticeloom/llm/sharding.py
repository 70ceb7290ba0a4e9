"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

1. Rows fall into logical partitions by a hash of their content; the counts per partition are taken.
2. The driver draws, without looking at rows, how many rows each partition sends to each shard: a matrix with the
   partitions' counts as row sums and the exact shard sizes as column sums, distributed as the counts of a uniformly
   random permutation are (multivariate hypergeometric).
3. Each partition is permuted by a seeded hash and cut by its row of the matrix, the rows are exchanged, and each shard
   is permuted again by an independent hash, which gives the slots.

The second permutation is cut into ranges of the hash so that no shard has to fit one task.
Everything on rows is DataFrame code; numpy draws the matrix of at most ``MATRIX_CELLS`` numbers on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import shuffle_partitions, table

#: Bound on partitions x shards, and so on what is drawn and broadcast (8 bytes a cell).
MATRIX_CELLS = 4_000_000
#: So that at least a hundred partitions remain.
MOST_SHARDS = MATRIX_CELLS // 100
#: numpy's sampler takes populations below this; above, the distribution is inverted around its mode.
NUMPY_POPULATION = 10**9


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` draws without replacement are good."""
    if sample <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return min(sample, good)
    if good + bad < NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, sample))
    total = good + bad
    low, high = max(0, sample - bad), min(good, sample)
    mean = sample * good / total
    spread = math.sqrt(max(1.0, mean * (bad / total) * ((total - sample) / (total - 1)))) * 12 + 12
    first, last = max(low, int(mean - spread)), min(high, int(mean + spread) + 1)
    # Ratios of neighbouring probabilities need no large factorials.
    k = np.arange(first, last, dtype=float)
    steps = np.log((good - k) * (sample - k)) - np.log((k + 1) * (bad - sample + k + 1))
    log_p = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(log_p - log_p.max())
    return first + int(np.searchsorted(np.cumsum(p) / p.sum(), rng.random(), side="right").clip(0, len(p) - 1))


def communication_matrix(counts: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Rows sum to ``counts``, columns to ``shard_sizes`` (equal totals)."""
    rng = np.random.default_rng(seed)
    left, out = list(shard_sizes), np.zeros((len(counts), len(shard_sizes)), dtype=np.int64)
    remaining = sum(left)
    for i, count in enumerate(counts):
        todo, pool = count, remaining
        for s, open_slots in enumerate(left):
            if todo == 0:
                break
            got = draw_hypergeometric(rng, open_slots, pool - open_slots, todo)
            out[i, s] = got
            todo, pool = todo - got, pool - open_slots
        left = [a - int(b) for a, b in zip(left, out[i], strict=True)]
        remaining -= count
    return out


def exact_sizes(rows: int, shards: int) -> list[int]:
    """Counts at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shard(df: DataFrame, shards: int, *, seed: int = 20_011, partitions: int | None = None) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Shard sizes are at most one apart and the order is a uniform shuffle that depends on the rows' content, the seed and
    the partition count only, so reruns and lost executors give the same result. Nulls hash like any value; rows that
    repeat in all columns are interchangeable, and stand in one partition; an empty table gives no rows; input columns
    named ``shard`` or ``slot`` are replaced. More than ``MOST_SHARDS`` shards are refused.
    """
    spark = df.sparkSession
    if shards > MOST_SHARDS:
        raise ValueError(f"at most {MOST_SHARDS} shards")
    partitions = min(MATRIX_CELLS // shards, partitions or 4 * shuffle_partitions(spark))
    ranges = max(1, -(-partitions // shards))
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    if not keep:
        raise ValueError("the rows have no column besides shard and slot")
    slim = df.select(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in keep]).alias("h"))
    full = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in keep]).alias("h"))
    part = F.pmod(F.col("h"), F.lit(partitions)).cast("int")

    counts = {r["part"]: r["count"] for r in slim.groupBy(part.alias("part")).count().collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(partitions)], exact_sizes(sum(counts.values()), shards), seed)
    cuts = spark.createDataFrame(
        [(p, [int(x) for x in row]) for p, row in enumerate(np.cumsum(matrix, axis=1))], "part int, cuts array<bigint>"
    )

    def sent(rows: DataFrame) -> DataFrame:
        """The local permutation, cut by the matrix; ``u`` orders the shard, ``piece`` is its range."""
        again = F.xxhash64(F.lit(seed + 1), F.col("h"))
        local = Window.partitionBy("part").orderBy("h")
        return (
            rows.withColumn("part", part)
            .withColumn("rank", F.row_number().over(local))
            .join(F.broadcast(cuts), "part")
            .withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("rank"))))
            .withColumn("u", F.shiftrightunsigned(again, 1))
            .withColumn("piece", F.shiftright(F.shiftrightunsigned(again, 33) * F.lit(ranges).cast("bigint"), 31).cast("int"))
            .drop("cuts", "part", "rank")
        )

    sizes = sent(slim).groupBy("shard", "piece").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "piece", F.coalesce(before, F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "piece").orderBy("u", "h")
    return (
        sent(full)
        .withColumn("place", F.row_number().over(within))
        .join(F.broadcast(starts), ["shard", "piece"])
        .select("row.*", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("place") - 1).cast("long").alias("slot"))
    )


def op1_sharding(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return shard(documents, shards).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
