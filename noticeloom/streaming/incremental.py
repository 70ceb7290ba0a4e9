"""An extra beside the batch operators: incremental ingest of a folder of raw items with Structured Streaming.

Each micro-batch is normalized and merged into the buckets of the stored table that it touches, and what has expired is taken
out. A batch that runs again merges the same rows into the same keys, which changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.functions.dates import retention_cutoff
from noticeloom.functions.values import RETENTION_DAYS
from noticeloom.operators.dedup import first_per
from noticeloom.operators.merge import purge_expired
from noticeloom.operators.stored import BucketedTable
from noticeloom.sources.adapters import to_rows

KEYS = ["source_id", "source_key"]


def merge_batch(stored: BucketedTable, made: DataFrame, now: Column, today: Column, first: bool = False) -> None:
    """A batch of normalized notices (with arrival) into the table: created_at stays, attachments stay where new ones are
    missing, of equal keys the last arrival counts. The ``first`` batch makes the table."""
    new = to_rows(made, now).withColumn("created_at", now)
    cutoff = retention_cutoff(today, RETENTION_DAYS)
    if first:
        stored.create(purge_expired(first_per(new, KEYS, [F.desc("arrival")]).drop("arrival"), cutoff))
        return
    stored.upsert(new, keep=["created_at"], coalesced=["attachments"], arrival="arrival")
    stored.delete(made.sparkSession, F.col("apply_end") < cutoff)


def ingest_stream(spark: SparkSession, folder: str, adapter: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, now: Column, today: Column, buckets: int = 16):
    """Runs through what is new in ``folder`` (text files, an item a line) and stops; returns the query. The table is one of
    ``buckets`` below ``target``; :func:`latest` reads it."""
    raw = spark.readStream.format("text").load(folder).select(F.col("value").alias("raw"))
    stored = BucketedTable(target, KEYS, buckets)

    def batch(df: DataFrame, number: int) -> None:
        merge_batch(stored, adapter(df.withColumn("arrival", F.monotonically_increasing_id())), now, today, number == 0)

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    return BucketedTable(target, KEYS).rows(spark)
