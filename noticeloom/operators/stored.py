"""A table of notices in buckets of its keys: an upsert reads and writes only the buckets that it touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.functions.scratch import written
from noticeloom.operators import merge

BUCKET = "bucket"


@dataclass
class BucketedTable:
    """Parquet below ``path``, a folder a bucket. ``buckets`` stays what it was made with; it is right where a bucket is
    some hundred MB, and bounds what one task writes.

    A run that breaks off between buckets is mended by running it again: what goes into a bucket is written aside first and
    replaces the bucket as a whole, and an upsert of the same rows gives the same table.
    """

    path: str
    keys: list[str]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        """Replaces the whole table."""
        self._put(rows.withColumn(BUCKET, self.bucket()), "overwrite", "static")

    def _put(self, rows: DataFrame, mode: str, overwrite: str) -> None:
        rows.repartition(BUCKET).write.mode(mode).option("partitionOverwriteMode", overwrite).partitionBy(BUCKET).parquet(self.path)

    def _read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def rows(self, spark: SparkSession) -> DataFrame:
        return self._read(spark).drop(BUCKET)

    def lookup(self, spark: SparkSession, wanted: DataFrame) -> DataFrame:
        """Rows of the keys of ``wanted``; only their buckets are read."""
        wanted = wanted.select(*self.keys).distinct()
        touched = [r[0] for r in wanted.select(self.bucket()).distinct().collect()]  # as many as there are buckets at most
        return self._read(spark).where(F.col(BUCKET).isin(touched)).drop(BUCKET).join(wanted, self.keys, "left_semi")

    def upsert(self, new: DataFrame, **options) -> list[int]:
        """:func:`merge.upsert` of the buckets that have rows of ``new``; returns these."""
        new = written(new.withColumn(BUCKET, self.bucket()), "bucket-news")
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())
        if touched:
            old = self._read(new.sparkSession).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
            merged = merge.upsert(old, new.drop(BUCKET), self.keys, **options)
            self._put(written(merged.withColumn(BUCKET, self.bucket()), "bucket-merged"), "overwrite", "dynamic")
        return touched

    def delete(self, spark: SparkSession, gone: Column) -> list[int]:
        """Takes out the rows for which ``gone`` is true; returns the buckets that had some."""
        rows = self._read(spark)
        touched = sorted(r[0] for r in rows.where(gone).select(BUCKET).distinct().collect())
        if touched:
            kept = written(rows.where(F.col(BUCKET).isin(touched) & ~F.coalesce(gone, F.lit(False))), "bucket-kept")
            self._put(kept, "overwrite", "dynamic")
            left = {r[0] for r in kept.select(BUCKET).distinct().collect()}
            for empty in sorted(set(touched) - left):  # nothing is written for a bucket without rows, so it is emptied by itself
                kept.limit(0).drop(BUCKET).write.mode("overwrite").parquet(f"{self.path}/{BUCKET}={empty}")
        return touched
