"""Windows over the event log by event time, in batch and as streams, with a rule for what comes late.

Late is what is older than the newest event of all batches before by more than a delay, or has no time. Late rows land in a
table of their own, so none is lost; all others reach the windows, as Spark's own watermark is never ahead of this rule's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_instant(rows: DataFrame, time: str) -> DataFrame:
    """``rows`` with ``time`` as a timestamp, which watermarks ask for; a time without a zone counts as of UTC, whatever the
    session's zone."""
    if not isinstance(rows.schema[time].dataType, T.TimestampNTZType):
        return rows
    return rows.withColumn(time, F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(time))))


def without_zone(c: Column) -> Column:
    """The other way: an instant as the time of UTC."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def windowed(rows: DataFrame, time: str, aggregates: list[Column], keys: list[str] = (), *, size: str | None = None, step: str | None = None, gap: str | None = None) -> DataFrame:
    """(keys, start, end, aggregates) per window: tumbling of a ``size``, sliding by a ``step``, or sessions that end with a
    ``gap``. Of a batch or a stream; rows without time are in no window."""
    if (size is None) == (gap is None):
        raise ValueError("give a size or a gap")
    window = F.session_window(time, gap) if gap else F.window(time, size, step)
    names = [*keys, "start", "end"]
    made = rows.where(F.col(time).isNotNull()).groupBy(*keys, window.alias("w")).agg(*aggregates)
    return made.withColumns({"start": F.col("w.start"), "end": F.col("w.end")}).select(*names, *[c for c in made.columns if c not in (*keys, "w")])


def split_late(spark: SparkSession, folder: str, schema: T.StructType, time: str, delay: str, target: str, checkpoint: str):
    """Runs through what is new in ``folder`` (Parquet) and writes it below ``target``, late rows apart; returns the query. A batch
    that runs again overwrites what it wrote."""
    rows = spark.readStream.schema(schema).parquet(folder)

    def batch(df: DataFrame, number: int) -> None:
        mark = spark.read.parquet(f"{target}/marks/batch={number - 1}").first()["newest"] if number else None
        old = F.lit(False) if mark is None else F.col(time) < F.lit(mark).cast(schema[time].dataType) - F.expr(f"interval {delay}")
        split = df.withColumn("late", F.coalesce(old, F.lit(True)) if mark is not None else F.col(time).isNull())
        split.write.mode("overwrite").partitionBy("late").parquet(f"{target}/rows/batch={number}")
        newest = df.agg(F.greatest(F.max(time), F.lit(mark).cast(schema[time].dataType)).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{target}/marks/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema, T.StructField("batch", T.IntegerType()), T.StructField("late", T.BooleanType())])).parquet(f"{target}/rows").where("late").drop("late")


def window_stream(spark: SparkSession, source: str, schema: T.StructType, time: str, delay: str, aggregates: list[Column], keys: list[str], target: str, checkpoint: str, **kind):
    """Appends the windows that have closed (whose end the newest event has passed by the delay) to ``target``, from the rows in
    time below ``source``, where :func:`split_late` put them; returns the query."""
    rows = as_instant(spark.readStream.schema(schema).parquet(f"{source}/rows/*/late=false"), time).withWatermark(time, delay)
    made = windowed(rows, time, aggregates, keys, **kind)
    if isinstance(schema[time].dataType, T.TimestampNTZType):
        made = made.withColumns({c: without_zone(F.col(c)) for c in ("start", "end")})
    return made.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed(rows: DataFrame, batch: Column, folder: str, run: Callable[[], None]) -> None:
    """Adds the rows to ``folder`` batch by batch and calls ``run`` after each, as a restarted job would."""
    marked = rows.withColumn("_batch", batch)
    for number in sorted(r[0] for r in marked.select("_batch").distinct().collect()):
        marked.where(F.col("_batch") == number).drop("_batch").write.mode("append").parquet(folder)
        run()
