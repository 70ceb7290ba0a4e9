"""Counts and selections for operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.functions import values as V
from noticeloom.operators.merge import FINAL_EMPTY

KINDS = ["single_region", "nationwide", "unknown", "conflict"]


def zero_filled(df: DataFrame, key: str, keys: list) -> DataFrame:
    """Counts by all of ``keys``."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = df.sparkSession.createDataFrame([(k,) for k in keys], f"{key} string")
    return known.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def kind_of(region: Column, reason: Column) -> Column:
    return F.when(reason == "conflict_or_multiple", F.lit("conflict")).when(region == V.NATIONWIDE, F.lit("nationwide")).when(region == V.UNKNOWN_REGION, F.lit("unknown")).otherwise(F.lit("single_region"))


def region_report(analysed: DataFrame) -> DataFrame:
    """One row of counts over ``region`` (as stored), ``inferred`` and ``reason``: all, by kind, and how many change."""
    kind = kind_of(F.col("inferred"), F.col("reason"))
    counts = [F.count_if(kind == k).alias(k) for k in KINDS]
    return analysed.agg(F.count(F.lit(1)).alias("total"), *counts, F.count_if(~F.col("region").eqNullSafe(F.col("inferred"))).alias("changed"))


def grouped(df: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """Values of each key in order, in numbered groups of at most ``size``, so that no group grows with the table."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(value)) - 1
    parts = df.select(key, value).withColumn("part", F.floor(place / size).cast("int"))
    return parts.groupBy(key, "part").agg(F.sort_array(F.collect_list(value)).alias(f"{value}s"))


def with_public_status(rows: DataFrame, view: DataFrame) -> DataFrame:
    """Rows (id, ...) with ``public_status`` from the public view; null for what isn't public."""
    return rows.join(view.select("id", F.col("status").alias("public_status")), "id", "left")


def detail_counts(notices: DataFrame, today: Column) -> DataFrame:
    """Per source: all, without detail, of these open, failed, and with a final empty page; in one pass."""
    missing = F.col("detail_content").isNull() & F.col("detail_url").isNotNull()
    open_ = F.coalesce(F.col("apply_end") >= today, F.lit(True))
    return notices.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(missing).alias("missing"),
        F.count_if(missing & open_).alias("missing_open"),
        F.count_if(F.coalesce(F.col("detail_fetch_status") == "failed", F.lit(False))).alias("failed"),
        F.count_if(F.col("detail_fetch_error").eqNullSafe(F.lit(FINAL_EMPTY))).alias("final_empty"),
    )


def backfill_targets(notices: DataFrame, today: Column, retry_before: Column, limit: int) -> DataFrame:
    """Notices whose page is to be fetched: open ones by nearest deadline, then those without, then closed ones, latest
    first. After two empty pages an open one comes back once its last attempt is old enough; a closed one doesn't."""
    closed = F.coalesce(F.col("apply_end") < today, F.lit(False))
    final = F.col("detail_fetch_error").eqNullSafe(F.lit(FINAL_EMPTY))
    again = F.coalesce(F.col("detail_fetch_attempted_at") <= retry_before, F.lit(True))
    wanted = notices.where(F.col("detail_content").isNull() & F.col("detail_url").isNotNull() & (~final | (~closed & again)))
    bucket = F.when(closed, F.lit(2)).when(F.col("apply_end").isNull(), F.lit(1)).otherwise(F.lit(0))
    day = F.unix_date("apply_end")
    near = F.when(closed, -day).otherwise(day)
    return wanted.withColumn("bucket", bucket).orderBy("bucket", near, "id").limit(limit)


def mixed_sample(candidates: DataFrame, limit: int) -> DataFrame:
    """A review sample of ``id, kind, is_open, place``: a quota per kind with open ones first, filled up in order of
    place. Only the first ``limit`` of each kind can be chosen, so both sorts end in a small limit."""
    quotas = dict(zip(KINDS, [max(0, limit - 15), min(5, limit), min(5, max(0, limit - 5)), min(5, max(0, limit - 10))], strict=True))
    quota = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col("kind"))
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    within = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("is_open"), "place"))
    ranked = candidates.where(F.col("kind").isin(KINDS)).withColumn("rank", within)
    chosen = ranked.withColumn("turn", F.when(F.col("rank") <= quota, order).otherwise(F.lit(len(KINDS))))
    key = F.when(F.col("turn") < len(KINDS), F.col("rank")).otherwise(F.col("place"))
    return chosen.orderBy("turn", key).limit(limit).select("id", "kind", "is_open", "place", "turn")


def ingest_counters(rows: DataFrame) -> DataFrame:
    """Per source: what came of each raw row. rows: source_id, outcome."""
    outcomes = ["upserted", "skipped", "failed", "duplicate", "expired"]
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in outcomes]
    return rows.groupBy("source_id").agg(*counts)
