"""Notices, alerts and word rules made of the given tables, in Spark and in DuckDB's SQL.

A document is a notice: its first sentence or cell the title, its second the target, its whole text the summary. Word rules stand in
for the domain's Korean ones, which are parameters of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.functions.text import WS, content_hash
from noticeloom.operators.classify import category_ids

TODAY = "2026-07-12"
RULES = {1: ["tion", "ción"], 2: ["eau", "ier "], 3: ["sch", "ung"], 4: ["ado", "mente"], 5: ["idiot", "clown"], 6: ["license"], 7: ["@"], 8: ["thorow", "ringing"], 9: [" | "]}
AUDIENCES = {"business": ["ndwh", "ierçré", "schkeit"], "worker": ["onthan", "ciónado"]}
BUSINESS, WORKER = ["the", "le "], ["ing", "ment"]
CODES = {"english": "en", "french": "fr", "german": "de", "spanish": "es"}
URL = "https://notices.example/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def today():
    return F.lit(TODAY).cast("date")


def now():
    return F.lit(f"{TODAY} 03:00:00").cast("timestamp_ntz")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    made = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        (F.substring("source", 4, 9).cast("int") % 5 + 1).alias("source_id"),
        F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("source_key"),
        F.regexp_extract("text", "^[^.!?|\n]*", 0).alias("title"),
        F.col("source").alias("organization"),
        F.col("lang").alias("region"),
        F.get(lines, F.lit(1)).alias("target"),
        F.col("lang").alias("support_type"),
        F.col("text").alias("summary"),
        F.when(F.col("doc_id") % 3 != 0, F.date_add(today(), (F.col("n_chars") % 40 - 60).cast("int"))).alias("apply_start"),
        F.when(F.col("doc_id") % 7 != 0, F.date_add(today(), (F.col("n_chars") % 60 - 30).cast("int"))).alias("apply_end"),
        F.concat(F.lit(URL), F.col("doc_id").cast("string")).alias("detail_url"),
        F.expr("timestampadd(HOUR, cast(doc_id % 4000 as int), timestamp_ntz '2026-02-01 00:00:00')").alias("created_at"),
        F.expr("timestampadd(MINUTE, cast(n_chars % 5000 as int), timestamp_ntz '2026-06-01 00:00:00')").alias("updated_at"),
    )
    return made.withColumns(
        {
            "category_ids": category_ids(F.col("title"), F.col("target"), F.col("support_type"), F.col("summary"), RULES),
            "content_hash": content_hash(F.col("title"), F.col("organization"), F.col("apply_end")),
        }
    )


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


_TEXT = "concat_ws(' ', title, target, support_type, summary)"
_RULES = ", ".join(f"CASE WHEN {_any(_TEXT, words)} THEN {id_} END" for id_, words in RULES.items())
_HASH = lambda c: rf"lower(regexp_replace(regexp_replace(coalesce({c}, ''), '{WS}', '', 'g'), '[\[\]()〈〉<>「」『』【】]', '', 'g'))"

NOTICES = rf"""
WITH plain AS (
  SELECT doc_id AS id, CAST(substr(source, 4) AS INTEGER) % 5 + 1 AS source_id, 'k' || doc_id AS source_key,
         regexp_extract(text, '^[^.!?|\n]*') AS title, source AS organization, lang AS region, string_split(text, chr(10))[2] AS target,
         lang AS support_type, text AS summary,
         CASE WHEN doc_id % 3 <> 0 THEN DATE '{TODAY}' + CAST(n_chars % 40 - 60 AS INTEGER) END AS apply_start,
         CASE WHEN doc_id % 7 <> 0 THEN DATE '{TODAY}' + CAST(n_chars % 60 - 30 AS INTEGER) END AS apply_end,
         '{URL}' || doc_id AS detail_url,
         TIMESTAMP '2026-02-01' + to_hours(CAST(doc_id % 4000 AS INTEGER)) AS created_at,
         TIMESTAMP '2026-06-01' + to_minutes(CAST(n_chars % 5000 AS INTEGER)) AS updated_at
  FROM documents),
notices AS (
  SELECT *, list_filter([{_RULES}], lambda x: x IS NOT NULL) AS category_ids,
         sha256({_HASH('title')} || '|' || {_HASH('organization')} || '|' || coalesce(strftime(apply_end, '%Y-%m-%d'), '')) AS content_hash
  FROM plain),
ranked AS (
  SELECT *, regexp_replace(lower(title), '[^0-9a-z가-힣]', '', 'g') AS canonical,
         row_number() OVER (PARTITION BY content_hash ORDER BY source_id, updated_at DESC, id DESC) AS place FROM notices),
best AS (SELECT * FROM ranked WHERE place = 1),
seen AS (
  SELECT c.*, CASE WHEN apply_end IS NULL OR apply_end >= DATE '{TODAY}' THEN 'open' ELSE 'closed' END AS status FROM best c
  WHERE NOT EXISTS (SELECT 1 FROM best p WHERE p.source_id < c.source_id AND length(c.canonical) >= 10 AND p.canonical = c.canonical
                    AND p.apply_end IS NOT DISTINCT FROM c.apply_end))
"""
any_word = _any
