"""Mixing of sources to target weights.

Tokens are aggregated per source, the mix's size is shared among the sources by weight with a cap on repetition, and
each document is emitted floor(rate) times plus one more time if a hash of it, read as a number in [0, 1), lies below
the rate's fraction. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import saved, table

#: Sources up to which their targets are broadcast, and the bytes of their names up to which they are.
MOST_SOURCES, MOST_NAME_BYTES = 100_000, 8 << 20
ADDED = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``source, source_size`` with ``target``: ``share`` x all sizes, dealt by weight and stopped at ``cap`` x size.

    Resharing the excess by weight until no target is above its cap ends at one level L per unit of weight, with
    target = min(cap, L * weight). In the order of cap / weight, L is what is left per weight at the first source whose
    cap isn't passed. One row per source takes part, not documents, so that a single ordered window is small.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("place", F.row_number().over(every)).withColumn(
        "weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    )
    by_cap = Window.orderBy("ratio", "place")
    upto = by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = (
        ranked.withColumn("most", F.col("source_size") * F.lit(cap))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("capped", F.sum("most").over(upto) - F.col("most"))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight"))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("weight_left"))
    )
    level = F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.col("capped"))).over(whole)
    return levels.withColumn("level", level).select(
        "source", "source_size", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target")
    )


def counted(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(id_: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed, the id and the text."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    whole = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("")), digest).cast("binary"))
    return F.conv(F.substring(whole, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def with_copies(rows: DataFrame, totals: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``rows`` (source, coin, others) with source_size, target and copies. ``totals``: source, source_size.

    Targets are one row a source. They are broadcast within the stated bounds; beyond, rows meet them in an equi-join, in
    which adaptive execution splits a hot source.
    """
    targets = saved(source_targets(totals, weights, share, cap), "mix-targets").withColumnRenamed("source", "of")
    names = F.coalesce(F.sum(F.octet_length(F.col("of").cast("string"))), F.lit(0))
    count, name_bytes = targets.agg(F.count(F.lit(1)), names).first()
    if count <= MOST_SOURCES and name_bytes <= MOST_NAME_BYTES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = (F.floor("rate") + (F.col("coin") < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    joined = rows.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return joined.withColumn("rate", rate).withColumn("copies", copies).drop("rate")


def plan_mix(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row of ``df`` with ``mix_size, mix_source_size, mix_target`` and ``mix_copies``, how often the mix takes it.

    ``carry`` names the columns to keep (all). Texts are read once: what is carried, sizes and coins are written and read
    again. A null text has size 0; null sources are one source; a source of size 0 takes nothing. The coin of a row depends
    on the seed, its id and its text, so reruns agree and rows that repeat in both share it. Input columns of the four
    names are replaced. An empty table gives no rows.
    """
    names = [c for c in (carry if carry is not None else df.columns) if c not in ADDED]
    text = F.col(f"`{text_col}`")
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{source_col}`").alias("source"),
        counted(text).alias("size"), coin(F.col(f"`{id_col}`"), text, seed).alias("coin"),
    )
    rows = saved(rows, "mix-sizes")
    planned = with_copies(rows, rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    return planned.select("row.*", *[F.col(c).alias(a) for c, a in zip(("size", "source_size", "target", "copies"), ADDED, strict=True)])


def mix(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """The mix itself: each row of ``df`` as often as :func:`plan_mix` takes it, with its own columns, whatever their names.

    Sizes are aggregated in one pass over the texts, copies made in a second one, as they depend on the coin and the
    source's rate alone; no text is shuffled while the targets are broadcast.
    """
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`").alias("source")
    totals = df.select(source, counted(text).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), source, coin(F.col(f"`{id_col}`"), text, seed).alias("coin"))
    planned = with_copies(rows, totals, weights, share, cap).where("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    planned = plan_mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return planned.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS coin
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM totals),
weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM ranked),
run AS (
  SELECT *, most / weight AS ratio, (SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE FROM totals) AS budget,
         sum(most) OVER (ORDER BY most / weight, place ROWS UNBOUNDED PRECEDING) - most AS capped,
         (SELECT sum(weight) FROM weighed) - sum(weight) OVER (ORDER BY most / weight, place ROWS UNBOUNDED PRECEDING) + weight AS weight_left
  FROM weighed),
level AS (
  SELECT min_by((budget - capped) / weight_left, capped) AS level FROM run WHERE ratio >= (budget - capped) / weight_left),
targets AS (
  SELECT source, source_size, least(most, coalesce(level * weight, most)) AS target FROM run, level),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, s.coin, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
