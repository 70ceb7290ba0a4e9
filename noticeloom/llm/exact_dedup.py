"""Exact deduplication by distributed MSD radix partitioning.

A digit is a run of bytes. In each round the rows of every open group are split by their next digit; a part with one row
is a singleton and done, a part whose texts have ended holds equal texts and is done, every other part is an open group
of the next round. Digits grow geometrically, so even texts of 100 MB take a few rounds. Parts are counted with map-side
combining, so a part that holds a third of all rows costs its tasks one record each; rows learn their part through an
equi-join that adaptive execution can split. Equality rests on the bytes alone; no digest takes part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import ascii_lower, saved, table


def exact_dedup(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    first_digit: int = 256,
    growth: int = 8,
    release_text: bool = False,
) -> DataFrame:
    """All rows and columns of ``df`` with ``keep_id``, ``group_size`` (long) and ``kept`` (boolean).

    Texts are equal if they are identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays (nulls are smallest); among rows that repeat that id too, exactly one stays. ``keep_id`` is null if
    all ids of the group are. ``release_text`` returns settled rows with a null text, for callers that need ids only, and
    so doesn't store the texts again. Input columns of the result's names are replaced. An empty table gives no rows.
    """
    names = [c for c in df.columns if c not in ("keep_id", "group_size", "kept")]
    fields = {c: F.col(f"row.`{c}`") for c in names}
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.lit(0).cast("long").alias("part"))
    done, offset, digit = [], 0, first_digit
    while True:
        body = ascii_lower(fields[text_col]).cast("binary")
        split = rows.withColumn("digit", F.substring(body, offset + 1, digit)).withColumn("ended", F.octet_length(body) <= offset + digit)
        parts = (
            split.groupBy("part", "digit", "ended")
            .agg(F.count(F.lit(1)).alias("n"), F.max(fields[id_col]).alias("top"))
            .where("n > 1")
            .withColumn("next", F.monotonically_increasing_id())
        )
        parts = saved(parts, f"radix-parts-{offset}")
        open_parts = not parts.where(~F.col("ended")).isEmpty()
        joined = split.join(parts, ["part", "digit", "ended"], "left")
        is_open = F.col("next").isNotNull() & ~F.col("ended")
        kept_text = F.when(is_open, fields[text_col]) if release_text else fields[text_col]
        joined = joined.select(
            F.struct(*[(kept_text if c == text_col else x).alias(c) for c, x in fields.items()]).alias("row"),
            is_open.alias("open"),
            F.coalesce("next", F.lit(-1)).alias("part"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.when(F.col("n").isNull(), fields[id_col]).otherwise(F.col("top")).alias("keep_id"),
        )
        if open_parts:
            joined = saved(joined, f"radix-rows-{offset}")
            rows = joined.where("open").select("row", "part")
        done.append(joined.where(~F.col("open")).withColumn("round", F.lit(len(done))).drop("open"))
        if not open_parts:
            break
        offset, digit = offset + digit, digit * growth
    settled = reduce(DataFrame.unionByName, done)
    # Rows that could stay: one in each group, unless ids repeat.
    could = F.col("row").getField(id_col).eqNullSafe(F.col("keep_id"))
    alone = settled.where((F.col("group_size") == 1) | ~could).withColumn("kept", F.col("group_size") == 1)
    tied = settled.where((F.col("group_size") > 1) & could)
    first = F.row_number().over(Window.partitionBy("round", "part").orderBy(F.xxhash64("row")))
    tied = tied.withColumn("kept", first == 1)
    return alone.unionByName(tied).select("row.*", "keep_id", "group_size", "kept")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    hashed = documents.withColumn("text_sha256", F.sha2(ascii_lower(F.col("text")).cast("binary"), 256))
    return exact_dedup(hashed, release_text=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
WITH normal AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM normal
"""
