"""Totals over several dimensions at once, and daily sketches that add up to any span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(rows: DataFrame, dimensions: list[str], aggregates: list[Column], sets: str | list[list[str]] = "cube") -> DataFrame:
    """(dimensions, level, aggregates) for each of the grouping sets: all (``cube``), those of leading dimensions
    (``rollup``), or those given. ``level`` has a bit per dimension that is summed over, the first the highest, so a null of
    the data isn't taken for a total. One expansion and one aggregation, which is partial before the shuffle."""
    if sets == "cube":
        grouped = rows.cube(*dimensions)
    elif sets == "rollup":
        grouped = rows.rollup(*dimensions)
    else:
        grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *dimensions)
    made = grouped.agg(F.grouping_id().cast("int").alias("level"), *aggregates)
    return made.select(*dimensions, "level", *made.columns[len(dimensions) + 1 :])


def spread(rows: DataFrame, by: str, over: str, values: list, aggregate: Column) -> DataFrame:
    """A row per ``by`` and a column per given value of ``over``. Values are given, so that no pass over the data seeks them."""
    return rows.groupBy(by).pivot(over, values).agg(aggregate)


def daily_sketches(rows: DataFrame, time: str, keys: list[str], distinct: str, measure: str, *, bits: int = 12, k: int = 200) -> DataFrame:
    """(keys, day, rows, distinct_state, measure_state): per day a sketch of the distinct values of one column (HyperLogLog,
    relative error about 1.04 / sqrt(2^bits)) and one of the quantiles of another (KLL, rank error about 1.33 % for k = 200), kept as
    bytes of bounded size. Null values count in neither."""
    return rows.groupBy(*keys, F.to_date(time).alias("day")).agg(
        F.count("*").alias("rows"), F.hll_sketch_agg(distinct, F.lit(bits)).alias("distinct_state"), F.kll_sketch_agg_double(F.col(measure).cast("double"), F.lit(k)).alias("measure_state")
    )


def merged_sketches(sketches: DataFrame, span: Column, keys: list[str], quantiles: list[float]) -> DataFrame:
    """(keys, span, rows, distinct, quantiles) of days that a ``span`` unites; the rows themselves aren't read again."""
    merged = sketches.groupBy(*keys, span.alias("span")).agg(F.sum("rows").alias("rows"), F.hll_union_agg("distinct_state").alias("d"), F.kll_merge_agg_double("measure_state").alias("m"))
    ranks = F.array(*[F.kll_sketch_get_quantile_double("m", F.lit(q)) for q in quantiles])
    return merged.select(*keys, "span", "rows", F.hll_sketch_estimate("d").alias("distinct"), ranks.alias("quantiles"))
