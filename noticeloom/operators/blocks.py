"""Two tables compared row by row within blocks, where most of their rows would meet in a join.

Each side is dealt to blocks of bounded size, and each pair of blocks is one task's group: nothing but what a comparison
keeps is shuffled, however many pairs are compared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What one block may hold, in entries (a row's trigrams, a list's places) of either side.
LEFT, RIGHT = 4_000_000, 4_000_000


def compared(left: DataFrame, right: DataFrame, by: tuple[str, str], entries: tuple[str, str], work: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType, keys: list[str] = ()) -> DataFrame:
    """What ``work`` makes of each pair of blocks (with equal ``keys``). Rows are dealt by a hash of a column each (``by``), to as many
    blocks as their numbers of ``entries`` (SQL) ask for."""
    least = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = [df.agg(F.sum(F.expr(e))).first()[0] or 0 for df, e in ((left, entries[0]), (right, entries[1]))]
    blocks = max(1, -(-sums[1] // RIGHT))
    parts = max(1, -(-sums[0] // LEFT), -(-least // blocks))  # a group for each task at least
    dealt = lambda df, c, name, n: df.withColumn(name, F.pmod(F.xxhash64(c), F.lit(n)).cast("int"))
    every = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    one = every(dealt(left, by[0], "_part", parts), "_block", blocks)
    two = every(dealt(right, by[1], "_block", blocks), "_part", parts)
    groups = [*keys, "_part", "_block"]
    n = parts * blocks
    a, b = (df.repartition(n, *groups).groupBy(*groups) for df in (one, two))
    return a.cogroup(b).applyInArrow(work, schema)


def empty(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def flat(table: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and where each row's begin (and the last one's end)."""
    column = table[name].combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def numbers(*columns: pa.Array) -> list[np.ndarray]:
    """Equal values of all the columns as equal numbers from 0 on."""
    codes = pa.concat_arrays([c.cast(columns[0].type) for c in columns]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


class Lists:
    """Inverted lists of rows of values: by value, the rows that have it."""

    def __init__(self, values: np.ndarray, starts: np.ndarray, size: int):
        rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.order = np.argsort(values, kind="stable")
        self.rows = rows[self.order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=size))])

    def of(self, values: np.ndarray) -> np.ndarray:
        """All places in the lists of these values."""
        sizes = self.at[values + 1] - self.at[values]
        ends = np.cumsum(sizes)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[values] - ends + sizes, sizes)
