"""The first notice of each title in a stream, with keyed state and timers; and what follows an event in another stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from noticeloom.streaming.windows import as_instant

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """Gives the first row (by ``_order``) of each key and remembers the key for ``keep_ms`` of event time after the last
    row that had it; 0 is for ever. A later row of the key is new again; timers clear what no row comes back to."""

    def __init__(self, keep_ms: int, names: list[str]):
        self.keep_ms, self.names = keep_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("until", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (Spark's names)
        before = self.seen.get() if self.seen.exists() else None
        first, newest = None, 0
        for part in rows:
            part.columns = self.names  # Spark's own names lose a leading underscore
            newest = max(newest, int(part["_ms"].max()))
            new = part if before is None else part[part["_ms"] > before[0]] if self.keep_ms else part[:0]
            if len(new):
                row = new.loc[[new["_order"].idxmin()]]
                first = row if first is None or row["_order"].iloc[0] < first["_order"].iloc[0] else first
        if self.keep_ms:
            until = max(newest + self.keep_ms, before[0] if before else 0)
            if before is None or until > before[0]:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(until)
                self.seen.update((until,))
        elif before is None:
            self.seen.update((0,))
        if first is not None:
            yield first.drop(columns=["_ms", "_order", "_key", "_time"], errors="ignore")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def first_in_stream(rows: DataFrame, key: Column, order: str, time: str | None = None, delay: str = "1 day", keep: str | None = None) -> DataFrame:
    """The rows of a stream that are the first of their key: within a batch by ``order``, and none in a batch before. With
    ``keep`` and an event ``time`` a key is forgotten so long after its last row, which bounds the state. The session has to use
    :data:`PROVIDER` for state."""
    keep_ms = 0
    if keep:
        if time is None:
            raise ValueError("what is kept for a while needs a time")
        keep_ms = int(rows.sparkSession.sql(f"SELECT unix_millis(timestamp_seconds(0) + interval {keep})").first()[0])
    marked = rows.withColumns({"_key": key, "_order": F.col(order), "_ms": F.lit(0).cast("long")})
    if keep_ms:
        marked = as_instant(marked.withColumn("_time", F.col(time)), "_time").withWatermark("_time", delay)
        marked = marked.withColumn("_ms", F.coalesce(F.unix_millis("_time"), F.lit(0).cast("long")))
    return marked.groupBy("_key").transformWithStateInPandas(FirstOfKey(keep_ms, marked.columns), rows.schema, "Append", "EventTime" if keep_ms else "None")


def followed(first: DataFrame, second: DataFrame, key: str, time: str, within: str, delay: str) -> DataFrame:
    """(key, first, second: structs of the rows) for each row of ``second`` that comes after one of ``first`` with the same key,
    at most ``within`` later. Of two streams the state is bounded: both have watermarks, and the condition bounds how long a row
    can still be met."""
    a = first.select(F.col(key).alias("_k"), F.col(time).alias("_at"), F.struct(*first.columns).alias("first"))
    b = second.select(F.col(key), F.col(time).alias("_then"), F.struct(*second.columns).alias("second"))
    a, b = as_instant(a, "_at").withWatermark("_at", delay), as_instant(b, "_then").withWatermark("_then", delay)
    met = (F.col("_k") == F.col(key)) & (F.col("_then") > F.col("_at")) & (F.col("_then") <= F.col("_at") + F.expr(f"interval {within}"))
    return a.join(b, met).select(key, "first", "second")
