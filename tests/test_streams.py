"""Streams in batches with restarts against what one batch gives."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from noticeloom.plans.stream_queries import keyed_state
from noticeloom.streaming import seen, windows

T0 = datetime(2024, 1, 1)
KINDS = "id long, ts timestamp_ntz, key string, batch int"


def rows_of(rng, n, batches):
    return [(i, T0 + timedelta(minutes=rng.randrange(3000)), rng.choice("aaabcdé"), rng.randrange(batches)) for i in range(n)]


def stream(spark, at, schema):
    return spark.readStream.schema(schema).parquet(f"{at}/in")


@pytest.mark.parametrize("batches", [1, 4])
def test_first_of_key_at_any_split(spark, tmp_path, batches):
    rows = rows_of(random.Random(batches), 60, batches)
    df = spark.createDataFrame(rows, KINDS).repartition(3)

    def run():
        first = seen.first_in_stream(stream(spark, tmp_path, df.schema), F.col("key"), "id")
        first.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()

    with keyed_state(spark):
        windows.replayed(df, F.col("batch"), f"{tmp_path}/in", run)
    best = {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        best.setdefault(r[2], r)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(best.values())


def test_a_key_is_forgotten_in_time(spark, tmp_path):
    """Ten hours after its last row a key is new again; before, it isn't."""
    times = [0, 5, 14, 40, 41, 90]
    rows = [(i, T0 + timedelta(hours=h), "a", i) for i, h in enumerate(times)]
    df = spark.createDataFrame(rows, KINDS)

    def run():
        first = seen.first_in_stream(stream(spark, tmp_path, df.schema), F.col("key"), "id", "ts", "1 hour", "10 hours")
        first.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()

    with keyed_state(spark):
        windows.replayed(df, F.col("batch"), f"{tmp_path}/in", run)
    ids = {r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert ids == {0, 3, 5}


def test_late_rows_and_closed_windows(spark, tmp_path):
    rng = random.Random(7)
    rows = rows_of(rng, 150, 3) + [(900, None, "a", 1)]
    df = spark.createDataFrame(rows, KINDS).repartition(2)

    def run():
        windows.split_late(spark, f"{tmp_path}/in", df.schema, "ts", "10 hours", f"{tmp_path}/split", f"{tmp_path}/c1").awaitTermination()
        windows.window_stream(spark, f"{tmp_path}/split", df.schema, "ts", "10 hours", [F.count("*").alias("n")], ["key"], f"{tmp_path}/out", f"{tmp_path}/c2", size="2 hours").awaitTermination()

    windows.replayed(df.where("batch <= 2"), F.col("batch"), f"{tmp_path}/in", run)
    newest, late = None, set()
    for b in range(3):
        late |= {r[0] for r in rows if r[3] == b and (r[1] is None or (newest and r[1] < newest - timedelta(hours=10)))}
        newest = max([r[1] for r in rows if r[3] == b and r[1]] + [newest or T0])
    assert late and {r["id"] for r in windows.late_rows(spark, f"{tmp_path}/split", df.schema).collect()} == late
    expected = windows.windowed(spark.createDataFrame([r for r in rows if r[0] not in late], KINDS), "ts", [F.count("*").alias("n")], ["key"], size="2 hours")
    expected = {tuple(r) for r in expected.collect() if r["end"] <= newest - timedelta(hours=10)}
    assert expected and {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == expected


def test_windows_in_batch(spark):
    df = spark.createDataFrame([(1, T0, "a", 0), (2, T0 + timedelta(hours=1), "a", 0), (3, T0 + timedelta(hours=5), "a", 0), (4, None, "a", 0)], KINDS)
    counts = lambda **kind: sorted((r["start"], r["end"], r["n"]) for r in windows.windowed(df, "ts", [F.count("*").alias("n")], **kind).collect())
    hour = lambda h: T0 + timedelta(hours=h)
    assert counts(size="2 hours") == [(hour(0), hour(2), 2), (hour(4), hour(6), 1)]
    assert counts(gap="2 hours") == [(hour(0), hour(3), 2), (hour(5), hour(7), 1)]
    assert counts(size="2 hours", step="1 hour") == [(hour(-1), hour(1), 1), (hour(0), hour(2), 2), (hour(1), hour(3), 1), (hour(4), hour(6), 1), (hour(5), hour(7), 1)]
    for wrong in ({}, {"size": "1 hour", "gap": "1 hour"}):
        with pytest.raises(ValueError, match="size or a gap"):
            windows.windowed(df, "ts", [], **wrong)
