"""The bucketed table against plain upserts, totals and sketches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from noticeloom.operators import merge, rollups
from noticeloom.operators.stored import BucketedTable

KINDS = "k int, g string, v string, arrival int"


def files(path) -> dict[str, set[str]]:
    found: dict[str, set[str]] = {}
    for p in Path(path).glob("bucket=*/*.parquet"):
        found.setdefault(p.parent.name, set()).add(p.name)
    return found


def test_upserts_touch_few_buckets(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "a", f"old{i}", 0) for i in range(300)] + [(None, "n", "old", 0)]
    table = BucketedTable(f"{tmp_path}/t", ["k", "g"], 24)
    old = spark.createDataFrame(rows, KINDS)
    table.create(old)
    before = files(table.path)
    news = [(rng.randrange(300), "a", rng.choice([None, "new"]), n) for n in range(5)] + [(1000, "a", "new", 9), (None, "n", "again", 3), (None, "n", "first", 1)]
    new = spark.createDataFrame(news, KINDS)
    touched = table.upsert(new, arrival="arrival", coalesced=["v"])
    expected = merge.upsert(old, new, ["k", "g"], arrival="arrival", coalesced=["v"])
    plain = lambda df: sorted(map(repr, df.select("k", "g", "v").collect()))
    assert plain(table.rows(spark)) == plain(expected)
    after = files(table.path)
    changed = {b for b in before | after if before.get(b) != after.get(b)}
    assert changed == {f"bucket={b}" for b in touched} and len(changed) < 12
    table.upsert(new, arrival="arrival", coalesced=["v"])  # once more changes nothing
    assert plain(table.rows(spark)) == plain(expected)
    assert table.upsert(new.limit(0)) == []


def test_deletes_and_lookups(spark, tmp_path):
    table = BucketedTable(f"{tmp_path}/t", ["k"], 8)
    table.create(spark.range(40).selectExpr("cast(id as int) AS k", "cast(id as string) AS v"))
    gone = table.delete(spark, F.col("k") % 3 == 0)
    assert gone and sorted(r["k"] for r in table.rows(spark).collect()) == [k for k in range(40) if k % 3]
    assert sorted(r["k"] for r in table.lookup(spark, spark.createDataFrame([(1,), (3,), (99,)], "k int")).collect()) == [1]
    table.delete(spark, F.lit(True))
    assert table.rows(spark).count() == 0 and table.delete(spark, F.lit(True)) == []
    table.upsert(spark.createDataFrame([(7, "x")], "k int, v string"))
    assert [tuple(r) for r in table.rows(spark).select("k", "v").collect()] == [(7, "x")]


def test_totals_tell_nulls_from_sums(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "x", 4)], "p string, q string, v int")
    got = {tuple(r) for r in rollups.totals(df, ["p", "q"], [F.sum("v").alias("s")]).collect()}
    assert got == {("a", None, 0, 1), ("a", "x", 0, 2), (None, "x", 0, 4), ("a", None, 1, 3), (None, None, 1, 4), (None, None, 2, 1), (None, "x", 2, 6), (None, None, 3, 7)}
    rolled = {tuple(r) for r in rollups.totals(df, ["p", "q"], [F.sum("v").alias("s")], "rollup").collect()}
    assert rolled == {r for r in got if r[2] != 2}
    some = {tuple(r) for r in rollups.totals(df, ["p", "q"], [F.sum("v").alias("s")], [["q"], []]).collect()}
    assert some == {r for r in got if r[2] in (2, 3)}
    assert {tuple(r) for r in rollups.spread(df, "q", "p", ["a", "b"], F.sum("v")).collect()} == {(None, 1, None), ("x", 2, None)}


def test_merged_sketches_are_those_of_the_whole(spark):
    rng = random.Random(3)
    rows = [(datetime(2024, 1, 1) + timedelta(hours=rng.randrange(240)), rng.randrange(3000), rng.random()) for _ in range(20_000)] + [(datetime(2024, 1, 2), None, None)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, u int, v double")
    days = rollups.daily_sketches(df, "t", [], "u", "v")
    assert days.count() == 10
    one = rollups.merged_sketches(days, F.lit(1), [], [0.1, 0.9]).collect()
    users = len({u for _, u, _ in rows if u is not None})
    assert len(one) == 1 and one[0]["rows"] == 20_001 and abs(one[0]["distinct"] - users) < 5 * 1.04 / 64 * users
    assert all(abs(x - q) < 0.03 for x, q in zip(one[0]["quantiles"], [0.1, 0.9], strict=True))
    whole = rollups.merged_sketches(rollups.daily_sketches(df.withColumn("t", F.lit(datetime(2024, 1, 1))), "t", [], "u", "v"), F.lit(1), [], [0.5]).collect()
    assert whole[0]["distinct"] == one[0]["distinct"]
