"""Totals of notices and lines of orders by grouping sets, daily sketches of events, and a bucketed table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeloom.functions.scratch import scratch_folder, written
from noticeloom.operators import rollups
from noticeloom.operators.stored import BucketedTable
from noticeloom.plans.bridge import CODES, NOTICES, notices, table
from noticeloom.plans.register import query


@query(NOTICES + "SELECT source_id, region, status, CAST(grouping_id(source_id, region, status) AS INTEGER) AS level, count(*) AS notices, count(apply_end) AS with_end FROM (SELECT *, CASE WHEN id % 9 <> 0 THEN region END AS region_ FROM seen) t(id, source_id, source_key, title, organization, r0, target, support_type, summary, apply_start, apply_end, detail_url, created_at, updated_at, category_ids, content_hash, canonical, place, status, region) GROUP BY CUBE (source_id, region, status)")
def notice_cube(spark, sf_dir):
    """Notices by source, region (some have none) and status, with all totals."""
    from noticeloom.plans.registry import view

    rows = view(spark, sf_dir).withColumn("region", F.when(F.col("id") % 9 != 0, F.col("region")))
    return rollups.totals(rows, ["source_id", "region", "status"], [F.count("*").alias("notices"), F.count("apply_end").alias("with_end")])


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, CAST(grouping_id(l_returnflag, l_linestatus, l_linenumber) AS INTEGER) AS level, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS lines
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), (l_returnflag, l_linenumber), ())""")
def lineitem_sets(spark, sf_dir):
    sets = [["l_returnflag", "l_linestatus"], ["l_linenumber"], ["l_returnflag", "l_linenumber"], []]
    aggregates = [F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count("*").alias("lines")]
    return rollups.totals(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], aggregates, sets)


@query("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(grouping_id(year(o_orderdate), month(o_orderdate)) AS INTEGER) AS level, count(*) AS orders FROM orders GROUP BY ROLLUP (year(o_orderdate), month(o_orderdate))")
def order_rollup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"))
    return rollups.totals(orders, ["y", "m"], [F.count("*").alias("orders")], "rollup")


@query(NOTICES + "SELECT organization, " + ", ".join(f"nullif(count(*) FILTER (region = '{c}'), 0) AS {c}" for c in CODES.values()) + " FROM notices GROUP BY organization")
def notices_spread(spark, sf_dir):
    """Notices of each organization, a column a region."""
    return rollups.spread(notices(spark, sf_dir), "organization", "region", list(CODES.values()), F.count(F.lit(1)))


@query("""WITH spans AS (SELECT event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS span, user_id, value FROM events)
    SELECT event_type, span, count(*) AS rows, count(DISTINCT user_id) AS users, true AS distinct_near, true AS median_near FROM spans GROUP BY ALL""")
def weekly_sketches(spark, sf_dir):
    """Weeks merged from stored days: the estimates of distinct users (within five standard errors) and of the median's rank (within three
    hundredths) beside exact counts."""
    events = table(spark, sf_dir, "events")
    week = lambda day: F.floor(F.datediff(day, F.lit("2024-01-01").cast("date")) / 7)
    days = written(rollups.daily_sketches(events, "ts", ["event_type"], "user_id", "value"), "daily-sketches")
    merged = rollups.merged_sketches(days, week(F.col("day")), ["event_type"], [0.5])
    exact = events.withColumn("span", week(F.to_date("ts"))).join(merged.select("event_type", "span", F.get("quantiles", F.lit(0)).alias("median")), ["event_type", "span"])
    exact = exact.groupBy("event_type", "span").agg(F.countDistinct("user_id").alias("users"), F.avg((F.col("value") <= F.col("median")).cast("double")).alias("at_most"), F.avg((F.col("value") < F.col("median")).cast("double")).alias("below"))
    near = F.abs(F.col("distinct") - F.col("users")) <= F.greatest(F.lit(1), 5 * 1.04 / 64 * F.col("users"))
    ranked = (F.col("at_most") >= 0.47) & (F.col("below") <= 0.53)
    return merged.join(exact, ["event_type", "span"]).select("event_type", "span", "rows", "users", near.alias("distinct_near"), ranked.alias("median_near"))


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 3 <> 0),
    n AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE 'U' END AS o_orderstatus, round(o_totalprice, 2) + 1 AS price FROM orders WHERE o_custkey = 1 OR o_orderkey % 100 = 0)
    SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_custkey, o.o_custkey) AS o_custkey, CASE WHEN n.o_orderkey IS NULL THEN o.o_orderstatus ELSE coalesce(n.o_orderstatus, o.o_orderstatus) END AS o_orderstatus,
      CASE WHEN n.o_orderkey IS NULL THEN o.price ELSE n.price END AS price FROM o FULL JOIN n USING (o_orderkey) WHERE coalesce(n.o_custkey, o.o_custkey) <> 7"""
)
def bucketed_upsert(spark, sf_dir):
    """Few new rows into a table of thirty-two buckets, and then one customer's rows out of it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    stored = BucketedTable(scratch_folder(spark, "bucketed"), ["o_orderkey"], 32)
    stored.create(orders.where("o_orderkey % 3 <> 0"))
    new = orders.where("o_custkey = 1 OR o_orderkey % 100 = 0").withColumns({"price": F.col("price") + 1, "o_orderstatus": F.when(F.col("o_custkey") % 2 != 0, F.lit("U"))})
    stored.upsert(new, coalesced=["o_orderstatus"])
    stored.delete(spark, F.col("o_custkey") == 7)
    return stored.rows(spark)
