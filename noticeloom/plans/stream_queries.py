"""Streams over the event log and the notices, replayed in batches with a restart after each, and the SQL of what must come out."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from noticeloom.functions.scratch import scratch_folder
from noticeloom.functions.text import view_title
from noticeloom.plans.bridge import NOTICES, notices, table
from noticeloom.plans.register import query
from noticeloom.streaming import seen, windows

DELAY = "2 days"
#: Six days a batch; a tenth of the events come a batch late.
ARRIVED = f"""WITH arrived AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 6 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS batch FROM events),
newest AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM arrived GROUP BY batch),
judged AS (SELECT a.*, coalesce(ts < mark - INTERVAL {DELAY.split()[0]} DAY, false) AS late FROM arrived a JOIN newest USING (batch)),
clock AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {DELAY.split()[0]} DAY AS passed FROM judged) """


def arrived(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    batch = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 6) + (F.col("event_id") % 10 == 0).cast("int")
    return events, batch


def streamed(spark, sf_dir, keys, **kind):
    """Closed windows and the folder of the rows, after all batches."""
    at = scratch_folder(spark, "event-windows")
    events, batch = arrived(spark, sf_dir)

    def run() -> None:
        windows.split_late(spark, f"{at}/in", events.schema, "ts", DELAY, f"{at}/split", f"{at}/check-split").awaitTermination()
        if kind:
            windows.window_stream(spark, f"{at}/split", events.schema, "ts", DELAY, [F.count("*").alias("events")], keys, f"{at}/out", f"{at}/check-out", **kind).awaitTermination()

    windows.replayed(events, batch, f"{at}/in", run)
    return at, events.schema


@query(ARRIVED + "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS events FROM judged, clock WHERE NOT late AND time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= passed GROUP BY ALL")
def events_tumbling_stream(spark, sf_dir):
    """Events by type and six hours, of the windows that have closed."""
    at, _ = streamed(spark, sf_dir, ["event_type"], size="6 hours")
    return spark.read.parquet(f"{at}/out")


@query(
    ARRIVED
    + """, gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS opens FROM judged WHERE NOT late),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM gaps)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 8 HOUR AS "end", count(*) AS events FROM numbered, clock GROUP BY user_id, session, passed HAVING max(ts) + INTERVAL 8 HOUR <= passed"""
)
def events_session_stream(spark, sf_dir):
    """Sessions of each user, which end after eight hours without an event."""
    at, _ = streamed(spark, sf_dir, ["user_id"], gap="8 hours")
    return spark.read.parquet(f"{at}/out")


@query(ARRIVED + "SELECT event_id, ts, user_id, event_type, CAST(batch AS INTEGER) AS batch FROM judged WHERE late")
def events_late_stream(spark, sf_dir):
    """Events that came later than the rule allows, and with which batch."""
    at, schema = streamed(spark, sf_dir, [])
    return windows.late_rows(spark, f"{at}/split", schema)


@query("""SELECT event_type, start, start + INTERVAL 12 HOUR AS "end", count(*) AS events FROM (SELECT event_type, unnest([time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 9 HOUR, time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 6 HOUR, time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR, time_bucket(INTERVAL 3 HOUR, ts)]) AS start FROM events) GROUP BY ALL""")
def events_sliding(spark, sf_dir):
    """Twelve hours, moved on by three, over the whole log in batch."""
    return windows.windowed(table(spark, sf_dir, "events"), "ts", [F.count("*").alias("events")], ["event_type"], size="12 hours", step="3 hours")


@contextmanager
def keyed_state(spark):
    """State of streams in the store that keyed state needs; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, seen.PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@query(NOTICES + "SELECT id, title, batch FROM (SELECT id, title, id % 5 AS batch, row_number() OVER (PARTITION BY regexp_replace(lower(title), '[^0-9a-z가-힣]', '', 'g') ORDER BY id % 5, id) AS nth FROM notices) WHERE nth = 1")
def titles_seen_stream(spark, sf_dir):
    """The first notice of each title, over five batches of a stream that is restarted after each."""
    at = scratch_folder(spark, "titles-seen")
    rows = notices(spark, sf_dir).select("id", "title", (F.col("id") % 5).alias("batch"))

    def run() -> None:
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        first = seen.first_in_stream(stream, view_title(F.col("title")), "id")
        first.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()

    with keyed_state(spark):
        windows.replayed(rows, F.col("batch"), f"{at}/in", run)
    return spark.read.parquet(f"{at}/out")


@query("""SELECT v.user_id, v.event_id AS view_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'view') v
    JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL 3 HOUR""")
def purchases_after_views_stream(spark, sf_dir):
    """Purchases within three hours of a view by the same user; views and purchases are two streams of five batches."""
    at = scratch_folder(spark, "views-purchases")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type").where("event_type in ('view', 'purchase')")

    def run() -> None:
        of = lambda kind: spark.readStream.schema(events.schema).parquet(f"{at}/in").where(F.col("event_type") == kind)
        met = seen.followed(of("view"), of("purchase"), "user_id", "ts", "3 hours", "1 day")
        found = met.select("user_id", F.col("first.event_id").alias("view_id"), F.col("second.event_id").alias("purchase_id"))
        found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()

    windows.replayed(events, F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 6), f"{at}/in", run)
    return spark.read.parquet(f"{at}/out")
