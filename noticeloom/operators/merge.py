"""Upserts, deletions, and the states of detail fetches, as functions from tables to tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.functions import values as V
from noticeloom.functions.dates import elapsed, is_open
from noticeloom.functions.scratch import written
from noticeloom.functions.text import trimmed, valid_uuid
from noticeloom.operators.dedup import first_per


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = (), arrival: str | None = None, coalesced: list[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same keys. Columns in ``keep`` stay as they were where a
    row existed; those in ``coalesced`` too where the new value is null. Of new rows with one key the last by ``arrival``
    counts. Columns that ``new`` lacks stay, or are null in new rows. Null keys equal null keys."""
    if arrival:
        new = first_per(new, keys, [F.desc(arrival)]).drop(arrival)
    same = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    rows = old.select(F.struct(*old.columns).alias("o")).join(new.select(F.struct(*new.columns).alias("n")), same, "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"o.{c}", f"n.{c}")
        if c not in new.columns:
            return F.col(f"o.{c}")
        if c in keep:
            return F.coalesce(F.when(F.col("o").isNotNull(), F.col(f"o.{c}")), F.col(f"n.{c}"))
        if c in coalesced:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        return F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return rows.select(*[value(c).alias(c) for c in old.columns])


def numbered(ordered: DataFrame, name: str, start: int = 0) -> DataFrame:
    """``ordered`` with ``place``, the rows' places in its order from ``start + 1`` on. The table is written once, with a
    number that tells partition and place within, so that counts and rows are of one and the same partitioning; a row's
    place is its partition's start and its place within. One row per partition meets in one task."""
    row = F.monotonically_increasing_id()
    marked = written(ordered.withColumn("part", F.shiftright(row, 33)).withColumn("within", row.bitwiseAND(F.lit((1 << 33) - 1))), name)
    starts = marked.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("part", (F.coalesce(before, F.lit(0)) + start).alias("start"))
    return marked.join(starts, "part").withColumn("place", F.col("start") + F.col("within") + 1).drop("part", "within", "start")


def with_new_ids(df: DataFrame, id_col: str, largest: int) -> DataFrame:
    """Rows without an id get the next ones after ``largest``, in no particular order and without a sort or shuffle."""
    new = numbered(df.where(F.col(id_col).isNull()), "new-ids", largest)
    return df.where(F.col(id_col).isNotNull()).unionByName(new.withColumn(id_col, F.col("place").cast("long")).select(*df.columns))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert, and do nothing where the key is there."""
    return old.unionByName(new.select(*old.columns).join(old, keys, "left_anti"))


def purge_expired(notices: DataFrame, cutoff: Column) -> DataFrame:
    """Without what ended before the cutoff; what has no end stays."""
    return notices.where(F.col("apply_end").isNull() | (F.col("apply_end") >= cutoff))


def purge_orphans(alerts: DataFrame, notices: DataFrame, alert_key: str, key: str) -> DataFrame:
    """Alerts go with their notices."""
    return alerts.join(notices.select(F.col(key).alias(alert_key)), alert_key, "left_semi")


def update_source(sources: DataFrame, counters: DataFrame, now: Column) -> DataFrame:
    """The time of the last run, for sources without error or failed row. counters: code, failed, error."""
    done = counters.where((F.col("failed") == 0) & F.col("error").isNull()).select("code", F.lit(True).alias("_done"))
    return sources.join(done, "code", "left").withColumn("last_fetched_at", F.when(F.col("_done"), now).otherwise(F.col("last_fetched_at"))).drop("_done")


def update_regions(notices: DataFrame, regions: DataFrame) -> DataFrame:
    """New regions by id (id, new_region), with fingerprints of all other columns before and after, which must agree."""
    others = [c for c in notices.columns if c != "region"]
    print_ = F.sha2(F.to_json(F.struct(*others)), 256)
    before = notices.withColumn("before", print_)
    after = before.join(regions, "id", "left").withColumn("region", F.coalesce("new_region", "region")).drop("new_region")
    return after.withColumn("after", print_)


# -- details of notices --------------------------------------------------------------------------------------------


FINAL_EMPTY = f"{V.EMPTY_SHELL}:{V.FINAL_ATTEMPT}"


def needs_detail(detail_url: Column, apply_end: Column, payload_hash: Column, stored_hash: Column, fetched_at: Column, error: Column, attempted_at: Column, today: Column, now: Column) -> Column:
    """Whether to fetch a notice's page: if it has one, and was never fetched, or its payload changed; after two empty
    pages only a day later, and if it is still open."""
    return (
        F.when(detail_url.isNull() | (detail_url == ""), F.lit(False))
        .when(fetched_at.isNotNull(), ~payload_hash.eqNullSafe(stored_hash))
        .when(error.eqNullSafe(F.lit(FINAL_EMPTY)), is_open(apply_end, today) & elapsed(attempted_at, now, V.RETRY_HOURS))
        .otherwise(F.lit(True))
    )


def within_budget(eligible: DataFrame, source: str, order: list[Column], budget: int = V.DETAIL_BUDGET) -> DataFrame:
    """The first few per source."""
    budget = max(0, min(V.MAX_DETAIL_BUDGET, budget))
    place = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return eligible.withColumn("_place", place).where(F.col("_place") <= budget).drop("_place")


def next_error(reason: Column, previous: Column) -> Column:
    """What a failed fetch leaves: an empty page counts its attempts up to two (an old-style mark is one)."""
    counted = F.try_to_number(F.nullif(F.regexp_extract(previous, rf"^{V.EMPTY_SHELL}:(\d+)$", 1), F.lit("")), F.lit("999999")).cast("int")
    before = F.coalesce(F.when(counted > 0, F.least(counted, F.lit(V.FINAL_ATTEMPT))), F.when(previous == V.LEGACY_EMPTY, F.lit(1)), F.lit(0))
    attempt = F.concat(F.lit(f"{V.EMPTY_SHELL}:"), F.least(before + 1, F.lit(V.FINAL_ATTEMPT)).cast("string"))
    return F.substring(F.when(reason == V.EMPTY_SHELL, attempt).otherwise(reason), 1, 200)


def with_states(prepared: DataFrame, stored: DataFrame) -> DataFrame:
    """Prepared rows (source_id, source_key, ...) with the stored state of their detail fetch; new ones have none."""
    state = ["detail_source_hash", "detail_fetched_at", "detail_fetch_status", "detail_fetch_error", "detail_fetch_attempted_at"]
    known = stored.select("source_id", "source_key", *state)
    return prepared.drop(*state).join(known, ["source_id", "source_key"], "left")


def to_fetch(prepared: DataFrame, stored: DataFrame, payload_hash: Column, today: Column, now: Column) -> DataFrame:
    """Prepared rows whose page is to be fetched, by the stored states (``needed``)."""
    c = F.col
    rows = with_states(prepared, stored).withColumn("payload_hash", payload_hash)
    needed = needs_detail(c("detail_url"), c("apply_end"), c("payload_hash"), c("detail_source_hash"), c("detail_fetched_at"), c("detail_fetch_error"), c("detail_fetch_attempted_at"), today, now)
    return rows.withColumn("needed", needed)


def apply_details(notices: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Fetch results (source_id, source_key, ok, reason, region and the detail columns) into the notices. Success writes
    all detail columns and, if given, the region; failure only state and reason."""
    detail = ["detail_content", "apply_method", "documents", "contact", "attachments", "detail_content_hash", "detail_source_hash"]
    rows = notices.join(results.select(F.struct(*results.columns).alias("r"), "source_id", "source_key"), ["source_id", "source_key"], "left")
    ok, tried = F.coalesce(F.col("r.ok"), F.lit(False)), F.col("r").isNotNull()
    changed = {c: F.when(ok, F.col(f"r.{c}")).otherwise(F.col(c)) for c in detail if c in results.columns}
    changed |= {
        "region": F.when(ok, F.coalesce("r.region", "region")).otherwise(F.col("region")),
        "detail_fetched_at": F.when(ok, now).otherwise(F.col("detail_fetched_at")),
        "detail_fetch_attempted_at": F.when(tried, now).otherwise(F.col("detail_fetch_attempted_at")),
        "detail_fetch_status": F.when(ok, F.lit("success")).when(tried, F.lit("failed")).otherwise(F.col("detail_fetch_status")),
        "detail_fetch_error": F.when(ok, F.lit(None)).when(tried, next_error(F.col("r.reason"), F.col("detail_fetch_error"))).otherwise(F.col("detail_fetch_error")),
    }
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in notices.columns])


# -- logs ------------------------------------------------------------------------------------------------------------


def valid_events(events: DataFrame, types: list[str] = V.EVENT_TYPES) -> DataFrame:
    """Rows of the event log: announcement_id, event_type, session_id (its first 64 characters)."""
    return events.where(F.col("event_type").isin(types)).withColumn("session_id", F.substring("session_id", 1, 64))


def valid_leads(leads: DataFrame, now: Column) -> DataFrame:
    """Requests for advice with consent, a name and a phone number of 9 to 11 digits; texts are cut to their columns."""
    digits = F.regexp_replace(F.coalesce("phone", F.lit("")), "[^0-9]", "")
    named = F.trim(F.coalesce("name", F.lit("")))
    return leads.where(F.coalesce("consent", F.lit(False)) & (F.length(named) > 0) & F.length(digits).between(9, 11)).select(
        "announcement_id",
        F.substring(named, 1, 50).alias("name"),
        digits.alias("phone"),
        F.coalesce("is_business", F.lit(False)).alias("is_business"),
        F.substring("region", 1, 20).alias("region"),
        F.substring("message", 1, 1000).alias("message"),
        now.alias("consent_at"),
    )


def valid_installations(requests: DataFrame) -> DataFrame:
    """Requests with a UUID (in any case, trimmed) as ``installation_id`` and a ``token`` of a fitting length, both as they
    count."""
    id_, token = F.lower(trimmed(F.col("installation_id"))), trimmed(F.col("token"))
    made = requests.withColumns({"installation_id": id_, "token": token})
    return made.where(valid_uuid(F.col("installation_id")) & F.length("token").between(V.TOKEN_LEAST, V.TOKEN_MOST))


def register_installations(known: DataFrame, requests: DataFrame) -> DataFrame:
    """Installations by id: new ones are added; known ones take the new platform and version if the token's hash is
    right, else they stay. requests: installation_id, token, platform, app_version, arrival."""
    last = first_per(requests.withColumn("token_hash", F.sha2("token", 256)), ["installation_id"], [F.desc("arrival")])
    new = last.select("installation_id", F.struct("token_hash", "platform", "app_version").alias("n"))
    rows = known.select("installation_id", F.struct("token_hash", "platform", "app_version").alias("o")).join(new, "installation_id", "full_outer")
    takes = F.col("o").isNull() | (F.col("n").isNotNull() & (F.col("o.token_hash") == F.col("n.token_hash")))
    return rows.select("installation_id", F.when(takes, F.col("n")).otherwise(F.col("o")).alias("s")).select("installation_id", "s.*")
