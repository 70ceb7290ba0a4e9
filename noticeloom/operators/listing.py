"""Lists, searches, pages, feeds, alerts and favourites over the public view."""

from __future__ import annotations

import base64
import json
import math
import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.functions import values as V
from noticeloom.functions.dates import seoul_date, status
from noticeloom.functions.text import http_url, sanitize
from noticeloom.operators.classify import audience, source_code

# Columns of the notices.
SEARCHED = ["title", "organization", "target", "support_type", "summary"]
LIST_COLUMNS = ["id", "source_id", "title", "organization", "category_ids", "region", "target", "support_type", "summary", "apply_start", "apply_end", "detail_url", "status", "created_at"]
DISPLAYED = ["title", "organization", "region", "target", "support_type", "summary"]


@dataclass
class ListParams:
    q: str | None = None
    status: str = "open"
    audience: str | None = None
    category_ids: list[int] = field(default_factory=list)
    category: int | None = None
    region: str | None = None
    recommendation_region: tuple[str, bool] | None = None  # label, with nationwide ones
    sort: str = "latest"
    page: float = 1
    size: float = 10


def positive(value, default: int) -> int:
    """At least 1, rounded down; no finite number is the default."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        return default
    return max(1, math.floor(value))


def search_pattern(q: str | None) -> str | None:
    """For ILIKE: what separates filters becomes a space, ``_`` stays a wildcard; blank is no search."""
    cleaned = re.sub(r"[,%()]", " ", (q or "").strip())
    return f"%{cleaned}%" if cleaned else None


def filtered(view: DataFrame, p: ListParams, audiences: dict[str, list[str]] = V.AUDIENCES) -> DataFrame:
    if p.status != "all":
        view = view.where(F.col("status") == p.status)
    if pattern := search_pattern(p.q):
        hits = F.lit(False)
        for c in SEARCHED:
            hits = hits | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
        view = view.where(hits)
    if p.audience and p.audience != "all":
        view = view.where(audience([F.col(c) for c in SEARCHED], audiences[p.audience]))
    if p.category_ids:
        view = view.where(F.arrays_overlap("category_ids", F.array(*map(F.lit, p.category_ids))))
    elif p.category:
        view = view.where(F.array_contains("category_ids", p.category))
    if p.recommendation_region:
        label, nationwide = p.recommendation_region
        own = F.col("region") == label
        view = view.where(own | (F.col("region") == V.NATIONWIDE) | F.col("region").isNull() if nationwide else own)
    elif p.region and p.region != V.NATIONWIDE:
        view = view.where(F.col("region").isin(p.region, V.NATIONWIDE))
    return view


def list_order(sort: str) -> list[tuple[str, bool]]:
    """Columns and whether they rise; nulls come last in deadlines."""
    return [("apply_end", True), ("id", True)] if sort == "deadline" else [("created_at", False), ("id", False)]


def ordered(view: DataFrame, sort: str, backward: bool = False) -> DataFrame:
    def one(c: str, rises: bool) -> Column:
        if rises != backward:
            return F.asc_nulls_last(c) if rises else F.asc_nulls_first(c)
        return F.desc_nulls_last(c) if not rises else F.desc_nulls_first(c)

    return view.orderBy(*[one(c, rises) for c, rises in list_order(sort)])


def page_count(total: int, size: int) -> int:
    return max(1, -(-total // size))


def list_page(view: DataFrame, p: ListParams, *, largest: int = 100, default: int = 10, display: bool = True) -> DataFrame:
    """One page of the list; beyond the last page it is the last. Counting is an action of its own and runs only for
    pages after the first; it reads what the filters need and no column of the list, and the page is then a top-k of the same
    view, so nothing is written for a few rows. (Who asks for many pages of one view writes the view first.) A page of the
    second half is taken from the other end, so the last page costs what the first does; a deep one in the middle holds as many
    rows as stand before it or after it (``keyset_page`` is the way through a long feed)."""
    size, page = min(largest, positive(p.size, default)), positive(p.page, 1)
    rows = filtered(view, p)
    before, count, backward = (page - 1) * size, size, False
    if page > 1:
        total = rows.count()
        before = (min(page, page_count(total, size)) - 1) * size
        count = max(0, min(size, total - before))
        backward = 2 * before > total
    if backward:
        found = ordered(ordered(rows, p.sort, backward=True).offset(total - before - count).limit(count), p.sort)
    else:
        found = ordered(rows, p.sort).offset(before).limit(count)
    found = found.select(*LIST_COLUMNS)
    return found.withColumns({c: sanitize(F.col(c)) for c in DISPLAYED}) if display else found


def get_notice(notices: DataFrame, id_: int, today: Column) -> DataFrame:
    """The notice of an id from the base table, hidden ones included, with its status; no row if there is none."""
    return notices.where(F.col("id") == id_).withColumn("status", status(F.col("apply_end"), today))


def list_totals(view: DataFrame, p: ListParams, size: int) -> DataFrame:
    return filtered(view, p).agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def public_items(rows: DataFrame, origin: str) -> DataFrame:
    return rows.select(
        "id", source_code(F.col("source_id")).alias("source"), "title", F.col("organization").alias("agency"), "category_ids", "region", "target", "support_type",
        F.lit("open").alias("status"), "apply_start", "apply_end", "created_at",
        F.concat(F.lit(f"{origin}/app/announcements/"), F.col("id").cast("string")).alias("detail_url"), F.col("detail_url").alias("original_url"),
    )


# -- keyset feeds ------------------------------------------------------------------------------------------------------


def after_cursor(df: DataFrame, time: str, id_: str, cursor: tuple | None) -> DataFrame:
    """What comes after (time, id) in descending order."""
    if cursor is None:
        return df
    at = F.lit(cursor[0]).cast(df.schema[time].dataType)
    return df.where((F.col(time) < at) | ((F.col(time) == at) & (F.col(id_) < cursor[1])))


def keyset_page(df: DataFrame, time: str, id_: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """``limit`` rows and one more, which tells that there are more."""
    return after_cursor(df, time, id_, cursor).orderBy(F.desc(time), F.desc(id_)).limit(limit + 1)


def encode_cursor(time: datetime, id_: int) -> str:
    stamp = time.isoformat(timespec="microseconds") + "Z"
    return base64.urlsafe_b64encode(json.dumps({"version": 1, "createdAt": stamp, "id": id_}, separators=(",", ":")).encode()).rstrip(b"=").decode()


def decode_cursor(value: str) -> tuple[str, int] | None:
    """Time and id, or None if it is no cursor."""
    try:
        found = json.loads(base64.urlsafe_b64decode(value + "=" * (-len(value) % 4)))
        time, id_ = datetime.fromisoformat(found["createdAt"]), found["id"]
    except (ValueError, KeyError, TypeError):
        return None
    if found.get("version") != 1 or type(id_) is not int or not 0 < id_ < 2**53 or time.tzinfo is None:
        return None
    return time.astimezone(timezone.utc).replace(tzinfo=None).isoformat(sep=" "), id_


def cursor_column(time: Column, id_: Column) -> Column:
    """The cursor of a row, as URL-safe base64 without padding."""
    text = F.concat(F.lit('{"version":1,"createdAt":"'), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z","id":'), id_.cast("string"), F.lit("}"))
    return F.rtrim(F.translate(F.regexp_replace(F.base64(text.cast("binary")), "[\r\n]", ""), "+/", "-_"), F.lit("="))


@dataclass
class FeedParams:
    since: str | None = None
    deadline_within_days: int = 7
    limit: int = 100
    cursor: tuple | None = None


class InvalidParam(ValueError):
    pass


STAMP = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?(?:Z|[+-]\d{2}:\d{2})")


def parse_feed_params(params: dict[str, str]) -> FeedParams:
    """Checked parameters; a deadline window over 30 is an error, a limit over 100 becomes 100."""

    def whole(name: str, default: int, most: int, clamp: bool) -> int:
        value = params.get(name) or ""
        if not value:
            return default
        if not re.fullmatch("[0-9]+", value) or not 1 <= int(value) < 2**53 or (not clamp and int(value) > most):
            raise InvalidParam(name)
        return min(int(value), most)

    since = (params.get("since") or "").strip() or None
    if since:
        try:
            if not STAMP.fullmatch(since):
                raise ValueError
            since = datetime.fromisoformat(since).astimezone(timezone.utc).replace(tzinfo=None).isoformat(sep=" ", timespec="milliseconds")
        except ValueError:
            raise InvalidParam("since") from None
    cursor = (params.get("cursor") or "").strip() or None
    if cursor and decode_cursor(cursor) is None:
        raise InvalidParam("cursor")
    return FeedParams(since, whole("deadlineWithinDays", 7, 30, False), whole("limit", 100, 100, True), decode_cursor(cursor) if cursor else None)


def checked_requests(asked: DataFrame) -> DataFrame:
    """:func:`parse_feed_params` of many requests (since, deadlineWithinDays, limit as texts, and further columns): ``error``
    names the first parameter that is wrong, and then the three are null."""

    def whole(name: str, default: int, most: int, clamp: bool) -> tuple[Column, Column]:
        given = F.nullif(F.col(name), F.lit(""))
        number = F.when(given.rlike("^[0-9]+$"), given.try_cast("decimal(38,0)"))
        bad = given.isNotNull() & ~F.coalesce(number.between(1, 2**53 - 1 if clamp else most), F.lit(False))
        return bad, F.when(number.isNotNull(), F.least(number, F.lit(most))).otherwise(F.lit(default)).cast("int")

    told = F.nullif(F.trim("since"), F.lit(""))
    # Read as a time of UTC, so that neither the session's zone nor a zone of the text but its offset counts.
    local = F.try_to_timestamp(F.concat(F.regexp_extract(told, r"^(.{19}(?:\.\d{1,3})?)", 1), F.lit("Z"))).isNotNull()
    time = F.regexp_extract(told, r"^(.{19}(?:\.\d{1,3})?)", 1).try_cast("timestamp_ntz")
    offset = F.regexp_extract(told, r"([+-])(\d{2}):(\d{2})$", 0)
    minutes = F.when(offset == "", 0).otherwise((F.substr(offset, F.lit(2), F.lit(2)).cast("int") * 60 + F.substr(offset, F.lit(5), F.lit(2)).cast("int")) * F.when(offset.startswith("-"), -1).otherwise(1))
    wrong = told.isNotNull() & ~F.coalesce(told.rlike(f"^(?:{STAMP.pattern})$") & local & time.isNotNull(), F.lit(False))
    bad_within, within = whole("deadlineWithinDays", 7, 30, False)
    bad_limit, limit = whole("limit", 100, 100, True)
    error = F.when(wrong, "since").when(bad_within, "deadlineWithinDays").when(bad_limit, "limit")
    checked = asked.withColumns({"error": error, "_since": F.timestamp_add("MINUTE", -minutes, time), "_within": within, "_limit": limit})
    good = F.col("error").isNull()
    kept = [c for c in asked.columns if c not in ("since", "deadlineWithinDays", "limit")]
    return checked.select(*kept, "error", *[F.when(good, F.col(f"_{c}")).alias(name) for c, name in (("since", "since"), ("within", "deadlineWithinDays"), ("limit", "limit"))])


def positive_number(c: Column, default: int) -> Column:
    """:func:`positive` of a column."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(finite, F.greatest(F.lit(1).cast("long"), F.floor(c))).otherwise(F.lit(default).cast("long"))


def parse_open_params(params: dict[str, str]) -> ListParams:
    """Checked parameters of the open list."""

    def whole(name: str, default: int) -> int:
        value = params.get(name) or ""
        if value and (not re.fullmatch("[0-9]+", value) or not 1 <= int(value) < 2**53):
            raise InvalidParam(name)
        return int(value) if value else default

    page, limit = whole("page", 1), min(100, whole("limit", 50))
    categories = params.get("categories") or ""
    if categories and not re.fullmatch(r"[1-9](?:,[1-9])*", categories):
        raise InvalidParam("categories")
    region = (params.get("user_region") or "").strip().lower()
    everywhere = region in ("", "nationwide", V.NATIONWIDE)
    if not everywhere and region not in V.REGION_CODES:
        raise InvalidParam("user_region")
    nationwide = params.get("include_nationwide") or "true"
    if nationwide not in ("true", "false"):
        raise InvalidParam("include_nationwide")
    return ListParams(
        status="open", sort="deadline" if params.get("sort") == "deadline" else "latest", page=page, size=limit,
        category_ids=sorted({int(c) for c in categories.split(",")}) if categories else [],
        recommendation_region=None if everywhere else (V.REGION_CODES[region], nationwide == "true"),
    )


def notification_feed(view: DataFrame, p: FeedParams, now: Column) -> DataFrame:
    """Open notices that are new since a time or end within days of today in Seoul, newest first, one more than the limit.
    ``notification_types`` tells why."""
    today = seoul_date(now)
    new = F.col("created_at") > F.lit(p.since).cast("timestamp_ntz") if p.since else F.lit(False)
    due = F.coalesce(F.col("apply_end").between(today, F.date_add(today, p.deadline_within_days)), F.lit(False))
    types = F.array_compact(F.array(F.when(new, F.lit("new")), F.when(due, F.lit("deadline"))))
    rows = view.where((F.col("status") == "open") & (new | due))
    ids = F.array_sort(F.array_distinct(F.filter(F.coalesce("category_ids", F.array().cast("array<int>")), lambda x: x.between(1, 9))))
    return keyset_page(rows, "created_at", "id", p.limit, p.cursor).select(
        "id", source_code(F.col("source_id")).alias("source"), "source_key", "title", F.col("organization").alias("agency"), ids.alias("category_ids"), "region",
        "target", "support_type", "status", "apply_start", "apply_end", "created_at", "updated_at", http_url(F.col("detail_url")).alias("original_url"), types.alias("notification_types"),
    )


# -- alerts and favourites --------------------------------------------------------------------------------------------


def alert_list(alerts: DataFrame, view: DataFrame) -> DataFrame:
    """An installation's alerts with their notices, latest alert first."""
    joined = view.join(alerts.select(F.col("announcement_id").alias("id"), F.col("created_at").alias("alert_created_at")), "id")
    return joined.orderBy(F.desc("alert_created_at"), F.desc("id"))


def add_alerts(alerts: DataFrame, wanted: DataFrame, view: DataFrame) -> DataFrame:
    """Adds what isn't there yet, of notices that are public."""
    public = wanted.join(view.select(F.col("id").alias("announcement_id")), "announcement_id", "left_semi")
    return alerts.unionByName(public.select(*alerts.columns).join(alerts, ["installation_id", "announcement_id"], "left_anti"))


def remove_alerts(alerts: DataFrame, unwanted: DataFrame) -> DataFrame:
    return alerts.join(unwanted, ["installation_id", "announcement_id"], "left_anti")


def sort_favorites(favorites: DataFrame, sort: str) -> DataFrame:
    latest = [F.desc("favorited_at"), F.desc("id")]
    end = F.when(F.col("apply_end").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("apply_end"))
    return favorites.orderBy(*([end.asc_nulls_last()] if sort == "deadline" else []), *latest)


def favorites_or_none(favorites: DataFrame, url_prefix: str) -> DataFrame:
    """All favourites, or none if one of them is broken (no positive id, blank title, or an address not of the site)."""
    good = (F.col("id") > 0) & (F.col("id") < 2**53) & (F.length(F.trim("title")) > 0) & (F.col("detail_url") == F.concat(F.lit(url_prefix), F.col("id").cast("string")))
    broken = F.sum(F.when(F.coalesce(good, F.lit(False)), 0).otherwise(1)).over(Window.partitionBy("owner"))
    return favorites.withColumn("_broken", broken).where("_broken = 0").drop("_broken")


# -- dates on cards --------------------------------------------------------------------------------------------------


def card_dates(start: Column, end: Column, today: Column) -> Column:
    """Labels of reception and deadline."""
    days = F.datediff(end, today)
    reception = F.when(start.isNull() | F.coalesce(end < today, F.lit(False)), F.lit(None)).when(today < start, F.concat(F.lit(V.STARTS_ON), F.date_format(start, "yyyy-MM-dd"))).otherwise(F.lit(V.RECEIVING))
    deadline = F.when(end.isNull(), F.lit(V.NO_DEADLINE)).when(days < 0, F.lit(V.CLOSED)).when(days == 0, F.lit(V.CLOSES_TODAY)).otherwise(F.concat(F.lit(V.CLOSES_IN), days.cast("string")))
    return F.struct(reception.alias("reception_label"), deadline.alias("deadline_label"), (end.isNotNull() & (days <= 7)).alias("urgent"))


def apply_period(start: Column, end: Column) -> Column:
    day = lambda c, default: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(default))
    return F.when(start.isNull() & end.isNull(), F.lit(V.NO_DEADLINE)).otherwise(F.concat(day(start, ""), F.lit(" ~ "), day(end, "")))
