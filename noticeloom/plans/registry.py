"""All registered queries over the given tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import dates, text
from noticeloom.functions import values as V
from noticeloom.operators import classify, dedup, lines, listing, merge, page_rules, recommend, region, reports
from noticeloom.operators.listing import FeedParams, ListParams
from noticeloom.plans import bridge
from noticeloom.plans.bridge import NOTICES, TODAY, notices, now, table, today
from noticeloom.plans.register import QUERIES, SQL, query
from noticeloom.sources import adapters, payloads

def joined(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",")


def view(spark, sf_dir) -> DataFrame:
    return dedup.public_view(notices(spark, sf_dir), today())


# -- the public view and its lists -----------------------------------------------------------------------------------


@query(NOTICES + "SELECT id, source_id, title, content_hash, status, apply_end, created_at FROM seen")
def public_view(spark, sf_dir):
    return view(spark, sf_dir).select("id", "source_id", "title", "content_hash", "status", "apply_end", "created_at")


LISTED = ["id", "source_id", "title", "status", "apply_end", "created_at"]
LIST_SQL = NOTICES + "SELECT id, source_id, title, status, apply_end, created_at FROM seen "


def listed(spark, sf_dir, p: ListParams, **options):
    return listing.list_page(view(spark, sf_dir), p, display=False, **options).select(*LISTED)


@query(LIST_SQL + "WHERE status = 'open' ORDER BY created_at DESC, id DESC LIMIT 10")
def list_latest(spark, sf_dir):
    return listed(spark, sf_dir, ListParams())


@query(LIST_SQL + "WHERE status = 'open' ORDER BY apply_end NULLS LAST, id LIMIT 20 OFFSET 40")
def list_deadline(spark, sf_dir):
    return listed(spark, sf_dir, ListParams(sort="deadline", page=3, size=20))


@query(
    NOTICES
    + """, n AS (SELECT (greatest(1, CAST(ceil(count(*) / 100.0) AS BIGINT))) AS pages FROM seen),
    r AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS nth FROM seen)
    SELECT id, source_id, title, status, apply_end, created_at FROM r CROSS JOIN n WHERE nth > (pages - 1) * 100"""
)
def list_page_clamped(spark, sf_dir):
    """A page far beyond the last is the last."""
    return listed(spark, sf_dir, ListParams(status="all", page=10**9, size=1000))


@query(NOTICES + "SELECT CAST(count(*) AS BIGINT) AS total, greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS pages FROM seen WHERE status = 'open'")
def list_totals(spark, sf_dir):
    return listing.list_totals(view(spark, sf_dir), ListParams(), 50)


@query(
    NOTICES
    + f"""SELECT id, CASE source_id {" ".join(f"WHEN {i} THEN '{c}'" for i, c, _ in V.SOURCES)} END AS source, title, organization AS agency, list_aggregate(category_ids, 'string_agg', ',') AS categories,
    'https://site.example/app/announcements/' || id AS detail_url, detail_url AS original_url FROM seen WHERE status = 'open'"""
)
def open_items(spark, sf_dir):
    items = listing.public_items(listing.filtered(view(spark, sf_dir), ListParams()), "https://site.example")
    return items.select("id", "source", "title", "agency", F.nullif(joined("category_ids"), F.lit("")).alias("categories"), "detail_url", "original_url")


# -- filters ---------------------------------------------------------------------------------------------------------


def ids(spark, sf_dir, p: ListParams, **options):
    return listing.filtered(view(spark, sf_dir), p, **options).select("id", "status")


IDS = NOTICES + "SELECT id, status FROM seen WHERE "


@query(IDS + " OR ".join(f"coalesce({c} ILIKE '%the_tion%', false)" for c in listing.SEARCHED))
def search_ilike(spark, sf_dir):
    """Separators become spaces and are trimmed, '_' matches any character."""
    return ids(spark, sf_dir, ListParams(q=" the_tion ", status="all"))


@query(IDS + "status = 'closed' AND (" + " OR ".join(f"coalesce({c} ILIKE '% th_ %', false)" for c in listing.SEARCHED) + ")")
def search_separators(spark, sf_dir):
    """What separates filters in a request becomes a space."""
    return ids(spark, sf_dir, ListParams(q=",th_%", status="closed"))


@query(IDS + "status = 'open' AND " + bridge.any_word("concat_ws(chr(1), title, organization, target, support_type, summary)", bridge.AUDIENCES["worker"]))
def audience_filter(spark, sf_dir):
    return ids(spark, sf_dir, ListParams(audience="worker"), audiences=bridge.AUDIENCES)


@query(IDS + "list_has_any(category_ids, [3, 6])")
def category_overlap(spark, sf_dir):
    return ids(spark, sf_dir, ListParams(status="all", category_ids=[3, 6], category=1))


@query(IDS + "status = 'open' AND list_contains(category_ids, 5)")
def category_contains(spark, sf_dir):
    return ids(spark, sf_dir, ListParams(category=5))


@query(IDS + f"region IN ('fr', '{V.NATIONWIDE}')")
def region_filter(spark, sf_dir):
    return ids(spark, sf_dir, ListParams(status="all", region="fr"))


@query(IDS + f"status = 'open' AND (region = 'de' OR region = '{V.NATIONWIDE}' OR region IS NULL)")
def recommended_region_filter(spark, sf_dir):
    return ids(spark, sf_dir, ListParams(recommendation_region=("de", True)))


# -- words, hashes, titles -------------------------------------------------------------------------------------------


@query(NOTICES + "SELECT id, unnest(category_ids) AS category_id FROM notices")
def category_map(spark, sf_dir):
    return notices(spark, sf_dir).select("id", F.explode(F.col("category_ids").cast("array<int>")).alias("category_id"))


@query(NOTICES + "SELECT category_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(category_ids) AS category_id FROM notices) GROUP BY 1")
def category_counts(spark, sf_dir):
    return notices(spark, sf_dir).select(F.explode(F.col("category_ids").cast("array<int>")).alias("category_id")).groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))


@query(NOTICES + f"SELECT id, array_to_string(list_filter([{', '.join(f'CASE WHEN list_contains(category_ids, {i}) THEN {chr(39)}{n}{chr(39)} END' for i, n in enumerate(V.CATEGORY_NAMES, 1))}], lambda x: x IS NOT NULL), '|') AS names FROM notices")
def category_names(spark, sf_dir):
    return notices(spark, sf_dir).select("id", F.array_join(classify.category_names(F.col("category_ids")), "|").alias("names"))


@query(NOTICES + "SELECT id, content_hash, regexp_replace(lower(title), '[^0-9a-z가-힣]', '', 'g') AS view_title FROM notices")
def title_forms(spark, sf_dir):
    return notices(spark, sf_dir).select("id", "content_hash", text.view_title(F.col("title")).alias("view_title"))


@query(NOTICES + "SELECT id, array_to_string(regexp_extract_all(summary, '\\d+'), '|') AS digits FROM notices")
def digit_signatures(spark, sf_dir):
    return notices(spark, sf_dir).select("id", text.digit_signature(F.col("summary")).alias("digits"))


@query(
    """SELECT event_id, regexp_replace(props, '[^0-9]', '', 'g') AS digits,
    CAST(try_strptime(CASE WHEN length(regexp_replace(strftime(ts, '%Y.%m.%d ~'), '[^0-9]', '', 'g')) >= 8 THEN substr(regexp_replace(strftime(ts, '%Y.%m.%d ~'), '[^0-9]', '', 'g'), 1, 8) END, '%Y%m%d') AS DATE) AS day,
    CAST(timezone('Asia/Seoul', timezone('UTC', ts)) AS DATE) AS seoul_day FROM events"""
)
def date_forms(spark, sf_dir):
    written = F.concat(F.date_format("ts", "yyyy.MM.dd"), F.lit(" ~"))
    return table(spark, sf_dir, "events").select("event_id", F.regexp_replace("props", "[^0-9]", "").alias("digits"), dates.parse_range(written)[0].alias("day"), dates.seoul_date(F.col("ts")).alias("seoul_day"))


@query(NOTICES + "SELECT id, regexp_matches(summary, '@|[0-9]{9}') AND regexp_matches(summary, '[A-Za-z]') AS contact, list_aggregate(regexp_extract_all(summary, 'https?://[^\\s\"''<>]+'), 'string_agg', ' ') AS links FROM notices")
def text_links(spark, sf_dir):
    s = F.col("summary")
    return notices(spark, sf_dir).select("id", (s.rlike("@|[0-9]{9}") & s.rlike("[A-Za-z]")).alias("contact"), F.nullif(F.array_join(text.links(s), " "), F.lit("")).alias("links"))


# -- duplicates ------------------------------------------------------------------------------------------------------


def two_sides(spark, sf_dir):
    made = notices(spark, sf_dir).select("id", "source_id", "title", "apply_end")
    return made.where("source_id > 2"), made.where("source_id <= 2")


SIDES = NOTICES + """, keyed AS (SELECT id, source_id, apply_end, regexp_replace(lower(title), '[^0-9a-z가-힣]', '', 'g') AS c FROM notices),
l AS (SELECT * FROM keyed WHERE source_id > 2 AND length(c) >= 10), r AS (SELECT DISTINCT c, apply_end FROM keyed WHERE source_id <= 2 AND length(c) >= 10),
exact AS (SELECT id FROM l WHERE c IN (SELECT c FROM r)) """


@query(SIDES + "SELECT id, 'exact' AS how FROM exact")
def preferred_dedup_exact(spark, sf_dir):
    return dedup.exact_duplicates(*two_sides(spark, sf_dir), canonical=text.view_title)


@query(
    SIDES
    + """, p AS (SELECT l.id, l.c AS a, r.c AS b FROM l JOIN r ON array_to_string(regexp_extract_all(l.c, '\\d+'), '|') = array_to_string(regexp_extract_all(r.c, '\\d+'), '|')
      AND (l.apply_end IS NULL OR r.apply_end IS NULL OR l.apply_end = r.apply_end) AND 2 * least(length(l.c), length(r.c)) - 2 >= 0.86 * (length(l.c) + length(r.c) - 2)
      WHERE l.id NOT IN (SELECT id FROM exact)),
    t AS (SELECT DISTINCT a AS s FROM p UNION SELECT DISTINCT b FROM p),
    g AS (SELECT s, g, count(*) AS n FROM (SELECT s, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS g FROM t) GROUP BY s, g),
    o AS (SELECT x.s AS a, y.s AS b, sum(least(x.n, y.n)) AS m FROM (SELECT DISTINCT a, b FROM p) q JOIN g x ON x.s = q.a JOIN g y ON y.s = q.b AND x.g = y.g GROUP BY 1, 2)
    SELECT DISTINCT p.id, 'similar' AS how FROM p JOIN o USING (a, b) WHERE 2.0 * m / (length(a) + length(b) - 2) >= 0.86 UNION ALL SELECT id, 'exact' FROM exact"""
)
def preferred_dedup_fuzzy(spark, sf_dir):
    return dedup.preferred_duplicates(*two_sides(spark, sf_dir), canonical=text.view_title)


@query(NOTICES + "SELECT min(id) AS id, regexp_replace(lower(title), '[^0-9a-z가-힣]', '', 'g') AS canonical FROM notices GROUP BY 2")
def first_seen(spark, sf_dir):
    seen = dedup.first_seen(notices(spark, sf_dir), F.col("id"), text.view_title)
    return seen.select("id", text.view_title(F.col("title")).alias("canonical"))


@query(
    SIDES
    + f""", sim AS (SELECT id FROM exact), fresh AS (SELECT k.id, k.c, k.apply_end FROM keyed k WHERE source_id > 2 AND k.id NOT IN (SELECT id FROM sim)),
    f AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY id) AS place FROM fresh)
    SELECT id FROM f WHERE place = 1 AND (apply_end IS NULL OR apply_end >= DATE '{TODAY}' - 2)"""
)
def ingest_exact(spark, sf_dir):
    """The order of ingest: preferred sources, first arrival, then expiry; with exact repetitions only."""
    left, right = two_sides(spark, sf_dir)
    exact = dedup.exact_duplicates(left, right, canonical=text.view_title)
    seen = dedup.first_seen(left.join(exact.select("id"), "id", "left_anti"), F.col("id"), text.view_title)
    return merge.purge_expired(seen, dates.retention_cutoff(today(), V.RETENTION_DAYS)).select("id")


@query(
    NOTICES
    + """, t AS (SELECT id, substr(title, 1, 200) AS a, lead(substr(title, 1, 200)) OVER (ORDER BY id) AS b FROM notices), p AS (SELECT id, a, CASE WHEN id % 5 = 0 THEN a || ' again' ELSE b END AS b FROM t),
    g AS (SELECT id, s, g, count(*) AS n FROM (SELECT id, 'a' AS s, unnest(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS g FROM p
      UNION ALL SELECT id, 'b', unnest(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) FROM p) GROUP BY 1, 2, 3),
    o AS (SELECT x.id, CAST(sum(least(x.n, y.n)) AS BIGINT) AS m FROM g x JOIN g y ON x.id = y.id AND x.g = y.g AND x.s = 'a' AND y.s = 'b' GROUP BY 1)
    SELECT id, CASE WHEN a = b THEN 1.0::DOUBLE WHEN length(a) < 2 OR length(b) < 2 THEN 0.0::DOUBLE WHEN b IS NOT NULL THEN round(2.0::DOUBLE * coalesce(m, 0) / (length(a) + length(b) - 2), 9) END AS score FROM p LEFT JOIN o USING (id)"""
)
def dice_scores(spark, sf_dir):
    """Each title's similarity to the next one, and every fifth's to an edited form of its own."""
    from pyspark.sql import Window

    titles = notices(spark, sf_dir).select("id", F.substring("title", 1, 200).alias("a"))
    # The next by id, found in ranges of ids: the first of a range is the next one of the range before.
    part = F.floor(F.col("id") / 1000)
    following = F.lead("a").over(Window.partitionBy("part").orderBy("id"))
    parts = titles.withColumn("part", part).withColumn("b", following)
    firsts = parts.groupBy("part").agg(F.min_by("a", "id").alias("head")).withColumn("part", F.col("part") - 1)
    paired = parts.join(firsts, "part", "left").withColumn("b", F.coalesce("b", "head"))
    other = F.when(F.col("id") % 5 == 0, F.concat("a", F.lit(" again"))).otherwise(F.col("b"))
    return paired.select("id", F.round(text.dice(F.col("a"), other), 9).alias("score"))


# -- upserts and deletions -------------------------------------------------------------------------------------------


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate AS created FROM orders WHERE o_orderkey % 3 <> 0),
    n AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE 'U' END AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate AS created FROM orders WHERE o_orderkey % 2 = 0)
    SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus,
    coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice, coalesce(o.created, n.created) AS created FROM o FULL JOIN n USING (o_orderkey)"""
)
def merge_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").alias("created"))
    new = orders.where("o_orderkey % 2 = 0").withColumns({"o_totalprice": F.col("o_totalprice") + 1, "o_orderstatus": F.when(F.col("o_custkey") % 2 != 0, F.lit("U"))})
    return merge.upsert(orders.where("o_orderkey % 3 <> 0"), new, ["o_orderkey"], keep=["created"], coalesced=["o_orderstatus"])


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def merge_last_wins(spark, sf_dir):
    """Several new rows of a key: the last arrival counts."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return merge.upsert(orders.limit(0), orders.withColumn("arrival", F.col("o_orderkey")), ["o_custkey"], arrival="arrival")


@query(NOTICES + f"SELECT id, apply_end FROM notices WHERE apply_end IS NULL OR apply_end >= DATE '{TODAY}' - 2")
def purge_expired(spark, sf_dir):
    return merge.purge_expired(notices(spark, sf_dir), dates.retention_cutoff(today(), V.RETENTION_DAYS)).select("id", "apply_end")


def alerts(spark, sf_dir):
    """Each order is an alert of its customer on a notice."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("installation_id"), F.col("o_orderkey").alias("announcement_id"), F.col("o_orderdate").alias("created_at"))


ALERTS = ", alerts AS (SELECT o_custkey AS installation_id, o_orderkey AS announcement_id, o_orderdate AS created_at FROM orders) "


@query(NOTICES + ALERTS + f"SELECT a.* FROM alerts a WHERE announcement_id IN (SELECT id FROM notices WHERE apply_end IS NULL OR apply_end >= DATE '{TODAY}' - 2)")
def purge_cascade(spark, sf_dir):
    kept = merge.purge_expired(notices(spark, sf_dir), dates.retention_cutoff(today(), V.RETENTION_DAYS))
    return merge.purge_orphans(alerts(spark, sf_dir), kept, "announcement_id", "id").select("installation_id", "announcement_id", "created_at")


@query("SELECT c_custkey, c_name FROM customer")
def insert_missing(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return merge.insert_missing(customers.where("c_custkey % 2 = 0"), customers, ["c_custkey"])


@query(
    NOTICES
    + """, f AS (SELECT *, sha256('{"id":' || id || ',"source_id":' || source_id || ',"organization":"' || organization || '"' || coalesce(',"apply_end":"' || strftime(apply_end, '%Y-%m-%d') || '"', '') || '}') AS print FROM notices)
    SELECT id, CASE WHEN source_id = 1 THEN 'xx' ELSE region END AS region, print AS before, print AS after FROM f"""
)
def region_update(spark, sf_dir):
    """New regions, and fingerprints of all other columns before and after."""
    made = notices(spark, sf_dir).select("id", "source_id", "organization", "region", "apply_end")
    return merge.update_regions(made, made.where("source_id = 1").select("id", F.lit("xx").alias("new_region"))).select("id", "region", "before", "after")


# -- feeds, alerts, favourites ----------------------------------------------------------------------------------------


FEED = """WITH r AS (SELECT event_id, ts, user_id, event_type FROM events), m AS (SELECT max(ts) AS latest FROM events)
SELECT event_id, ts, user_id, event_type FROM r, m WHERE ts < latest - INTERVAL 1 HOUR OR (ts = latest - INTERVAL 1 HOUR AND event_id < 100) ORDER BY ts DESC, event_id DESC LIMIT 101"""


@query(FEED)
def feed_keyset(spark, sf_dir):
    """The page after a cursor, and one row more."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    at = events.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).cast("string")).first()[0]
    return listing.keyset_page(events, "ts", "event_id", 100, (at, 100))


@query("""SELECT event_id, rtrim(replace(replace(to_base64(encode('{"version":1,"createdAt":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","id":' || event_id || '}')), '+', '-'), '/', '_'), '=') AS "cursor" FROM events""")
def feed_cursors(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", listing.cursor_column(F.col("ts"), F.col("event_id")).alias("cursor"))


@query(
    NOTICES
    + f"""SELECT id, CASE source_id {" ".join(f"WHEN {i} THEN '{c}'" for i, c, _ in V.SOURCES)} ELSE 'unknown' END AS source, created_at, apply_end, list_aggregate(list_distinct(category_ids), 'string_agg', ',') IS NOT NULL AS has_categories,
    concat_ws(',', CASE WHEN created_at > TIMESTAMP '2026-06-20' THEN 'new' END, CASE WHEN apply_end BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 7 THEN 'deadline' END) AS types
    FROM seen WHERE status = 'open' AND (created_at > TIMESTAMP '2026-06-20' OR apply_end BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 7) ORDER BY created_at DESC, id DESC LIMIT 101"""
)
def notification_feed(spark, sf_dir):
    feed = listing.notification_feed(view(spark, sf_dir), FeedParams(since="2026-06-20 00:00:00.000"), now())
    return feed.select("id", "source", "created_at", "apply_end", (F.size("category_ids") > 0).alias("has_categories"), joined("notification_types").alias("types"))


@query(NOTICES + ALERTS + "SELECT s.id, s.title, a.installation_id, a.created_at AS alert_created_at FROM seen s JOIN alerts a ON s.id = a.announcement_id")
def alerts_join(spark, sf_dir):
    own = alerts(spark, sf_dir)
    found = listing.alert_list(own, view(spark, sf_dir).select("id", "title"))
    return found.join(own.select(F.col("announcement_id").alias("id"), "installation_id"), "id").select("id", "title", "installation_id", "alert_created_at")


@query(NOTICES + ALERTS + "SELECT installation_id, announcement_id FROM alerts WHERE announcement_id % 2 = 0 UNION ALL SELECT installation_id, announcement_id FROM alerts WHERE announcement_id % 2 <> 0 AND announcement_id IN (SELECT id FROM seen)")
def alerts_added(spark, sf_dir):
    every = alerts(spark, sf_dir).select("installation_id", "announcement_id")
    return listing.add_alerts(every.where("announcement_id % 2 = 0"), every, view(spark, sf_dir))


@query("SELECT o_custkey AS installation_id, o_orderkey AS announcement_id FROM orders WHERE o_orderstatus <> 'F'")
def alerts_removed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("installation_id"), F.col("o_orderkey").alias("announcement_id"), "o_orderstatus")
    return listing.remove_alerts(orders, orders.where("o_orderstatus = 'F'")).select("installation_id", "announcement_id")


@query(
    """SELECT o_orderkey AS id, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END NULLS LAST, o_custkey DESC, o_orderkey DESC) AS place FROM orders"""
)
def favorites_sort(spark, sf_dir):
    """All favourites in the order of deadlines, which aren't all valid; places are taken from ranges of the order."""
    orders = table(spark, sf_dir, "orders")
    end = F.when(F.col("o_orderkey") % 5 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return merge.numbered(listing.sort_favorites(orders.select(F.col("o_orderkey").alias("id"), end.alias("apply_end"), F.col("o_custkey").alias("favorited_at")), "deadline"), "favorites").select("id", "place")


# -- recommendations, dates, labels -----------------------------------------------------------------------------------


CONDITION = recommend.Condition("sole_proprietor", "french", ["startup_support", "small_business_support", "facility_digital", "?"])


@query(
    NOTICES
    + f""", m AS (SELECT *, list_sort(list_intersect(category_ids, [1, 2, 9])) AS matched, contains(lower(trim(region)), 'fr') AS here, coalesce(length(trim(target)) > 0, false) AS told,
      coalesce({bridge.any_word('target', bridge.BUSINESS)}, false) AS b, coalesce({bridge.any_word('target', bridge.WORKER)}, false) AS w FROM seen WHERE status = 'open')
    SELECT id, array_to_string(matched, ',') AS matched, NOT told AS needs_review, concat_ws('|', '{V.INTEREST_REASON}', '{V.REGION_REASON}', CASE WHEN NOT told THEN '{V.TARGET_REVIEW}' END) AS reasons
    FROM m WHERE len(matched) > 0 AND here AND (NOT told OR (b AND w) OR NOT w)"""
)
def recommendations(spark, sf_dir):
    found = recommend.recommend(view(spark, sf_dir), CONDITION, codes=bridge.CODES, business=bridge.BUSINESS, worker=bridge.WORKER)
    return found.select("id", joined("matched_category_ids").alias("matched"), "needs_review", F.array_join("reasons", "|").alias("reasons"))


@query(
    NOTICES
    + f"""SELECT id, CASE WHEN apply_start IS NULL OR apply_end < DATE '{TODAY}' THEN NULL WHEN DATE '{TODAY}' < apply_start THEN '{V.STARTS_ON}' || strftime(apply_start, '%Y-%m-%d') ELSE '{V.RECEIVING}' END AS reception,
    CASE WHEN apply_end IS NULL THEN '{V.NO_DEADLINE}' WHEN apply_end < DATE '{TODAY}' THEN '{V.CLOSED}' WHEN apply_end = DATE '{TODAY}' THEN '{V.CLOSES_TODAY}' ELSE '{V.CLOSES_IN}' || (apply_end - DATE '{TODAY}') END AS deadline,
    CASE WHEN apply_start IS NULL AND apply_end IS NULL THEN '{V.NO_DEADLINE}' ELSE coalesce(strftime(apply_start, '%Y-%m-%d'), '') || ' ~ ' || coalesce(strftime(apply_end, '%Y-%m-%d'), '') END AS period FROM notices"""
)
def card_dates(spark, sf_dir):
    start, end = F.col("apply_start"), F.col("apply_end")
    made = notices(spark, sf_dir).select("id", listing.card_dates(start, end, today()).alias("c"), listing.apply_period(start, end).alias("period"))
    return made.select("id", F.col("c.reception_label").alias("reception"), F.col("c.deadline_label").alias("deadline"), "period")


@query(NOTICES + f"SELECT id, CASE source_id {' '.join(f'WHEN {i} THEN {chr(39)}{label}{chr(39)}' for i, _, label in V.SOURCES)} END AS label FROM notices")
def source_labels(spark, sf_dir):
    return notices(spark, sf_dir).select("id", classify.source_label(classify.source_code(F.col("source_id"))).alias("label"))


# -- logs and payloads -----------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type, substr(CAST(user_id AS VARCHAR) || props, 1, 64) AS session_id FROM events WHERE event_type IN ('view', 'click')")
def event_log_valid(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.col("user_id").cast("string"), "props").alias("session_id"))
    return merge.valid_events(events, ["view", "click"])


@query(
    """SELECT c_custkey AS announcement_id, substr(trim(c_name), 1, 50) AS name, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS phone, c_acctbal > 0 AS is_business,
    substr(c_mktsegment, 1, 20) AS region FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey > 5"""
)
def leads_valid(spark, sf_dir):
    leads = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("announcement_id"), F.col("c_name").alias("name"), F.concat(F.lit("tel. "), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("phone"),
        (F.col("c_acctbal") > 0).alias("is_business"), F.col("c_mktsegment").alias("region"), F.lit("?").alias("message"), (F.col("c_nationkey") > 5).alias("consent"),
    )
    return merge.valid_leads(leads, now()).drop("message", "consent_at")


@query("SELECT event_id, props ->> '$.\"page\"' AS page, nullif(trim(coalesce(props ->> '$.\"nothing\"', props)), '') AS first_text FROM events")
def props_extract(spark, sf_dir):
    props = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), text.first_text(F.get_json_object("props", "$.nothing"), props).alias("first_text"))


@query("SELECT event_type AS page, CAST(count(*) AS BIGINT) AS items, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def json_items(spark, sf_dir):
    """Each event type's rows as the items of JSON responses of up to a thousand, taken apart again; responses keep their
    items in one of six places."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    paged = events.groupBy("event_type", F.floor(F.col("event_id") / 1000).alias("page")).agg(F.collect_list(F.to_json(F.struct("event_id", "user_id"))).alias("l"))
    listed = F.concat(F.lit("["), F.array_join("l", ","), F.lit("]"))
    forms = [('{"response":{"body":{"items":{"item":', "}}}}"), ('{"response":{"body":{"items":', "}}}"), ('{"jsonArray":', "}"), ('{"data":', "}"), ('{"items":', "}"), ('{"body":{"items":', "}}")]
    body = F.element_at(F.array(*[F.concat(F.lit(a), listed, F.lit(b)) for a, b in forms]), (F.col("page") % len(forms) + 1).cast("int"))
    items = paged.select("event_type", F.explode(payloads.json_items(body)).alias("item"))
    user = F.get_json_object("item", "$.user_id").cast("bigint")
    return items.groupBy(F.col("event_type").alias("page")).agg(F.count(F.lit(1)).alias("items"), F.sum(user).alias("users"))


@query("SELECT p_partkey, p_name AS name, p_type || '|' || p_brand AS files, replace(p_name, ' ', '') || ' & <' || p_size || '>' AS note FROM part")
def xml_items(spark, sf_dir):
    """Parts as XML items with CDATA, entities and repeated tags, taken apart again."""
    parts = table(spark, sf_dir, "part")
    item = F.concat(
        F.lit("<items><item><key>"), F.col("p_partkey").cast("string"), F.lit("</key><name> <![CDATA["), "p_name", F.lit("]]> </name><file>"), "p_type", F.lit("</file><file>"), "p_brand",
        F.lit('</file><note lang="x">'), F.replace("p_name", F.lit(" "), F.lit("")), F.lit(" &amp; &lt;"), F.col("p_size").cast("string"), F.lit("&gt;</note></item></items>"),
    )
    found = parts.select(F.explode(payloads.xml_items(item)).alias("item"))
    one = lambda tag: F.get(payloads.xml_values(F.col("item"), tag), F.lit(0))
    return found.select(one("key").cast("bigint").alias("p_partkey"), one("name").alias("name"), F.array_join(payloads.xml_values(F.col("item"), "file"), "|").alias("files"), one("note").alias("note"))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS source_key, trim(title) AS title, trim(source) AS organization, CAST(DATE '2026-01-01' + CAST(doc_id % 300 AS INTEGER) AS DATE) AS apply_end FROM
    (SELECT doc_id, source, regexp_replace(string_split(text, chr(10))[1], '[^A-Za-z0-9 ]', '', 'g') AS title FROM documents) WHERE trim(title) <> ''"""
)
def adapter_kstartup(spark, sf_dir):
    """Documents as one source's raw JSON, through its adapter."""
    title = F.regexp_replace(F.get(F.split("text", "\n"), F.lit(0)), "[^A-Za-z0-9 ]", "")
    end = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "yyyyMMdd")
    raw = F.to_json(F.struct(F.struct(F.col("doc_id").alias("pbanc_sn"), title.alias("biz_pbanc_nm"), F.col("source").alias("pbanc_ntrp_nm"), end.alias("pbanc_rcpt_end_dt")).alias("col")))
    return adapters.kstartup(table(spark, sf_dir, "documents").select(raw.alias("raw"), F.col("doc_id").alias("arrival"))).select("source_key", "title", "organization", "apply_end")


# -- states of detail fetches ------------------------------------------------------------------------------------------


def fetch_states(spark, sf_dir):
    id_ = F.col("id")
    return notices(spark, sf_dir).select(
        "id", "source_id", "apply_end", F.when(id_ % 11 != 0, F.col("detail_url")).alias("detail_url"),
        F.when(id_ % 4 == 0, F.lit("text")).alias("detail_content"), F.when(id_ % 4 == 0, F.lit("success")).when(id_ % 4 == 1, F.lit("failed")).alias("detail_fetch_status"),
        F.when(id_ % 4 == 1, F.when(id_ % 8 == 1, F.lit(merge.FINAL_EMPTY)).otherwise(F.lit(V.LEGACY_EMPTY))).alias("detail_fetch_error"),
        F.when(id_ % 4 < 2, now() - F.expr("make_interval(0, 0, 0, 0, cast(id % 50 as int))")).alias("attempted_at"),
        F.when(id_ % 4 == 0, now()).alias("fetched_at"), F.md5("content_hash").alias("payload_hash"), F.md5(F.when(id_ % 12 == 0, F.lit("old")).otherwise(F.col("content_hash"))).alias("stored_hash"),
    )


STATES = NOTICES + f""", states AS (SELECT id, source_id, apply_end, CASE WHEN id % 11 <> 0 THEN detail_url END AS detail_url, CASE WHEN id % 4 = 0 THEN 'text' END AS detail_content,
  CASE id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' END AS detail_fetch_status, CASE WHEN id % 4 = 1 THEN CASE WHEN id % 8 = 1 THEN '{merge.FINAL_EMPTY}' ELSE '{V.LEGACY_EMPTY}' END END AS detail_fetch_error,
  CASE WHEN id % 4 < 2 THEN TIMESTAMP '{TODAY} 03:00:00' - to_hours(CAST(id % 50 AS INTEGER)) END AS attempted_at, CASE WHEN id % 4 = 0 THEN TIMESTAMP '{TODAY} 03:00:00' END AS fetched_at,
  md5(content_hash) AS payload_hash, md5(CASE WHEN id % 12 = 0 THEN 'old' ELSE content_hash END) AS stored_hash FROM notices),
needs AS (SELECT *, CASE WHEN detail_url IS NULL THEN false WHEN fetched_at IS NOT NULL THEN payload_hash IS DISTINCT FROM stored_hash
  WHEN detail_fetch_error IS NOT DISTINCT FROM '{merge.FINAL_EMPTY}' THEN (apply_end IS NULL OR apply_end >= DATE '{TODAY}') AND TIMESTAMP '{TODAY} 03:00:00' - attempted_at >= INTERVAL 24 HOURS ELSE true END AS needed FROM states) """


def needed(spark, sf_dir):
    c = F.col
    needs = merge.needs_detail(c("detail_url"), c("apply_end"), c("payload_hash"), c("stored_hash"), c("fetched_at"), c("detail_fetch_error"), c("attempted_at"), today(), now())
    return fetch_states(spark, sf_dir).withColumn("needed", needs)


@query(STATES + "SELECT id, needed FROM needs")
def detail_state(spark, sf_dir):
    return needed(spark, sf_dir).select("id", "needed")


@query(STATES + "SELECT source_id, id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS place FROM needs WHERE needed) WHERE place <= 8")
def detail_budget(spark, sf_dir):
    return merge.within_budget(needed(spark, sf_dir).where("needed"), "source_id", [F.asc("id")]).select("source_id", "id")


@query(
    STATES
    + f"""SELECT id, CASE WHEN id % 2 = 0 THEN 'HTTP 500' WHEN detail_fetch_error IS NULL THEN 'empty_shell_200:1' ELSE 'empty_shell_200:2' END AS next_error FROM states"""
)
def detail_errors(spark, sf_dir):
    reason = F.when(F.col("id") % 2 == 0, F.lit("HTTP 500")).otherwise(F.lit(V.EMPTY_SHELL))
    return fetch_states(spark, sf_dir).select("id", merge.next_error(reason, F.col("detail_fetch_error")).alias("next_error"))


@query(
    STATES
    + f""", t AS (SELECT id, apply_end < DATE '{TODAY}' AS closed, apply_end, detail_fetch_error IS NOT DISTINCT FROM '{merge.FINAL_EMPTY}' AS final, attempted_at FROM states WHERE detail_content IS NULL AND detail_url IS NOT NULL)
    SELECT id, CASE WHEN coalesce(closed, false) THEN 2 WHEN apply_end IS NULL THEN 1 ELSE 0 END AS bucket FROM t
    WHERE NOT final OR (NOT coalesce(closed, false) AND coalesce(attempted_at <= TIMESTAMP '{TODAY} 03:00:00' - INTERVAL 24 HOURS, true))
    ORDER BY bucket, CASE WHEN coalesce(closed, false) THEN -(apply_end - DATE '1970-01-01') ELSE apply_end - DATE '1970-01-01' END, id LIMIT 100"""
)
def backfill_priority(spark, sf_dir):
    states = fetch_states(spark, sf_dir).withColumn("detail_fetch_attempted_at", F.col("attempted_at"))
    return reports.backfill_targets(states, today(), now() - F.expr("INTERVAL 24 HOURS"), 100).select("id", "bucket")


@query(
    STATES
    + f"""SELECT source_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (detail_content IS NULL AND detail_url IS NOT NULL) AS BIGINT) AS missing,
    CAST(count(*) FILTER (detail_content IS NULL AND detail_url IS NOT NULL AND (apply_end IS NULL OR apply_end >= DATE '{TODAY}')) AS BIGINT) AS missing_open,
    CAST(count(*) FILTER (detail_fetch_status = 'failed') AS BIGINT) AS failed, CAST(count(*) FILTER (detail_fetch_error = '{merge.FINAL_EMPTY}') AS BIGINT) AS final_empty FROM states GROUP BY 1"""
)
def detail_counts(spark, sf_dir):
    return reports.detail_counts(fetch_states(spark, sf_dir), today())


# -- reports -----------------------------------------------------------------------------------------------------------


@query(NOTICES + "SELECT source_id, status, CAST(count(*) AS BIGINT) AS n FROM seen GROUP BY 1, 2")
def status_counts(spark, sf_dir):
    return view(spark, sf_dir).groupBy("source_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(NOTICES + "SELECT r.region, CAST(count(n.id) AS BIGINT) AS n FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('ko')) r(region) LEFT JOIN notices n USING (region) GROUP BY 1")
def region_counts(spark, sf_dir):
    return reports.zero_filled(notices(spark, sf_dir), "region", ["de", "en", "es", "fr", "ko"])


KIND_SQL = "CASE region WHEN 'en' THEN 'single_region' WHEN 'fr' THEN 'nationwide' WHEN 'de' THEN 'unknown' ELSE 'conflict' END"


def kinds(spark, sf_dir):
    region_, reason = F.col("region"), F.when(F.col("region") == "es", F.lit("conflict_or_multiple")).otherwise(F.lit("-"))
    inferred = F.when(region_ == "fr", F.lit(V.NATIONWIDE)).when(region_ == "de", F.lit(V.UNKNOWN_REGION)).otherwise(region_)
    return view(spark, sf_dir).select("id", reports.kind_of(inferred, reason).alias("kind"), (F.col("status") == "open").alias("is_open"), F.col("id").alias("place"))


@query(NOTICES + f"SELECT k.kind, CAST(count(s.id) AS BIGINT) AS n FROM (VALUES ('single_region'), ('nationwide'), ('unknown'), ('conflict')) k(kind) LEFT JOIN (SELECT id, {KIND_SQL} AS kind FROM seen) s USING (kind) GROUP BY 1")
def kind_counts(spark, sf_dir):
    return reports.zero_filled(kinds(spark, sf_dir), "kind", reports.KINDS)


@query(
    NOTICES
    + f""", k AS (SELECT id, {KIND_SQL} AS kind, status = 'open' AS is_open FROM seen), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY is_open DESC, id) AS place FROM k),
    t AS (SELECT *, CASE WHEN kind = 'single_region' AND place <= 15 THEN 0 WHEN kind = 'nationwide' AND place <= 5 THEN 1 WHEN kind = 'unknown' AND place <= 5 THEN 2 WHEN kind = 'conflict' AND place <= 5 THEN 3 ELSE 4 END AS turn FROM r)
    SELECT id, kind, is_open FROM t ORDER BY turn, CASE WHEN turn < 4 THEN place ELSE id END LIMIT 30"""
)
def mixed_sample(spark, sf_dir):
    return reports.mixed_sample(kinds(spark, sf_dir), 30).select("id", "kind", "is_open")


OUTCOMES = ["upserted", "skipped", "failed", "duplicate", "expired"]


@query("SELECT user_id % 5 AS source_id, " + ", ".join(f"CAST(count(*) FILTER (event_id % 6 = {i}) AS BIGINT) AS {o}" for i, o in enumerate(OUTCOMES)) + " FROM events GROUP BY 1")
def ingest_counters(spark, sf_dir):
    outcome = F.get(F.array(*map(F.lit, OUTCOMES)), (F.col("event_id") % 6).cast("int"))
    return reports.ingest_counters(table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("source_id"), outcome.alias("outcome")))


# -- texts and pages: no SQL; tests compare them with examples ----------------------------------------------------------


@query()
def page_details(spark, sf_dir):
    """Pages through the five sources' parsers and the general one in turn."""
    codes = F.array(*[F.lit(code) for _, code, _ in V.SOURCES], F.lit(None).cast("string"))
    source = F.get(codes, (F.col("page_id") % 6).cast("int"))
    parsed = page_rules.parse_pages(table(spark, sf_dir, "pages"), source)
    return parsed.select("page_id", "detail.detail_content", F.size("detail.attachments").alias("files"), "detail.reason", "detail_content_hash")


@query()
def page_lines(spark, sf_dir):
    parsed = page_rules.parse_pages(table(spark, sf_dir, "pages")).select("page_id", F.col("detail.detail_content").alias("content"))
    found = lines.text_lines(parsed, "content")
    return found.select("page_id", "place", "kind", "warning", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("line"))


@query()
def page_texts(spark, sf_dir):
    """Whole pages cleared of tags, entities and emoji in the JVM."""
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize(F.col("html")).alias("plain"), text.clean_text(F.col("html")).alias("clean"))


@query()
def region_inference(spark, sf_dir):
    made = notices(spark, sf_dir)
    return made.select("id", region.infer_region("title", "target", "summary", "summary").alias("r")).select("id", "r.region", "r.reason")


@query()
def dedup_titles(spark, sf_dir):
    """Titles in the form of ingest, with compatibility characters folded."""
    return notices(spark, sf_dir).select("id", text.dedup_title(F.col("title")).alias("canonical"))


from noticeloom.plans import own_text_queries, payload_queries, rollup_queries, search_queries, state_queries, stream_queries, temporal_queries, text_queries  # noqa: E402, F401  (they register their own)

__all__ = ["QUERIES", "SQL"]
