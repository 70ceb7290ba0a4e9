"""Queries over states of detail fetches, lookups, recommendations in pages, installations and favourites, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import text
from noticeloom.functions import values as V
from noticeloom.operators import classify, dedup, html, listing, merge, page_rules, recommend, reports
from noticeloom.operators.listing import ListParams
from noticeloom.plans import bridge
from noticeloom.plans.bridge import NOTICES, TODAY, notices, now, table, today
from noticeloom.plans.register import query

AT = f"TIMESTAMP '{TODAY} 03:00:00'"


def view(spark, sf_dir) -> DataFrame:
    return dedup.public_view(notices(spark, sf_dir), today())


def joined(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",")


# -- lookups -----------------------------------------------------------------------------------------------------------


@query(NOTICES + f"SELECT id, title, content_hash, CASE WHEN apply_end IS NULL OR apply_end >= DATE '{TODAY}' THEN 'open' ELSE 'closed' END AS status FROM notices WHERE id = (SELECT max(id) FROM notices) // 2")
def notice_by_id(spark, sf_dir):
    """One notice from the base table, whether the public view hides it or not."""
    made = notices(spark, sf_dir)
    largest = made.agg(F.max("id")).first()[0]
    return listing.get_notice(made, largest // 2, today()).select("id", "title", "content_hash", "status")


@query(NOTICES + "SELECT n.id, s.status AS public_status FROM notices n LEFT JOIN seen s ON n.id = s.id WHERE n.source_id = 1")
def public_statuses(spark, sf_dir):
    """Rows of one source with their status in the public view, if they are there."""
    return reports.with_public_status(notices(spark, sf_dir).where("source_id = 1").select("id"), view(spark, sf_dir))


@query(NOTICES + ", p AS (SELECT source_id, id, (row_number() OVER (PARTITION BY source_id ORDER BY id) - 1) // 100 AS part FROM notices) SELECT source_id, CAST(part AS INTEGER) AS part, string_agg(id, ',' ORDER BY id) AS ids FROM p GROUP BY 1, 2")
def ids_by_source(spark, sf_dir):
    """Ids of each source in groups of a hundred."""
    return reports.grouped(notices(spark, sf_dir), "source_id", "id", 100).select("source_id", "part", joined("ids").alias("ids"))


@query(
    NOTICES
    + f""", a AS (SELECT id, region, CASE region WHEN 'fr' THEN '{V.NATIONWIDE}' WHEN 'de' THEN '{V.UNKNOWN_REGION}' ELSE CASE WHEN id % 2 = 0 THEN region ELSE 'xx' END END AS inferred, region = 'es' AS conflict FROM notices)
    SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (NOT conflict AND inferred NOT IN ('{V.NATIONWIDE}', '{V.UNKNOWN_REGION}')) AS BIGINT) AS single_region, CAST(count(*) FILTER (NOT conflict AND inferred = '{V.NATIONWIDE}') AS BIGINT) AS nationwide,
    CAST(count(*) FILTER (NOT conflict AND inferred = '{V.UNKNOWN_REGION}') AS BIGINT) AS unknown, CAST(count(*) FILTER (conflict) AS BIGINT) AS conflict, CAST(count(*) FILTER (region IS DISTINCT FROM inferred) AS BIGINT) AS changed FROM a"""
)
def region_report(spark, sf_dir):
    region = F.col("region")
    inferred = F.when(region == "fr", F.lit(V.NATIONWIDE)).when(region == "de", F.lit(V.UNKNOWN_REGION)).when(F.col("id") % 2 == 0, region).otherwise(F.lit("xx"))
    reason = F.when(region == "es", F.lit("conflict_or_multiple")).otherwise(F.lit("-"))
    return reports.region_report(notices(spark, sf_dir).select("region", inferred.alias("inferred"), reason.alias("reason")))


# -- states of detail fetches --------------------------------------------------------------------------------------------


def stored_states(spark, sf_dir) -> DataFrame:
    id_, none = F.col("id"), F.lit(None).cast("string")
    return notices(spark, sf_dir).select(
        "id", "source_id", "source_key", "region", "apply_end", "detail_url", F.when(id_ % 4 == 0, F.lit("text")).alias("detail_content"), none.alias("apply_method"),
        F.when(id_ % 6 == 0, F.lit("old")).when(id_ % 4 == 0, F.col("content_hash")).alias("detail_source_hash"),
        F.when(id_ % 4 == 0, now()).alias("detail_fetched_at"), F.when(id_ % 4 == 0, F.lit("success")).when(id_ % 4 == 1, F.lit("failed")).alias("detail_fetch_status"),
        F.when(id_ % 8 == 1, F.lit(merge.FINAL_EMPTY)).when(id_ % 8 == 5, F.lit(V.LEGACY_EMPTY)).alias("detail_fetch_error"),
        F.when(id_ % 4 < 2, now() - F.expr("make_interval(0, 0, 0, 0, cast(id % 50 as int))")).alias("detail_fetch_attempted_at"),
    )


STORED = NOTICES + f""", stored AS (SELECT id, source_id, region, apply_end, content_hash, CASE WHEN id % 4 = 0 THEN 'text' END AS detail_content, CASE WHEN id % 6 = 0 THEN 'old' WHEN id % 4 = 0 THEN content_hash END AS source_hash,
  CASE WHEN id % 4 = 0 THEN {AT} END AS fetched, CASE id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' END AS state, CASE id % 8 WHEN 1 THEN '{merge.FINAL_EMPTY}' WHEN 5 THEN '{V.LEGACY_EMPTY}' END AS error,
  CASE WHEN id % 4 < 2 THEN {AT} - to_hours(CAST(id % 50 AS INTEGER)) END AS attempted FROM notices) """


@query(
    STORED
    + f"""SELECT n.id, CASE WHEN fetched IS NOT NULL THEN n.content_hash IS DISTINCT FROM source_hash WHEN coalesce(error = '{merge.FINAL_EMPTY}', false) THEN (n.apply_end IS NULL OR n.apply_end >= DATE '{TODAY}') AND {AT} - attempted >= INTERVAL 24 HOUR ELSE true END AS needed
    FROM notices n LEFT JOIN (SELECT * FROM stored WHERE id % 5 <> 0) s ON n.id = s.id"""
)
def states_joined(spark, sf_dir):
    """Prepared rows meet the stored states by source and key; a fifth is new."""
    prepared = notices(spark, sf_dir)
    return merge.to_fetch(prepared, stored_states(spark, sf_dir).where("id % 5 <> 0"), F.col("content_hash"), today(), now()).select("id", "needed")


@query(
    STORED
    + f"""SELECT id, CASE WHEN id % 6 = 0 THEN 'found ' || id ELSE detail_content END AS detail_content, CASE WHEN id % 12 = 0 THEN 'xx' ELSE region END AS region, CASE WHEN id % 6 = 0 THEN {AT} ELSE fetched END AS fetched_at,
    CASE WHEN id % 3 = 0 THEN {AT} ELSE attempted END AS attempted_at, CASE WHEN id % 6 = 0 THEN 'success' WHEN id % 3 = 0 THEN 'failed' ELSE state END AS state,
    CASE WHEN id % 6 = 0 THEN NULL WHEN id % 3 <> 0 THEN error WHEN id % 9 = 0 THEN 'HTTP 404' WHEN error IS NULL THEN '{V.EMPTY_SHELL}:1' ELSE '{merge.FINAL_EMPTY}' END AS error FROM stored"""
)
def details_applied(spark, sf_dir):
    """Results of fetches: success writes the detail and a region if given, failure its reason and attempts only."""
    stored, id_ = stored_states(spark, sf_dir), F.col("id")
    reason = F.when(id_ % 9 == 0, F.lit("HTTP 404")).otherwise(F.lit(V.EMPTY_SHELL))
    results = stored.where("id % 3 = 0").select("source_id", "source_key", (id_ % 2 == 0).alias("ok"), reason.alias("reason"), F.when(id_ % 12 == 0, F.lit("xx")).alias("region"), F.concat(F.lit("found "), id_.cast("string")).alias("detail_content"))
    made = merge.apply_details(stored, results, now())
    return made.select("id", "detail_content", "region", F.col("detail_fetched_at").alias("fetched_at"), F.col("detail_fetch_attempted_at").alias("attempted_at"), F.col("detail_fetch_status").alias("state"), F.col("detail_fetch_error").alias("error"))


@query("SELECT n_name AS code, CASE WHEN n_nationkey % 3 = 0 THEN TIMESTAMP '2026-01-01' ELSE " + AT + " END AS last_fetched_at FROM nation")
def sources_updated(spark, sf_dir):
    """The last run is noted for sources without failed rows and without error."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("code"), F.col("n_nationkey").alias("n"))
    failed = F.when(F.col("n") % 6 == 0, 1).otherwise(0)
    counters = nations.select("code", failed.alias("failed"), F.when(F.col("n") % 6 == 3, F.lit("broken")).alias("error"))
    return merge.update_source(nations.select("code", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").alias("last_fetched_at")), counters, now())


@query("SELECT coalesce(o_custkey, -1) AS k, CAST(count(*) AS BIGINT) AS n, CAST(sum(price) AS DOUBLE) AS price FROM (SELECT CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS o_custkey, round(max_by(o_totalprice, o_orderkey), 2) AS price FROM orders GROUP BY 1) GROUP BY 1")
def merge_null_keys(spark, sf_dir):
    """Rows without a key are rows of one key: old and new ones meet."""
    key = F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("k")
    orders = table(spark, sf_dir, "orders").select(key, F.round("o_totalprice", 2).alias("price"), F.col("o_orderkey").alias("arrival"))
    old = orders.groupBy("k").agg(F.lit(0.0).alias("price"))
    merged = merge.upsert(old, orders, ["k"], arrival="arrival")
    return merged.groupBy(F.coalesce("k", F.lit(-1)).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"))


# -- installations and favourites ----------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT o_custkey AS installation_id, max(o_orderkey) AS version, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE 't' || o_custkey END, o_orderkey) AS token FROM orders GROUP BY 1),
    k AS (SELECT c_custkey AS installation_id FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(k.installation_id, r.installation_id) AS installation_id, CASE WHEN k.installation_id IS NULL THEN sha256(token) ELSE sha256('t' || k.installation_id) END AS token_hash,
    CASE WHEN k.installation_id IS NULL OR token = 't' || k.installation_id THEN 'android' ELSE 'ios' END AS platform, CASE WHEN k.installation_id IS NULL OR token = 't' || k.installation_id THEN CAST(version AS VARCHAR) ELSE '1' END AS app_version
    FROM k FULL JOIN r ON k.installation_id = r.installation_id"""
)
def installations(spark, sf_dir):
    """The last request of each; known installations change only with the right token."""
    id_ = F.col("o_custkey").cast("string")
    requests = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("installation_id"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("x")).otherwise(F.concat(F.lit("t"), id_)).alias("token"), F.lit("android").alias("platform"),
        F.col("o_orderkey").cast("string").alias("app_version"), F.col("o_orderkey").alias("arrival"),
    )
    token = F.sha2(F.concat(F.lit("t"), F.col("c_custkey").cast("string")), 256)
    known = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("installation_id"), token.alias("token_hash"), F.lit("ios").alias("platform"), F.lit("1").alias("app_version"))
    return merge.register_installations(known, requests)


@query(
    """SELECT o_orderkey, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) || '-0000-4000-8000-000000000000' AS installation_id, repeat('t', CAST(o_orderkey % 600 AS INTEGER)) AS token,
    CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey END AS announcement_id FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 600 BETWEEN 32 AND 512"""
)
def credentials(spark, sf_dir):
    """Requests by a right id and a token of fitting length; ids of notices as texts, some of which are none."""
    key = F.col("o_orderkey")
    id_ = F.concat(F.lit(" "), F.upper(F.substring(F.md5(key.cast("string")), 1, 8)), F.when(key % 5 == 0, F.lit("-0000-4000-c000-000000000000")).otherwise(F.lit("-0000-4000-8000-000000000000")))
    token = F.concat(F.lit(" "), F.repeat(F.lit("t"), (key % 600).cast("int")), F.lit("\n"))
    wanted = F.element_at(F.array(F.concat(F.lit(" "), key.cast("string")), F.concat(F.lit("00"), key.cast("string")), F.concat(F.lit("-"), key.cast("string")), F.lit(str(2**53))), (key % 4 + 1).cast("int"))
    made = table(spark, sf_dir, "orders").select("o_orderkey", id_.alias("installation_id"), token.alias("token"), wanted.alias("wanted"))
    return merge.valid_installations(made).select("o_orderkey", "installation_id", "token", text.valid_id(F.col("wanted")).alias("announcement_id"))


@query(
    """WITH f AS (SELECT o_custkey AS owner, o_orderkey AS id, CASE WHEN o_orderkey % 61 = 0 THEN '  ' ELSE o_orderstatus END AS title, CASE WHEN o_orderkey % 53 = 0 THEN 'https://other.example/' ELSE 'https://site.example/n/' END || o_orderkey AS url FROM orders)
    SELECT owner, id FROM f WHERE owner NOT IN (SELECT owner FROM f WHERE trim(title) = '' OR url <> 'https://site.example/n/' || id)"""
)
def favorites_valid(spark, sf_dir):
    """An owner with one broken favourite has none."""
    id_ = F.col("o_orderkey")
    prefix = F.when(id_ % 53 == 0, F.lit("https://other.example/")).otherwise(F.lit("https://site.example/n/"))
    made = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), id_.alias("id"), F.when(id_ % 61 == 0, F.lit("  ")).otherwise(F.col("o_orderstatus")).alias("title"), F.concat(prefix, id_.cast("string")).alias("detail_url"))
    return listing.favorites_or_none(made, "https://site.example/n/").select("owner", "id")


# -- recommendations -----------------------------------------------------------------------------------------------------


CONDITION = recommend.Condition("sole_proprietor", "french", ["startup_support", "small_business_support", "facility_digital"])
FITTING = NOTICES + f""", fits AS (SELECT * FROM (SELECT *, len(list_intersect(category_ids, [1, 2, 9])) AS matched, contains(lower(trim(region)), 'fr') AS here, coalesce(length(trim(target)) > 0, false) AS told,
  coalesce({bridge.any_word('target', bridge.BUSINESS)}, false) AS b, coalesce({bridge.any_word('target', bridge.WORKER)}, false) AS w FROM seen WHERE status = 'open') WHERE matched > 0 AND here AND (NOT told OR (b AND w) OR NOT w)) """


def recommended(spark, sf_dir, sort: str, pages: int) -> DataFrame:
    """Pages one after the other, each from the last row shown before."""
    seen, after, made = view(spark, sf_dir), None, []
    for _ in range(pages):
        page = recommend.recommendation_page(seen, CONDITION, sort, 10, after, codes=bridge.CODES, business=bridge.BUSINESS, worker=bridge.WORKER).select("id", "created_at", "apply_end")
        rows = page.collect()[:10]  # a page, as it is shown
        made += rows
        if len(rows) < 10:
            break
        after = (rows[-1][listing.list_order(sort)[0][0]], rows[-1]["id"])
    return spark.createDataFrame(made, "id bigint, created_at timestamp_ntz, apply_end date")


@query(FITTING + "SELECT id, created_at, apply_end FROM fits ORDER BY created_at DESC, id DESC LIMIT 30")
def recommendation_pages_latest(spark, sf_dir):
    return recommended(spark, sf_dir, "latest", 3)


@query(FITTING + "SELECT id, created_at, apply_end FROM fits ORDER BY apply_end NULLS LAST, id LIMIT 30")
def recommendation_pages_deadline(spark, sf_dir):
    return recommended(spark, sf_dir, "deadline", 3)


@query(NOTICES + f", n AS (SELECT *, CASE WHEN id % 5 = 0 THEN '{V.NATIONWIDE}' WHEN id % 5 = 1 THEN 'nationwide' WHEN id % 5 = 2 THEN NULL ELSE '서울' END AS moved FROM seen) SELECT id FROM n WHERE status = 'open' AND list_has_any(category_ids, [1]) AND moved = '서울'")
def recommendations_local(spark, sf_dir):
    """Without nationwide notices, and with the domain's own region names."""
    id_ = F.col("id")
    place = F.when(id_ % 5 == 0, F.lit(V.NATIONWIDE)).when(id_ % 5 == 1, F.lit("nationwide")).when(id_ % 5 > 2, F.lit("서울"))
    moved = view(spark, sf_dir).withColumn("region", place).withColumn("target", F.lit(None).cast("string"))
    return recommend.recommend(moved, recommend.Condition("other", "seoul", ["startup_support"]), include_nationwide=False).select("id")


TARGETS = [*V.BUSINESS_TARGETS, *V.WORKER_TARGETS, "모두"]


@query(
    f"""WITH e AS (SELECT event_id, [{", ".join(f"'{t}'" for t in TARGETS)}][event_id % {len(TARGETS)} + 1] || CASE WHEN event_id % 17 = 0 THEN ' 구직자 사업자' ELSE '' END AS target FROM events),
    m AS (SELECT *, {bridge.any_word('target', V.BUSINESS_TARGETS)} AS b, {bridge.any_word('target', V.WORKER_TARGETS)} AS w FROM e)
    SELECT event_id, CASE WHEN b AND w THEN 'match' WHEN w THEN 'conflict' ELSE 'match' END AS owner, CASE WHEN b AND w THEN 'match' WHEN b THEN 'conflict' ELSE 'match' END AS worker FROM m"""
)
def target_matches(spark, sf_dir):
    """Targets in the domain's words, for an owner of a business and for a worker."""
    word = F.element_at(F.array(*map(F.lit, TARGETS)), (F.col("event_id") % len(TARGETS) + 1).cast("int"))
    target = F.concat(word, F.when(F.col("event_id") % 17 == 0, F.lit(" 구직자 사업자")).otherwise(F.lit("")))
    return table(spark, sf_dir, "events").select("event_id", recommend.target_match("sme", target).alias("owner"), recommend.target_match(V.WORKER_USER, target).alias("worker"))


AUDIENCE_WORDS = sorted({w for words in V.AUDIENCES.values() for w in words} | {"모두", "R&D"})


@query(
    f"WITH e AS (SELECT event_id, event_type || ' ' || [{', '.join(f'{chr(39)}{w}{chr(39)}' for w in AUDIENCE_WORDS)}][event_id % {len(AUDIENCE_WORDS)} + 1] AS title FROM events) SELECT event_id, "
    + ", ".join(f"{bridge.any_word('title', words)} AS {name}" for name, words in V.AUDIENCES.items())
    + " FROM e"
)
def audience_words(spark, sf_dir):
    """The domain's own audience words."""
    word = F.element_at(F.array(*map(F.lit, AUDIENCE_WORDS)), (F.col("event_id") % len(AUDIENCE_WORDS) + 1).cast("int"))
    title = F.concat_ws(" ", "event_type", word)
    return table(spark, sf_dir, "events").select("event_id", *[classify.audience([title], words).alias(name) for name, words in V.AUDIENCES.items()])


# -- lists as shown --------------------------------------------------------------------------------------------------------


@query(NOTICES + f"SELECT id, trim(source_key) || ' & x' AS title, '{V.NATIONWIDE}' AS region FROM seen WHERE status = 'open' ORDER BY created_at DESC, id DESC LIMIT 100")
def list_shown(spark, sf_dir):
    """A page with its texts cleared for display."""
    dirty = F.concat(F.lit("?? <b>"), F.col("source_key"), F.lit("</b>&nbsp;&#38;&#x20;x 😀 ?"))
    rows = view(spark, sf_dir).withColumns({"title": dirty, "region": F.lit(f" {V.NATIONWIDE}&nbsp;")})
    return listing.list_page(rows, ListParams(size=10**6)).select("id", "title", "region")


@query(NOTICES + f"SELECT id, coalesce(apply_end <= DATE '{TODAY}' + 7, false) AS urgent FROM notices")
def urgent_cards(spark, sf_dir):
    return notices(spark, sf_dir).select("id", listing.card_dates(F.col("apply_start"), F.col("apply_end"), today())["urgent"].alias("urgent"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '/api/attachments/msit?nttSeqNo=' || o_custkey || '&atchFileNo=' || o_orderkey || '&fileOrd=1' END AS url FROM orders")
def proxied_files(spark, sf_dir):
    """Addresses of proxied files in their one form; those with other paths or numbers are none."""
    id_, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    path = F.when(F.col("o_orderkey") % 8 == 0, F.lit("/api/attachments/other?")).otherwise(F.lit("/api/attachments/msit?"))
    order = F.when(F.col("o_orderkey") % 8 == 4, F.lit("x")).otherwise(F.lit("1"))
    given = F.concat(path, F.lit("fileOrd="), order, F.lit("&atchFileNo=%20"), id_, F.lit("&nttSeqNo="), customer, F.lit("&z=1"))
    return table(spark, sf_dir, "orders").select("o_orderkey", html.proxied_url(given).alias("url"))


@query("SELECT page_id, 'head ' || page_id || chr(10) || 'first 한국 part' AS content, 'file ' || page_id || '|https://files.example/d/' || page_id || '.pdf' AS files, NULL::VARCHAR AS reason FROM pages")
def page_bytes(spark, sf_dir):
    """Pages as bytes in two character sets, with scripts, hidden parts and a link that is no file."""
    id_ = F.col("page_id").cast("string")
    page = F.concat(
        F.lit("<html><head><meta charset='utf-8'><script>var x = '<main>';</script></head><body><nav>menu</nav><main><h2>head "), id_, F.lit("</h2><p>first &#54620;국 part<span style='display:none'>no</span></p>"),
        F.lit("<a href='/d/"), id_, F.lit(".pdf'>file "), id_, F.lit("</a><a href='#x'>up</a></main></body></html>"),
    )
    made = table(spark, sf_dir, "pages").select("page_id", F.lit("https://files.example/").alias("url"), F.encode(page, "UTF-8").alias("html"), F.lit("text/html; charset=UTF-8").alias("content_type"))
    detail = page_rules.parse_pages(made).select("page_id", "detail.*")
    files = F.array_join(F.transform("attachments", lambda a: F.concat_ws("|", a["label"], a["url"])), ";")
    # The link's own text stands in the main text as well.
    content = F.regexp_replace("detail_content", r"\n?file \d+up$", "")
    return detail.select("page_id", content.alias("content"), files.alias("files"), "reason")
