"""Queries over raw payloads of the five sources, made of the documents, and a whole ingest of them, with their SQL.

The domain's own word lists are at work here: titles and other fields take words of them in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import dates, text
from noticeloom.functions import values as V
from noticeloom.functions.scratch import written
from noticeloom.operators import ingest, merge
from noticeloom.plans.bridge import TODAY, now, table, today
from noticeloom.plans.register import query
from noticeloom.sources import adapters, payloads

BENEFITS = [*V.BUSINESS_BENEFITS, "개인", "가구"]
NOTICE_WORDS = [*V.SUPPORT, *V.ADMINISTRATIVE, "소식"]
ORGANIZATIONS = ["서울특별시", "부산광역시", "충청북도 청주시", "충남", "전라남도 목포시", "경상북도", "경남", "제주특별자치도", "강원", "행정안전부"]
KEYWORDS = [word for words in V.CATEGORY_KEYWORDS.values() for word in words]


def quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def turn(words: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.col("doc_id") % len(words) + 1).cast("int"))


def turn_sql(words: list[str]) -> str:
    return f"{quoted(words)}[doc_id % {len(words)} + 1]"


def any_of(text_: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text_}), '{w.lower()}')" for w in words) + ")"


#: A document's first line in plain letters, and a period that may have expired.
DOCS = f"""WITH docs AS (SELECT doc_id, source, lang, trim(regexp_replace(string_split(text, chr(10))[1], '[^A-Za-z0-9 ]', '', 'g')) AS plain,
  DATE '{TODAY}' - CAST(doc_id % 50 AS INTEGER) AS starts, DATE '{TODAY}' + CAST(doc_id % 11 AS INTEGER) - 4 AS ends FROM documents) """


def docs(spark, sf_dir) -> DataFrame:
    plain = F.trim(F.regexp_replace(F.get(F.split("text", "\n"), F.lit(0)), "[^A-Za-z0-9 ]", ""))
    id_ = F.col("doc_id")
    starts, ends = F.date_sub(today(), (id_ % 50).cast("int")), F.date_add(today(), (id_ % 11 - 4).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", plain.alias("plain"), starts.alias("starts"), ends.alias("ends"))


def json_of(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def tag(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), value if isinstance(value, Column) else F.lit(value), F.lit(f"</{name}>"))


def day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def raw_item(source: str, title: Column) -> Column:
    """A document as an item of a source."""
    c, id_ = F.col, F.col("doc_id").cast("string")
    if source == "bizinfo":
        address = F.when(c("doc_id") % 3 < 2, F.concat(F.lit("/view?pblancId=U"), id_))
        period = F.concat(day(c("starts")), F.lit(" ~ "), F.date_format("ends", "yyyy.MM.dd"))
        return json_of(pblancNm=title, pblancId=F.when(c("doc_id") % 3 == 0, F.concat(F.lit("B"), id_)), pblancUrl=address, reqstBeginEndDe=period, jrsdInsttNm=c("source"), bsnsSumryCn=F.concat(F.lit("<p>"), c("plain"), F.lit("</p><br/>end")))
    if source == "kstartup":
        return json_of(pbanc_sn=c("doc_id"), biz_pbanc_nm=title, pbanc_ntrp_nm=c("source"), supt_regin=F.when(c("doc_id") % 2 == 0, F.lit("서울")), aply_trgt=c("lang"), supt_biz_clsfc=F.lit("융자"), pbanc_ctnt=c("plain"), pbanc_rcpt_bgng_dt=F.date_format("starts", "yyyyMMdd"), pbanc_rcpt_end_dt=F.date_format("ends", "yyyyMMdd"), detl_pg_url=F.concat(F.lit("https://k.example/"), id_))
    if source == "mois":
        return json_of(서비스ID=F.concat(F.lit("M"), id_), 서비스명=title, 소관기관명=turn(ORGANIZATIONS), 사용자구분=F.lit("개인"), 지원대상=turn(BENEFITS), 지원유형=c("lang"), 서비스목적요약=c("plain"), 신청기한=F.concat(day(c("starts")), F.lit("∼"), day(c("ends"))), 상세조회URL=F.concat(F.lit("https://m.example/"), id_))
    if source == "mss":
        files = [tag("fileName", F.concat(F.lit("a"), id_, F.lit(".pdf"))), tag("fileUrl", F.concat(F.lit("https://www.mss.go.kr/f?a=1&amp;b="), id_)), tag("fileName", "other"), tag("fileUrl", "https://evilmss.go.kr/x"), tag("fileName", " "), tag("fileUrl", "www.mss.go.kr/third")]
        return F.concat(tag("itemId", id_), tag("title", F.concat(F.lit("<![CDATA["), title, F.lit("]]>"))), tag("dataContents", F.concat(F.lit("&lt;p&gt;"), c("plain"), F.lit("&lt;/p&gt;"))), tag("applicationStartDate", day(c("starts"))), tag("applicationEndDate", day(c("ends"))), tag("viewUrl", F.concat(F.lit("https://www.mss.go.kr/"), id_)), *files)
    address = F.concat(F.lit("https://msit.example/view?nttSeqNo="), F.when(c("doc_id") % 4 != 0, id_).otherwise(F.lit("")), F.lit("&amp;x=1"))
    return F.concat(tag("subject", title), tag("viewUrl", address), tag("deptName", F.when(c("doc_id") % 3 == 0, F.lit(" ")).otherwise(c("source"))), tag("pressDt", day(c("starts"))))


def adapted(spark, sf_dir, source: str, title: Column) -> DataFrame:
    raw = docs(spark, sf_dir).select(raw_item(source, title).alias("raw"), F.col("doc_id").alias("arrival"))
    return adapters.ADAPTERS[source](raw)


SQUEEZED = "regexp_replace(plain, ' +', ' ', 'g')"


@query(
    DOCS
    + f"""SELECT coalesce(CASE WHEN doc_id % 3 = 0 THEN 'B' || doc_id END, CASE WHEN doc_id % 3 = 1 THEN 'U' || doc_id END, plain) AS source_key, plain AS title, source AS organization,
    trim({SQUEEZED} || chr(10) || 'end', ' ' || chr(10)) AS told, starts AS apply_start, ends AS apply_end, CASE WHEN doc_id % 3 < 2 THEN 'https://www.bizinfo.go.kr/view?pblancId=U' || doc_id END AS detail_url, 1 AS source_id
    FROM docs WHERE plain <> ''"""
)
def adapter_bizinfo(spark, sf_dir):
    """Keys from a field, from the address, or the title; both ends of a period; tags become line ends."""
    made = adapted(spark, sf_dir, "bizinfo", F.col("plain"))
    return made.select("source_key", "title", "organization", F.col("summary").alias("told"), "apply_start", "apply_end", "detail_url", "source_id")


@query(
    DOCS
    + f""", m AS (SELECT *, trim(plain || ' ' || {turn_sql(NOTICE_WORDS)}) AS title FROM docs)
    SELECT CAST(doc_id AS VARCHAR) AS source_key, title, '{V.MINISTRY}' AS organization, '{V.NATIONWIDE}' AS region, nullif(left({SQUEEZED}, 2000), '') AS told, starts AS apply_start, ends AS apply_end,
    'a' || doc_id || '.pdf|https://www.mss.go.kr/f?a=1&b=' || doc_id || ';{V.ATTACHMENT} 3|https://www.mss.go.kr/third' AS files
    FROM m WHERE NOT {any_of("title", V.ADMINISTRATIVE)} AND {any_of(f"title || chr(10) || left({SQUEEZED}, 2000)", V.SUPPORT)}"""
)
def adapter_mss(spark, sf_dir):
    """XML with CDATA, entities and repeated tags; notices for administration go, foreign addresses too."""
    made = adapted(spark, sf_dir, "mss", F.concat_ws(" ", "plain", turn(NOTICE_WORDS)))
    files = F.array_join(F.transform("attachments", lambda a: F.concat_ws("|", a["label"], a["url"])), ";")
    return made.select("source_key", "title", "organization", "region", F.nullif("summary", F.lit("")).alias("told"), "apply_start", "apply_end", files.alias("files"))


@query(
    DOCS
    + f""", m AS (SELECT *, {turn_sql(ORGANIZATIONS)} AS organization, {turn_sql(BENEFITS)} AS target FROM docs)
    SELECT 'M' || doc_id AS source_key, plain AS title, organization, CASE {" ".join(f"WHEN regexp_matches(organization, '{p}') THEN '{r}'" for p, r in V.ORGANIZATION_REGIONS)} ELSE '{V.NATIONWIDE}' END AS region,
    target, lang AS support_type, plain AS told, starts AS apply_start, ends AS apply_end FROM m WHERE plain <> '' AND ({any_of("plain", V.BUSINESS_BENEFITS)} OR {any_of("target", V.BUSINESS_BENEFITS)})"""
)
def adapter_mois(spark, sf_dir):
    made = adapted(spark, sf_dir, "mois", F.col("plain"))
    return made.select("source_key", "title", "organization", "region", "target", "support_type", F.col("summary").alias("told"), "apply_start", "apply_end")


@query(
    DOCS
    + f"""SELECT CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id AS VARCHAR) ELSE plain END AS source_key, plain AS title, CASE WHEN doc_id % 3 = 0 THEN '{V.SCIENCE_MINISTRY}' ELSE source END AS organization,
    '{V.SCIENCE_SUPPORT}' AS support_type, starts AS apply_start, CAST(NULL AS DATE) AS apply_end, 'https://msit.example/view?nttSeqNo=' || CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END || '&x=1' AS detail_url FROM docs WHERE plain <> ''"""
)
def adapter_msit(spark, sf_dir):
    return adapted(spark, sf_dir, "msit", F.col("plain")).select("source_key", "title", "organization", "support_type", "apply_start", "apply_end", "detail_url")


@query(
    DOCS
    + f""", m AS (SELECT *, trim({SQUEEZED} || ' &amp; ' || {turn_sql(KEYWORDS)}) AS title FROM docs),
    t AS (SELECT *, lower(concat_ws(' ', title, lang, '융자', {SQUEEZED})) AS all_ FROM m)
    SELECT CAST(doc_id AS VARCHAR) AS source_key, title, CASE WHEN doc_id % 2 = 0 THEN '서울' ELSE '{V.NATIONWIDE}' END AS region,
    list_aggregate(list_filter([{", ".join(f"CASE WHEN {any_of('all_', words)} THEN {i} END" for i, words in V.CATEGORY_KEYWORDS.items())}], lambda x: x IS NOT NULL), 'string_agg', ',') AS categories,
    sha256(lower(replace(title, ' ', '')) || '|' || lower(replace(source, ' ', '')) || '|' || strftime(ends, '%Y-%m-%d')) AS content_hash FROM t"""
)
def stored_rows(spark, sf_dir):
    """Notices as stored: entities, tags, emoji, stray question marks and space are cleared before categories and hashes."""
    title = F.concat(F.lit("? <b>"), "plain", F.lit("</b> &amp;amp; 😀\t "), turn(KEYWORDS))
    rows = adapters.to_rows(adapted(spark, sf_dir, "kstartup", title), now())
    return rows.select("source_key", "title", "region", F.array_join(F.col("category_ids").cast("array<string>"), ",").alias("categories"), "content_hash")


@query(
    DOCS
    + f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'kept' ELSE nullif({SQUEEZED}, '') END AS detail_content,
    '온라인 신청: page ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '방문 접수: desk' ELSE '' END AS apply_method, 'office / 02-' || doc_id AS contact,
    '원문|https://stored.example/' || doc_id || ';사업 신청|https://www.apply.example/' || doc_id AS links FROM docs"""
)
def detail_records(spark, sf_dir):
    """Detail texts kept in raw payloads; what looks encoded is no way to apply, links of both kinds are merged."""
    id_ = F.col("doc_id").cast("string")
    inner = F.struct(
        F.concat(F.lit("<div>"), "plain", F.lit("</div>")).alias("pbanc_ctnt"), F.concat(F.lit("page "), id_).alias("aply_mthd_onli_rcpt_istc"), F.lit("QUJD" * 8).alias("aply_mthd_eml_rcpt_istc"),
        F.when(F.col("doc_id") % 2 == 0, F.lit(" desk ")).alias("aply_mthd_vst_rcpt_istc"), F.lit("office").alias("biz_prch_dprt_nm"), F.concat(F.lit("02-"), id_).alias("prch_cnpl_no"),
        F.concat(F.lit("www.apply.example/"), id_).alias("biz_aply_url"), F.concat(F.lit("https://stored.example/"), id_).alias("biz_gdnc_url"), F.lit("no address").alias("file_url"),
    )
    none = F.lit(None).cast("string")
    stored = F.array(F.struct(F.lit(" 원문 ").alias("label"), F.concat(F.lit("https://stored.example/"), id_).alias("url")))
    rows = docs(spark, sf_dir).select("doc_id", F.to_json(F.struct(inner.alias("col"))).alias("raw"), F.when(F.col("doc_id") % 4 == 0, F.lit("kept")).alias("detail_content"), none.alias("apply_method"), none.alias("documents"), none.alias("contact"), stored.alias("attachments"))
    links = F.array_join(F.transform("attachments", lambda a: F.concat_ws("|", a["label"], a["url"])), ";")
    return adapters.detail_record(rows).select("doc_id", "detail_content", "apply_method", "contact", links.alias("links"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS first_day, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) END AS last_day FROM orders")
def date_ranges(spark, sf_dir):
    """Both ends of periods in four ways of writing them; the last has one date only."""
    start = F.col("o_orderdate").cast("date")
    end = F.date_add(start, (F.col("o_orderkey") % 90).cast("int"))
    signs = F.element_at(F.array(F.lit(" ~ "), F.lit("∼"), F.lit(" - ")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    told = F.when(F.col("o_orderkey") % 4 == 3, F.date_format(start, "yyyyMMdd")).otherwise(F.concat(F.date_format(start, "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 4 < 3, signs), F.date_format(end, "yyyy.MM.dd")))
    made = table(spark, sf_dir, "orders").withColumn("period", told)
    first, last = dates.parse_range(F.col("period"))
    return made.select("o_orderkey", first.alias("first_day"), last.alias("last_day"))


URLS = [
    # address, as http address, of the domain, private
    ("http://a.mss.go.kr/x", "http://a.mss.go.kr/x", True, False), ("www.mss.go.kr", "https://www.mss.go.kr", True, False), ("ftp://mss.go.kr", None, False, False),
    ("https://evilmss.go.kr", "https://evilmss.go.kr", False, False), ("  https://MSS.go.kr/ ", "https://MSS.go.kr/", True, False), ("javascript:x", None, False, False),
    ("http://localhost/a", "http://localhost/a", False, True), ("http://172.20.0.1/", "http://172.20.0.1/", False, True), ("http://172.40.0.1/", "http://172.40.0.1/", False, False),
]


@query(f"""SELECT event_id, {[u for _, u, _, _ in URLS]!r}[event_id % {len(URLS)} + 1] AS url, {[d for _, _, d, _ in URLS]!r}[event_id % {len(URLS)} + 1] AS of_domain, {[p for _, _, _, p in URLS]!r}[event_id % {len(URLS)} + 1] AS private,
    event_id % 2 = 0 AS is_uuid, event_id % 3 = 0 AS encoded FROM events""".replace("None", "NULL").replace("True", "true").replace("False", "false"))
def address_checks(spark, sf_dir):
    """Addresses, hosts, ids and encoded texts, checked per event."""
    id_ = F.col("event_id")
    address = F.element_at(F.array(*[F.lit(u) for u, _, _, _ in URLS]), (id_ % len(URLS) + 1).cast("int"))
    hexed = F.md5(id_.cast("string"))
    made = F.concat(F.substring(hexed, 1, 8), F.lit("-"), F.substring(hexed, 9, 4), F.lit("-4"), F.substring(hexed, 13, 3), F.lit("-"), F.when(id_ % 2 == 0, F.lit("a")).otherwise(F.lit("c")), F.substring(hexed, 16, 3), F.lit("-"), F.substring(hexed, 19, 12))
    coded = F.concat(F.regexp_replace(F.base64(F.encode(F.lpad(id_.cast("string"), 30, "0"), "UTF-8")), "[\r\n]", ""), F.when(id_ % 3 == 0, F.lit("")).otherwise(F.lit("?")))
    url = text.http_url(address)
    private = F.coalesce(text.private_host(F.try_parse_url(url, F.lit("HOST"))), F.lit(False))
    return table(spark, sf_dir, "events").select("event_id", url.alias("url"), text.host_in(url, ["mss.go.kr"]).alias("of_domain"), private.alias("private"), text.valid_uuid(made).alias("is_uuid"), text.looks_encoded(coded).alias("encoded"))


# -- a whole ingest ------------------------------------------------------------------------------------------------------

#: Sources by id mod 5; titles by number, so that some of the third source repeat the first's or each other.
ITEMS = DOCS + f""", items AS (SELECT *, doc_id // 100 AS page, ['bizinfo', 'kstartup', 'mss', 'mois', 'msit'][doc_id % 5 + 1] AS code,
  'Programme notice ' || CASE WHEN doc_id % 5 = 2 AND doc_id % 3 = 0 THEN doc_id - 2 WHEN doc_id % 5 = 2 THEN doc_id // 30 * 1000000 ELSE doc_id END || ' 지원사업' AS title FROM docs),
read AS (SELECT * FROM items WHERE code <> 'mois' OR page < 1),
told AS (SELECT *, CASE WHEN code = 'msit' THEN true ELSE ends >= DATE '{TODAY}' - 2 END AS current_, CASE WHEN code = 'mois' THEN {any_of(turn_sql(BENEFITS), V.BUSINESS_BENEFITS)} OR {any_of("title", V.BUSINESS_BENEFITS)} ELSE true END AS wanted FROM read),
stored AS (SELECT doc_id, title, ends FROM items WHERE code = 'bizinfo' AND doc_id % 7 = 0),
originals AS (SELECT title FROM told WHERE code IN ('bizinfo', 'kstartup') AND current_ UNION SELECT title FROM stored),
third AS (SELECT *, title IN (SELECT title FROM originals) AS copy FROM told WHERE code = 'mss'),
placed AS (SELECT *, copy OR row_number() OVER (PARTITION BY copy, title ORDER BY doc_id) > 1 AS repeated FROM third),
outcomes AS (SELECT doc_id, code, title, CASE WHEN NOT wanted THEN 'skipped' WHEN NOT current_ THEN 'expired' ELSE 'upserted' END AS outcome FROM told WHERE code <> 'mss'
  UNION ALL SELECT doc_id, code, title, CASE WHEN repeated THEN 'duplicate' WHEN NOT current_ THEN 'expired' ELSE 'upserted' END FROM placed) """


def ingest_items(spark, sf_dir) -> DataFrame:
    id_ = F.col("doc_id")
    number = F.when((id_ % 5 == 2) & (id_ % 3 == 0), id_ - 2).when(id_ % 5 == 2, F.floor(id_ / 30) * 1_000_000).otherwise(id_)
    title = F.concat(F.lit("Programme notice "), number.cast("string"), F.lit(" 지원사업"))
    codes = [code for _, code, _ in V.SOURCES]
    made = docs(spark, sf_dir).withColumns({"page": F.floor(id_ / 100).cast("int"), "source_code": F.element_at(F.array(*map(F.lit, codes)), (id_ % 5 + 1).cast("int")), "title": title})
    raw = F.lit(None).cast("string")
    for code in reversed(codes):
        raw = F.when(F.col("source_code") == code, raw_item(code, F.col("title"))).otherwise(raw)
    return made.withColumn("raw", raw)


def whole_ingest(spark, sf_dir, twice: bool = False, only: str | None = None, unfit: Column | None = None, states: bool = False) -> ingest.Ingest:
    """Documents as response pages of twenty items; one source breaks off at its second page. ``twice``: every other page
    comes again. ``states``: the stored notices have states of detail fetches, and pages were fetched."""
    items = ingest_items(spark, sf_dir)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "raw"))), lambda x: x["raw"])
    is_xml = F.col("source_code").isin(ingest.XML_SOURCES)
    paged = items.groupBy("source_code", "page").agg(listed.alias("l"))
    xml = F.concat(F.lit("<items>"), F.array_join(F.transform("l", lambda r: F.concat(F.lit("<item>"), r, F.lit("</item>"))), ""), F.lit("</items>"))
    json = F.concat(F.lit('{"items":['), F.array_join("l", ","), F.lit("]}"))
    body = F.when(is_xml, xml).when((F.col("source_code") == "mois") & (F.col("page") == 1), F.lit("<html>busy")).otherwise(json)
    pages = paged.select(F.col("source_code").alias("source"), "page", body.alias("body"))
    if twice:
        pages = pages.unionByName(pages.where("page % 2 = 0"))
    old = adapters.to_rows(adapters.bizinfo(items.where("doc_id % 35 = 0").select("raw", F.col("doc_id").alias("arrival"))).withColumn("apply_end", F.lit(None).cast("date")), now()).drop("arrival")
    before = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    stored = old.withColumns({"id": F.regexp_extract("title", r"(\d+)", 1).cast("long"), "created_at": before, "organization": F.lit("before")})
    sources = spark.createDataFrame([(code,) for _, code, _ in V.SOURCES], "code string").withColumn("last_fetched_at", before)
    fetched = None
    if states:
        none = F.lit(None)
        fresh, number = F.col("id") % 2 == 0, F.col("id").cast("string")
        hash_ = F.when(fresh, adapters.payload_hash(F.col("raw"), F.col("source_id"))).otherwise(F.lit("older"))
        stored = stored.withColumns({"detail_source_hash": hash_, "detail_fetched_at": before, "detail_fetch_status": F.lit("success"), "detail_fetch_error": none.cast("string"), "detail_fetch_attempted_at": before, "detail_content": F.concat(F.lit("old "), number)})
        of = items.where("source_code = 'bizinfo'").select(F.lit(1).alias("source_id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("B"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("U"), F.col("doc_id").cast("string"))).otherwise(F.col("title")).alias("source_key"), F.col("doc_id"))
        fetched = of.select("source_id", "source_key", (F.col("doc_id") % 4 != 0).alias("ok"), F.lit("busy").alias("reason"), none.cast("string").alias("region"), F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("detail_content"))
    return ingest.run_ingest(pages, written(stored, "stored-notices"), sources, now(), only, unfit=unfit, fetched=fetched)


#: Two sources with every other page twice; titles that end in 5 aren't taken.
DOUBLED = ITEMS + f""", doubled AS (SELECT *, 0 AS copy_ FROM items WHERE code IN ('bizinfo', 'mss') UNION ALL SELECT *, 1 FROM items WHERE code IN ('bizinfo', 'mss') AND page % 2 = 0),
judged AS (SELECT *, ends >= DATE '{TODAY}' - 2 AS current_, title LIKE '%5 지원사업' AS fails FROM doubled),
known AS (SELECT title FROM judged WHERE code = 'bizinfo' AND current_ AND NOT fails UNION SELECT title FROM stored),
thirds AS (SELECT *, title IN (SELECT title FROM known) AS found FROM judged WHERE code = 'mss'),
firsts AS (SELECT *, found OR row_number() OVER (PARTITION BY found, title ORDER BY page, copy_, doc_id) > 1 AS again FROM thirds),
results AS (SELECT code, doc_id, title, false AS again, current_, fails FROM judged WHERE code = 'bizinfo' UNION ALL SELECT code, doc_id, title, again, current_, fails FROM firsts),
ended AS (SELECT code, doc_id, title, CASE WHEN again THEN 'duplicate' WHEN NOT current_ THEN 'expired' WHEN fails THEN 'failed' ELSE 'upserted' END AS outcome FROM results) """


@query(
    DOUBLED
    + f"""SELECT s.code, CAST(count(r.doc_id) AS BIGINT) AS items, CAST(count(*) FILTER (outcome = 'upserted') AS BIGINT) AS upserted, CAST(count(*) FILTER (outcome IN ('duplicate', 'expired')) AS BIGINT) AS skipped,
    CAST(count(*) FILTER (outcome = 'duplicate') AS BIGINT) AS duplicates, CAST(count(*) FILTER (outcome = 'expired') AS BIGINT) AS expired, CAST(count(*) FILTER (outcome = 'failed') AS BIGINT) AS failed,
    CASE WHEN count(*) FILTER (outcome = 'failed') > 0 THEN TIMESTAMP '2026-01-01' ELSE TIMESTAMP '{TODAY} 03:00:00' END AS last_fetched_at
    FROM (VALUES ('bizinfo'), ('mss')) s(code) LEFT JOIN ended r USING (code) GROUP BY 1"""
)
def ingest_repeated_pages(spark, sf_dir):
    """Two sources by name, with pages that come twice and rows that the table doesn't take: counts, and when each source was fetched."""
    run = whole_ingest(spark, sf_dir, twice=True, only=" mss,bizinfo, ", unfit=F.col("title").like("%5 지원사업"))
    return run.counters.join(run.sources, "code").select("code", "items", "upserted", "skipped", "duplicates", "expired", "failed", "last_fetched_at")


@query(DOUBLED + "SELECT code, title, CAST(count(*) AS BIGINT) AS times FROM (SELECT DISTINCT code, doc_id, title FROM ended WHERE outcome = 'upserted' UNION SELECT 'bizinfo', doc_id, title FROM stored) GROUP BY ALL")
def ingest_repeated_stored(spark, sf_dir):
    """Each notice of the pages that came twice is stored once."""
    run = whole_ingest(spark, sf_dir, twice=True, only="mss,bizinfo", unfit=F.col("title").like("%5 지원사업"))
    code = F.element_at(F.array(*[F.lit(c) for _, c, _ in V.SOURCES]), F.col("source_id").cast("int"))
    return run.notices.groupBy(code.alias("code"), "title").agg(F.count("*").alias("times"))


#: Of the first source's taken items those have an address whose id isn't 2 more than a multiple of 3; stored ones of even id
#: have been fetched with this payload.
FETCHED = ITEMS + """, mine AS (SELECT doc_id, doc_id % 3 < 2 AND NOT (doc_id IN (SELECT doc_id FROM stored) AND doc_id % 2 = 0) AS needed FROM outcomes WHERE code = 'bizinfo' AND outcome = 'upserted'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY needed ORDER BY doc_id) AS nth FROM mine),
tried AS (SELECT doc_id FROM ranked WHERE needed AND nth <= 8) """


@query(FETCHED + """SELECT CAST(count(*) FILTER (needed AND nth <= 8 AND doc_id % 4 <> 0) AS BIGINT) AS details_fetched, CAST(count(*) FILTER (needed AND nth <= 8 AND doc_id % 4 = 0) AS BIGINT) AS details_failed,
    CAST(count(*) FILTER (NOT needed) AS BIGINT) AS details_skipped, CAST(count(*) FILTER (needed AND nth > 8) AS BIGINT) AS details_pending FROM ranked""")
def ingest_detail_counts(spark, sf_dir):
    """Which pages of notices an ingest may fetch, within its budget, and what came of them."""
    counters = whole_ingest(spark, sf_dir, states=True).counters.where("code = 'bizinfo'")
    return counters.select("details_fetched", "details_failed", "details_skipped", "details_pending")


@query(FETCHED + f"""SELECT title, CASE WHEN doc_id IN (SELECT doc_id FROM tried) AND doc_id % 4 <> 0 THEN 'new ' || doc_id WHEN doc_id IN (SELECT doc_id FROM stored) THEN 'old ' || doc_id END AS detail_content,
    CASE WHEN doc_id IN (SELECT doc_id FROM tried) AND doc_id % 4 = 0 THEN 'busy' END AS detail_fetch_error,
    CASE WHEN doc_id IN (SELECT doc_id FROM tried) THEN TIMESTAMP '{TODAY} 03:00:00' WHEN doc_id IN (SELECT doc_id FROM stored) THEN TIMESTAMP '2026-01-01' END AS attempted_at
    FROM (SELECT doc_id, title FROM outcomes WHERE code = 'bizinfo' AND outcome = 'upserted' UNION SELECT doc_id, title FROM stored)""")
def ingest_details_stored(spark, sf_dir):
    """The first source's notices after the run, with what was fetched for them."""
    notices = whole_ingest(spark, sf_dir, states=True).notices.where("source_id = 1")
    return notices.select("title", "detail_content", "detail_fetch_error", F.col("detail_fetch_attempted_at").alias("attempted_at"))


@query(
    ITEMS
    + f"""SELECT s.code, CAST(count(r.doc_id) AS BIGINT) AS items, CAST(count(*) FILTER (outcome = 'upserted') AS BIGINT) AS upserted, CAST(count(*) FILTER (outcome IS NOT NULL AND outcome <> 'upserted') AS BIGINT) AS skipped,
    CAST(count(*) FILTER (outcome = 'duplicate') AS BIGINT) AS duplicates, CAST(count(*) FILTER (outcome = 'expired') AS BIGINT) AS expired,
    CASE WHEN s.code = 'mois' AND (SELECT count(*) FROM items WHERE code = 'mois' AND page = 1) > 0 THEN '{ingest.FAILED}' END AS error
    FROM (VALUES ('bizinfo'), ('kstartup'), ('mss'), ('mois'), ('msit')) s(code) LEFT JOIN outcomes r USING (code) GROUP BY 1"""
)
def ingest_run(spark, sf_dir):
    """What came of the items of each source."""
    return whole_ingest(spark, sf_dir).counters.select("code", "items", "upserted", "skipped", "duplicates", "expired", "error")


@query(
    ITEMS
    + f"""SELECT ['bizinfo', 'kstartup', 'mss', 'mois', 'msit'][source_id] AS code, title, is_new, kept_time, organization FROM (
    SELECT doc_id % 5 + 1 AS source_id, title, doc_id NOT IN (SELECT doc_id FROM stored) AS is_new, doc_id IN (SELECT doc_id FROM stored) AS kept_time,
      CASE code WHEN 'mss' THEN '{V.MINISTRY}' WHEN 'mois' THEN 'x' WHEN 'msit' THEN 'x' ELSE 'src' END AS organization FROM outcomes WHERE outcome = 'upserted'
    UNION ALL SELECT 1, title, false, true, 'before' FROM stored WHERE doc_id NOT IN (SELECT doc_id FROM outcomes WHERE outcome = 'upserted'))"""
)
def ingest_stored(spark, sf_dir):
    """The table after the run: new rows with new ids, known ones with their id and time of creation."""
    run = whole_ingest(spark, sf_dir)
    code = F.element_at(F.array(*[F.lit(c) for _, c, _ in V.SOURCES]), F.col("source_id").cast("int"))
    number = F.regexp_extract("title", r"(\d+)", 1).cast("long")
    kept = F.col("created_at") == F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    told = F.when(F.col("source_id") > 3, F.lit("x")).when(F.col("organization").isin("before", V.MINISTRY), F.col("organization")).otherwise(F.lit("src"))
    return run.notices.select(code.alias("code"), "title", (~kept | (F.col("id") != number)).alias("is_new"), kept.alias("kept_time"), told.alias("organization"))


@query(ITEMS + f"""SELECT code, CASE WHEN code = 'mois' AND (SELECT count(*) FROM items WHERE code = 'mois' AND page = 1) > 0 THEN TIMESTAMP '2026-01-01' ELSE TIMESTAMP '{TODAY} 03:00:00' END AS last_fetched_at
    FROM (VALUES ('bizinfo'), ('kstartup'), ('mss'), ('mois'), ('msit')) s(code)""")
def ingest_sources(spark, sf_dir):
    return whole_ingest(spark, sf_dir).sources.select("code", "last_fetched_at")


@query("SELECT event_id % 7 AS page, CAST(count(*) FILTER (event_id % 3 <> 0) AS BIGINT) AS good, CAST(count(*) FILTER (event_id % 3 = 0) AS BIGINT) AS bad FROM events GROUP BY 1")
def json_checks(spark, sf_dir):
    """Bodies that are JSON and bodies cut short."""
    events = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "props")).alias("body"))
    cut = F.when(F.col("event_id") % 3 == 0, F.substr("body", F.lit(1), F.length("body") - 1)).otherwise(F.col("body"))
    good = payloads.is_json(cut)
    return events.groupBy((F.col("event_id") % 7).alias("page")).agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))


@query(f"SELECT o_orderkey, CAST(date_trunc('year', timezone('Asia/Seoul', timezone('UTC', o_orderdate::TIMESTAMP + INTERVAL 20 HOUR))) AS DATE) AS first_day, CAST(timezone('Asia/Seoul', timezone('UTC', o_orderdate::TIMESTAMP + INTERVAL 20 HOUR)) AS DATE) AS last_day, 'https://api.example/list?key=a%20b&from=' || o_orderkey AS url FROM orders")
def fetch_windows(spark, sf_dir):
    """The window and the address of a request made in the evening of each order's day."""
    at = F.timestamp_add("HOUR", F.lit(20), F.col("o_orderdate").cast("timestamp_ntz"))
    window = adapters.fetch_window(at)
    url = F.replace(payloads.request_url("https://api.example/list", key="a b", **{"from": F.col("o_orderkey")}), F.lit("+"), F.lit("%20"))
    return table(spark, sf_dir, "orders").select("o_orderkey", window["start"].alias("first_day"), window["end"].alias("last_day"), url.alias("url"))
