"""The five sources: from raw items (column raw, JSON or XML text, and arrival) to one notice schema.

An adapter is a function from a DataFrame to a DataFrame. Rows without key or title, and those that aren't meant for
businesses, are dropped. Further adapters can be added to ``ADAPTERS``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import values as V
from noticeloom.functions.dates import parse_range, seoul_date, to_date
from noticeloom.functions.text import clean_text, content_hash, first_text, has_text, host_in, http_url, looks_encoded, once, sanitize, strip_html, trimmed
from noticeloom.operators.classify import category_ids, is_business_benefit, is_support, region_of_organization
from noticeloom.operators.region import infer_region
from noticeloom.sources.payloads import xml_map

ATTACHMENTS = "array<struct<label:string,url:string>>"
COLUMNS = ["source_id", "source_key", "title", "organization", "region", "target", "support_type", "summary", "apply_start", "apply_end", "detail_url", "attachments", "raw", "arrival"]


def with_fields(df: DataFrame, body: Column | None = None) -> DataFrame:
    """``fields``, the top level of the JSON item as texts; parsed once, whatever is picked."""
    return df.withColumn("fields", F.from_json(body if body is not None else F.col("raw"), "map<string,string>"))


def pick(*keys: str) -> Column:
    """The first field with text."""
    return first_text(*[F.col("fields")[k] for k in keys])


def with_tags(df: DataFrame) -> DataFrame:
    """``fields``, the values of each tag of the XML item."""
    return df.withColumn("fields", xml_map(F.col("raw")))


def xml(tag: str) -> Column:
    return first_text(F.get(F.col("fields")[tag], F.lit(0)))


def notices(df: DataFrame, source: str, wanted: Callable[[Column], Column] = lambda row: F.lit(True), **columns: Column) -> DataFrame:
    """Rows of one schema. A row is made once and then kept or not: as a filter, the conditions would be pushed below and
    take each field a second time."""
    text, day = F.lit(None).cast("string"), F.lit(None).cast("date")
    default = {c: day if c in ("apply_start", "apply_end") else text for c in COLUMNS}
    default |= {"source_id": F.lit(V.SOURCE_ID[source]), "attachments": F.array().cast(ATTACHMENTS), "raw": F.col("raw"), "arrival": F.col("arrival")}
    row = F.struct(*[{**default, **columns}[c].alias(c) for c in COLUMNS])
    return df.select(F.inline(F.filter(F.array(row), lambda n: n["title"].isNotNull() & n["source_key"].isNotNull() & wanted(n))))


def bizinfo(df: DataFrame, site: str = "https://www.bizinfo.go.kr") -> DataFrame:
    title = pick("pblancNm", "pblancName", "title", "bsnsTitle")
    in_url = F.nullif(F.regexp_extract(pick("pblancUrl"), r"pblancId=(\w+)", 1), F.lit(""))
    start, end = parse_range(pick("reqstBeginEndDe", "reqstDe", "applyPeriod"))
    url = pick("pblancUrl", "detailUrl", "url")
    made = notices(
        with_fields(df), "bizinfo", title=title, source_key=F.coalesce(pick("pblancId", "pblancSn", "id", "seq"), in_url, title),
        organization=pick("jrsdInsttNm", "excInsttNm", "insttNm", "organNm"), target=pick("trgetNm", "targetNm", "aplyTrgt"),
        support_type=pick("pldirSportRealmLclasCodeNm", "sportRealmNm", "suptType"), summary=strip_html(pick("bsnsSumryCn", "sumryCn", "summary")),
        apply_start=F.coalesce(start, to_date(pick("reqstBeginDe", "applyStart"))), apply_end=F.coalesce(end, to_date(pick("reqstEndDe", "applyEnd"))),
        detail_url=once(url, lambda u: F.when(u.startswith("/"), F.concat(F.lit(site), u)).otherwise(u)),
    )
    return made.withColumn("region", infer_region("title", "target", "summary", F.lit(None).cast("string"))["region"])


def kstartup(df: DataFrame) -> DataFrame:
    title = pick("biz_pbanc_nm", "pbancNm", "title", "intg_pbanc_biz_nm")
    return notices(
        with_fields(df, F.coalesce(F.get_json_object("raw", "$.col"), F.col("raw"))), "kstartup", title=title, source_key=F.coalesce(pick("pbanc_sn", "pbancSn", "id"), title),
        organization=pick("pbanc_ntrp_nm", "spnsr_organ_nm", "organNm"), region=F.coalesce(pick("supt_regin", "region"), F.lit(V.NATIONWIDE)),
        target=pick("aply_trgt_ctnt", "aply_trgt", "target"), support_type=pick("supt_biz_clsfc", "bizClsfc"), summary=pick("pbanc_ctnt", "summary"),
        apply_start=to_date(pick("pbanc_rcpt_bgng_dt", "rcptBgngDt")), apply_end=to_date(pick("pbanc_rcpt_end_dt", "rcptEndDt")), detail_url=pick("detl_pg_url", "detailUrl", "url"),
    )


def mss(df: DataFrame, domains: list[str] = ["mss.go.kr"]) -> DataFrame:  # noqa: B006
    safe = lambda url: once(http_url(url), lambda u: F.when(host_in(u, domains), u))
    every = lambda tag: F.coalesce(F.col("fields")[tag], F.array().cast("array<string>"))
    files = F.arrays_zip(every("fileName").alias("name"), every("fileUrl").alias("url"))
    named = F.transform(
        files,
        lambda f, i: F.struct(
            F.coalesce(first_text(f["name"]), F.concat(F.lit(V.ATTACHMENT + " "), (i + 1).cast("string"))).alias("label"), safe(f["url"]).alias("url")
        ),
    )
    return notices(
        with_tags(df), "mss", wanted=lambda n: is_support(n["title"], n["summary"]), title=xml("title"), source_key=xml("itemId"), organization=F.lit(V.MINISTRY), region=F.lit(V.NATIONWIDE),
        summary=F.substring(strip_html(xml("dataContents")), 1, 2000), apply_start=to_date(xml("applicationStartDate")), apply_end=to_date(xml("applicationEndDate")),
        detail_url=safe(xml("viewUrl")), attachments=F.filter(named, lambda a: a["url"].isNotNull()),
    )


def mois(df: DataFrame) -> DataFrame:
    title, organization, user = pick("서비스명"), pick("소관기관명"), pick("사용자구분")
    start, end = parse_range(pick("신청기한"))
    return notices(
        with_fields(df), "mois", wanted=lambda n: is_business_benefit(user, n["title"], n["target"]), title=title, source_key=F.coalesce(pick("서비스ID"), title),
        organization=organization, region=region_of_organization(organization), target=pick("지원대상"), support_type=pick("지원유형"),
        summary=pick("서비스목적요약", "지원내용"), apply_start=start, apply_end=end, detail_url=pick("상세조회URL"),
    )


def msit(df: DataFrame) -> DataFrame:
    title, url = xml("subject"), xml("viewUrl")
    return notices(
        with_tags(df), "msit", title=title, source_key=F.coalesce(F.nullif(F.regexp_extract(url, r"nttSeqNo=(\d+)", 1), F.lit("")), title),
        organization=F.coalesce(xml("deptName"), F.lit(V.SCIENCE_MINISTRY)), region=F.lit(V.NATIONWIDE), support_type=F.lit(V.SCIENCE_SUPPORT),
        apply_start=to_date(xml("pressDt")), detail_url=url,
    )


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"bizinfo": bizinfo, "kstartup": kstartup, "mss": mss, "mois": mois, "msit": msit}


def selected(only: str | None) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Adapters of a comma-separated list; none named means all."""
    names = [n.strip() for n in (only or "").split(",") if n.strip()]
    return {k: a for k, a in ADAPTERS.items() if not names or k in names}


def fetch_window(now: Column) -> Column:
    """From the first day of the year in Seoul to today there."""
    today = seoul_date(now)
    return F.struct(F.trunc(today, "YEAR").alias("start"), today.alias("end"))


def to_rows(made: DataFrame, now: Column) -> DataFrame:
    """Notices as stored: texts cleared, categories, content hash of the cleared texts, nationwide where no region is."""
    made = made.withColumns({c: once(F.col(c), sanitize) for c in ("title", "organization", "region", "target", "support_type", "summary")})
    kept = F.filter(F.transform("attachments", lambda a: F.struct(sanitize(a["label"]).alias("label"), a["url"].alias("url"))), lambda a: F.length(a["label"]) > 0)
    return made.withColumns(
        {
            "category_ids": category_ids(*[F.col(c) for c in ("title", "target", "support_type", "summary")]),
            "region": F.coalesce("region", F.lit(V.NATIONWIDE)),
            "content_hash": content_hash(F.col("title"), F.col("organization"), F.col("apply_end")),
            "attachments": F.when(F.size(kept) > 0, kept),
            "updated_at": now,
        }
    )


def payload_hash(raw: Column, source_id: Column) -> Column:
    """Of the payload with sorted keys; one source's parser has a version of its own."""
    version = F.when(source_id == V.SOURCE_ID["msit"], F.lit("\nmsit-detail-v2")).otherwise(F.lit(""))
    return F.sha2(F.concat(F.coalesce(F.to_json(F.try_parse_json(raw)), raw), version), 256)


# -- details kept in raw payloads -----------------------------------------------------------------------------------


# Fields of the payloads and labels of the links.
APPLY_METHODS = [
    ("온라인 신청", ["aply_mthd_onli_rcpt_istc", "biz_aply_url"]), ("이메일 접수", ["aply_mthd_eml_rcpt_istc"]), ("방문 접수", ["aply_mthd_vst_rcpt_istc"]),
    ("우편 접수", ["aply_mthd_pssr_rcpt_istc"]), ("팩스 접수", ["aply_mthd_fax_rcpt_istc"]), ("기타", ["aply_mthd_etc_istc"]),
]
LINKS = [("사업 신청", ["biz_aply_url"]), ("사업 안내", ["biz_gdnc_url"]), ("첨부파일", ["pbanc_file_url", "atch_file_url", "file_url", "atchFileUrl", "fileUrl"])]


def untrimmed(raw: Column, keys: list[str]) -> Column:
    fields = [F.get_json_object(raw, f"$['{k}']") for k in keys]
    return F.coalesce(*[F.when(has_text(f), f) for f in fields])


def detail_record(df: DataFrame) -> DataFrame:
    """Detail texts of notices: the stored column if it has text, else what the raw payload has."""
    raw = F.coalesce(F.get_json_object("raw", "$.col"), F.col("raw"))
    fields = {
        "detail_content": ["pbanc_ctnt", "detail_content", "content", "summary"], "documents": ["sbmsn_dcmnt_ctnt", "sbmsn_dcmnt", "submit_documents", "documents"],
        "office": ["biz_prch_dprt_nm", "charge_dept"], "number": ["prch_cnpl_no", "inqr_telno", "contact"],
    }
    fields |= {f"method{i}": keys for i, (_, keys) in enumerate(APPLY_METHODS)} | {f"link{i}": keys for i, (_, keys) in enumerate(LINKS)}
    # Each field is cleaned once, in a column of its own; what is made of several comes after.
    df = df.withColumn("_clean", F.struct(*[once(untrimmed(raw, keys), clean_text).alias(name) for name, keys in fields.items()]))
    clean = lambda name: F.col("_clean")[name]
    methods = [F.when(~looks_encoded(clean(f"method{i}")), F.concat(F.lit(f"{label}: "), clean(f"method{i}"))) for i, (label, _) in enumerate(APPLY_METHODS)]
    kept = {
        "detail_content": clean("detail_content"),
        "apply_method": F.nullif(F.array_join(F.array_compact(F.array(*methods)), "\n"), F.lit("")),
        "documents": clean("documents"),
        "contact": F.nullif(F.concat_ws(" / ", clean("office"), clean("number")), F.lit("")),
    }
    address = lambda i: F.when(clean(f"link{i}").rlike(r"(?i)^(?:https?://|www[.])"), F.regexp_replace(clean(f"link{i}"), "(?i)^(?=www[.])", "https://"))
    own = F.filter(F.array(*[F.struct(F.lit(label).alias("label"), address(i).alias("url")) for i, (label, _) in enumerate(LINKS)]), lambda a: a["url"].isNotNull())
    stored = F.filter(F.transform(F.coalesce("attachments", F.array().cast(ATTACHMENTS)), lambda a: F.struct(trimmed(sanitize(a["label"])).alias("label"), http_url(a["url"]).alias("url"))), lambda a: (F.length(a["label"]) > 0) & a["url"].isNotNull())
    df = df.withColumns({c: F.when(has_text(F.col(c)), F.col(c)).otherwise(v) for c, v in kept.items()} | {"attachments": F.concat(stored, own)})
    return df.withColumns({c: once(F.col(c), sanitize) for c in kept} | {"attachments": merged_links(F.col("attachments"))}).drop("_clean")


def merged_links(links: Column, most: int = 50) -> Column:
    """The first link of each address."""

    def firsts(every: Column) -> Column:
        urls = F.transform(every, lambda x: x["url"])
        return F.slice(F.filter(every, lambda x, i: F.array_position(urls, x["url"]) == i + 1), 1, most)

    return once(links, firsts)
