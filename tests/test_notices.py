"""Adapters, duplicates, merges, lists, feeds, recommendations, reports on small examples."""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from datetime import date, datetime

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeloom.functions.values import REGION_CODES
from noticeloom.operators import dedup, listing, merge, recommend, reports
from noticeloom.operators.listing import FeedParams, InvalidParam, ListParams, decode_cursor, encode_cursor, parse_feed_params, parse_open_params
from noticeloom.plans.bridge import now, today
from noticeloom.sources import adapters, payloads
from noticeloom.streaming.incremental import ingest_stream, latest


def raw(spark, *items):
    return spark.createDataFrame([(i if isinstance(i, str) else json.dumps(i, ensure_ascii=False), n) for n, i in enumerate(items)], "raw string, arrival long")


# -- payloads and adapters -------------------------------------------------------------------------------------------


def test_json_items(spark):
    bodies = ['{"response":{"body":{"items":{"item":[{"a":1},{"a":2}]}}}}', '{"response":{"body":{"items":{"item":{"a":3}}}}}', '{"jsonArray":[{"b":1}]}', '{"data":[]}', '{"x":1}', "<no/>"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    assert [r[0] for r in df.orderBy("i").select(payloads.json_items(F.col("b"))).collect()] == [['{"a":1}', '{"a":2}'], ['{"a":3}'], ['{"b":1}'], [], [], []]
    assert [r[0] for r in df.orderBy("i").select(payloads.is_json(F.col("b"))).collect()] == [True] * 5 + [False]


def test_xml_items(spark):
    body = "<r><item><t><![CDATA[ A &amp; B ]]></t><f>1</f><f>2</f></item><item><t k='v'>x &lt; &amp;amp;</t></item></r>"
    items = spark.createDataFrame([(body,)], "b string").select(F.explode(payloads.xml_items(F.col("b"))).alias("i"))
    assert [r[0] for r in items.select(payloads.xml_map(F.col("i"))).collect()] == [{"t": ["A & B"], "f": ["1", "2"]}, {"t": ["x < &amp;"]}]


def test_adapters(spark):
    b = adapters.bizinfo(raw(spark, {"pblancNm": " 경기도 소재 기업 지원 ", "pblancUrl": "/web/x?pblancId=P_1", "reqstBeginEndDe": "20260101 ~ 20260131", "bsnsSumryCn": "<p>a&amp;b</p>"}, {"title": " "})).collect()
    assert [(r.source_key, r.title, r.region, str(r.apply_end), r.detail_url, r.summary) for r in b] == [("P_1", "경기도 소재 기업 지원", "경기", "2026-01-31", "https://www.bizinfo.go.kr/web/x?pblancId=P_1", "a&b")]
    k = adapters.kstartup(raw(spark, {"col": {"biz_pbanc_nm": "가", "pbanc_sn": 7}}, {"biz_pbanc_nm": "나", "supt_regin": "서울"})).orderBy("arrival").collect()
    assert [(r.source_key, r.region) for r in k] == [("7", "전국"), ("나", "서울")]
    xml = "<title>창업 지원사업</title><itemId>5</itemId><dataContents>x</dataContents><viewUrl>https://www.mss.go.kr/a</viewUrl><fileName>f1</fileName><fileName> </fileName><fileName>f3</fileName><fileUrl>https://mss.go.kr/1</fileUrl><fileUrl>https://mss.go.kr/2</fileUrl><fileUrl>https://evil.kr/3</fileUrl>"
    m = adapters.mss(raw(spark, xml, xml.replace("창업 지원사업", "창업 공모전"), xml.replace("창업 지원사업", "안내"))).collect()
    assert [(r.source_key, r.organization, [tuple(a) for a in r.attachments]) for r in m] == [("5", "중소벤처기업부", [("f1", "https://mss.go.kr/1"), ("첨부파일 2", "https://mss.go.kr/2")])]
    o = adapters.mois(raw(spark, {"서비스명": "소상공인 지원", "소관기관명": "경기도 광주시", "신청기한": "상시신청"}, {"서비스명": "아동 수당", "사용자구분": "개인"})).collect()
    assert [(r.source_key, r.region, r.apply_end) for r in o] == [("소상공인 지원", "광주", None)]
    s = adapters.msit(raw(spark, "<subject>공고</subject><viewUrl>https://x/v?nttSeqNo=12</viewUrl><pressDt>2026-07-01</pressDt>", "<subject>둘</subject>")).orderBy("arrival").collect()
    assert [(r.source_key, str(r.apply_start), r.support_type) for r in s] == [("12", "2026-07-01", "기술/R&D"), ("둘", "None", "기술/R&D")]
    assert list(adapters.selected("mss, msit,?")) == ["mss", "msit"]
    assert len(adapters.selected(None)) == 5


def test_rows_window_and_details(spark):
    made = adapters.kstartup(raw(spark, {"biz_pbanc_nm": "창업 &amp; 수출😀", "pbanc_sn": 1, "prch_cnpl_no": "02-1", "biz_prch_dprt_nm": "부서", "biz_aply_url": "www.a.kr", "aply_mthd_etc_istc": "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo="}))
    row = adapters.to_rows(made, now()).first()
    assert (row.title, row.category_ids, row.region, row.attachments) == ("창업 & 수출", [1, 7], "전국", None)
    blank = {c: F.lit(None).cast("string") for c in ("detail_content", "apply_method", "documents", "contact")}
    detail = adapters.detail_record(made.withColumns(blank)).first()
    assert (detail.contact, detail.apply_method) == ("부서 / 02-1", "온라인 신청: www.a.kr")
    assert [tuple(a) for a in detail.attachments] == [("사업 신청", "https://www.a.kr")]
    window = spark.range(1).select(adapters.fetch_window(F.lit("2025-12-31 16:00:00").cast("timestamp_ntz")).alias("w")).select("w.*").first()
    assert tuple(map(str, window)) == ("2026-01-01", "2026-01-01")


# -- duplicates ------------------------------------------------------------------------------------------------------


def duplicates(spark, candidate, preferred):
    c = spark.createDataFrame([(1, *candidate)], "id int, title string, apply_end date")
    return [r.how for r in dedup.preferred_duplicates(c, spark.createDataFrame(preferred, "title string, apply_end date")).collect()]


def test_preferred_duplicates(spark):
    end, other = date(2026, 7, 31), date(2026, 8, 1)
    title = "[경기] 2026년도 소상공인 경영환경 개선사업 참여기업 모집"
    assert duplicates(spark, ("2026년 소상공인 경영환경개선사업 참여기업 모집 (경기)", None), [("2026년 소상공인 경영환경 개선사업 참여기업 모집 경기", end)]) == ["exact"]
    assert duplicates(spark, ("2026년 소상공인 경영환경개선사업 참여기업 모집", end), [("2026년 소상공인 경영환경 개선사업 참여기업 모집공고", end)]) == ["similar"]
    assert duplicates(spark, ("2026년 소상공인 경영환경개선사업 참여기업 모집", other), [("2026년 소상공인 경영환경 개선사업 참여기업 모집공고", end)]) == []
    assert duplicates(spark, ("2026년 3차 소상공인 경영환경개선사업 참여기업 모집", end), [("2026년 소상공인 경영환경 개선사업 참여기업 모집공고", end)]) == []
    assert duplicates(spark, ("짧은 제목", end), [("짧은 제목", end)]) == []
    assert duplicates(spark, (title, end), []) == []


def test_public_view(spark):
    rows = [
        (1, 2, "가나다라마바사아자차 1", date(2026, 8, 1), "h1", datetime(2026, 1, 1)),
        (2, 1, "가나다라마바사아자차-1", date(2026, 8, 1), "h2", datetime(2026, 1, 1)),  # hides 1
        (3, 3, "가나다라마바사아자차 1", None, "h3", datetime(2026, 1, 1)),  # another deadline
        (4, 4, "가나다라마바사아자차 1", None, "h4", datetime(2026, 1, 1)),  # hidden by 3
        (5, 5, "짧다", date(2026, 7, 11), "h5", datetime(2026, 1, 1)),
        (6, 5, "짧다", date(2026, 7, 11), "h5", datetime(2026, 2, 1)),  # newer than 5
    ]
    df = spark.createDataFrame(rows, "id int, source_id int, title string, apply_end date, content_hash string, updated_at timestamp_ntz")
    assert {r.id: r.status for r in dedup.public_view(df, today()).collect()} == {2: "open", 3: "open", 6: "closed"}


def test_expired_first_arrival_hides_later_ones(spark):
    made = spark.createDataFrame([(1, 0, "동일한 공고 제목입니다", date(2026, 1, 1)), (2, 1, "동일한 공고 제목입니다", date(2026, 9, 1)), (3, 2, "다른 공고 제목이에요", None)], "id int, arrival long, title string, apply_end date")
    none = spark.createDataFrame([], "title string, apply_end date")
    assert [r.id for r in dedup.ingest_candidates(made, none, F.lit("2026-07-10").cast("date")).collect()] == [3]


# -- merges ----------------------------------------------------------------------------------------------------------


def test_upsert_twice_is_upsert_once(spark):
    old = spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 1, "y")], "k int, v string, created int, extra string")
    new = spark.createDataFrame([(2, None, 2, 0), (3, "c", 2, 0), (3, "d", 3, 1)], "k int, v string, created int, n int")
    once = merge.upsert(old, new, ["k"], keep=["created"], coalesced=["v"], arrival="n")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1, "x"), (2, "b", 1, "y"), (3, "d", 3, None)]
    assert sorted(map(tuple, merge.upsert(once, new, ["k"], keep=["created"], coalesced=["v"], arrival="n").collect())) == sorted(map(tuple, once.collect()))


def test_new_ids_continue(spark):
    df = spark.createDataFrame([(7, "a")] + [(None, c) for c in "bcdefg"], "id long, v string")
    assert sorted(r.id for r in merge.with_new_ids(df, "id", 7).collect()) == [7, 8, 9, 10, 11, 12, 13]


@pytest.mark.parametrize(
    "reason, before, after",
    [("empty_shell_200", None, "empty_shell_200:1"), ("empty_shell_200", "empty_shell_200:1", "empty_shell_200:2"), ("empty_shell_200", "empty_shell_200:9", "empty_shell_200:2"), ("empty_shell_200", "본문 없음", "empty_shell_200:2"), ("x" * 300, "본문 없음", "x" * 200)],
)
def test_attempts(spark, reason, before, after):
    df = spark.createDataFrame([(reason, before)], "r string, b string")
    assert df.select(merge.next_error(F.col("r"), F.col("b"))).first()[0] == after


def test_details_are_stored(spark):
    notices = spark.createDataFrame([(1, "a", "전국"), (1, "b", "전국"), (1, "c", "전국")], "source_id int, source_key string, region string")
    states = {c: F.lit(None).cast("string") for c in ("detail_content", "detail_fetch_status", "detail_fetch_error")}
    notices = notices.withColumns(states | {c: F.lit(None).cast("timestamp_ntz") for c in ("detail_fetched_at", "detail_fetch_attempted_at")})
    results = spark.createDataFrame([(1, "a", True, None, "서울", "text"), (1, "b", False, "empty_shell_200", None, None)], "source_id int, source_key string, ok boolean, reason string, region string, detail_content string")
    got = {r.source_key: (r.region, r.detail_content, r.detail_fetch_status, r.detail_fetch_error, r.detail_fetched_at is None) for r in merge.apply_details(notices, results, now()).collect()}
    assert got == {"a": ("서울", "text", "success", None, False), "b": ("전국", None, "failed", "empty_shell_200:1", True), "c": ("전국", None, None, None, True)}


def test_sources_leads_installations(spark):
    sources = spark.createDataFrame([("a", None), ("b", None), ("c", None)], "code string, last_fetched_at timestamp_ntz")
    counters = spark.createDataFrame([("a", 0, None), ("b", 1, None), ("c", 0, "x")], "code string, failed int, error string")
    assert {r.code for r in merge.update_source(sources, counters, now()).where("last_fetched_at IS NOT NULL").collect()} == {"a"}
    leads = spark.createDataFrame([(1, " n ", "010-1234-5678", True, "r", "m", True), (2, "n", "12", True, "r", "m", True), (3, "n", "0101234567", True, "r", "m", False), (None, "", "0101234567", None, None, None, True)], "announcement_id int, name string, phone string, is_business boolean, region string, message string, consent boolean")
    assert [(r.announcement_id, r.name, r.phone) for r in merge.valid_leads(leads, now()).collect()] == [(1, "n", "01012345678")]
    known = merge.register_installations(spark.createDataFrame([], "installation_id string, token_hash string, platform string, app_version string"), spark.createDataFrame([("i", "t1", "android", "1", 0)], "installation_id string, token string, platform string, app_version string, arrival int"))
    again = merge.register_installations(known, spark.createDataFrame([("i", "t1", "android", "2", 0), ("j", "t", "android", "1", 1)], "installation_id string, token string, platform string, app_version string, arrival int"))
    wrong = merge.register_installations(again, spark.createDataFrame([("i", "bad", "android", "3", 0)], "installation_id string, token string, platform string, app_version string, arrival int"))
    assert {r.installation_id: r.app_version for r in wrong.collect()} == {"i": "2", "j": "1"}


# -- lists and feeds --------------------------------------------------------------------------------------------------


def numbered(spark, n):
    return spark.range(1, n + 1).select(
        "id", F.lit(1).alias("source_id"), F.concat(F.lit("t"), "id").alias("title"), F.lit("o").alias("organization"), F.array(F.lit(1)).alias("category_ids"), F.lit("전국").alias("region"),
        F.lit(None).cast("string").alias("target"), F.lit("s").alias("support_type"), F.lit("x").alias("summary"), F.lit(None).cast("date").alias("apply_start"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.date_add(today(), (F.col("id") % 4).cast("int"))).alias("apply_end"), F.lit("https://a.kr").alias("detail_url"), F.lit("open").alias("status"),
        F.expr("timestampadd(HOUR, cast(id div 2 as int), timestamp_ntz '2026-01-01 00:00:00')").alias("created_at"),
    )


@pytest.mark.parametrize("sort", ["latest", "deadline"])
def test_pages_make_up_the_list(spark, sort):
    view = numbered(spark, 23)
    pages = [[r.id for r in listing.list_page(view, ListParams(sort=sort, page=p, size=5)).collect()] for p in range(1, 6)]
    assert [i for p in pages for i in p] == [r.id for r in listing.ordered(view, sort).collect()]
    assert [r.id for r in listing.list_page(view, ListParams(sort=sort, page=99, size=5)).collect()] == pages[-1]


def test_keyset_pages_make_up_the_feed(spark):
    view, cursor, seen = numbered(spark, 23), None, []
    while True:
        rows = listing.keyset_page(view, "created_at", "id", 4, cursor).collect()
        seen += [r.id for r in rows[:4]]
        if len(rows) <= 4:
            break
        cursor = decode_cursor(encode_cursor(rows[3].created_at, rows[3].id))
    assert seen == [r.id for r in listing.ordered(view, "latest").collect()]


@given(st.datetimes(min_value=datetime(1990, 1, 1), max_value=datetime(2100, 1, 1)), st.integers(1, 2**53 - 1))
def test_cursors_round_trip(time, id_):
    stamp, back = decode_cursor(encode_cursor(time, id_))
    assert (datetime.fromisoformat(stamp), back) == (time, id_)


@pytest.mark.parametrize("bad", ["", "x", "e30", "bnVsbA", encode_cursor(datetime(2026, 1, 1), 0)])
def test_bad_cursors(bad):
    assert decode_cursor(bad) is None


def test_parameters():
    assert parse_feed_params({}) == FeedParams(None, 7, 100, None)
    assert parse_feed_params({"limit": "500", "deadlineWithinDays": "30", "since": "2026-07-12T09:00:00+09:00"}) == FeedParams("2026-07-12 00:00:00.000", 30, 100, None)
    for bad in ({"deadlineWithinDays": "31"}, {"limit": "0"}, {"limit": "x"}, {"since": "2026-07-12"}, {"cursor": "?"}):
        with pytest.raises(InvalidParam):
            parse_feed_params(bad)
    assert parse_open_params({"categories": "3,1,3", "user_region": " Seoul ", "limit": "900", "include_nationwide": "false"}) == ListParams(size=100, category_ids=[1, 3], recommendation_region=("서울", False))
    assert parse_open_params({"user_region": "nationwide"}) == ListParams(size=50)
    for bad in ({"page": "0"}, {"categories": "0"}, {"user_region": "x"}, {"include_nationwide": "yes"}):
        with pytest.raises(InvalidParam):
            parse_open_params(bad)
    assert (listing.positive(float("nan"), 4), listing.positive(2.9, 1), listing.positive(-3, 1), listing.search_pattern(" a,b% ")) == (4, 2, 1, "%a b %")


def test_notification_types(spark):
    view = numbered(spark, 4).withColumns({"source_key": F.lit("k"), "updated_at": F.col("created_at"), "created_at": F.when(F.col("id") == 1, F.lit("2026-07-11 00:00:00").cast("timestamp_ntz")).otherwise(F.col("created_at"))})
    view = view.withColumn("apply_end", F.when(F.col("id") == 2, F.lit("2026-07-18").cast("date")).when(F.col("id") == 4, F.lit("2026-07-13").cast("date"))).withColumn("status", F.when(F.col("id") == 4, F.lit("closed")).otherwise(F.lit("open")))
    got = listing.notification_feed(view, FeedParams(since="2026-07-10 00:00:00.000"), now())
    assert {r.id: r.notification_types for r in got.collect()} == {1: ["new"], 2: ["deadline"]}


def test_favorites(spark):
    rows = [(1, "2026-08-01", 5), (2, "bad", 9), (3, "2026-07-01", 1), (4, None, 7), (5, "2026-07-01", 2)]
    df = spark.createDataFrame(rows, "id int, apply_end string, favorited_at int")
    assert [r.id for r in listing.sort_favorites(df, "deadline").collect()] == [5, 3, 1, 2, 4]
    assert [r.id for r in listing.sort_favorites(df, "latest").collect()] == [2, 4, 1, 5, 3]
    owned = spark.createDataFrame([("a", 1, "t", "u/1"), ("a", 2, "t", "u/2"), ("b", 3, "t", "u/3"), ("b", 4, " ", "u/4")], "owner string, id int, title string, detail_url string")
    assert {r.owner for r in listing.favorites_or_none(owned, "u/").collect()} == {"a"}


def test_card_labels(spark):
    day = lambda s: F.lit(s).cast("date")
    cases = [(None, None), ("2026-07-20", "2026-07-30"), ("2026-07-01", "2026-07-12"), ("2026-07-01", "2026-07-11"), (None, "2026-07-13")]
    got = [spark.range(1).select(listing.card_dates(day(s), day(e), today()).alias("c")).select("c.*").first() for s, e in cases]
    assert [(r.reception_label, r.deadline_label) for r in got] == [(None, "상시/미정"), ("접수일 · 2026-07-20", "마감일 - 18"), ("접수중", "오늘 마감"), (None, "마감"), (None, "마감일 - 1")]


# -- recommendations and reports ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "user, target, expected",
    [
        ("job_seeker_worker", "근로자", "match"), ("job_seeker_worker", "중소기업", "conflict"), ("sme", "구직자", "conflict"), ("sme", "소상공인", "match"), ("sme", "법인 근로자", "match"),
        ("sme", "누구나", "match"), ("other", "근로자", "match"), ("?", "소상공인", "unknown"), ("sme", " ", "unknown"), ("sme", None, "unknown"),
    ],
)
def test_target_match(spark, user, target, expected):
    df = spark.createDataFrame([(target,)], "t string")
    assert df.select(recommend.target_match(user, F.col("t"))).first()[0] == expected


@pytest.mark.parametrize("user, region, expected", [("nationwide", None, "match"), ("seoul", None, "unknown"), ("seoul", "전국", "match"), ("seoul", "서울특별시", "match"), ("seoul", "부산", "conflict"), ("mars", "부산", "unknown"), ("seoul", "SEOUL", "match")])
def test_region_match(spark, user, region, expected):
    assert spark.createDataFrame([(region,)], "r string").select(recommend.region_match(user, F.col("r"))).first()[0] == expected
    assert REGION_CODES["seoul"] == "서울"


def test_recommend(spark):
    view = spark.createDataFrame([(1, [1, 3], "서울", "소상공인", "open"), (2, [1], "전국", None, "open"), (3, [2], "서울", "x", "open"), (4, [1], "부산", "x", "open"), (5, [1], "서울", "x", "closed"), (6, [1], None, "x", "open")], "id int, category_ids array<int>, region string, target string, status string")
    condition = recommend.Condition("sme", "seoul", ["finance_loan_guarantee", "startup_support", None, "?"])
    got = {r.id: (r.matched_category_ids, r.reasons, r.needs_review) for r in recommend.recommend(view, condition).collect()}
    assert got == {1: ([1, 3], ["관심 분야 일치", "지역 일치"], False), 2: ([1], ["관심 분야 일치", "지역 일치", "지원대상 확인 필요"], True), 6: ([1], ["관심 분야 일치", "지역 확인 필요"], True)}
    assert {r.id for r in recommend.recommend(view, condition, include_nationwide=False).collect()} == {1}
    assert recommend.recommend(view, recommend.Condition("sme", "seoul", ["startup_support"], False)).count() == 0


def test_mixed_sample_fills_up(spark):
    rows = [(i, "single_region", i % 2 == 0, i) for i in range(30)] + [(100 + i, "conflict", False, 100 + i) for i in range(3)]
    got = reports.mixed_sample(spark.createDataFrame(rows, "id int, kind string, is_open boolean, place int"), 20).collect()
    assert len(got) == 20
    assert sum(r.kind == "conflict" for r in got) == 3
    assert [r.id for r in got if r.turn == 0] == [0, 2, 4, 6, 8]


# -- the stream --------------------------------------------------------------------------------------------------------


def test_stream_merges_batches(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()

    def run():
        ingest_stream(spark, str(inbox), adapters.kstartup, str(tmp_path / "out"), str(tmp_path / "check"), now(), today()).awaitTermination()
        return {r.source_key: r.title for r in latest(spark, str(tmp_path / "out")).collect()}

    item = lambda key, name, end="20260801": json.dumps({"pbanc_sn": key, "biz_pbanc_nm": name, "pbanc_rcpt_end_dt": end})
    (inbox / "1.txt").write_text("\n".join([item(1, "a"), item(2, "b"), item(3, "old", "20260101")]))
    assert run() == {"1": "a", "2": "b"}
    (inbox / "2.txt").write_text("\n".join([item(2, "B"), item(4, "d")]))
    assert run() == {"1": "a", "2": "B", "4": "d"}


def test_similar_titles_shuffle_no_pairs(spark, monkeypatch):
    """Titles that are all alike: what goes on from the blocks grows with titles and their ends, not with pairs."""
    from noticeloom.operators import dedup

    made, real = [], dedup._ends_of_similar
    monkeypatch.setattr(dedup, "_ends_of_similar", lambda *a: made.append(real(*a).localCheckpoint()) or made[0])
    monkeypatch.setattr(dedup.blocks, "LEFT", 100_000)
    title = lambda c, i: f"a notice of support for every small enterprise in town {c}{chr(97 + i % 26)}{chr(97 + i // 26)}"
    c = spark.createDataFrame([(i, title("x", i), "2026-01-01" if i % 2 else "2026-02-02") for i in range(200)], "id long, title string, apply_end string").withColumn("apply_end", F.to_date("apply_end"))
    p = spark.createDataFrame([(title("y", i), "2026-01-01") for i in range(200)], "title string, apply_end string").withColumn("apply_end", F.to_date("apply_end"))
    found = dedup.preferred_duplicates(c, p).collect()
    assert sorted(r["id"] for r in found) == list(range(1, 200, 2)) and {r["how"] for r in found} == {"similar"}
    assert made[0].count() <= 200 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_titles_without_common_digits_are_not_compared(spark, monkeypatch):
    from noticeloom.operators import dedup

    seen = []
    plain = dedup._ends_of_similar
    monkeypatch.setattr(dedup, "_ends_of_similar", lambda titles, threshold: seen.append({r["canonical"] for r in titles.collect()}) or plain(titles, threshold))
    kinds = "id long, title string, apply_end date"
    mine = spark.createDataFrame([(1, "abcdefghij klmnop 17", None), (2, "abcdefghij klmnop 5", None), (3, "abcdefghij klmnopq", None)], kinds)
    known = spark.createDataFrame([(9, "abcdefghij klmnopq 17", None), (10, "abcdefghij klmnop 6", None)], kinds)
    found = dedup.preferred_duplicates(mine, known.select("title", "apply_end"))
    assert [(r.id, r.how) for r in found.collect()] == [(1, "similar")]
    assert seen == [{"abcdefghijklmnop17", "abcdefghijklmnopq17"}]


def test_similar_titles_are_sent_to_few_blocks(spark, monkeypatch):
    """What is shuffled grows with the titles where each length has few of them, not with the number of blocks of all."""
    from noticeloom.operators import dedup

    def sent(threshold, schema):
        return lambda theirs, own: pa.table({"key": ["x"], "end": pa.array([theirs.num_rows + own.num_rows], pa.int32())})

    monkeypatch.setattr(dedup, "_count_out", sent)
    monkeypatch.setattr(dedup.blocks, "LEFT", 50_000)
    monkeypatch.setattr(dedup.blocks, "RIGHT", 50_000)
    monkeypatch.setattr(dedup, "_ends_of_similar", lambda *a, f=dedup._ends_of_similar: made.append(f(*a)) or made[0])
    made = []
    titles = spark.range(1200).selectExpr("id", "repeat(chr(int(97 + id % 26)), int(12 * exp(id / 200))) AS title", "date '2026-01-01' AS apply_end")
    mine, known = titles.where("id % 2 = 0"), titles.where("id % 2 = 1")
    dedup.preferred_duplicates(mine, known.select("title", "apply_end"))
    assert 0 < sum(r["end"] for r in made[0].collect()) <= 5 * 1200


def test_similar_titles_equal_brute_force(spark, monkeypatch):
    """In blocks of a few titles, compared a few pairs at once; some titles are long, with digits, Hangul or the same bigram often."""
    from noticeloom.operators import dedup

    for name, n in (("SIDE", 7), ("LEAST_TITLES", 3), ("AT_ONCE", 10), ("COUNTED", 20), ("KINDS", 500)):
        monkeypatch.setattr(dedup, name, n, raising=False)
    rng, rows = random.Random(5), []
    for i in range(40):
        base = "".join(rng.choice("ab가나" if i % 3 else "abcdefgh가나다라") for _ in range(rng.choice([10, 11, 14, 30, 70, 70, 200, 2000 if i % 9 == 0 else 40]))) + "7" * (i % 2)
        for _ in range(6):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 8))):
                edited[rng.randrange(len(edited))] = rng.choice("abx가")
            rows.append(("".join(edited) + rng.choice(["", "", "z", "zz"]), rng.choice([None, date(2026, 1, 1), date(2026, 2, 2)])))
    mine, known = rows[::2], rows[1::2]

    def score(a, b):
        grams = lambda s: Counter(s[k : k + 2] for k in range(len(s) - 1))
        return 2.0 * (grams(a) & grams(b)).total() / (len(a) + len(b) - 2)

    def how(title, end):
        if any(title == t for t, _ in known):
            return "exact"
        near = (t for t, e in known if (end is None or e is None or end == e) and re.findall(r"\d+", t) == re.findall(r"\d+", title))
        return "similar" if any(score(title, t) >= dedup.FUZZY_DICE for t in near) else None

    c = spark.createDataFrame([(i, *r) for i, r in enumerate(mine)], "id int, title string, apply_end date")
    found = {r.id: r.how for r in dedup.preferred_duplicates(c, spark.createDataFrame(known, "title string, apply_end date")).collect()}
    expected = {i: how(*r) for i, r in enumerate(mine)}
    assert found == {i: h for i, h in expected.items() if h}
    assert {"exact", "similar", None} == set(expected.values())
