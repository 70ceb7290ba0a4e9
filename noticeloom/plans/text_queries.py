"""Queries over the domain's own texts: places, lines, emphasis, markup and titles, each with what SQL says must come of them.

Every event (or page) takes one of the forms below in turn, with its own id in it, so a query's work grows with its table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeloom.functions import text
from noticeloom.functions import values as V
from noticeloom.operators import lines, page_rules, region
from noticeloom.plans.bridge import table
from noticeloom.plans.register import query


def listed(values: list) -> str:
    """A list of texts in SQL; None is null."""
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def in_turn(values: list, id_: str = "event_id") -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(id_) % len(values) + 1).cast("int"))


def in_turn_sql(values: list, id_: str = "event_id") -> str:
    return f"{listed(values)}[{id_} % {len(values)} + 1]"


def with_id(form: Column, id_: str = "event_id", mark: str = "#") -> Column:
    """The mark in a form becomes the id."""
    return F.replace(form, F.lit(mark), F.col(id_).cast("string"))


def with_id_sql(form: str, id_: str = "event_id", mark: str = "#") -> str:
    return f"replace({form}, '{mark}', CAST({id_} AS VARCHAR))"


# -- places ----------------------------------------------------------------------------------------------------------------

NAMES = [(name, r) for tables in (region.ALIASES, region.PLACES) for r, names in tables.items() for name in names]


@query(f"SELECT event_id, {in_turn_sql([r for _, r in NAMES])} AS region, 'single_region' AS reason FROM events")
def region_names(spark, sf_dir):
    """Every name of a province, city, county or district, in brackets before a title."""
    title = F.concat(F.lit("["), in_turn([n for n, _ in NAMES]), F.lit("] 지원사업 공고"))
    none = F.lit(None).cast("string")
    made = table(spark, sf_dir, "events").select("event_id", title.alias("title"))
    return made.select("event_id", region.infer_region("title", none, none, none).alias("r")).select("event_id", "r.region", "r.reason")


#: Title, target, detail; region, reason.
EVIDENCE = [
    ("지원사업 공고 #", "전국 소재 중소기업", None, V.NATIONWIDE, "nationwide"),
    ("전국 방송 안내 #", None, None, V.UNKNOWN_REGION, "no_evidence"),
    ("공고 #", "지원대상: 부산광역시 소재 기업", None, "부산", "single_region"),
    ("수원시 소상공인 지원 #", None, None, "경기", "single_region"),
    ("[광주] 광주시 지원 #", None, None, "광주", "single_region"),
    ("광주시 지원 #", None, None, "경기", "single_region"),
    ("경기침체 극복 지원 #", None, None, V.UNKNOWN_REGION, "no_evidence"),
    ("(제주) 창업 지원 #", "도내 사업자", None, "제주", "single_region"),
    ("공고 #", None, "문의처: 서울특별시 소재 담당부서", V.UNKNOWN_REGION, "no_evidence"),
    ("[서울] 지원 #", "전국 소재 기업", None, V.UNKNOWN_REGION, "conflict_or_multiple"),
    ("[서울] 지원 #", "신청대상: 부산 소재 기업", None, V.UNKNOWN_REGION, "conflict_or_multiple"),
    ("공고 #", None, "<p>신청자격 : 전라남도&nbsp;소재 사업장</p>", "전남", "single_region"),
]


@query(f"SELECT event_id, {in_turn_sql([e[3] for e in EVIDENCE])} AS region, {in_turn_sql([e[4] for e in EVIDENCE])} AS reason FROM events")
def region_evidence(spark, sf_dir):
    made = table(spark, sf_dir, "events").select("event_id", *[with_id(in_turn([e[i] for e in EVIDENCE])).alias(c) for i, c in enumerate(("title", "target", "detail"))])
    found = made.select("event_id", region.infer_region("title", "target", F.lit(None).cast("string"), "detail").alias("r"))
    return found.select("event_id", "r.region", "r.reason")


# -- lines -----------------------------------------------------------------------------------------------------------------

#: A line, its kind, whether it warns, and its text without marks.
LINES = [
    ("사업 개요", "heading", False, "사업 개요"), ("창업지원", "subheading", False, "창업지원"), ("이 사업은 기업 #곳을 지원합니다.", "paragraph", False, "이 사업은 기업 #곳을 지원합니다."),
    ("", None, None, None), ("□ 항목 #", "item", False, "항목 #"), ("짧은 줄", "paragraph", False, "짧은 줄"), ("- 목록 #", "bullet", False, "목록 #"), ("※ 반드시 # 확인", "note", True, "반드시 # 확인"),
    ("☞ 안내 #", "note", False, "안내 #"), ("", None, None, None), ("https://a.kr/#", "paragraph", False, "https://a.kr/#"), ("", None, None, None), ("다음 제목", "heading", False, "다음 제목"),
]
KEPT = [(kind, warning, told) for _, kind, warning, told in LINES if kind]


@query(
    f"""SELECT event_id, CAST(i AS INTEGER) AS place, {listed([k for k, _, _ in KEPT])}[i + 1] AS kind, {listed([str(w) for _, w, _ in KEPT])}[i + 1] = 'True' AS warning, {with_id_sql(f"{listed([t for _, _, t in KEPT])}[i + 1]")} AS line
    FROM (SELECT event_id, unnest(range({len(KEPT)})) AS i FROM events)"""
)
def line_kinds(spark, sf_dir):
    """Headings, items, bullets, notes with warnings, and paragraphs, with empty lines between."""
    content = with_id(F.lit("\n".join(line for line, _, _, _ in LINES)))
    found = lines.text_lines(table(spark, sf_dir, "events").select("event_id", content.alias("content")), "content")
    return found.select("event_id", "place", "kind", "warning", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("line"))


@query("""SELECT event_id, CAST(i AS INTEGER) AS place, replace(['one #:true:false', 'two:true:false| three:false:false', 'four:false:true|five #:false:false', 'six:true:true|seven:true:false'][i + 1], '#', CAST(event_id AS VARCHAR)) AS segments
    FROM (SELECT event_id, unnest(range(4)) AS i FROM events)""")
def line_emphasis(spark, sf_dir):
    """Red and bold parts run across lines; empty lines count for them, and a close too many for nothing."""
    content = with_id(F.lit("[[em]]one #\ntwo[[/em]] three\n[[b]]\n□ four[[/b]]five #[[/b]]\n[[em]][[b]]six[[/b]]seven"))
    found = lines.text_lines(table(spark, sf_dir, "events").select("event_id", content.alias("content")), "content")
    one = lambda s: F.concat_ws(":", s["text"], s["red"].cast("string"), s["bold"].cast("string"))
    return found.select("event_id", "place", F.array_join(F.transform("segments", one), "|").alias("segments"))


# -- clearing --------------------------------------------------------------------------------------------------------------

#: A text, as shown, as an adapter strips it, as a detail field is cleaned.
CLEARED = [
    ("&#x41;&#66;&#9999999;&nbsp;x §", "AB&#9999999; x §", "&#x41;&#66;&#9999999;&nbsp;x §", "AB&#9999999; x §"),
    ("a😀  b §", "a b §", "a😀 b §", "a b §"),
    ("?? 안내 §?", "안내 §", "?? 안내 §?", "안내 §"),
    ("§ 신청할까??", "§ 신청할까?", "§ 신청할까??", "§ 신청할까?"),
    ("<p>가 §</p> 나", "가 §\n나", "가 §\n나", "가 §\n나"),
    ("&amp;lt;b&amp;gt;x §", "x §", "x §", "x §"),
    ("a<br/>b §</p>c<b>d</b>", "a\nb §\nc d", "a\nb §\nc d", "a\nb §\nc d"),
    (" § ", "§", "§", "§"),
]


@query("SELECT event_id, " + ", ".join(f"{with_id_sql(in_turn_sql([t[i] for t in CLEARED]), mark='§')} AS {c}" for i, c in ((1, "shown"), (2, "stripped"), (3, "cleaned"))) + " FROM events")
def cleared_texts(spark, sf_dir):
    """Entities, tags, emoji, white space and stray question marks, for display, from an adapter, and of a detail field."""
    given = table(spark, sf_dir, "events").select("event_id", with_id(in_turn([c[0] for c in CLEARED]), mark="§").alias("t"))
    return given.select("event_id", *[text.once(F.col("t"), f).alias(c) for f, c in ((text.sanitize, "shown"), (text.strip_html, "stripped"), (text.clean_text, "cleaned"))])


#: A title, and its forms in the view and in ingest.
TITLES = [
    ("［2026년도］ ＡＢ-c ㄱ #", "2026년도c#", "2026년abc#"),
    ("[공고] A (b) 「c」- #", "공고abc#", "공고abc#"),
    ("수출 ① 바우처 ㎏ #", "수출바우처#", "수출1바우처kg#"),
]


@query(f"SELECT event_id, {with_id_sql(in_turn_sql([t[1] for t in TITLES]))} AS of_view, {with_id_sql(in_turn_sql([t[2] for t in TITLES]))} AS of_ingest FROM events")
def folded_titles(spark, sf_dir):
    """Compatibility forms stay apart in the view and are folded by ingest."""
    title = with_id(in_turn([t[0] for t in TITLES]))
    made = table(spark, sf_dir, "events").select("event_id", title.alias("t"))
    return made.select("event_id", text.view_title(F.col("t")).alias("of_view"), text.dedup_title(F.col("t")).alias("of_ingest"))


# -- pages -----------------------------------------------------------------------------------------------------------------

BODY = "본문입니다. 이 안내문 #은 스무 글자를 넘습니다."


def board_file(call: str, name: str) -> str:
    return f"<li><a class='ico_file_hwp'>{name}</a><div class='down_btn'><a onclick=\"{call}\">받기</a></div></li>"


def section(title: str, body: str) -> str:
    return f"<div class='information_list x'><p class='title'>{title}</p><ul><li class='dot_list'>{body}</li></ul></div>"


#: Source, page; text, method of application, files, reason.
PAGES = [
    ("bizinfo", f"<body><nav>menu</nav><div class='board_view'><h2>제목 #</h2><p>{BODY}</p><script>x()</script></div><div id='contents'>other</div></body>", f"제목 #\n{BODY}", None, "", None),
    ("kstartup", section("신청방법 및 대상", "온라인으로 신청하십시오 #") + section("문의처", "02-#"), "신청방법 및 대상\n온라인으로 신청하십시오 #\n\n문의처\n02-#", "온라인으로 신청하십시오 #", "", None),
    ("mss", f"<main>{BODY}<a href='/f/#.pdf'>공고문 다운로드</a><a href='/page'>쪽</a></main>", f"{BODY}공고문 다운로드쪽", None, "공고문|https://h.kr/f/#.pdf", None),
    ("mois", f"<div class='tab-content'>짧음</div><article>{BODY}<br>둘째 줄</article>", f"{BODY}\n둘째 줄", None, "", None),
    ("msit", "<ul class='down_file'>" + board_file("fn_download('#','1','hwp')", " 가  나 ") + board_file("other()", "no") + f"</ul><div class='view_cont'>{BODY}</div>", BODY, None, "가 나|/api/attachments/msit?nttSeqNo=77&atchFileNo=#&fileOrd=1", None),
    ("kstartup", "<div></div>", "", None, "", V.EMPTY_SHELL),
    ("kstartup", "<input type='password'>", "", None, "", V.LEGACY_EMPTY),
    ("bizinfo", f"<main>{BODY} <span style='color:#f00'>빨강 <b>굵게</b></span> <strong>굵게</strong></main>".replace("color:#f00", "color:red"), f"{BODY} [[em]]빨강 굵게[[/em]] [[b]]굵게[[/b]]", None, "", None),
]


@query(
    f"""SELECT page_id, {with_id_sql(in_turn_sql([p[2] for p in PAGES], "page_id"), "page_id")} AS detail_content, {with_id_sql(in_turn_sql([p[3] for p in PAGES], "page_id"), "page_id")} AS apply_method,
    {with_id_sql(in_turn_sql([p[4] for p in PAGES], "page_id"), "page_id")} AS files, {in_turn_sql([p[5] for p in PAGES], "page_id")} AS reason FROM pages"""
)
def page_sources(spark, sf_dir):
    """Pages of each source's making: places of the text, sections, emphasis, files of both kinds, empty shells."""
    page = with_id(in_turn([p[1] for p in PAGES], "page_id"), "page_id")
    made = table(spark, sf_dir, "pages").select("page_id", page.alias("html"), F.lit("https://h.kr/view.do?nttSeqNo=77").alias("url"))
    parsed = page_rules.parse_pages(made, in_turn([p[0] for p in PAGES], "page_id")).select("page_id", "detail.*")
    files = F.array_join(F.transform("attachments", lambda a: F.concat_ws("|", a["label"], a["url"])), ";")
    return parsed.select("page_id", "detail_content", "apply_method", files.alias("files"), "reason")
