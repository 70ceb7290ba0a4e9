"""Pages, lines and regions against examples."""

from __future__ import annotations

import random
import resource
import time

import pytest
from pyspark.sql import functions as F

from noticeloom.operators.html import BLOCKS, Limits, Page, Tree, cleared, decode_html, emphasis, is_red, page_has_file, proxied_file, squeezed
from noticeloom.operators.lines import classify_lines, text_lines
from noticeloom.operators.page_rules import parse_pages
from noticeloom.operators.region import RegionInference, infer_region
from tests.plain_pages import attachments, main_text, page_detail

INFER = RegionInference()


def detail(html, url="https://www.msit.go.kr/view.do?nttSeqNo=77", source=None):
    return page_detail(html, url, source)


def test_main_text_skips_what_is_not_content():
    page = "<body><nav>menu menu menu menu menu</nav><div id='contents'><p>첫 문단입니다. 내용이 있습니다.<p>둘째<br>줄</p><script>x()</script><div style='display:none'>no</div></div></body>"
    assert main_text(cleared(Tree(page).root), ["#contents"]) == "첫 문단입니다. 내용이 있습니다.\n둘째\n줄"


def test_short_matches_fall_through_to_the_body():
    assert main_text(cleared(Tree("<body><main>짧음</main><p>본문</p></body>").root), ["main"]) == "짧음본문"


def test_emphasis_marks_the_outermost():
    page = "<p>a <span style='color:#ff0000'>b <b>c</b></span> <strong>d</strong> <font color='blue'>e</font></p>"
    assert Page(Tree(page).root).text(0) == "a [[em]]b c[[/em]] [[b]]d[[/b]] e"
    assert [is_red(c) for c in ("RED", "#f00", "rgb(160, 96, 96)", "rgb(159,0,0)", "#ff6161", "")] == [True, True, True, False, False, False]


def test_sections():
    block = lambda t, b: f"<div class='information_list x'><p class='title'>{t}</p><ul><li class='dot_list'>{b}</li></ul></div>"
    d = detail("<body>" + block("신청방법 및 대상", "온라인으로 신청하십시오 전체") + block("문의처", "02-000") + "</body>", source="kstartup")
    assert (d["apply_method"], d["documents"], d["contact"]) == ("온라인으로 신청하십시오 전체", None, "02-000")
    assert d["detail_content"] == "신청방법 및 대상\n온라인으로 신청하십시오 전체\n\n문의처\n02-000"


def test_attachments():
    page = """<a href="/f/a.pdf">공고문 다운로드</a><a href="/f/a.pdf">again</a><a href="#x.pdf">no</a><a href="javascript:f()">no</a><a href="/page">no</a>
    <a href="http://10.0.0.1/b.hwp">no</a><a href="http://u:p@h.kr/b.hwp">no</a><a href="/x" download title="신청서.hwp">다운로드</a><li><a class="file_bg">이름.zip</a><a href="/download?id=1">다운로드</a></li>"""
    assert attachments(Page(Tree(page).root), "https://h.kr/v") == [
        {"label": "공고문", "url": "https://h.kr/f/a.pdf"}, {"label": "신청서.hwp", "url": "https://h.kr/x"}, {"label": "이름.zip", "url": "https://h.kr/download?id=1"},
    ]


def test_numbered_files():
    li = lambda call, name: f"<li><a class='ico_file_hwp'>{name}</a><div class='down_btn'><a onclick=\"{call}\">받기</a></div></li>"
    page = "<ul class='down_file'>" + li("fn_download('12','1','hwp')", " 가  나 ") + li("fn_download('12','1','hwp')", "again") + li("fn_download('12','2','pdf')", "") + li("other()", "no") + "</ul><p>" + "본문 " * 10 + "</p>"
    assert detail(page, source="msit")["attachments"] == [
        {"label": "가 나", "url": "/api/attachments/msit?nttSeqNo=77&atchFileNo=12&fileOrd=1"}, {"label": "첨부파일 2", "url": "/api/attachments/msit?nttSeqNo=77&atchFileNo=12&fileOrd=2"},
    ]


@pytest.mark.parametrize("page, reason", [("", "empty_shell_200"), ("<input type=password>", "본문 없음"), ("<iframe></iframe>", "본문 없음"), ("<div id=root></div>", "본문 없음"), ("<a href='/f.zip'>f</a>", "본문 없음"), ("<p>" + "본문 " * 10, None)])
def test_empty_shells(page, reason):
    assert detail(page, source="kstartup")["reason"] == reason


def test_pages_in_spark(spark):
    df = spark.createDataFrame([("u", "<p>x</p>"), ("u", "<p>x</p><!-- -->"), (None, None), ("u", "<<<>>&#xD800;" * 50)], "url string, html string")
    rows = parse_pages(df).collect()
    assert len(rows) == 4
    assert rows[0].detail_content_hash == rows[1].detail_content_hash


@pytest.mark.parametrize("tag", ["option", "font", "a", "center", "span", "b", "div"])
def test_deep_pages(tag):
    text = detail(f"<main>한글 본문 스무 글자를 넘는 안내 문장입니다. {f'<{tag}>x' * 3000}</main>")["detail_content"]
    assert text.count("x") == 3000


def test_options_end_each_other():
    root = Tree("<select><option>a<option>b<optgroup><option>c<optgroup><option>d</select>").root
    assert [Page(root).raw_text(i) for i in Page(root).select("option")] == ["a", "b", "c", "d"]


def kinds(text):
    return [x["kind"] for x in classify_lines(text)]


def test_line_kinds():
    assert kinds("사업 개요\n창업지원\n이 사업은 창업 기업을 지원합니다.\n\n□ 항목\n짧은 줄\n- 목록\n※ 반드시 확인") == ["heading", "subheading", "paragraph", "item", "paragraph", "bullet", "note"]
    assert kinds("기관명\n\n창업진흥원\n\n다음") == ["heading", "subheading", "heading"]
    assert kinds("2026.01\n없음\nhttp://a") == ["paragraph"] * 3
    assert classify_lines("※ 반드시")[0]["warning"] is True
    assert classify_lines(None) == []


def test_emphasis_runs_across_lines():
    lines = classify_lines("[[em]]하나\n둘[[/em]] 셋\n[[b]]\n□ 넷[[/b]]다섯")
    assert [[(s["text"], s["red"], s["bold"]) for s in x["segments"]] for x in lines] == [[("하나", True, False)], [("둘", True, False), (" 셋", False, False)], [("넷", False, True), ("다섯", False, False)]]


def test_lines_in_spark(spark):
    df = spark.createDataFrame([(1, "가나\n- 다"), (2, None), (3, "")], "id int, t string")
    assert [(r.id, r.place, r.kind) for r in text_lines(df, "t").orderBy("id", "place").collect()] == [(1, 0, "heading"), (1, 1, "bullet")]


def region(title=None, target=None, summary=None, detail=None):
    r = INFER.infer(title, target, summary, detail)
    return r["region"], r["reason"]


@pytest.mark.parametrize(
    "given, expected",
    [
        ({"title": "지원사업 공고", "target": "전국 소재 중소기업"}, ("전국", "nationwide")),
        ({"title": "전국 방송 안내"}, ("미확인", "no_evidence")),
        ({"title": "공고", "target": "지원대상: 부산광역시 소재 기업"}, ("부산", "single_region")),
        ({"title": "수원시 소상공인 지원"}, ("경기", "single_region")),
        ({"title": "[광주] 광주시 지원"}, ("광주", "single_region")),
        ({"title": "광주시 지원"}, ("경기", "single_region")),
        ({"title": "경기침체 극복 지원"}, ("미확인", "no_evidence")),
        ({"title": "(제주) 창업 지원", "target": "도내 사업자"}, ("제주", "single_region")),
        ({"title": "공고", "detail": "문의처: 서울특별시 소재 담당부서"}, ("미확인", "no_evidence")),
        ({"title": "[서울] 지원", "target": "전국 소재 기업"}, ("미확인", "conflict_or_multiple")),
        ({"title": "[서울] 지원", "target": "신청대상: 부산 소재 기업"}, ("미확인", "conflict_or_multiple")),
        ({}, ("미확인", "no_evidence")),
    ],
)
def test_regions(given, expected):
    assert region(**given) == expected


def test_regions_in_spark(spark):
    df = spark.createDataFrame([("[서울] 지원", None, None), (None, None, None)], "t string, a string, s string")
    assert [r[0].region for r in df.select(infer_region("t", "a", "s", F.lit(None).cast("string"))).collect()] == ["서울", "미확인"]


ODD = [
    ("<![foo[x]]> the text of this page goes on and on", "the text of this page goes on and on"),
    ("<p>the text before a section that never ends <![foo[", "the text before a section that never ends"),
    ("<font color='rgb(" + "9" * 5000 + ",1,1)'>the text in a colour that is none</font>", "the text in a colour that is none"),
    ("<![if !x]>a conditional part of a page<![endif]>", "a conditional part of a page"),
]


@pytest.mark.parametrize("page, text", ODD)
def test_odd_markup_gives_a_row(page, text):
    assert detail(page, "http://[bad", "msit")["detail_content"] == text


@pytest.mark.parametrize("page", ["<div class='content'>" * 100_000 + "deep text that is long enough" + "</div>" * 100_000 + "<p>after</p>", "<p>a" * 100_000, "<li><a download href='/f'>download</a>" * 20_000, "x" * 20_000_000])
def test_deep_and_long_pages_take_seconds(page):
    began = time.time()
    found = detail(page)
    assert time.time() - began < 60
    assert len(found["detail_content"]) <= 200_000
    if "after" in page:
        assert "deep text that is long enough" in found["detail_content"] and found["detail_content"].endswith("after")


def test_limits_are_parameters():
    page = "<main>" + "".join(f"<a href='/{i}.pdf'>file {i}</a>" for i in range(60)) + "</main>"
    assert len(detail(page)["attachments"]) == 50
    wide = page_detail(page, "https://h.kr/", None, Limits(text=10, files=100, label=4))
    assert (len(wide["attachments"]), wide["attachments"][0]["label"], len(wide["detail_content"])) == (60, "file", 10)


def test_charsets():
    page = "<meta charset='euc-kr'><p>한국</p>"
    assert decode_html(page.encode("cp949")) == page
    assert decode_html("한국".encode("cp949"), "text/html; charset=KS_C_5601-1987") == "한국"
    assert decode_html("한국".encode(), "text/html; charset=nonsense") == "한국"
    assert decode_html(b"a\xffb") == "a\ufffdb"
    assert decode_html("\ufeffx".encode()) == "x"
    assert decode_html(None) is None


def test_pages_as_bytes_and_nulls(spark):
    page = "<main>충분히 긴 본문이 여기에 있습니다. 그리고 더 있습니다.</main>"
    rows = [(1, "https://h.kr/", page.encode("cp949"), "text/html; charset=euc-kr"), (2, None, None, None), (3, "https://h.kr/", b"\x00\xff\xfe", "charset=utf-16")]
    df = spark.createDataFrame(rows, "page_id int, url string, html binary, content_type string")
    found = {r["page_id"]: r["detail"] for r in parse_pages(df).collect()}
    assert found[1]["detail_content"] == "충분히 긴 본문이 여기에 있습니다. 그리고 더 있습니다."
    assert found[2]["reason"] and found[3]["reason"]


def test_proxied_files():
    assert proxied_file("/api/attachments/msit?fileOrd=1&nttSeqNo=3&atchFileNo=%202") == "/api/attachments/msit?nttSeqNo=3&atchFileNo=2&fileOrd=1"
    for bad in (None, "", "/api/attachments/msit", "/api/attachments/msit?nttSeqNo=3", "/api/attachments/msit?nttSeqNo=3&atchFileNo=x&fileOrd=1", "/other?nttSeqNo=3&atchFileNo=2&fileOrd=1", "//h/api/attachments/msit?nttSeqNo=3&atchFileNo=2&fileOrd=1"):
        assert proxied_file(bad) is None
    assert page_has_file("<a onclick=\"FN_download('12', '1', 'hwp')\">", "12", "1")
    assert not page_has_file("<a onclick=\"fn_download('12', '1', 'hwp')\">", "12", "2") and not page_has_file("", "x", "1")


# -- large and nested pages --------------------------------------------------------------------------------------------------

MASSES = {
    "links": "<div>" + "<a href='/f/{0}.pdf'>다운로드</a>" * 100_000 + "</div>",
    "nested views": "<div class='board_view'>" * 500 + "가나다라마 " * 40_000 + "</div>" * 500,
    "nested lists": "<div class='information_list'><p class='title'>t</p>" * 500 + "<ul class='dot_list'>x</ul>" * 50_000 + "</div>" * 500,
    "nested links": "<a href='/download'>" * 500 + "x " * 500_000,
    "buttons": "<ul class='down_file'><li><div class='down_btn'>" * 250 + "<a onclick=\"fn_download('1','2','hwp')\">x</a>" * 20_000,
    "emphasis": "<b style='color:red'>" * 500 + "<i>y</i>" * 100_000,
    "empty blocks": "<div class='board_view'>" * 300 + "<p></p>" * 100_000,
    "rows": "<li><div>" * 250 + "<a href='/x.pdf'></a>" * 50_000 + "<a class='file_bg'>name</a>",
}


@pytest.mark.parametrize("name", list(MASSES))
@pytest.mark.parametrize("source", ["bizinfo", "kstartup", "msit"])
def test_large_pages_take_seconds(name, source):
    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = page_detail(MASSES[name], "https://h.kr/v?nttSeqNo=7", source)
    assert time.time() - began < 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < before + 300_000
    assert len(found["detail_content"]) <= 200_000 and len(found["attachments"]) <= 50


def plain_text(node, marked=False):
    """Text of a node by plain recursion."""
    out = ""
    for c in node.children:
        if isinstance(c, str):
            out += c
        elif c.name == "br":
            out += "\n"
        else:
            raw = lambda n: "".join(x if isinstance(x, str) else raw(x) for x in n.children)
            marks = None if marked or not raw(c).strip() else emphasis(c)
            out += (marks[0] if marks else "") + plain_text(c, marked or marks is not None) + (marks[1] if marks else "") + ("\n" if c.name in BLOCKS else "")
    return out


def test_flat_pages_equal_plain_recursion():
    rng = random.Random(12)
    tags = ["div", "p", "b", "span style='color:red'", "span", "li", "br", "strong", "i class='x'", "section id='y'"]
    for _ in range(300):
        html = "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(['div', 'p', 'b', 'span', 'li', 'i'])}>", "text ", " ", "\n"]) for _ in range(40))
        page = Page(Tree(html).root)
        for i, node in enumerate(page.nodes):
            assert page.text(i) == squeezed(plain_text(node))
        for selector, holds in ((".x", lambda n: "x" in n.classes), ("#y", lambda n: n.attributes.get("id") == "y"), ("b", lambda n: n.name == "b")):
            assert page.select(selector) == [i for i, n in enumerate(page.nodes) if i and holds(n)]


ROWS = [
    "<ul class='down_file'><li><a class='x ico_file_hwp'> a  b </a><div class='down_btn'><a onclick=\"fn_download('1','2','hwp')\">받기</a></div></li><li><div class='down_btn'><a onclick=\"fn_download('1','2','hwp')\">again</a></div></li><li><div class='down_btn'><a onclick=\"fn_download('3','4','pdf')\">z</a></div></li></ul>",
    "<tr><td><a class='file_bg' href='#'> 이름.hwp </a></td><td><a href='/f/1.hwp'>다운로드</a><a href='/f/2' title='제목' download>바로보기</a></td></tr>",
    "<a href='http://10.0.0.1/a.pdf'>x.pdf</a><a href='http://u:p@h.kr/a.pdf'>x</a><a href=' //h.kr/b.zip '>[첨부파일] 안내 다운로드</a><a href='javascript:x'>f</a><a href='#file'>f</a><a href='http://[bad/a.pdf'>x</a>",
    "<div class='information_list'><p class='title'>신청방법 및 대상</p><ul><li class='dot_list'>온라인 <b>신청</b></li><li class='dot_list'>방문</li></ul></div><div class='information_list'><p class='title'></p>x</div><div class='information_list'><p class='title'>문의처</p>02</div>",
    "<div class='board_view'>짧음</div><div class='view_cont'>스무 글자를 넘는 본문이 여기에 있습니다. 그렇습니다.<br>둘<p>셋</p></div><div class='view_cont'>또 하나의 스무 글자를 넘는 본문이 여기에 있습니다.</div>",
    "<iframe></iframe>", "<input type='password'>", "<div id='app'></div>", "", None, "plain text only", "<body>  <nav>menu</nav>본문 <font color='red'>빨강</font></body>", "<main>" + "긴 글 " * 100_000 + "</main>",
]


def test_rules_equal_a_plain_version(spark):
    rng = random.Random(21)
    tags = ["div class='board_view'", "p", "b", "span style='color:red'", "a href='/x/{}.pdf'", "li", "br", "a class='file_bg'", "div class='information_list'", "p class='title'", "li class='dot_list'", "div class='down_btn'", "ul class='down_file'", "main", "article", "a href='/download?i={}' title='다운로드'", "a onclick=\"fn_download('{}','1','hwp')\"", "td", "tr"]
    made = ["".join(rng.choice([f"<{rng.choice(tags)}>".replace("{}", str(rng.randrange(4))), f"</{rng.choice(['div', 'p', 'a', 'li', 'ul', 'tr'])}>", "글 text ", " ", "\n", "다운로드"]) for _ in range(60)) for _ in range(150)]
    real = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    sources = ["bizinfo", "kstartup", "mss", "mois", "msit", "other", None]
    rows = [(n, h, "https://h.kr/a/view.do?nttSeqNo=77", s) for n, (h, s) in enumerate((h, s) for h in [*ROWS, *made[:60], *real[:5]] for s in sources)]
    rows += [(len(rows) + n, h, u, "msit") for n, (h, u) in enumerate((h, u) for h in made[60:] for u in ("https://h.kr/v?nttSeqNo=x", None, "not an address"))]
    found = parse_pages(spark.createDataFrame(rows, "n int, html string, url string, source string").repartition(4), F.col("source")).collect()
    assert len(found) == len(rows)
    for r in found:
        plain = page_detail(r["html"], r["url"], r["source"])
        assert r["detail"].asDict(recursive=True) == plain, (r["html"], r["source"])


def test_rules_on_large_pages(spark):
    rows = [(h, "https://h.kr/v?nttSeqNo=7", s) for h in MASSES.values() for s in ("bizinfo", "kstartup", "msit")]
    began = time.time()
    found = parse_pages(spark.createDataFrame(rows, "html string, url string, source string").repartition(len(rows)), F.col("source"))
    sizes = found.select(F.length("detail.detail_content"), F.size("detail.attachments")).collect()
    assert len(sizes) == len(rows) and all(a <= 200_000 and b <= 50 for a, b in sizes)
    assert time.time() - began < 240


def test_pages_are_held_a_few_at_a_time(spark):
    """A batch of pages is given back in slices that don't grow with it."""
    import pyarrow as pa

    from noticeloom.operators import html, lines

    pages = pa.array([f"<main><p>page {i}</p>{'text ' * 20_000}</main>" for i in range(60)] + [None])
    parts = list(html.flat_pages().func(iter([pages])))
    assert len(parts) >= 5 and sum(map(len, parts)) == len(pages)
    assert max(map(len, parts)) * 100_000 <= lines.HELD
