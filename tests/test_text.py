"""Column functions against examples and against plain Python."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticeloom.functions import dates, text
from noticeloom.operators import region


def values(spark, function, given_values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given_values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_trim_and_first_text(spark):
    assert values(spark, text.trimmed, ["　 a b﻿ ", "", None, " \t"]) == ["a b", "", None, ""]
    df = spark.createDataFrame([(" ", " x "), (None, None), ("a", "b")], "a string, b string")
    assert [r[0] for r in df.select(text.first_text(F.col("a"), F.col("b"))).collect()] == ["x", None, "a"]


def test_strip_html_decodes_ampersands_first(spark):
    assert values(spark, text.strip_html, ["a<br/>b</p>c<b>d</b>", "&amp;lt;b&amp;gt;x", "", None]) == ["a\nb\nc d", "x", None, None]


def test_sanitize(spark):
    given_values = ["&#x41;&#66;&#9999999;&nbsp;x", "a😀  b", "?? 안내?", "신청할까??", "신청 가능 ?", "<p>가</p> 나", None, "", "&#xD800;"]
    assert values(spark, text.sanitize, given_values) == ["AB&#9999999; x", "a b", "안내", "신청할까?", "신청 가능", "가\n나", None, "", "&#xD800;"]


def test_three_title_forms_differ(spark):
    title = "［2026년도］ ＡＢ-c ㄱ"
    assert values(spark, text.view_title, [title]) == ["2026년도c"]
    assert values(spark, text.dedup_title, [title]) == ["2026년abc"]
    assert values(spark, text.hash_form, ["[공고] A (b) 「c」-"]) == ["공고abc-"]


def test_digit_signature(spark):
    assert values(spark, text.digit_signature, ["2026년 3차 12", "없음", None]) == ["2026|3|12", "", None]


def plain_dice(a, b):
    if a is None or b is None:
        return None
    if a == b or len(a) < 2 or len(b) < 2:
        return float(a == b)
    pairs = [Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b)]
    return 2 * sum((pairs[0] & pairs[1]).values()) / (len(a) + len(b) - 2)


def test_dice_counts_multisets(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("가나다ab 😀\n") for _ in range(r.randint(0, 12)))
    rows = [(word(), word()) for _ in range(300)] + [(None, "ab"), ("ab", None), ("aaaa", "aa"), ("aa", "aa"), ("", ""), ("a", "a"), ("ab" * 3000, "ba" * 3000)]
    for a, b, score, back in spark.createDataFrame(rows, "a string, b string").select("a", "b", text.dice(F.col("a"), F.col("b")), text.dice(F.col("b"), F.col("a"))).collect():
        assert score == back == (None if a is None or b is None else pytest.approx(plain_dice(a, b)))


def test_bigrams_are_numbered(spark):
    assert values(spark, text.bigrams, ["aaab", "a", "", None, "😀b"]) == [["aa1", "aa2", "ab1"], [], [], None, ["😀b1"]]


def test_urls(spark):
    assert values(spark, text.http_url, ["www.a.kr/x", " https://b.kr ", "ftp://c", "text", None]) == ["https://www.a.kr/x", "https://b.kr", None, None, None]
    assert values(spark, lambda c: text.host_in(c, ["mss.go.kr"]), ["https://www.mss.go.kr/a", "https://mss.go.kr", "https://xmss.go.kr", None]) == [True, True, False, False]
    assert values(spark, text.private_host, ["localhost", "10.1.2.3", "172.20.0.1", "172.40.0.1", "a.kr"]) == [True, True, True, False, False]


def test_dates(spark):
    assert [str(v) for v in values(spark, dates.to_date, ["2026.01.02", "20260231", "2026", None, "2026-13-01"])] == ["2026-01-02", "None", "None", "None", "None"]
    start, end = dates.parse_range(F.col("v"))
    df = spark.createDataFrame([("20240101 ~ 20240131",), ("2026.01.01.~2026.12.31.",), ("2026-01-01 - 2026-02-01",), ("상시",)], "v string")
    assert [tuple(map(str, r)) for r in df.select(start, end).collect()] == [("2024-01-01", "2024-01-31"), ("2026-01-01", "2026-12-31"), ("2026-01-01", "2026-02-01"), ("None", "None")]
    assert values(spark, lambda c: dates.seoul_date(c.cast("timestamp_ntz")).cast("string"), ["2026-07-12 14:59:59", "2026-07-12 15:00:00"]) == ["2026-07-12", "2026-07-13"]


MANY = 1_000_000


@pytest.mark.parametrize("mass", ["?", " ", "<", "\n", "? ", "<?", "&lt;", "\n ", "&#", "&amp;", "<br ", "\u3000?\n"])
def test_masses_of_one_mark(spark, mass):
    """A million marks in a text, at its ends or within it, take seconds and no stack."""
    masses = mass * (MANY // len(mass))
    given_values = [masses, f"a{masses}b", f"{masses}a", f"a{masses}", f"{masses}a>b"]
    functions = (text.sanitize, text.clean_text, text.strip_html, text.trimmed, text.hash_form, text.dedup_title)
    began = time.time()
    df = spark.createDataFrame([(v,) for v in given_values], "v string").repartition(4)
    found = df.select(*[F.length(f(F.col("v"))).alias(f.__name__) for f in functions]).collect()
    assert len(found) == 5 and time.time() - began < 60


def plain_untagged(t):
    return re.sub("<[^>]+>", " ", re.sub("(?i)</p>", "\n", re.sub(r"(?i)<br\s*/?>", "\n", t)))


def plain_edges(t):
    return re.sub(rf"^(?:\?[{text.BLANKS}]*)+", "", t)


def test_clearing_equals_plain_rules(spark):
    rng = random.Random(6)
    given_values = ["".join(rng.choice(["<", ">", "a", "?", " ", "<br>", "</P>", "\n", "\u3000", "<b x>"]) for _ in range(rng.randrange(14))) for _ in range(400)]
    assert values(spark, text.untagged, given_values) == [plain_untagged(v) for v in given_values]
    leading = values(spark, text.strip_question_marks, [f"{v}x" for v in given_values])
    assert leading == [plain_edges(f"{v}x") for v in given_values]
    trailing = values(spark, text.strip_question_marks, [f"x{v}" for v in given_values])
    assert trailing == [re.sub(rf"[?{text.BLANKS}]+$", "", f"x{v}") if v.endswith("?") else f"x{v}" for v in given_values]
    assert values(spark, text.trimmed, given_values) == [v.strip(text.BLANKS) for v in given_values]


def test_lines_and_folded_texts_are_held_a_few_at_a_time():
    """A batch of many or long texts is given back in slices that don't grow with it."""
    import pyarrow as pa

    from noticeloom.operators import lines

    texts = pa.array(["one\n- two"] * 3000 + [None, "", "x" * 2_000_000, "three"])
    parts = list(lines._lines(iter([pa.concat_arrays([texts] * 40)])))
    assert len(parts) > 40 and sum(map(len, parts)) == 40 * len(texts)
    assert [[line["kind"] for line in told or []] for told in parts[0].slice(0, 1).to_pylist()] == [["heading", "bullet"]]
    folded = list(text.nfkc.func(iter([texts])))
    assert max(map(len, folded)) <= text.NFKC_TEXTS and pa.concat_arrays(folded).equals(texts)


def test_rows_of_equal_texts_are_told_once(monkeypatch):
    told = []
    plain = region.RegionInference.infer
    monkeypatch.setattr(region.RegionInference, "infer", lambda self, *texts: told.append(texts) or plain(self, *texts))
    none = pa.nulls(900, pa.string())
    (found,) = region._infer(iter([(pa.array(["[서울] a", "구로구로구 군위군위군", None] * 300), none, none, none)]))
    assert len(told) == 3 and [f["region"] for f in found.to_pylist()] == ["서울", "미확인", "미확인"] * 300
    assert [(p.start, p.end, p.region) for p in region.Gazetteer().places("구로구로구 군위군위군")] == [(0, 3, "서울"), (6, 9, "대구")]
