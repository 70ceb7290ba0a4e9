"""A whole ingest, deep pages, null keys, recommendations in pages, and the entry, on small examples."""

from __future__ import annotations

import json
import subprocess
import sys
from collections import Counter
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noticeloom.functions import scratch
from noticeloom.operators import ingest, listing, merge, recommend, reports
from noticeloom.operators.listing import ListParams
from noticeloom.plans.bridge import now, today
from noticeloom.sources import adapters

ROOT = Path(__file__).resolve().parent.parent
BEFORE = datetime(2026, 1, 1)


def page(*items):
    return json.dumps({"items": list(items)}, ensure_ascii=False)


def xml_page(*items):
    return "<items>" + "".join(f"<item><title>{t}</title><itemId>{k}</itemId><dataContents>x</dataContents><applicationEndDate>{e}</applicationEndDate></item>" for k, t, e in items) + "</items>"


def run(spark, pages, only=None):
    kept = adapters.kstartup(spark.createDataFrame([(json.dumps({"biz_pbanc_nm": "오래된 창업 지원사업 공고", "pbanc_sn": 1}, ensure_ascii=False), 0)], "raw string, arrival long"))
    stored = adapters.to_rows(kept, now()).drop("arrival").withColumns({"id": F.lit(41).cast("long"), "created_at": F.lit(BEFORE).cast("timestamp_ntz")})
    gone = stored.withColumns({"id": F.lit(40).cast("long"), "source_key": F.lit("gone"), "apply_end": F.lit("2026-01-01").cast("date")})
    sources = spark.createDataFrame([(c, BEFORE) for c in adapters.ADAPTERS], "code string, last_fetched_at timestamp_ntz")
    return ingest.run_ingest(spark.createDataFrame(pages, "source string, page int, body string"), stored.unionByName(gone), sources, now(), only)


def test_ingest(spark):
    done = run(
        spark,
        [
            ("bizinfo", 0, page({"pblancNm": "경기도 수출 기업 모집 공고 2026", "pblancId": "A", "reqstEndDe": "20260901"}, {"title": " "}, {"pblancNm": "끝난 공고", "pblancId": "B", "reqstEndDe": "20260101"})),
            ("kstartup", 0, page({"biz_pbanc_nm": "오래된 창업 지원사업 공고 개정", "pbanc_sn": 1}, {"biz_pbanc_nm": "첫째", "pbanc_sn": 2}, {"biz_pbanc_nm": "둘째", "pbanc_sn": 2})),
            ("mss", 0, xml_page((1, "경기도 수출 기업 모집 공고 2026", ""), (2, "경기도 수출 기업 모집공고 2026", "2026-09-01"), (3, "다른 지원사업 하나", "2026-01-01"), (4, "다른 지원사업 하나", ""), (5, "새로운 지원사업", ""))),
            ("mois", 0, page({"서비스ID": "S1", "서비스명": "소상공인 혜택"})),
            ("mois", 1, "busy"),
            ("mois", 2, page({"서비스ID": "S2", "서비스명": "소상공인 혜택 둘"})),
        ],
    )
    counts = {r["code"]: (r["items"], r["upserted"], r["skipped"], r["duplicates"], r["expired"], r["error"]) for r in done.counters.collect()}
    assert counts == {
        "bizinfo": (3, 1, 2, 0, 1, None), "kstartup": (3, 3, 0, 0, 0, None), "mss": (5, 1, 4, 3, 1, None), "mois": (1, 1, 0, 0, 0, ingest.FAILED), "msit": (0, 0, 0, 0, 0, None),
    }
    rows = {(r["source_id"], r["source_key"]): r for r in done.notices.collect()}
    assert {k: r["title"] for k, r in rows.items()} == {
        (1, "A"): "경기도 수출 기업 모집 공고 2026", (2, "1"): "오래된 창업 지원사업 공고 개정", (2, "2"): "둘째", (3, "5"): "새로운 지원사업", (4, "S1"): "소상공인 혜택",
    }
    assert (rows[2, "1"]["id"], rows[2, "1"]["created_at"]) == (41, BEFORE)
    assert sorted(r["id"] for r in rows.values()) == [41, 42, 43, 44, 45]
    fetched = {r["code"]: r["last_fetched_at"] != BEFORE for r in done.sources.collect()}
    assert fetched == {"bizinfo": True, "kstartup": True, "mss": True, "mois": False, "msit": True}


def test_ingest_of_some_sources_and_of_nothing(spark):
    done = run(spark, [("bizinfo", 0, page({"pblancNm": "공고", "pblancId": "A"})), ("kstartup", 0, page({"biz_pbanc_nm": "가", "pbanc_sn": 9}))], "bizinfo")
    assert {r["source_key"] for r in done.notices.collect()} == {"A", "1"}
    assert {r["code"] for r in done.counters.collect()} == {"bizinfo"}
    nothing = run(spark, [("mss", 0, "")])
    assert [r["id"] for r in nothing.notices.collect()] == [41]


def listed(spark, n):
    ends = [None if i % 4 == 0 else date(2026, 8, 1 + i % 9) for i in range(n)]
    rows = [(i, 1, "t", "o", [1], "r", "x", "s", "y", None, ends[i], "u", "open", datetime(2026, 1, 1 + i % 5)) for i in range(n)]
    kinds = "id long, source_id int, title string, organization string, category_ids array<int>, region string, target string, support_type string, summary string, apply_start date, apply_end date, detail_url string, status string, created_at timestamp_ntz"
    return spark.createDataFrame(rows, kinds), rows


@pytest.mark.parametrize("sort", ["latest", "deadline"])
@pytest.mark.parametrize("n", [1, 23, 30])
def test_each_page_from_either_end(spark, sort, n):
    view, rows = listed(spark, n)
    order = sorted(rows, key=(lambda r: (r[10] is None, r[10] or date.max, r[0])) if sort == "deadline" else (lambda r: (-r[13].toordinal(), -r[0])))
    expected = [r[0] for r in order]
    for number in range(1, 6):
        found = [r["id"] for r in listing.list_page(view, ListParams(sort=sort, page=number, size=7), display=False).collect()]
        at = min(number, max(1, -(-n // 7))) - 1
        assert found == expected[7 * at : 7 * at + 7]
    assert listing.list_page(view.limit(0), ListParams(page=3)).count() == 0


def test_the_last_page_holds_no_more_than_a_page(spark):
    view, _ = listed(spark, 1000)
    plan = listing.list_page(view, ListParams(page=100, size=10), display=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalLimit 10" in plan and "990" not in plan


def test_null_keys_are_one_key(spark):
    old = spark.createDataFrame([(None, "a"), (1, "b")], "k int, v string")
    new = spark.createDataFrame([(None, "c"), (2, "d")], "k int, v string")
    assert Counter(map(tuple, merge.upsert(old, new, ["k"]).collect())) == Counter([(None, "c"), (1, "b"), (2, "d")])


def test_places_and_new_ids(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "v int, i int").repartition(5)
    placed = merge.numbered(df.orderBy("v"), "test").collect()
    assert [(r["place"], r["v"]) for r in sorted(placed, key=lambda r: r["place"])] == [(v + 1, v) for v in range(1000)]
    same = spark.range(50).select(F.lit(None).cast("long").alias("id"), F.lit("x").alias("v"))
    assert sorted(r["id"] for r in merge.with_new_ids(same.unionByName(spark.createDataFrame([(9, "y")], "id long, v string")), "id", 9).collect()) == list(range(9, 60))


def test_get_by_id(spark):
    rows = spark.createDataFrame([(1, date(2026, 7, 1)), (2, None)], "id long, apply_end date")
    assert [tuple(r) for r in listing.get_notice(rows, 1, today()).collect()] == [(1, date(2026, 7, 1), "closed")]
    assert listing.get_notice(rows, 3, today()).count() == 0


@pytest.mark.parametrize("sort", ["latest", "deadline"])
def test_recommendation_pages_repeat_nothing(spark, sort):
    view, rows = listed(spark, 35)
    view = view.withColumns({"category_ids": F.array(F.when(F.col("id") % 3 == 0, 1).otherwise(2)), "region": F.lit("서울"), "target": F.lit(None).cast("string")})
    view = view.unionByName(view.where("id < 5"))  # a repetition of a notice counts once
    condition, after, seen = recommend.Condition("other", "seoul", ["startup_support"]), None, []
    while True:
        found = recommend.recommendation_page(view, condition, sort, 5, after).collect()
        seen += [r["id"] for r in found[:5]]
        if len(found) <= 5:
            break
        after = (found[4]["created_at" if sort == "latest" else "apply_end"], found[4]["id"])
    order = sorted(rows, key=(lambda r: (r[10] is None, r[10] or date.max, r[0])) if sort == "deadline" else (lambda r: (-r[13].toordinal(), -r[0])))
    assert seen == [r[0] for r in order if r[0] % 3 == 0]
    assert recommend.recommendation_page(view, recommend.Condition("other", "seoul", ["?"]), sort).count() == 0


def test_conditions():
    good = {"user_type": "sme", "region": "seoul", "industry": "", "startup_years": "", "interests": ["startup_support", 3, None], "onboarding_completed": True, "schema_version": 1}
    found = recommend.condition_of(good)
    assert (found.user_type, found.region, found.interests, found.onboarding_completed) == ("sme", "seoul", ["startup_support"], True)
    assert recommend.condition_of(good | {"schema_version": 2.0}) is not None
    for bad in (None, [], good | {"region": 1}, good | {"interests": "x"}, good | {"onboarding_completed": 1}, good | {"schema_version": 1.5}, good | {"schema_version": True}, {k: v for k, v in good.items() if k != "industry"}):
        assert recommend.condition_of(bad) is None


def test_groups_are_bounded(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(25)], "k int, v int")
    found = {(r["k"], r["part"]): r["vs"] for r in reports.grouped(df, "k", "v", 10).collect()}
    assert found == {(0, 0): list(range(0, 20, 2)), (0, 1): [20, 22, 24], (1, 0): list(range(1, 20, 2)), (1, 1): [21, 23]}


def test_scratch_folders_are_shared_or_an_error(spark):
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    class Table:
        sparkSession = Session()  # noqa: N815

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        scratch.written(Table(), "x")


@pytest.mark.parametrize("missing", [[], ["corpus_pipeline"], ["noticeloom.llm"], ["zstandard"], ["tokenizers"]])
def test_entry_without_a_part(missing):
    """Core queries stay whatever of the training-data part is missing."""
    code = f"""
import sys
for name in {missing!r}:
    sys.modules[name] = None
import __spark_entry__ as e
names = set(e.queries())
assert {{"list_latest", "ingest_run"}} <= names and set(e.oracle_sql()) <= names
print(len(names))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


