"""Checks of requests in bulk against those of one request."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noticeloom.operators import listing, recommend

SINCE = [None, "", " ", "2026-07-12T03:00:00Z", "2026-07-12T03:00:00.5+09:00", "2026-02-30T00:00:00Z", "2026-07-12", "2026-07-12T24:00:00Z", " 2026-07-12T03:00:00-03:30 ", "2026-07-12T03:00:00", "x"]
WITHIN = [None, "", "0", "1", "30", "31", "-1", "7.0", "9007199254740993", "０"]
LIMIT = [None, "", "0", "1", "100", "101", "00012", "9007199254740991", "9007199254740992", "1" * 50]


def test_feed_requests(spark):
    asked = [(s, w, n) for s in SINCE for w in (None, "5", "99") for n in (None, "200")] + [(None, w, None) for w in WITHIN] + [(None, None, n) for n in LIMIT]
    df = spark.createDataFrame([(i, *a, "kept") for i, a in enumerate(asked)], "i int, since string, deadlineWithinDays string, `limit` string, other string")
    found = {r["i"]: r for r in listing.checked_requests(df).collect()}
    for i, (since, within, limit) in enumerate(asked):
        given = {k: v for k, v in (("since", since), ("deadlineWithinDays", within), ("limit", limit)) if v is not None}
        try:
            p = listing.parse_feed_params(given)
            expected = (None, p.since and datetime.fromisoformat(p.since), p.deadline_within_days, p.limit)
        except listing.InvalidParam as wrong:
            expected = (str(wrong), None, None, None)
        r = found[i]
        assert (r["error"], r["since"], r["deadlineWithinDays"], r["limit"]) == expected, asked[i]
        assert r["other"] == "kept"


def test_pages_and_sizes(spark):
    given = [None, 0.0, -5.0, 1.0, 2.9, float("nan"), float("inf"), float("-inf"), 1e9]
    found = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v double").orderBy("i").select(listing.positive_number(F.col("v"), 10)).collect()]
    assert found == [listing.positive(v, 10) for v in given]


GOOD = {"user_type": "sme", "region": "seoul", "industry": "", "startup_years": "", "interests": ["a", 3, None, "b"], "onboarding_completed": True, "schema_version": 1}
ODD = [{}, {"region": 1}, {"region": None}, {"interests": "x"}, {"interests": {}}, {"interests": []}, {"onboarding_completed": 1}, {"schema_version": 1.5}, {"schema_version": True}, {"schema_version": 2.0}, {"schema_version": "1"}, {"industry": None}]


def test_conditions_in_bulk(spark):
    told = [json.dumps(GOOD | o) for o in ODD] + [json.dumps({k: v for k, v in GOOD.items() if k != missing}) for missing in GOOD] + ["", "[]", "null", "{", "3", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "i int, t string")
    found = {r["i"]: r["c"] for r in df.select("i", recommend.conditions(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(told):
        try:
            one = recommend.condition_of(json.loads(t)) if t is not None else None
        except ValueError:
            one = None
        c = found[i]
        assert (c is None) == (one is None), t
        assert c is None or (c["user_type"], c["region"], c["interests"], c["onboarding_completed"]) == (one.user_type, one.region, one.interests, one.onboarding_completed)


def test_wrong_parameters_have_names():
    with pytest.raises(listing.InvalidParam, match="limit"):
        listing.parse_feed_params({"limit": "x"})
