"""Registered queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from noticeloom.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    found = __spark_entry__.queries()[name](spark, SF)
    rows = found.collect()
    if name not in SQL:
        assert rows
        return
    expected = duck.sql(SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    order = [expected.columns.index(c) for c in found.columns]
    assert plain(rows) == plain([[row[i] for i in order] for row in expected.fetchall()])


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["id", "source_id", "title", "status", "apply_end", "created_at"]
    assert found.count() == 10


def test_plans_push_down_and_prune(spark):
    """Filters and column choice reach the scan; the best row per hash is found before the shuffle too."""
    plan = QUERIES["public_view"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    scan = QUERIES["event_log_valid"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type, [click,view])]" in scan
    assert "value" not in scan.split("ReadSchema: ")[1]
    assert "TakeOrderedAndProject" in QUERIES["list_latest"](spark, SF)._jdf.queryExecution().executedPlan().toString()
