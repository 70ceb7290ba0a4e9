import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from noticeloom.llm.exact_dedup import exact_dedup
from tests.llm.conftest import EDGES

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def normal(text):
    return (text or "").encode().translate(LOWER)


@pytest.mark.parametrize("first_digit", [1, 256])
@pytest.mark.parametrize("release", [False, True])
def test_equals_grouping_by_whole_texts(edges, first_digit, release):
    rows = exact_dedup(edges.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)), first_digit=first_digit, growth=16, release_text=release).collect()
    assert len(rows) == len(EDGES)
    by_sha = {hashlib.sha256((e[1] or "").encode()).hexdigest(): normal(e[1]) for e in EDGES}
    groups = defaultdict(list)
    for e in EDGES:
        groups[normal(e[1])].append(e[0])
    kept = defaultdict(int)
    for r in rows:
        key = by_sha[r["sha"]]
        ids = [i for i in groups[key] if i is not None]
        assert r["keep_id"] == max(ids, default=None)
        assert r["group_size"] == len(groups[key])
        kept[key] += r["kept"]
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}
    assert len(kept) == len(groups)


def test_long_common_prefixes_part_late(frame):
    base = "x" * 5000
    rows = exact_dedup(frame([(1, base + "a"), (2, base + "b"), (3, base + "A"), (4, base), (5, base + "ab")]), first_digit=4).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows} == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True), 5: (5, 1, True)}


def test_empty_table_and_clashing_names(empty, edges):
    assert exact_dedup(empty).count() == 0
    clashing = edges.withColumns({c: F.lit("x") for c in ("kept", "part", "digit", "ended", "n", "next", "row", "open", "round")})
    out = exact_dedup(clashing)
    assert out.count() == len(EDGES)
    assert out.select("digit").distinct().collect()[0][0] == "x"
