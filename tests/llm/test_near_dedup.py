import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import noticeloom.llm.near_dedup as module
from noticeloom.llm.components import components
from noticeloom.llm.near_dedup import Shingler, near_dedup, near_groups, op9_near_dedup, similar
from tests.llm.conftest import EDGES

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    """Index of each row's group: links by exact Jaccard over an inverted index."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for v in s:
            lists[v].append(i)
    for i, s in enumerate(sets):
        for j, m in Counter(j for v in s for j in lists[v] if j > i).items():
            if 100 * m >= 75 * (len(s) + len(sets[j]) - m):
                parent[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def as_rows(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def corpus(seed, families=6, size=25):
    """Families of edited copies, texts around a common passage, and unrelated ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(50)]
    rows = []
    for _ in range(families):
        base = [word() for _ in range(r.randint(3, 160))]
        for _ in range(r.randint(1, size)):
            copy = [w if r.random() > 0.02 else word() for w in base]
            rows.append(" ".join(copy))
    rows += [" ".join([word() for _ in range(r.randint(0, 40))] + passage + [word() for _ in range(r.randint(0, 40))]) for _ in range(40)]
    rows += [" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(30)]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("hot, square", [(24, 1000), (2, 6)])
def test_equals_brute_force(frame, monkeypatch, hot, square):
    monkeypatch.setattr(module, "HOT", hot)
    monkeypatch.setattr(module, "SQUARE", square)
    rows = corpus(hot)
    assert as_rows(near_groups(frame(rows).select("doc_id", "text"))) == Counter(brute_groups(rows))


def test_a_family_costs_about_its_size_and_squares_carry_no_texts(frame, monkeypatch):
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    copies = [" ".join([*base, f"end{i}"]) for i in range(200)]
    rows = list(enumerate(copies))
    monkeypatch.setattr(module, "SQUARE", 20)
    squares, verifications, settled, verified = [], [], module.settled, module.verified
    monkeypatch.setattr(module, "settled", lambda dealt, texts: (squares.append((dealt.columns, dealt.count())), settled(dealt, texts))[1])
    monkeypatch.setattr(module, "verified", lambda pairs, texts: (verifications.append(pairs.where(pairs["a"] != pairs["b"]).count()), verified(pairs, texts))[1])
    groups = as_rows(near_groups(frame(rows).select("doc_id", "text")))
    assert groups == Counter(brute_groups(rows))
    assert squares and all("text" not in columns for columns, _ in squares)
    assert sum(n for _, n in squares) < 3 * len(rows)
    assert sum(verifications) < 2 * len(rows)


def test_pairs_that_only_seem_similar(frame, monkeypatch):
    # By sketches these may be similar (0.6 to 0.7), but no two are; only two copies are.
    apart = [" ".join([f"v{i}" for i in range(100)] + [f"x{k}y{i}" for i in range(22)]) for k in range(30)]
    rows = list(enumerate([*apart, apart[3] + " end", apart[3] + " ends"]))
    monkeypatch.setattr(module, "SQUARE", 20)
    assert as_rows(near_groups(frame(rows).select("doc_id", "text"))) == Counter(brute_groups(rows))


def test_texts_of_common_passages_and_sets_that_are_not_whole(frame, monkeypatch):
    r = random.Random(5)
    passages = [" ".join(f"p{i}w{j}" for j in range(25)) for i in range(14)]
    texts = [" ".join(r.sample(passages, 5)) for _ in range(60)]
    texts += [f"{texts[0]} end{i}" for i in range(30)] + [f"{texts[1]} {passages[0]} end{i}" for i in range(30)]
    rows = list(enumerate(texts))
    for name, value in (("HOT", 3), ("SQUARE", 20), ("WIDE", 70)):
        monkeypatch.setattr(module, name, value)
    squares, settled = [], module.settled
    monkeypatch.setattr(module, "settled", lambda dealt, texts: (squares.append(dealt.count()), settled(dealt, texts))[1])
    assert as_rows(near_groups(frame(rows).select("doc_id", "text"))) == Counter(brute_groups(rows))
    assert sum(squares) > 0


def test_similar_sets_share_a_run(spark):
    # All splits of unions of 4 to 31 values into shared and unshared ones, at random places; larger ones by chance.
    r = random.Random(3)
    pairs = []
    for size in [n for n in range(4, 32) for _ in range(40)] + [r.randrange(32, 400) for _ in range(300)]:
        alone = size // 4
        values = sorted(r.sample(range(1 << 62), size))
        out = set(r.sample(values, alone))
        of_b = set(r.sample(sorted(out), r.randint(0, alone)))
        pairs.append(([v for v in values if v not in of_b][: module.K], [v for v in values if v not in out - of_b][: module.K], size - len(of_b), size - alone + len(of_b)))
    df = spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>, n_a bigint, n_b bigint")
    keys = [module.run_keys(df[f"n_{x}"], df[x]) for x in "ab"]
    assert all(row[0] for row in df.select(F.arrays_overlap(*keys)).collect())
    kept = [np.array(x, dtype=np.uint64) for p in pairs for x in p[:2]]
    sizes = np.array([n for p in pairs for n in p[2:]])
    open_ = module.open_pairs(sizes, kept, np.zeros(len(kept)))
    assert all(open_[i, i + 1] for i in range(0, len(kept), 2) if kept[i].tolist() != kept[i + 1].tolist())


def test_sets_are_exact_and_runs_do_not_matter(monkeypatch):
    text = " ".join(f"W{i % 97} x{i % 31}" for i in range(3000)).encode()
    whole = Shingler().hashes(text)
    assert len(whole) == len(shingles(text.decode()))
    monkeypatch.setattr(module, "RUN", 50)
    assert np.array_equal(Shingler().hashes(text), whole)
    assert len(Shingler().hashes(b"one two three")) == 1
    assert not np.array_equal(Shingler().hashes(b"one two"), Shingler().hashes(b"two one"))


def test_threshold_is_inclusive():
    a = np.arange(8, dtype=np.uint64)
    assert similar(a, a[:6])
    assert not similar(a, np.append(a[:6], np.uint64(99)))
    assert not similar(a, a[:0])


def test_edges(edges, empty):
    rows = [(e[0], e[1]) for e in EDGES]
    got = as_rows(near_groups(edges.select("doc_id", "text")))
    assert got == Counter((d, n, c if n else d) for d, n, c in brute_groups(rows))
    assert near_groups(empty.select("doc_id", "text")).count() == 0
    kept = near_dedup(edges)
    assert kept.columns == edges.columns
    left = Counter(r["doc_id"] for r in kept.collect())
    assert left[3] == 1 and left[4] == 0 and left[9] == 1 and left[10] == 0 and left[2] == 1 and left[11] == 1


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    links = [(f"c{i:04}", f"c{i + 1:04}") for i in range(60)] + [("hub", f"s{i}") for i in range(200)] + [("x", "x"), ("p", "q")]
    r.shuffle(links)
    found = {row["node"]: row["label"] for row in components(spark.createDataFrame(links, "a string, b string"), "test").collect()}
    groups = Counter(found.values())
    assert sorted(groups.values()) == [2, 61, 201]
    assert components(spark.createDataFrame([], "a string, b string"), "none").count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op9_near_dedup(spark, sf)
    assert as_rows(got) == Counter(brute_groups(rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())
