"""The recount of terms, its perfect hashes and divergences, against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from noticeloom.llm import divergence_audit as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_audit(rows, min_docs, top=10):
    """Of (lang, source, text) rows."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out, langs = set(), defaultdict(list)
    for lang, source, text in rows:
        langs[lang].append((source, plain_terms(text)))
    for lang, docs in langs.items():
        df = Counter(t for _, words in docs for t in set(words))
        kept = {t for t, n in df.items() if n >= min_docs}
        counts = defaultdict(Counter)
        for source, words in docs:
            counts[source].update(w for w in words if w in kept)
        whole = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            words = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", words, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(ordered[:most], 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, rank int").repartition(3)


def words(rng, n):
    return " ".join(f"{rng.choice('abcdéß한')}{rng.choice('XYZ')}{'q' * rng.randrange(4)}" for _ in range(n))


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 1000, "tile": 2}])
def test_equals_plain_version(spark, options, monkeypatch):
    monkeypatch.setattr(D, "SHARD_TERMS", 8)
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de", "en"]), rng.choice(["a", "b", "c", "é", "a"]), words(rng, rng.randrange(40))) for _ in range(150)]
    rows += [("fr", "a", "one two"), ("fr", "b", None), (None, None, "one"), ("en", None, None), ("en", "empty", ""), ("es", "alone", "x " * 20)] + [("en", "a", "same same text-here_now")] * 12
    found = D.audit(frame(spark, rows), min_docs=3, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, 3)


def test_edges(spark, edges, empty):
    assert D.audit(empty).collect() == []
    rows = [(r.lang, r.source, r.text) for r in edges.collect()]
    assert {tuple(r) for r in D.audit(edges, min_docs=2).collect()} == plain_audit(rows, 2)


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(D, "SLICE", 50)
    text = words(random.Random(1), 500) + "\x00[`{~ É▁ \U0001f600x" + "y" * 200
    assert [t.decode() for part in D.terms(text) for t in part] == plain_terms(text)


@pytest.mark.parametrize("twins", [False, True])
def test_perfect_hash(monkeypatch, twins):
    """Every kept term has a slot of its own, all slots are used, no other term has one; equal hashes do no harm."""
    if twins:
        plain = D.hashed
        monkeypatch.setattr(D, "hashed", lambda keys: plain([k[:3] for k in keys]))
    keys = [f"{i:05d}é".encode() for i in range(3000)] if not twins else [f"{i:04d}".encode() for i in range(300)]
    shards = 4
    at = (D.hashed(keys) & np.uint64(shards - 1)).astype(int)
    rows = []
    for shard in range(shards):
        own = [k for k, s in zip(keys, at, strict=True) if s == shard]
        sizes, bits, order, left = D.built(own)
        assert bool(left) == (twins and bool(own))
        rows.append({"shard": shard, "sizes": sizes, "bits": bits, "terms": [own[i].decode() for i in [*order, *left]], "unplaced": len(left)})
    directory = D.Directory(shards, rows)
    assert sorted(directory.slots(keys)) == list(range(len(keys)))
    assert [directory.stored[int(s)].as_py() for s in directory.slots(keys)] == keys
    assert set(directory.slots([b"other", b"", b"0000", b"x" * 999][: 2 + 2 * (not twins)])) == {-1}


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(2000):
        total = rng.randrange(1, 9 * 10**15)
        count = rng.randrange(1, total + 1)
        assert D.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * count // total
