"""Scores of the backoff automaton against a plain one that is walked token by token."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeloom.llm import lm_scoring as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [" "]


class PlainAutomaton:
    """States are tuples of tokens; walked one token at a time."""

    def __init__(self, texts, order, strengths):
        self.order, self.strengths, self.counts = order, strengths, [Counter() for _ in range(order + 1)]
        for text in texts:
            s = ["", *tokens(text)]
            for k in range(1, order + 1):
                self.counts[k].update(tuple(s[i - k + 1 : i + 1]) for i in range(max(k - 1, 0), len(s)))
        self.words = {w for (w,) in self.counts[1] if w}
        self.total = sum(n for (w,), n in self.counts[1].items() if w)

    def is_state(self, state):
        return not state or self.counts[len(state)][state] > 0

    def probability(self, state, w):
        if not state:
            return (self.counts[1][w,] + 1) / (self.total + len(self.words) + 1)
        k = self.strengths[len(state) - 1]
        return (self.counts[len(state) + 1][*state, w] + k * self.probability(state[1:], w)) / (self.counts[len(state)][state] + k)

    def score(self, text):
        state, out = ("",)[: self.order - 1], 0.0
        while not self.is_state(state):
            state = state[1:]
        for w in tokens(text):
            while state and self.counts[len(state) + 1][*state, w] == 0:  # a failure arc
                k = self.strengths[len(state) - 1]
                out += math.log10(k / (self.counts[len(state)][state] + k))
                state = state[1:]
            out += math.log10(self.probability(state, w))
            # The longest context that is a state, of at most order - 1 tokens; failure arcs lose none that is one.
            state = (*state, w)[-(self.order - 1) :] if self.order > 1 else ()
            while not self.is_state(state):
                state = state[1:]
        return out

    def base(self, text):
        return sum(math.log10((self.counts[1][w,] + 1) / (self.total + len(self.words) + 1)) for w in tokens(text))


def words(rng, n):
    return " ".join(f"{rng.choice('aAbcé')}{rng.choice('xy')}" for _ in range(n))


@pytest.mark.parametrize(("order", "block", "bucket"), [(3, 60, 40), (2, 10**6, 10**6), (1, 100, 50)])
def test_equals_plain_automaton(spark, order, block, bucket):
    rng = random.Random(order)
    rows = [(i, words(rng, rng.randrange(30))) for i in range(120)] + [(500, None), (None, "ax bx"), (500, ""), (7, "never seen before"), (8, "\x1d\x00 \x85 a\xa0b\nax\tbx\x0b\x0c")]
    rows = [(i, t, i is not None and i % 3 != 0, -1.5) for i, t in rows]
    plain = PlainAutomaton([t for _, t, train, _ in rows if train], order, (2.0, 3.0))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, train boolean, score double").repartition(3)
    got = L.scores(df, F.col("train"), order=order, strengths=(2.0, 3.0), block_tokens=block, bucket_ngrams=bucket).collect()
    expected = [(i, train, len(tokens(t)), sum(plain.counts[1][w,] > 0 for w in tokens(t)), plain.total, plain.base(t), plain.score(t)) for i, t, train, _ in rows]
    key = lambda r: (repr(r[0]), r[2], r[5])
    assert len(got) == len(expected)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-12)


def test_every_state_adds_up_to_one():
    rng = random.Random(9)
    plain = PlainAutomaton([words(rng, 20) for _ in range(30)], 3, (2.0, 3.0))
    for state in [(), ("",), ("ax",), ("ax", "by"), ("", "ax")]:
        assert math.isclose(sum(plain.probability(state, w) for w in plain.words) + plain.probability(state, "unseen"), 1.0)


def test_edges(spark, edges, empty):
    assert L.scores(empty, F.lit(True)).collect() == []
    got = L.scores(edges, F.lit(None).cast("boolean")).collect()  # nothing to learn from
    assert len(got) == edges.count() and all(r.score == r.base_score == 0 and r.n_known == 0 for r in got)
    rows = edges.collect()
    plain = PlainAutomaton([r.text for r in rows], 3, L.STRENGTHS)
    expected = sorted(plain.score(r.text) for r in rows)
    assert np.allclose(sorted(r.score for r in L.scores(edges, F.lit(True), block_tokens=1000).collect()), expected, rtol=1e-9)


def test_packing():
    rng = np.random.default_rng(1)
    for dtype in ("<u4", "<u8", "<i8"):
        values = rng.integers(0, 2**31, 1000).astype(dtype)
        assert (L.unpacked(L.packed(values), 1000, dtype) == values).all()
        assert len(L.unpacked(L.packed(values[:0]), 0, dtype)) == 0
    for found in ([b""], [b"", b" "], [b"a", b"\x00"]):
        assert L.unpacked_words(L.packed_words(found)) == found


def test_words_of_long_texts(monkeypatch):
    monkeypatch.setattr(L, "SLICE", 40)
    text = "x" * 100 + words(random.Random(1), 300) + "　É \t\n"
    assert [w.decode() for part in L.words_of(text) for w in part] == tokens(text)[:-1]
