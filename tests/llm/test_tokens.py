import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import noticeloom.llm.token_counts as token_counts_module
from noticeloom.llm.packing import best_fit, byte_ids, cut, op8_packing, pack
from noticeloom.llm.token_counts import PrefixCounter, counter, op7_token_counts, prefix_counts, runs, token_counts
from tests.llm.conftest import EDGES

WORD, BYTE, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
BITS = ["a", "B", "é", "È", " ", "  ", "\n", "'s", "'re", "don't", "'", "!!", "2", "²", "½", "é", "İ", "中文", "한국", "\xa0", "<|endoftext|>", "<|end", "_", "-", "K", "ß", "ﬁ", "\x85", "\x1c", " ", "😀", "Σς", "ª", "\r\n", "\t"]


def texts():
    r = random.Random(5)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 50))) for _ in range(400)]


def test_counts_equal_the_library():
    c = counter(WORD)
    for t in texts():
        assert c.answer(t, (3,))[0] == len(c.tokenizer.encode(t, add_special_tokens=False).ids), t


def test_every_prefix_equals_its_own_encoding():
    c = counter(WORD)
    for t in ["The Don't-stop 12 cafés!!", "it's they'll 'round 'r", "a  b\n\nc…"]:
        counts = np.concatenate(list(c.prefixes(t)))
        assert counts.tolist() == [len(c.tokenizer.encode(t[:i], add_special_tokens=False).ids) for i in range(1, len(t) + 1)]


def test_budget_is_the_longest_prefix():
    c = counter(WORD)
    t = "antidisestablishmentarianism and internationalization of whatsoever " * 3
    for budget in (0, 1, 2, 5, 9, 1000):
        chars = c.answer(t, (budget,))[1][0]
        fits = [i for i in range(len(t) + 1) if len(c.tokenizer.encode(t[:i], add_special_tokens=False).ids) <= budget]
        assert chars == fits[-1]


def library_prefixes(c, t):
    return [len(c.tokenizer.encode(t[:i], add_special_tokens=False).ids) for i in range(1, len(t) + 1)]


@pytest.mark.parametrize("bits, size", [("acgt", 400), ("a", 300), ("=", 300), ("=-_'<|!", 400), ("abcdefghijklmnopqrstuvwxyz", 400), ("éßaèñ한국中文", 200), ("😀😂🇺🇸", 150), ("haehlo", 300)])
def test_prefixes_of_a_long_word(bits, size):
    r = random.Random(size)
    c = counter(WORD)
    word = "".join(r.choice(bits) for _ in range(size))
    t = f"so {word} it"
    expected = library_prefixes(c, t)
    assert np.concatenate(list(c.prefixes(t))).tolist() == expected
    budgets = (0, 1, 2, 7, 30, 60, 1000)
    assert c.answer(t, budgets) == (expected[-1], [max((i + 1 for i, n in enumerate(expected) if n <= b), default=0) for b in budgets])


def test_a_long_run_takes_linear_time_and_is_not_kept(spark, frame):
    r = random.Random(3)
    long = ["=" * 100_000, "a" * 100_000, "".join(r.choice("acgt") for _ in range(100_000))]
    c = PrefixCounter(WORD)
    began = time.monotonic()
    for t in long:
        n, (fit,) = c.answer(t, (2048,))
        assert n == len(c.tokenizer.encode(t, add_special_tokens=False).ids) > 2048
        assert len(c.tokenizer.encode(t[:fit], add_special_tokens=False).ids) <= 2048 < len(c.tokenizer.encode(t[: fit + 1], add_special_tokens=False).ids)
    assert np.concatenate(list(c.prefixes(long[2])))[-1] == n
    assert time.monotonic() - began < 60
    assert not c.counts and not c.tables
    rows = token_counts(frame(list(enumerate(long))), WORD).collect()
    assert sorted(row["n_tokens"] for row in rows) == sorted(c.answer(t, ())[0] for t in long)


def test_caches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(token_counts_module, "CACHE_BYTES", 5_000)
    c = PrefixCounter(WORD)
    t = " ".join(f"word{i} thing{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))
    expected = len(c.tokenizer.encode(t, add_special_tokens=False).ids)
    assert c.answer(t, (5,))[0] == expected == np.concatenate(list(c.prefixes(t)))[-1]
    assert len(c.counts) + len(c.tables) < 30


def test_runs_do_not_change_counts():
    t = "the quick  brown fox's\n" * 200
    assert "".join(runs(t, 100)) == t
    c = counter(WORD)
    whole = len(c.tokenizer.encode(t, add_special_tokens=False).ids)
    assert sum(len(c.tokenizer.encode(r, add_special_tokens=False).ids) for r in runs(t, 100)) == whole


def test_ids_equal_the_library():
    ids = byte_ids(BYTE, RANKS)
    for t in texts():
        assert np.frombuffer(ids.ids(t), "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_ids_of_every_plain_character_equal_the_library():
    ids = byte_ids(BYTE, RANKS)
    plain = [chr(c) for c in range(0x3000) if token_counts_module.PLAIN.fullmatch(chr(c))]
    assert len(plain) > 300
    r = random.Random(4)
    t = []
    for c in plain:
        t += [c, 2 * c, f"a{c}b", f" {c}", f"{c} ", f"1{c}2", f"{c}'s", f"'{c}", f"!{c}?", f"\n{c}\n", f"{c}\r\n{c}", f"  {c}  ", f"\t{c}"]
    t += ["".join(r.choice(plain) for _ in range(40)) for _ in range(3000)]
    for x in t:
        if "<|" not in x:
            assert np.frombuffer(ids.ids(x), "<u4").tolist() == ids.tokenizer.encode(x, add_special_tokens=False).ids, repr(x)


def test_token_counts_on_edges(edges, empty):
    rows = token_counts(edges, WORD, budgets=(3, 2048)).collect()
    assert len(rows) == len(EDGES)
    c = counter(WORD)
    for r in rows:
        assert r["n_tokens"] == len(c.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
    assert token_counts(empty, WORD).count() == 0
    assert prefix_counts(edges.where("doc_id = 9"), WORD).first()["prefix_counts"][-1] == 9


def test_query(spark):
    documents = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows, library = op7_token_counts(spark, "/root/testdata/sf0.001").collect(), counter(WORD).tokenizer
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        n = len(library.encode(documents[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(documents[r["doc_id"]].encode()), n, n > 2048)


def test_clashing_names(edges):
    clashing = {c: F.lit(i) for i, c in enumerate(["n_tokens", "fit_2048", "row", "text_", "piece", "bin", "sequence_id", "offset", "fill"])}
    counted = token_counts(edges.withColumns(clashing), WORD)
    assert sorted(counted.columns) == sorted({*edges.columns, *clashing})
    assert counted.where("row = 2 AND piece = 4").count() == len(EDGES)
    same = lambda df: sorted((r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert same(pack(edges.withColumns(clashing), BYTE)) == same(pack(edges, BYTE))


def test_best_fit_is_whole_and_tight():
    r = random.Random(2)
    sizes = [r.randint(1, 2048) for _ in range(3000)]
    bins = best_fit(sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert all(sum(sizes[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= 1.02 * -(-sum(sizes) // 2048) + 1


def test_cut():
    assert cut(10, 4) == [(0, 2), (2, 4), (6, 4)]
    assert cut(8, 4) == [(0, 4), (4, 4)]
    assert cut(4, 4) == [(0, 4)]


@pytest.mark.parametrize("task_items", [20_000, 3])
def test_pack_is_a_partition_of_all_ids(edges, monkeypatch, task_items):
    import noticeloom.llm.packing as module

    monkeypatch.setattr(module, "TASK_ITEMS", task_items)
    rows = pack(edges, BYTE, ranks=RANKS, with_ids=True).collect()
    library = byte_ids(BYTE, None)
    expected, got = defaultdict(int), defaultdict(int)
    for e in EDGES:
        data = library.ids(e[1] or "") + b"\0\0\0\0"
        for n, (s, m) in enumerate(cut(len(data) // 4, 2048)):
            expected[e[0], n, s, data[4 * s : 4 * (s + m)]] += 1
    sequences = defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], bytes(r["ids"])] += 1
        assert len(r["ids"]) == 4 * r["length"]
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == expected
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    if task_items > 3:
        assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_pack_nothing(empty):
    assert pack(empty, BYTE).count() == 0


def test_packing_query(spark):
    documents = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    library, expected, sequences = byte_ids(BYTE, None).tokenizer, set(), defaultdict(list)
    for i, t in documents.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        expected |= {(i, n, s, m, zlib.crc32(np.array(ids[s : s + m], "<u4").tobytes())) for n, (s, m) in enumerate(cut(len(ids), 2048))}
    rows = op8_packing(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(expected)
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        ends = [0, *[o + n for o, n in sorted(pieces)]]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_answers_are_read_off_the_counts_of_all_prefixes(monkeypatch):
    """No word is counted by itself beside them; an array that is wrong gives wrong answers."""
    c = PrefixCounter(WORD)
    monkeypatch.setattr(c, "prefixes", lambda text: iter([np.array([1, 1, 2]), np.array([4, 3, 5])]))
    assert c.answer("any text", (0, 1, 3, 5)) == (5, [0, 2, 5, 6])
