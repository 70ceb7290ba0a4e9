"""Groups, links and counts of two tokenizers against a plain version."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest

from noticeloom.llm import alignment as A
from noticeloom.llm.token_counts import BYTE_CHARACTERS

PATHS = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain_groups(text, tools):
    a, b = tools
    as_byte = {c: n for n, c in BYTE_CHARACTERS.items()}
    ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
    bytes_a = [bytes(as_byte[c] for c in a.id_to_token(i)) for i in ids_a]
    pieces = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
    data = (" " + text).encode() if text else None
    if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
        return []
    ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    out, start = [], 0
    for end in sorted(set(ends_a) & set(ends_b)):
        out.append(([i for i, e in zip(ids_a, ends_a) if start < e <= end], [i for i, e in zip(ids_b, ends_b) if start < e <= end]))
        start = end
    return out


def plain_align(rows, tools):
    groups = [(i, plain_groups(t, tools)) for i, t in rows]
    counts = Counter(p for _, g in groups for p in {(a, b) for x, y in g for a in x for b in y})
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    for i, g in groups:
        links = [(a, b) for x, y in g for a in x for b in y]
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        yield (i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(spelled.encode()).hexdigest() if g else "")


WORDS = ["the", "Straße", "été", "한국어", "<|endoftext|>", "<s>", "x1y2", "😀", "unbelievably", "▁", "antidisestablishmentarianism", "a-b", "...", "日本", "naïveté", "don't", "zqxj"]
ODD = [(500, None), (None, "again"), (501, ""), (502, " two  spaces"), (503, "tail "), (504, "line\nbreak\ttab"), (505, "ﬁ ligature"), (506, "\x00 nul"), (507, "▁"), (7, "same text"), (7, "same text"), (508, "é")]


@pytest.mark.parametrize("hot_pairs", [A.HOT_PAIRS, 3])
def test_equals_plain_version(spark, tools, hot_pairs):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 25)))) for i in range(60)] + ODD
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_best int").repartition(3)
    found = A.align(df, *PATHS, ranks=P.path("byte_bpe_50k.tiktoken") if hot_pairs > 3 else None, hot_pairs=hot_pairs)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain_align(rows, tools), key=repr)


def test_empty_and_clashing(spark, empty):
    assert A.align(empty, *PATHS).collect() == []


@pytest.mark.parametrize("limits", [{"CHUNK": 30, "LINKS": 7, "GROUP_LINKS": 3}, {}])
def test_runs_chunks_and_large_groups(tools, monkeypatch, limits):
    """Texts in several runs and groups of many links give what whole texts do."""
    for name, value in limits.items():
        monkeypatch.setattr(A, name, value)
    plain_runs = A.runs
    if limits:
        monkeypatch.setattr(A, "runs", lambda text: plain_runs(text, 40))
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS[:-1]) for _ in range(60)) for _ in range(5)] + ["bad " * 20 + "  double " + "more " * 20, "", "x"]
    v = A.vocabularies(*PATHS, None)
    for text, row in zip(texts, A.aligned_texts(texts, v), strict=True):
        g = plain_groups(text, tools)
        links = Counter((a, b) for x, y in g for a in x for b in y)
        assert row[:4] == (sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(links.values()))
        assert row[4] == (hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if g else "")
        got = {(int(a), int(v.same[a])): n for a, n in zip(row[5], row[6])} | {(int(p) // v.size_b, int(p) % v.size_b): n for p, n in zip(row[7], row[8])}
        assert got == links


def test_names_without_bytes():
    v = A.vocabularies(*PATHS, None)
    assert all(v.bytes_b[b] == v.bytes_a[a] for a, b in enumerate(v.same) if b >= 0)
    assert not any(re.search("[^ ] ", d.decode(errors="replace")) for d in v.bytes_b)  # no piece crosses a cut before a space
