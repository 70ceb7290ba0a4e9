import random
import re

import pytest
from pyspark.sql import functions as F

from noticeloom.llm.license_scan import LicenseScanner, SuffixAutomaton, license_scan, op2_license_scan, word_runs
from noticeloom.llm.license_templates import BASE_PHRASES, TEMPLATES
from tests.llm.conftest import EDGES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_places(text):
    w, places, labels = words(text), [], set()
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), places, labels


def test_automaton_gives_matching_statistics():
    r = random.Random(4)
    for _ in range(30):
        sequences = [[r.randrange(4) for _ in range(r.randint(1, 12))] for _ in range(3)]
        auto = SuffixAutomaton()
        for name, s in enumerate(sequences):
            auto.add(s, name)
        auto.finish()
        inside = {tuple(s[i:j]): None for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        text, state, size = [r.randrange(4) for _ in range(40)], 0, 0
        for i, x in enumerate(text):
            while state and x not in auto.next[state]:
                state = auto.link[state]
                size = auto.length[state]
            state, size = (auto.next[state][x], size + 1) if x in auto.next[state] else (0, 0)
            best = max((k for k in range(i + 2) if tuple(text[i + 1 - k : i + 1]) in inside), default=0)
            assert size == best
            found = tuple(text[i + 1 - size : i + 1])
            if size:
                places = [(n, a + size) for n, s in enumerate(sequences) for a in range(len(s)) if tuple(s[a : a + size]) == found]
                assert sorted(auto.ends[state]) == places


def scanner():
    return LicenseScanner(TEMPLATES, BASE_PHRASES, 4, 0.6, 20, 20)


@pytest.mark.parametrize("label, text", TEMPLATES)
def test_templates_find_themselves(label, text):
    found = scanner().scan(f"some words before {text.upper()} and after".encode())
    assert label in found["labels"].split(",")
    assert found["score"] == pytest.approx(1.0)


def all_matches(text, template, least):
    """Stretches of both that can't be extended to either side, as (start, end, end in the template)."""
    for i in range(len(text)):
        for j in range(len(template)):
            if text[i] == template[j] and (not i or not j or text[i - 1] != template[j - 1]):
                n = 1
                while i + n < len(text) and j + n < len(template) and text[i + n] == template[j + n]:
                    n += 1
                if n >= least:
                    yield i, i + n, j + n


def brute_chain(matches, gap, last=None):
    """The most words that a chain of matches covers, by trying all."""
    best = 0
    for start, end, at in matches:
        size, new = end - start, end - start
        if last:
            if not (end > last[1] and at > last[2] and start - last[1] <= gap and at - size - last[2] <= gap):
                continue
            new = size - max(0, last[1] - start, last[2] - (at - size))
        if new > 0:
            best = max(best, new + brute_chain(matches, gap, (start, end, at)))
    return best


def test_chains_equal_brute_force():
    r = random.Random(9)
    for _ in range(150):
        templates = [("".join(f"t{n}"), " ".join(r.choice("abcd") for _ in range(r.randint(4, 14)))) for n in range(3)]
        base = templates[r.randrange(3)][1].split()
        text = [w if r.random() > 0.2 else r.choice("abcde") for w in base for _ in range(1 + (r.random() < 0.1))]
        scan = LicenseScanner(templates, {}, 2, 0.0, 2, 0)
        found = {}
        chain = scan.chain
        scan.chain = lambda name, matches, found=found, chain=chain: found.setdefault(name, (sorted(matches), chain(name, matches)))[1]
        scan.scan(" ".join(text).encode())
        for name, (_, template) in enumerate(templates):
            matches = sorted(all_matches(text, template.split(), 2))
            assert found.get(name, ([], []))[0] == matches
            spans = found.get(name, ([], []))[1]
            assert max((s["covered"] for s in spans), default=0) == brute_chain(matches, 2)
            ends = sorted((s["start_word"], s["end_word"]) for s in spans)
            assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("label, text", [t for t in TEMPLATES if len(words(t[1])) >= 20])
def test_labels_survive_edits_and_insertions(label, text):
    r, scan, template = random.Random(1), scanner(), words(text)
    for _ in range(300):
        edited = list(template)
        for i in r.sample(range(len(edited)), min(3, len(edited) // 15)):  # what still leaves three fifths in stretches of four
            edited[i] = "changed"
        at, start = r.randrange(len(edited)), r.randrange(len(edited) - 5)
        edited[at:at] = template[start : start + 5]
        assert label in scan.scan(" ".join(edited).encode())["labels"].split(",")


def test_licences_that_differ_by_a_word_are_told_apart():
    for label, text in TEMPLATES:
        if label in ("gpl", "lgpl", "agpl") or label.startswith("cc"):
            assert scanner().scan(f"here {text} there".encode())["labels"] == label
    nd = b"This work is licensed under the Creative Commons Attribution-Noncommercial-Something 4.0 International License"
    assert scanner().scan(nd)["labels"] == ""


def test_repeated_licences_give_a_span_each_in_linear_time():
    mit = TEMPLATES[0][1]
    found = scanner().scan((f"{mit} " * 3000).encode())
    assert [s["covered"] for s in found["spans"]] == [len(words(mit))] * 3000


def test_parts_and_edits():
    mit = TEMPLATES[0][1].split()
    edited = " ".join(w for i, w in enumerate(mit) if i % 25)
    found = scanner().scan(edited.encode())
    assert found["labels"] == "mit"
    assert 0.6 < found["score"] < 1
    assert scanner().scan(" ".join(mit[:40]).encode())["labels"] == ""
    assert scanner().scan(b"the of and is by with this to")["labels"] == ""


@pytest.mark.parametrize("text", ["MIT License, mit-license; cc by-nc 4.0", "Apache License, Version 2.0 apache license version 2", "mit  Licenseé mit license2", "", None, "cc by nc cc by nc"])
def test_phrases_equal_brute_force(text):
    found = scanner().scan((text or "").encode())
    n, places, labels = brute_places(text)
    assert found["n_words"] == n
    assert found["n_base"] == len(places)
    assert (found["first_word"], found["last_word"]) == ((min(places), max(places)) if places else (None, None))
    assert found["base_labels"] == ",".join(sorted(labels))
    assert labels <= set(found["labels"].split(","))


def test_runs_are_cut_between_words():
    import noticeloom.llm.license_scan as module

    text = "mit license héllo ".encode() * 50
    whole = module.words_of(text)
    old, module.RUN = module.RUN, 7
    try:
        assert [w for run in word_runs(text) for w in run] == whole
        assert scanner().scan(text)["n_base"] == 50
    finally:
        module.RUN = old


def test_edges(edges, empty):
    rows = license_scan(edges).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        assert (r["n_words"], r["n_base"]) == (len(words(r["text"])), len(brute_places(r["text"])[1]))
    assert license_scan(empty).count() == 0


def test_query_on_whole_texts(spark):
    documents = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op2_license_scan(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in rows} == set(documents)
    for r in rows:
        n, places, labels = brute_places(documents[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(places), ",".join(sorted(labels)))
        assert 0 <= r["score"] <= 1


def test_clashing_names(spark):
    """Input columns of the result's names are replaced, others of any name stay."""
    df = spark.createDataFrame([(1, "under the mit license", "x", 9, "y"), (2, None, None, None, None)], "doc_id bigint, text string, labels string, `n.words` int, row string").withColumn("score", F.lit("old"))
    rows = {r["doc_id"]: r for r in license_scan(df).collect()}
    assert rows[1]["labels"] == "mit" and rows[1]["score"] == 1.0 and rows[1]["n.words"] == 9 and rows[1]["row"] == "y"
    assert rows[2]["labels"] == "" and rows[2]["score"] == 0.0 and rows[2]["n_words"] == 0


def test_query_counts_the_phrases_of_its_contract(spark, tmp_path):
    """The phrase of the MIT license begins with 'under', and without it doesn't count."""
    texts = ["x Released under the MIT License y", "the mit license", "Apache License, Version 2.0 under the mit license under the MIT-license cc by nc", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in op2_license_scan(spark, str(tmp_path)).collect()}
    told = lambda r: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
    assert [told(rows[i]) for i in range(4)] == [(7, 1, 2, 2, "mit"), (3, 0, None, None, ""), (16, 4, 0, 13, "apache-2,cc-by-nc,mit"), (0, 0, None, None, "")]
