"""Licence scans with a generalised suffix automaton.

The automaton holds every substring of all licence templates and phrases, as sequences of words. Streaming a text through
it gives the matching statistics: at each word, the longest stretch ending there that some template contains; along the
suffix links, the longest for every other template. Stretches of at least ``min_match`` words that the next word doesn't
extend are chained, per template, into spans that go forward in both text and template, those that cover most words. A span
that covers enough of its template labels the text, unless a span of another label covers more of the same place. A
template of fewer than ``short`` words must stand whole and unbroken. A phrase stands wherever the current stretch ends with
it, which the suffix links tell, too.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.llm.common import table
from noticeloom.llm.license_templates import BASE_PHRASES, QUERY_PHRASES, TEMPLATES

#: Lower-cases A-Z and makes a space of every byte that is in no word.
SPLITTER = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
RUN = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(SPLITTER).split()


def word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words, in runs of about ``RUN`` bytes, so that memory doesn't grow with a text."""
    start = 0
    while start < len(text):
        end = start + RUN
        while end < len(text) and SPLITTER[text[end]] != 0x20:
            end += 1
        yield words_of(text[start:end])
        start = end


class SuffixAutomaton:
    """Generalised over all sequences added; states are numbers, 0 the empty string."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Per state, all places (sequence, words up to and with the last) at which its strings end.
        self.ends: list[list[tuple[int, int]]] = [[]]

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def add(self, sequence: list[int], name: int) -> None:
        last = 0
        for at, word in enumerate(sequence, 1):
            last = self._extend(last, word)
            self.ends[last].append((name, at))

    def finish(self) -> None:
        """Hand the ends on to shorter strings."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]


class LicenseScanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], min_match: int, min_coverage: float, max_gap: int, short: int):
        self.min_match, self.min_coverage, self.max_gap, self.short = min_match, min_coverage, max_gap, short
        self.vocabulary: dict[bytes, int] = {}
        number = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text.encode())]
        self.labels = [label for label, _ in templates]
        self.sequences = sequences = [number(text) for _, text in templates]
        self.sizes = [len(s) for s in sequences]
        stated = [(number(phrase), label) for phrase, label in phrases.items()]
        self.automaton = auto = SuffixAutomaton()
        for name, sequence in enumerate([*sequences, *[s for s, _ in stated]]):
            auto.add(sequence, name)
        auto.finish()
        #: Per state, (words, label) of each phrase that the state's strings of at least so many words end with.
        at = {}
        for sequence, label in stated:
            state = 0
            for word in sequence:
                state = auto.next[state][word]
            at[state] = (len(sequence), label)
        self.phrases: list[tuple] = [()] * len(auto.next)
        for state in sorted(range(1, len(auto.next)), key=auto.length.__getitem__):
            self.phrases[state] = (*self.phrases[max(0, auto.link[state])], *([at[state]] if state in at else []))
        self.places: dict[int, list] = {}

    def stretches(self, state: int) -> list[tuple[int, int, int]]:
        """Where the longest stretches of each template end that suffixes of the state's strings have, as (words, template,
        end); of the state's own places the words are those matched so far (0 here)."""
        found = self.places.get(state)
        if found is None:
            auto, found, seen, at, words = self.automaton, [], set(), state, 0
            while at == state or (at > 0 and auto.length[at] >= self.min_match):
                found += [(words, *place) for place in auto.ends[at] if place not in seen and place[0] < len(self.sizes)]
                seen.update(auto.ends[at])
                at = auto.link[at]
                words = auto.length[at]
            self.places[state] = found
        return found

    def scan(self, text: bytes) -> dict:
        auto, lookup = self.automaton, self.vocabulary.get
        following, link, length, phrases, least = auto.next, auto.link, auto.length, self.phrases, self.min_match
        state = size = n = n_base = 0
        first = last = None
        base: set[str] = set()
        matches: dict[int, list[tuple[int, int, int]]] = {}

        def ended(i: int, following_word: int | None) -> None:
            """Keep what the word at ``i`` doesn't extend, as (start, end, end in the template) by template."""
            for words_, name, at in self.stretches(state):
                if at == self.sizes[name] or self.sequences[name][at] != following_word:
                    matches.setdefault(name, []).append((i - (words_ or size), i, at))

        for words in word_runs(text):
            for i, word in enumerate([lookup(w) for w in words], n):
                if size >= least:
                    ended(i, word)
                if word is None:
                    state = size = 0
                    continue
                while word not in following[state] and state:
                    state = link[state]
                    size = length[state]
                to = following[state].get(word)
                if to is None:
                    size = 0
                else:
                    state, size = to, size + 1
                for words_needed, label in phrases[state]:
                    if size >= words_needed:
                        at = i - words_needed + 1
                        n_base, first, last = n_base + 1, at if first is None else min(first, at), at if last is None else max(last, at)
                        base.add(label)
            n += len(words)
        if size >= least:
            ended(n, None)
        spans = self.best([span for name, found in matches.items() for span in self.chain(name, found)])
        score = 1.0 if n_base else max((s["coverage"] for s in spans), default=0.0)
        labels = base | {s["label"] for s in spans}
        return {
            "n_words": n, "n_base": n_base, "first_word": first, "last_word": last,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "spans": spans,
        }

    def chain(self, name: int, matches: list[tuple[int, int, int]]) -> list[dict]:
        """Spans of one template that cover enough of it, from its matches in the order of their ends.

        A match follows another if it ends later in text and template and begins at most ``max_gap`` words after it; where
        both overlap, words count once. Of all chains those that cover most words are taken, then the best of those
        that don't overlap them in the text, and so on.
        """
        whole = self.sizes[name]
        needed = whole if whole < self.short else self.min_coverage * whole
        if whole < self.short:
            matches = [m for m in matches if m[1] - m[0] == whole]
        if sum(end - start for start, end, _ in matches) < needed:
            return []
        covered, before = [], []
        for i, (start, end, at) in enumerate(matches):
            most, link, j = end - start, -1, i - 1
            while j >= 0 and matches[j][1] >= start - self.max_gap:
                _, end_j, at_j = matches[j]
                if end_j < end and at_j < at and at - (end - start) - at_j <= self.max_gap:
                    new = (end - start) - max(0, end_j - start, at_j - (at - (end - start)))
                    if new > 0 and covered[j] + new > most:
                        most, link = covered[j] + new, j
                j -= 1
            covered.append(most)
            before.append(link)
        spans, taken = [], []
        for i in sorted((i for i in range(len(matches)) if covered[i] >= needed), key=lambda i: (-covered[i], i)):
            first = i
            while before[first] >= 0:
                first = before[first]
            start, end = matches[first][0], matches[i][1]
            place = bisect.bisect(taken, (start, end))
            if (place and taken[place - 1][1] > start) or (place < len(taken) and taken[place][0] < end):
                continue
            taken.insert(place, (start, end))
            template_start = matches[first][2] - (matches[first][1] - start)
            spans.append({
                "label": self.labels[name], "template": name, "start_word": start, "end_word": end, "template_start": template_start,
                "template_end": matches[i][2], "covered": covered[i], "coverage": covered[i] / whole,
            })
        return spans

    def best(self, spans: list[dict]) -> list[dict]:
        """Without spans most of whose place a span of another label covers with more words (or as many, but more of its
        template), in the order of the text."""
        spans = sorted(spans, key=lambda s: (s["start_word"], s["template"]))
        starts = [s["start_word"] for s in spans]
        longest = max((s["end_word"] - s["start_word"] for s in spans), default=0)

        def stands(span: dict) -> bool:
            start, end = span["start_word"], span["end_word"]
            near = spans[bisect.bisect_left(starts, start - longest) : bisect.bisect_left(starts, end)]
            over = (min(end, o["end_word"]) - max(start, o["start_word"]) for o in near if o["label"] != span["label"] and (o["covered"], o["coverage"]) > (span["covered"], span["coverage"]))
            return 2 * max(over, default=0) <= end - start

        return [s for s in spans if stands(s)]


SPAN = "array<struct<label:string,template:int,start_word:bigint,end_word:bigint,template_start:int,template_end:int,covered:int,coverage:double>>"
ADDED = f"n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {SPAN}"


def license_scan(
    df: DataFrame,
    *,
    text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = BASE_PHRASES,
    min_match: int = 4,
    min_coverage: float = 0.6,
    max_gap: int = 20,
    short: int = 20,
    keep_text: bool = True,
) -> DataFrame:
    """All rows of ``df`` with the places of phrases, labels, a score from 0 to 1 (1 where a phrase stands, else the best
    coverage of a template) and the covered ``spans``.

    Null texts are empty; they have no words, no labels (empty strings) and score 0. Input columns of the result's names
    are replaced. An empty table gives no rows.
    """
    fields = T._parse_datatype_string(ADDED).fields
    added = [f.name for f in fields]
    names = [c for c in df.columns if c not in added and (keep_text or c != text_col)]
    given = df.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    schema = T.StructType([given.schema["row"], *fields])
    span = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("template_start", pa.int32()), ("template_end", pa.int32()), ("covered", pa.int32()), ("coverage", pa.float64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(templates, phrases, min_match, min_coverage, max_gap, short)
        for batch in batches:
            found = [scanner.scan(text.as_py()) for text in batch.column("text")]
            columns = [pa.array([x[a] for x in found], kind) for a, kind in zip(added, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names=["row", *added])

    return given.mapInArrow(work, schema).select("row.*", *added)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan(documents, phrases=QUERY_PHRASES, keep_text=False).drop("spans")
