"""Token counts by prefix dynamic programming.

The count at a prefix is the count at the last word boundary before it plus the count of the cut word, so one pass over a
text gives the exact token count of every prefix, and truncation or budget questions become searches in that array
instead of new encodings. The counts inside a word are computed once a word and kept for short ones; in long words by a pass that is
linear in the word's length. ``token_counts`` reads its answers off the array run by run; ``prefix_counts`` gives it whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.llm.common import table

#: Letters, digits, marks and spaces on which Python's ``re`` classes and the tokenizers' Unicode classes agree, which
#: have no combining forms, and whose lower case has the same length. Other texts take the tokenizer's own splitting.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-±´-¸º»¿-įı-ɏ‐-‧‰-⁞€]*")
#: The words of word_bpe_49k.json, each with the white space before it.
WORDS = re.compile(r"\s*(?:'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+)|\s+")
#: Words of more characters are neither cached nor encoded prefix by prefix.
SHORT = 64
#: Bytes of cached words a worker, and what an entry takes besides its characters.
CACHE_BYTES, ENTRY = 96 << 20, 200
BLANK = " \t\n\r"
#: In byte-level vocabularies each byte is one character: the printable ones stand for themselves, the others follow
#: from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Texts are worked off in runs of about so many characters, cut at a space, so that memory doesn't grow with a text.
RUN = 1_000_000


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def runs(text: str, size: int = RUN) -> Iterator[str]:
    """Slices that end before a lone space, where no token of the tokenizers used here crosses."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or (not text[cut - 1].isspace() and not text[cut + 1 : cut + 2].isspace()):
                break
            cut += 1
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def as_bytes(word: str) -> str:
    """A word as the vocabulary writes it, one character a byte."""
    return word if word.isascii() and word.isprintable() else word.encode().decode("latin1").translate(BYTE_CHARACTERS)


class PrefixEncoder:
    """Counts at every prefix of one word in time and memory linear in its length.

    A sequence of tokens is what the merges give if and only if each two neighbours are what the merges give for these
    two alone: up to the first merge across a border, the merges on its two sides are those of the two alone. So the
    encoding of a prefix is that of a shorter one and the one last token that fits its last. The last character of a
    word carries a mark (END) in the vocabulary; prefixes are therefore followed without the mark, and only the last
    token is sought with it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): n for n, (a, b) in enumerate(merges)}
        self.end = model["end_of_word_suffix"] or ""
        self.vocabulary = {t: t for t in model["vocab"]}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocabulary)
        self.fits: dict[tuple[str, str], bool] = {}
        self.held = 0

    def merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, len(self.ranks)), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            if rank == len(self.ranks):
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def fit(self, before: str, token: str) -> bool:
        """Whether the merges leave the border between two tokens (or a token alone) as it is."""
        found = self.fits.get((before, token))
        if found is None:
            whole = token.endswith(self.end) and len(token) > len(self.end)
            symbols = [*before, *(token.removesuffix(self.end) if whole else token)]
            if whole:
                symbols[-1] += self.end
            found = self.merged(symbols) == ([before, token] if before else [token])
            self.held += len(before) + len(token) + 2 * ENTRY
            if self.held > CACHE_BYTES // 4:
                self.fits.clear()
                self.held = 0
            self.fits[before, token] = found
        return found

    def last(self, text: str, at: int, tokens: list[str], end: str) -> str:
        """The last token of the encoding of ``text[:at]``, whose shorter prefixes end with ``tokens``."""
        for start in range(at - 1, max(at - self.longest, 0) - 1, -1):
            token = self.vocabulary.get(text[start:at] + end)
            if token is not None and self.fit(tokens[start], token):
                return token
        raise ValueError("no token fits")

    def counts(self, word: str) -> np.ndarray:
        text = as_bytes(word)
        # By bytes: the last token, and the count, of the prefix without the mark.
        tokens, plain = [""], np.zeros(len(text) + 1, dtype="<u4")
        ends = np.cumsum(np.fromiter((len(c.encode()) for c in word), dtype=np.int64, count=len(word)))
        out = np.zeros(len(word), dtype="<u4")
        place = 0
        for at in range(1, len(text) + 1):
            if at == ends[place]:
                token = self.last(text, at, tokens, self.end)
                out[place] = plain[at - len(token) + len(self.end)] + 1
                place += 1
            token = self.last(text, at, tokens, "")
            tokens.append(token)
            plain[at] = plain[at - len(token)] + 1
        return out


class PrefixCounter:
    """Exact token counts at every prefix, for a tokenizer of the splitting of word_bpe_49k.json."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.prefixer = PrefixEncoder(path)
        self.counts: dict[str, int] = {}
        self.tables: dict[str, bytes] = {}
        self.held = 0

    def encoded(self, word: str) -> int:
        if word[0] in "'<" and len(word) <= SHORT:  # may be several words by itself, as a cut contraction or special string is
            return len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return len(self.tokenizer.model.tokenize(as_bytes(word)))  # without splitting, several times as fast

    def hold(self, size: int) -> None:
        """Makes room for so many bytes more."""
        self.held += size
        if self.held > CACHE_BYTES:
            self.tables.clear()
            self.counts.clear()
            self.held = size

    def count(self, word: str) -> int:
        """The count of one whole word (with white space before it), by one encoding."""
        bare = word.lstrip(BLANK)
        found = self.encoded(bare) if bare else 0
        if len(word) <= SHORT:
            self.hold(len(word) + ENTRY)
            self.counts[word] = found
        return found

    def inside(self, bare: str) -> np.ndarray:
        """The count at every prefix of one word without white space before it."""
        if len(bare) <= SHORT:
            return np.fromiter((self.encoded(bare[:i]) for i in range(1, len(bare) + 1)), dtype="<u4", count=len(bare))
        return self.prefixer.counts(bare)

    def table(self, word: str) -> bytes:
        """The count at every prefix of one word (with white space before it), as 32-bit numbers."""
        bare = word.lstrip(BLANK)
        found = bytes(4 * (len(word) - len(bare))) + self.inside(bare).tobytes()
        if len(word) <= SHORT:
            self.hold(5 * len(word) + ENTRY)
            self.tables[word] = found
        return found

    def words(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text) and "<|" not in text:
            return WORDS.findall(text.lower())
        out = []
        for part in self.special.split(text) if self.special else [text]:
            if self.special and self.special.fullmatch(part):
                out.append(part)
                continue
            normal, at = self.tokenizer.normalizer.normalize_str(part), 0
            for _, (start, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                out += [normal[at:start], normal[start:end]]
                at = end
            out.append(normal[at:])
        return [w for w in out if w]

    def prefixes(self, text: str) -> Iterator[np.ndarray]:
        """Token counts after 1, 2, ... characters of the normalised text, in runs."""
        before, known = 0, self.tables
        for run in runs(text):
            words = self.words(run)
            if not words:
                continue
            tables = [known.get(w) or self.table(w) for w in words]
            inside = np.frombuffer(b"".join(tables), dtype="<u4")
            lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            ends = np.cumsum(lengths) - 1
            whole = np.cumsum(inside[ends], dtype=np.int64)
            base = np.concatenate([[0], whole[:-1]]) + before
            yield inside + np.repeat(base, lengths)
            before += int(whole[-1])

    def answer(self, text: str, budgets: tuple[int, ...]) -> tuple[int, list[int]]:
        """The text's count, and for each budget the number of characters of the longest prefix within it, both read off the
        counts of all prefixes, which don't fall from word to word but may within one."""
        total, chars, fit = 0, 0, [0] * len(budgets)
        for counts in self.prefixes(text):
            for i, budget in enumerate(budgets):
                within = np.flatnonzero(counts <= budget) if fit[i] == chars else ()
                if len(within):
                    fit[i] = chars + int(within[-1]) + 1
            total, chars = int(counts[-1]), chars + len(counts)
        return total, fit


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One per Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(df: DataFrame, path: str, *, text_col: str = "text", budgets: tuple[int, ...] = (2048,), keep_text: bool = True) -> DataFrame:
    """All rows of ``df`` with ``n_tokens`` (long) and, per budget B, ``fit_B`` (long): the characters of the longest
    prefix of the normalised text with at most B tokens.

    Null and empty texts have 0 tokens. Special strings count as the library counts them by default; none are added and
    nothing is cut. Input columns of the result's names are replaced. An empty table gives no rows.
    """
    added = ["n_tokens", *[f"fit_{b}" for b in budgets]]
    names = [c for c in df.columns if c not in added and (keep_text or c != text_col)]
    given = df.select(F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    schema = T.StructType([given.schema["row"], *[T.StructField(a, T.LongType()) for a in added]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            found = [count.answer(t or "", budgets) for t in batch.column("text").to_pylist()]
            columns = [pa.array([n for n, _ in found], pa.int64())] + [pa.array([f[i] for _, f in found], pa.int64()) for i in range(len(budgets))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names=["row", *added])

    return given.mapInArrow(work, schema).select("row.*", *added)


def prefix_counts(df: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with ``prefix_counts`` (array of int): the token count of every prefix, one number
    per character of the normalised text; empty for null and empty texts."""
    names = [c for c in df.columns if c != "prefix_counts"]
    given = df.select(F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    schema = T.StructType([given.schema["row"], T.StructField("prefix_counts", T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                parts = list(count.prefixes(text or ""))
                array = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
                counts = pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), pa.array(array))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, 1), counts], names=["row", "prefix_counts"])

    return given.mapInArrow(work, schema).select("row.*", "prefix_counts")


def op7_token_counts(spark, sf_dir: str, limit: int = 2048) -> DataFrame:
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_counts(documents, public_tokenizers.path("word_bpe_49k.json"), budgets=(limit,), keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.col(f"fit_{limit}").alias("fit_chars"))
