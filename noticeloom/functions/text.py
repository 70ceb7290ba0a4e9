"""Text functions on columns. All but the folding of Unicode forms stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.functions.values import QUESTION_ENDINGS

#: White space as Unicode-aware trimming sees it; spelled out, as regex dialects differ on the short form.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same characters as a text, for trimming without a regex.
BLANKS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Characters and marks that are cleared or recognised.
EMOJI = r"[\x{1F000}-\x{10FFFF}]|[\x{2600}-\x{27BF}]\x{FE0F}?|\x{FE0F}|\x{200D}"
BRACKETS = r"[\[\]()〈〉<>「」『』【】]"
#: Texts that are folded at once.
NFKC_TEXTS = 256
EMPHASIS = r"\[\[/?(?:em|b)\]\]"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c computed once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def replaced(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(by))
    return c


def trimmed(c: Column) -> Column:
    """Without white space at the ends; linear in the text, as a regex that seeks its end isn't."""
    return F.btrim(c, F.lit(BLANKS))


def has_text(c: Column) -> Column:
    return F.coalesce(F.length(trimmed(c)) > 0, F.lit(False))


def first_text(*candidates: Column) -> Column:
    """The first candidate that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(trimmed(c), F.lit("")) for c in candidates])


def contains_any(c: Column, keywords: list[str]) -> Column:
    """Whether the lower-cased text has one of the keywords; null has none."""
    return F.coalesce(once(F.lower(c), lambda text: has_one(text, keywords)), F.lit(False))


def has_one(text: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(k.lower()) for k in keywords], F.lit(False))


# -- HTML remains ----------------------------------------------------------------------------------------------------

# Fixed values. Ampersands first, so that twice encoded tags become tags and go.
NAMED = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'")]
BREAKS = [(r"(?i)<br\s*/?>", "\n"), ("(?i)</p>", "\n")]


def untagged(c: Column) -> Column:
    """Line ends for breaks and paragraphs, a space for each other tag. What follows the last ``>`` has no tag and isn't
    searched for one, so that texts full of ``<`` take no longer than others."""

    def spaced(text: Column) -> Column:
        rest = F.substring_index(text, ">", -1)
        return once(rest, lambda r: F.concat(F.regexp_replace(F.substr(text, F.lit(1), F.length(text) - F.length(r)), F.lit("<[^>]+>"), F.lit(" ")), r))

    return once(replaced(c, *BREAKS), spaced)


def strip_html(c: Column) -> Column:
    """Plain text of an adapter's field; empty becomes null only if it was."""
    return trimmed(replaced(untagged(replaced(F.nullif(c, F.lit("")), *NAMED)), (r"[ \t]+", " "), (rf"\n{WS}+", "\n")))


def _code_points(c: Column, pattern: str, radix: int) -> Column:
    """Numeric entities as characters; what is no character stays."""

    def character(entity: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(entity, pattern, 1), "^0+(?=.)", "")
        code = F.when(F.length(digits) <= 7, F.conv(digits, radix, 10).cast("int"))
        decoded = once(code, lambda n: F.when((n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
        return F.coalesce(decoded, entity)

    def joined(text: Column) -> Column:
        entities = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), character)
        return F.array_join(F.zip_with(F.split(text, pattern), entities, lambda part, char: F.concat(part, F.coalesce(char, F.lit("")))), "")

    return once(c, lambda text: F.when(text.rlike(pattern), joined(text)).otherwise(text))


def decode_entities(c: Column) -> Column:
    c = replaced(c, ("(?i)&nbsp;", " "), *[(f"(?i){p}", by) for p, by in NAMED])
    return _code_points(_code_points(c, "(?i)&#x([0-9a-f]+);", 16), r"&#(\d+);", 10)


def strip_question_marks(c: Column) -> Column:
    """Question marks at the edges are traces of broken characters, but one stays after what ends like a question."""

    def stripped(text: Column) -> Column:
        base = F.rtrim(text, F.lit("?" + BLANKS))
        return once(base, lambda b: F.when(b.rlike("(?:" + "|".join(QUESTION_ENDINGS) + ")$") & (F.substr(text, F.length(b) + 1, F.lit(1)) == "?"), F.concat(b, F.lit("?"))).otherwise(b))

    leading = once(c, lambda text: F.when(text.startswith("?"), F.ltrim(text, F.lit("?" + BLANKS))).otherwise(text))
    return once(leading, lambda text: F.when(text.endswith("?"), stripped(text)).otherwise(text))


def sanitize(c: Column) -> Column:
    """Text for display: entities, tags, emoji, white space and stray question marks are cleared."""
    plain = replaced(untagged(decode_entities(c)), (EMOJI, ""), (r"[ \t]{2,}", " "), (r"\n[ \t]+", "\n"))
    return strip_question_marks(trimmed(plain))


def clean_text(c: Column) -> Column:
    """Plain display text of a detail field; blank is null."""
    plain = replaced(untagged(replaced(F.nullif(c, F.lit("")), *NAMED, ("&nbsp;", " "))), (r"[ \t]+", " "), (rf"\n{WS}+", "\n"))
    return F.nullif(sanitize(trimmed(plain)), F.lit(""))


def strip_emphasis(c: Column) -> Column:
    return replaced(c, (EMPHASIS, ""))


# -- titles ----------------------------------------------------------------------------------------------------------


@F.arrow_udf(T.StringType())
def nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Few texts at a time, so that memory follows these and not the batch."""
    for batch in batches:
        for start in range(0, len(batch), NFKC_TEXTS):
            yield pa.array([s if s is None or s.isascii() else unicodedata.normalize("NFKC", s) for s in batch.slice(start, NFKC_TEXTS).to_pylist()], pa.string())


def hash_form(c: Column) -> Column:
    """For content hashes: no white space, no brackets, lower case."""
    return F.lower(replaced(F.coalesce(c, F.lit("")), (WS, ""), (BRACKETS, "")))


def content_hash(title: Column, organization: Column, apply_end: Column) -> Column:
    end = F.coalesce(F.date_format(apply_end, "yyyy-MM-dd"), F.lit(""))
    return F.sha2(F.concat_ws("|", hash_form(title), hash_form(organization), end), 256)


def view_title(c: Column) -> Column:
    """For the public view: digits, Latin letters and Hangul syllables."""
    return replaced(F.lower(c), ("[^0-9a-z가-힣]", ""))


def dedup_title(c: Column) -> Column:
    """For ingest: compatibility forms folded, 'year of' forms unified; single Hangul letters are kept where folding
    leaves them."""
    return replaced(F.lower(nfkc(c)), (r"(\d{4})년도", "$1년"), ("[^0-9a-z가-힣ㄱ-ㅎㅏ-ㅣ]", ""))


def digit_signature(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), "|")


def bigrams(c: Column) -> Column:
    """Bigrams, each with its occurrence number, so that sets of them intersect as multisets do; in time linear in the
    text but for a sort. Texts of under two characters have none."""
    characters = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    pairs = once(characters, lambda ch: F.array_sort(F.transform(F.sequence(F.lit(1), F.size(ch) - 1), lambda i: F.concat(F.get(ch, i - 1), F.get(ch, i)))))

    def numbered(sorted_: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(sorted_) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(sorted_, i) != F.get(sorted_, i - 1)))

        def runs(at: Column) -> Column:
            end = lambda k: F.coalesce(F.get(at, k + 1), F.size(sorted_))
            each = lambda start, k: F.transform(F.sequence(F.lit(1), end(k) - start), lambda n: F.concat(F.get(sorted_, start), n.cast("string")))
            return F.flatten(F.transform(at, each))

        return once(starts, runs)

    return F.when(F.length(c) >= 2, once(pairs, numbered)).when(c.isNotNull(), F.array().cast("array<string>"))


def dice_of(a: Column, b: Column, grams_a: Column, grams_b: Column) -> Column:
    """Twice the common bigrams by all bigrams; equal texts have 1, others of under two characters 0."""
    common = 2.0 * F.size(F.array_intersect(grams_a, grams_b)) / (F.length(a) + F.length(b) - 2)
    return F.when(a == b, F.lit(1.0)).when((F.length(a) < 2) | (F.length(b) < 2), F.lit(0.0)).otherwise(common)


def dice(a: Column, b: Column) -> Column:
    return dice_of(a, b, bigrams(a), bigrams(b))


# -- addresses -------------------------------------------------------------------------------------------------------


def http_url(c: Column) -> Column:
    """The address if it is one of http or https (``www.`` counts as https), else null."""
    full = F.regexp_replace(trimmed(c), "(?i)^(?=www[.])", "https://")
    return once(full, lambda url: F.when(url.rlike("(?i)^https?://") & F.try_parse_url(url, F.lit("HOST")).isNotNull(), url))


def host_in(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    names = "|".join(d.replace(".", "[.]") for d in domains)
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).rlike(f"^(?:.*[.])?(?:{names})$"), F.lit(False))


def private_host(host: Column) -> Column:
    return F.lower(host).rlike(r"^(?:localhost|.*[.]local|127[.].*|10[.].*|192[.]168[.].*|169[.]254[.].*|172[.](?:1[6-9]|2\d|3[01])[.].*)[.]?$")


def looks_encoded(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9+/]{24,}={0,2}$")


def links(c: Column) -> Column:
    """All http addresses in a text."""
    return F.regexp_extract_all(c, F.lit(r"https?://[^\s\"'<>]+"), F.lit(0))


def valid_uuid(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def valid_id(c: Column) -> Column:
    """A text as the id of a notice: a whole number from 1 to 2**53 - 1, else null."""
    number = trimmed(c).try_cast("bigint")
    return F.when(trimmed(c).rlike("^[0-9]+$") & number.between(1, 2**53 - 1), number)
