"""Queries that clear, class and parse texts made of the tables' own, with SQL that computes what must come of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeloom.functions import text
from noticeloom.functions import values as V
from noticeloom.operators import lines, listing, page_rules, recommend, region
from noticeloom.plans.bridge import NOTICES, TODAY, now, table
from noticeloom.plans.payload_queries import quoted
from noticeloom.plans.register import query
from noticeloom.plans.text_queries import BODY, NAMES, PAGES, in_turn, in_turn_sql, with_id, with_id_sql
from noticeloom.sources import adapters

# -- SQL of the rules ------------------------------------------------------------------------------------------------

BLANKS = "'" + text.BLANKS + "'"
ENDINGS = "|".join(V.QUESTION_ENDINGS)


def let(value: str, body: str, name: str = "x") -> str:
    """A value that a body names several times."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def replaced(value: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        value = f"regexp_replace({value}, '{pattern}', {by}, 'g')"
    return value


NAMED = [("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;|&apos;", "chr(39)")]
UNTAGGED = [(r"(?i)<br\s*/?>", "chr(10)"), ("(?i)</p>", "chr(10)"), ("<[^>]+>", "' '")]
PACKED = [(r"[ \t]+", "' '"), (rf"\n{text.WS}+", "chr(10)")]


def coded(value: str, pattern: str, number: str) -> str:
    """Numeric entities as characters."""
    found = f"list_transform(regexp_extract_all(x, '{pattern}', 1), lambda h: chr(CAST({number} AS INTEGER)))"
    parts = f"string_split_regex(x, '{pattern.replace('(', '(?:', 2).replace('(?:?i)', '(?i)') if pattern.startswith('(?i)') else pattern.replace('(', '(?:')}')"
    joined = "array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(f[i], '')), '')"
    return let(value, let(parts, let(found, joined, "f"), "p"))


def sanitized(value: str) -> str:
    named = replaced(value, ("(?i)&nbsp;", "' '"), *[(f"(?i){p}", by) for p, by in NAMED])
    decoded = coded(coded(named, "(?i)&#x([0-9a-f]+);", "('0x' || h)"), r"&#(\d+);", "h")
    plain = replaced(decoded, *UNTAGGED, (text.EMOJI, "''"), (r"[ \t]{2,}", "' '"), (r"\n[ \t]+", "chr(10)"))
    leading = let(f"trim({plain}, {BLANKS})", f"CASE WHEN starts_with(x, '?') THEN ltrim(x, '?' || {BLANKS}) ELSE x END")
    kept = f"CASE WHEN regexp_matches(y, '(?:{ENDINGS})$') AND substr(x, length(y) + 1, 1) = '?' THEN y || '?' ELSE y END"
    return let(leading, f"CASE WHEN ends_with(x, '?') THEN {let(f'rtrim(x, chr(63) || {BLANKS})', kept, 'y')} ELSE x END")


def stripped(value: str) -> str:
    return f"trim({replaced(f'nullif({value}, {chr(39) * 2})', *NAMED, *UNTAGGED, *PACKED)}, {BLANKS})"


def cleaned(value: str) -> str:
    plain = f"trim({replaced(f'nullif({value}, {chr(39) * 2})', *NAMED, ('&nbsp;', chr(39) + ' ' + chr(39)), *UNTAGGED, *PACKED)}, {BLANKS})"
    return f"nullif({sanitized(plain)}, '')"


#: A page's source with some letters as entities, emoji, and stray question marks at its ends.
SPOILT = """'? ' || chr(10) || '?? ' || replace(replace(replace(replace(html, 'o', '&#111;'), 'u', '&#X75;'), '. ', '.&NBSP;😀  '), '<h1>', '&lt;b&amp;gt;') || CASE page_id % 3 WHEN 0 THEN ' ??' WHEN 1 THEN ' 신청할까? ?' ELSE ' ' END"""


@query(f"SELECT page_id, {sanitized('t')} AS shown, {stripped('t')} AS stripped, {cleaned('t')} AS cleaned FROM (SELECT page_id, {SPOILT} AS t FROM pages)")
def page_sources_cleared(spark, sf_dir):
    """Whole pages' sources for display, from an adapter, and of a detail field."""
    spoilt = F.col("html")
    for old, new in (("o", "&#111;"), ("u", "&#X75;"), (". ", ".&NBSP;😀  "), ("<h1>", "&lt;b&amp;gt;")):
        spoilt = F.replace(spoilt, F.lit(old), F.lit(new))
    id_ = F.col("page_id") % 3
    made = F.concat(F.lit("? \n?? "), spoilt, F.when(id_ == 0, " ??").when(id_ == 1, " 신청할까? ?").otherwise(" "))
    given = table(spark, sf_dir, "pages").select("page_id", made.alias("t"))
    return given.select("page_id", *[text.once(F.col("t"), f).alias(c) for f, c in ((text.sanitize, "shown"), (text.strip_html, "stripped"), (text.clean_text, "cleaned"))])


ASCII = "".join(map(chr, range(33, 127)))
WIDE = "".join(chr(c + 0xFEE0) for c in range(33, 127))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(lower(text || ' ' || (2000 + doc_id % 30) || '년도'), '(\d{4})년도', '\1년', 'g'), '[^0-9a-z가-힣ㄱ-ㅎㅏ-ㅣ]', '', 'g') AS of_ingest,
    regexp_replace(lower(text || ' ' || (2000 + doc_id % 30) || '년도'), '[^0-9a-z가-힣]', '', 'g') AS of_view FROM documents""")
def texts_folded(spark, sf_dir):
    """Whole texts in full-width letters are folded by ingest to what their narrow form is; the view's form is of the narrow one."""
    told = F.concat("text", F.lit(" "), (2000 + F.col("doc_id") % 30).cast("string"), F.lit("년도"))
    made = table(spark, sf_dir, "documents").select("doc_id", F.translate(told, ASCII, WIDE).alias("wide"), told.alias("narrow"))
    return made.select("doc_id", text.dedup_title(F.col("wide")).alias("of_ingest"), text.view_title(F.col("narrow")).alias("of_view"))


# -- lines -----------------------------------------------------------------------------------------------------------

#: Lines of a document with marks by their length; some are cut to the size of a heading, some are empty.
MARKED = "CASE length(l) % 7 WHEN 0 THEN '※ ' || l || ' 유의' WHEN 1 THEN '□ ' || l WHEN 2 THEN '- ' || l WHEN 3 THEN '' WHEN 4 THEN l ELSE substr(l, 1, 5 + length(l) % 9) END"


@query(
    rf"""WITH marked AS (SELECT doc_id, i, trim(list_transform([string_split(text, chr(10))[i]], lambda l: {MARKED})[1], {BLANKS}) AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    classed AS (SELECT *, CASE WHEN line = '' THEN 'g' WHEN regexp_matches(line, '^[※☞]') THEN 'n' WHEN regexp_matches(line, '^[□■◎○▶]') THEN 'i' WHEN regexp_matches(line, '^[-·•◦ㆍ]') THEN 'b'
      WHEN length(line) BETWEEN 2 AND 22 AND NOT regexp_matches(line, '[.:,?!~]$|(?:습니다|합니다|주세요|바랍니다|하세요)$|^(?:해당\s*없음|없음|상시|무료)$|(?i:https?://)|\d{{4}}[.\-/]\d{{1,2}}') THEN 'T' ELSE 'p' END AS class FROM marked),
    walked AS (SELECT doc_id, list_reduce(list_prepend('', list(class ORDER BY i)), lambda acc, c: acc || CASE WHEN c <> 'T' THEN c
      WHEN right(rtrim(acc, 'g'), 1) = 'i' THEN 'p' WHEN right(rtrim(acc, 'g'), 1) = 'H' OR (right(rtrim(acc, 'g'), 1) = 'S' AND right(acc, 1) <> 'g') THEN 'S'
      WHEN acc = '' OR right(acc, 1) = 'g' OR rtrim(acc, 'g') = '' THEN 'H' ELSE 'p' END) AS kinds FROM classed GROUP BY doc_id),
    told AS (SELECT doc_id, i, line, substr(kinds, CAST(i AS INTEGER), 1) AS k FROM classed JOIN walked USING (doc_id))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS place, CASE k WHEN 'n' THEN 'note' WHEN 'i' THEN 'item' WHEN 'b' THEN 'bullet' WHEN 'H' THEN 'heading' WHEN 'S' THEN 'subheading' ELSE 'paragraph' END AS kind,
      k = 'n' AND regexp_matches(line, '주의|유의|반드시|필수|불이익|제외|금지|불가') AS warning, CASE WHEN k IN ('n', 'i', 'b') THEN regexp_replace(line, '^.\s*', '') ELSE line END AS line FROM told WHERE line <> ''"""
)
def lines_of_texts(spark, sf_dir):
    """Kinds of all lines of all documents."""

    def marked(line):
        n = F.length(line)
        short = F.substr(line, F.lit(1), 5 + n % 9)
        return F.when(n % 7 == 0, F.concat(F.lit("※ "), line, F.lit(" 유의"))).when(n % 7 == 1, F.concat(F.lit("□ "), line)).when(n % 7 == 2, F.concat(F.lit("- "), line)).when(n % 7 == 3, "").when(n % 7 == 4, line).otherwise(short)

    content = F.array_join(F.transform(F.split("text", "\n"), marked), "\n")
    found = lines.text_lines(table(spark, sf_dir, "documents").select("doc_id", content.alias("content")), "content")
    return found.select("doc_id", "place", "kind", "warning", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("line"))


#: All words of a document, with marks before or after some, and a line's end after each ninth.
STYLED = "CASE WHEN i % 7 = 0 THEN '[[em]]' WHEN i % 11 = 0 THEN '[[b]]' ELSE '' END || w || CASE WHEN i % 5 = 0 THEN '[[/em]]' WHEN i % 6 = 0 THEN '[[/b]]' ELSE '' END"


@query(
    rf"""WITH words AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents),
    told AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n, ws FROM words),
    marks AS (SELECT doc_id, i, i // 9 AS line, ws[i] AS w, CASE WHEN i % 9 = 8 OR i = n THEN '' ELSE ' ' END AS after,
      CASE WHEN i % 7 = 0 THEN 1 ELSE 0 END AS em_up, CASE WHEN i % 7 <> 0 AND i % 11 = 0 THEN 1 ELSE 0 END AS b_up, CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END AS em_down, CASE WHEN i % 5 <> 0 AND i % 6 = 0 THEN 1 ELSE 0 END AS b_down FROM told),
    -- At each word its text, and then what follows it, as the close stands between. Sums of opens and closes never below zero: less the lowest so far.
    steps AS (SELECT doc_id, line, i * 2 AS pos, w AS t, em_up AS em, b_up AS b FROM marks UNION ALL SELECT doc_id, line, i * 2 + 1, after, -em_down, -b_down FROM marks),
    summed AS (SELECT *, sum(em) OVER o AS es, sum(b) OVER o AS bs FROM steps WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    open AS (SELECT *, es - least(0, min(es) OVER o) > 0 AS red, bs - least(0, min(bs) OVER o) > 0 AS bold FROM summed WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    runs AS (SELECT *, CASE WHEN lag(red) OVER (PARTITION BY doc_id, line ORDER BY pos) = red AND lag(bold) OVER (PARTITION BY doc_id, line ORDER BY pos) = bold THEN 0 ELSE 1 END AS starts FROM open WHERE t <> ''),
    numbered AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, line ORDER BY pos) AS run FROM runs),
    segments AS (SELECT doc_id, line, run, string_agg(t, '' ORDER BY pos) || ':' || any_value(red) || ':' || any_value(bold) AS s FROM numbered GROUP BY ALL)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS place, string_agg(s, '|' ORDER BY run) AS segments FROM segments GROUP BY doc_id, line"""
)
def emphasis_of_texts(spark, sf_dir):
    """Red and bold parts that run across the lines of whole texts; closes too many count for nothing."""

    def styled(w, k):
        i = k + 1
        up = F.when(i % 7 == 0, "[[em]]").when(i % 11 == 0, "[[b]]").otherwise("")
        down = F.when(i % 5 == 0, "[[/em]]").when(i % 6 == 0, "[[/b]]").otherwise("")
        return F.concat(up, w, down, F.when(i % 9 == 8, "\n").otherwise(" "))

    content = F.rtrim(F.array_join(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), styled), ""))
    found = lines.text_lines(table(spark, sf_dir, "documents").select("doc_id", content.alias("content")), "content")
    one = lambda s: F.concat_ws(":", s["text"], s["red"].cast("string"), s["bold"].cast("string"))
    return found.select("doc_id", "place", F.array_join(F.transform("segments", one), "|").alias("segments"))


# -- places ----------------------------------------------------------------------------------------------------------

TOWNS = {name for names in region.PLACES.values() for name in names}
GAZETTEER = ", ".join(f"('{name}', '{r}', {str(name in TOWNS).lower()})" for name, r in NAMES)
PLACED = f"""CASE WHEN doc_id % 4 = 0 THEN '[' || {{name}} || '] ' || {{own}} WHEN doc_id % 4 = 1 THEN {{own}} || ' ' || {{name}} || ' ' || {{own}} WHEN doc_id % 4 = 2 THEN {{own}} || ' ' || {{name}} || ' 소재 ' || {{own}} ELSE {{own}} || {{name}} || '의 ' || {{own}} END"""
OWN = "trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))"


@query(
    rf"""WITH names(name, region, town) AS (VALUES {GAZETTEER}),
    made AS (SELECT doc_id, {PLACED.format(name=in_turn_sql([n for n, _ in NAMES], "doc_id"), own=OWN)} AS title FROM documents),
    met AS (SELECT doc_id, title, name, town, strpos(title, name) - 1 AS start, CASE WHEN name = '{region.TWIN}' AND regexp_matches(title, '{region.TWIN_MARK.pattern}') THEN '{region.TWIN_REGION}' ELSE region END AS region
      FROM made JOIN names ON contains(title, name)),
    counted AS (SELECT * FROM met WHERE (town OR length(name) > 2 OR NOT (regexp_matches(substr(title, start, 1), '[가-힣]') OR regexp_matches(substr(title, start + length(name) + 1, 1), '[가-힣]')))
      AND (town OR regexp_matches(title, '{region.LOCATION.pattern}') OR regexp_matches(substr(title, 1, start), '^[\s\[(（【]{{0,3}}$'))),
    around AS (SELECT *, substr(title, greatest(0, start - 55) + 1, CAST(least(length(title), start + length(name) + 75) - greatest(0, start - 55) AS BIGINT)) AS near FROM counted),
    last AS (SELECT doc_id, count(DISTINCT region) AS regions, arg_max(region, start * 1000 - length(name)) AS region, arg_max(near, start * 1000 - length(name)) AS near FROM around GROUP BY doc_id)
    SELECT m.doc_id, CASE WHEN regions = 1 THEN region ELSE '{V.UNKNOWN_REGION}' END AS region, CASE WHEN regions = 1 THEN 'single_region' WHEN regions > 1 THEN 'conflict_or_multiple' ELSE 'no_evidence' END AS reason,
      CASE WHEN regions = 1 THEN 'title' END AS evidence_field, CASE WHEN regions = 1 THEN CASE WHEN length(near) <= 140 THEN near ELSE substr(near, 1, 137) || '...' END END AS evidence_snippet
    FROM made m LEFT JOIN last USING (doc_id)"""
)
def places_in_texts(spark, sf_dir):
    """Names of all places in titles made of whole texts: in brackets before them, among their words with and without a
    word of location, and with letters that join them; with the words around as evidence."""
    own = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
    name, id_ = in_turn([n for n, _ in NAMES], "doc_id"), F.col("doc_id") % 4
    title = F.when(id_ == 0, F.concat(F.lit("["), name, F.lit("] "), own)).when(id_ == 1, F.concat(own, F.lit(" "), name, F.lit(" "), own)).when(id_ == 2, F.concat(own, F.lit(" "), name, F.lit(" 소재 "), own)).otherwise(F.concat(own, name, F.lit("의 "), own))
    none = F.lit(None).cast("string")
    made = table(spark, sf_dir, "documents").select("doc_id", title.alias("title"))
    return made.select("doc_id", region.infer_region("title", none, none, none).alias("r")).select("doc_id", "r.region", "r.reason", "r.evidence_field", "r.evidence_snippet")


# -- addresses and pages -----------------------------------------------------------------------------------------------

ADDRESS = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '  ' || regexp_replace(url, '^https?://', 'www.') || ' ' WHEN 2 THEN regexp_replace(url, '^https?', 'ftp') WHEN 3 THEN 'http://10.' || (page_id % 256) || '.0.1/' || page_id ELSE 'https://172.' || (page_id % 40) || '.1.1:8080/' || page_id END"


@query(
    rf"""WITH told AS (SELECT page_id, regexp_replace(trim({ADDRESS}), '(?i)^www[.]', 'https://www.') AS a FROM pages),
    kept AS (SELECT page_id, CASE WHEN regexp_matches(a, '(?i)^https?://') THEN a END AS url FROM told),
    hosts AS (SELECT *, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM kept)
    SELECT page_id, url, url IS NOT NULL AND (host IN ('example.com', 'example.net') OR ends_with(host, '.example.com') OR ends_with(host, '.example.net')) AS of_domain,
      url IS NOT NULL AND (starts_with(host, '10.') OR (starts_with(host, '172.') AND TRY_CAST(string_split(host, '.')[2] AS INTEGER) BETWEEN 16 AND 31)) AS private FROM hosts"""
)
def page_addresses(spark, sf_dir):
    """Pages' addresses, some without a scheme or with another, some of private hosts."""
    id_, url = F.col("page_id"), F.col("url")
    forms = F.when(id_ % 5 == 0, url).when(id_ % 5 == 1, F.concat(F.lit("  "), F.regexp_replace(url, "^https?://", "www."), F.lit(" "))).when(id_ % 5 == 2, F.regexp_replace(url, "^https?", "ftp"))
    forms = forms.when(id_ % 5 == 3, F.concat(F.lit("http://10."), (id_ % 256).cast("string"), F.lit(".0.1/"), id_.cast("string"))).otherwise(F.concat(F.lit("https://172."), (id_ % 40).cast("string"), F.lit(".1.1:8080/"), id_.cast("string")))
    made = table(spark, sf_dir, "pages").select("page_id", text.http_url(forms).alias("url"))
    private = F.coalesce(text.private_host(F.try_parse_url("url", F.lit("HOST"))), F.lit(False))
    return made.select("page_id", "url", text.host_in(F.col("url"), ["example.com", "example.net"]).alias("of_domain"), private.alias("private"))


#: A page's own letters, in the place of the examples' text.
LETTERS = "trim(regexp_replace(html, '[^A-Za-z]+', ' ', 'g'))"
OF_PAGE = [[None if x is None else x.replace(BODY, "§") for x in p] for p in PAGES]
JSON = "replace(replace(coalesce(chr(34) || {} || chr(34), 'null'), chr(10), '\\n'), chr(9), '\\t')"


def own_sql(i: int) -> str:
    return f"replace({with_id_sql(in_turn_sql([p[i] for p in OF_PAGE], 'page_id'), 'page_id')}, '§', {LETTERS})"


def own_json(c: str) -> str:
    return JSON.format(c)


@query(
    f"""WITH told AS (SELECT page_id, {own_sql(2)} AS detail_content, {own_sql(3)} AS apply_method, CASE WHEN page_id % {len(PAGES)} = 1 THEN '02-' || page_id END AS contact, {own_sql(4)} AS files, {in_turn_sql([p[5] for p in OF_PAGE], "page_id")} AS reason FROM pages),
    filed AS (SELECT *, CASE WHEN files = '' THEN '[]' ELSE '[{{"label":"' || split_part(files, '|', 1) || '","url":"' || split_part(files, '|', 2) || '"}}]' END AS listed FROM told)
    SELECT page_id, detail_content, apply_method, contact, files, reason, sha256('{{"detail_content":' || {own_json("detail_content")} || ',"apply_method":' || {own_json("apply_method")} || ',"documents":null,"contact":' || {own_json("contact")} || ',"attachments":' || listed || '}}') AS detail_hash FROM filed"""
)
def page_contents(spark, sf_dir):
    """Pages of each source's making that hold the pages' own letters, whole, and the hashes of what is read from them."""
    own = F.trim(F.regexp_replace("html", "[^A-Za-z]+", " "))
    page = F.replace(with_id(in_turn([p[1] for p in OF_PAGE], "page_id"), "page_id"), F.lit("§"), F.col("own"))
    made = table(spark, sf_dir, "pages").select("page_id", own.alias("own")).select("page_id", page.alias("html"), F.lit("https://h.kr/view.do?nttSeqNo=77").alias("url"))
    parsed = page_rules.parse_pages(made, in_turn([p[0] for p in OF_PAGE], "page_id")).select("page_id", "detail.*", F.col("detail_content_hash").alias("detail_hash"))
    files = F.array_join(F.transform("attachments", lambda a: F.concat_ws("|", a["label"], a["url"])), ";")
    return parsed.select("page_id", "detail_content", "apply_method", "contact", files.alias("files"), "reason", "detail_hash")


# -- requests ----------------------------------------------------------------------------------------------------------


@query(NOTICES + f"""SELECT id, array_to_string(list_sort(list_distinct(list_filter([9, 3, 12, 0, source_id, 3, NULL], lambda c: c BETWEEN 1 AND 9))), ',') AS categories FROM seen
    WHERE status = 'open' AND created_at > TIMESTAMP '2026-02-02' ORDER BY created_at DESC, id DESC LIMIT 101""")
def feed_categories(spark, sf_dir):
    """Category ids of a feed, sorted and once each, of rows that repeat them and have others."""
    from noticeloom.plans.registry import view

    made = F.array(*[F.lit(x) for x in (9, 3, 12, 0)], F.col("source_id"), F.lit(3), F.lit(None).cast("int"))
    feed = listing.notification_feed(view(spark, sf_dir).withColumn("category_ids", made), listing.FeedParams("2026-02-02 00:00:00", 1, 100, None), now())
    return feed.where(F.array_contains("notification_types", "new")).orderBy(F.desc("created_at"), F.desc("id")).select("id", F.array_join(F.col("category_ids").cast("array<string>"), ",").alias("categories"))


REQUESTS = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(event_id % 140 AS VARCHAR) WHEN 2 THEN '07' WHEN 3 THEN '-1' ELSE '' END AS lim,
    CASE event_id % 7 WHEN 0 THEN CAST(event_id % 40 AS VARCHAR) WHEN 1 THEN '1.5' ELSE NULL END AS within,
    CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.250+09:00' WHEN 2 THEN strftime(ts, '%Y-%m-') || '31T25:00:00Z' WHEN 3 THEN strftime(ts, '%Y-%m-%d') WHEN 4 THEN ' ' ELSE NULL END AS since, ts FROM events"""


@query(
    f"""WITH asked AS ({REQUESTS}),
    judged AS (SELECT *, CASE WHEN coalesce(trim(since), '') <> '' AND event_id % 6 IN (2, 3) THEN 'since' WHEN within = '1.5' OR TRY_CAST(within AS BIGINT) NOT BETWEEN 1 AND 30 THEN 'deadlineWithinDays'
      WHEN coalesce(lim, '') <> '' AND (lim = '-1' OR CAST(lim AS BIGINT) < 1) THEN 'limit' END AS error FROM asked)
    SELECT event_id, error, CASE WHEN error IS NULL THEN CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 9 HOUR + INTERVAL 250 MILLISECOND END END AS since,
      CASE WHEN error IS NULL THEN CAST(coalesce(TRY_CAST(within AS INTEGER), 7) AS INTEGER) END AS within, CASE WHEN error IS NULL THEN CAST(least(100, coalesce(TRY_CAST(nullif(lim, '') AS INTEGER), 100)) AS INTEGER) END AS lim FROM judged"""
)
def feed_requests(spark, sf_dir):
    """Requests of each event's time, checked in bulk: the first parameter that is wrong, or all as they count."""
    id_, ts = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    limit = F.when(id_ % 5 == 1, (id_ % 140).cast("string")).when(id_ % 5 == 2, "07").when(id_ % 5 == 3, "-1").when(id_ % 5 == 4, "")
    within = F.when(id_ % 7 == 0, (id_ % 40).cast("string")).when(id_ % 7 == 1, "1.5")
    since = F.when(id_ % 6 == 0, F.concat(ts, F.lit("Z"))).when(id_ % 6 == 1, F.concat(ts, F.lit(".250+09:00"))).when(id_ % 6 == 2, F.concat(F.substr(ts, F.lit(1), F.lit(8)), F.lit("31T25:00:00Z"))).when(id_ % 6 == 3, F.substr(ts, F.lit(1), F.lit(10))).when(id_ % 6 == 4, " ")
    asked = table(spark, sf_dir, "events").select("event_id", since.alias("since"), within.alias("deadlineWithinDays"), limit.alias("limit"))
    checked = listing.checked_requests(asked)
    return checked.select("event_id", "error", "since", F.col("deadlineWithinDays").alias("within"), F.col("limit").alias("lim"))


@query("""SELECT event_id, CAST(CASE WHEN event_id % 4 < 2 THEN greatest(1, floor(value / 10 - 3)) ELSE 1 END AS BIGINT) AS page, CAST(least(100, CASE event_id % 4 WHEN 0 THEN 10 WHEN 3 THEN 10 ELSE greatest(1, floor(value)) END) AS BIGINT) AS size FROM events""")
def page_requests(spark, sf_dir):
    """Pages and sizes as asked for, whatever numbers they are."""
    id_ = F.col("event_id")
    page = F.when(id_ % 4 < 2, F.col("value") / 10 - 3).when(id_ % 4 == 2, F.lit(float("nan")))
    size = F.when(id_ % 4 == 0, F.lit(float("inf"))).when(id_ % 4 < 3, F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", listing.positive_number(page, 1).alias("page"), F.least(F.lit(100), listing.positive_number(size, 10)).alias("size"))


@query("""SELECT event_id, event_id % 6 = 0 OR event_id % 6 = 5 AS valid, CASE WHEN event_id % 6 IN (0, 5) THEN 'u' || user_id END AS user_type, CASE WHEN event_id % 6 = 0 THEN event_type || ',b' WHEN event_id % 6 = 5 THEN '' END AS interests FROM events""")
def user_conditions(spark, sf_dir):
    """Users' conditions in JSON, of which some lack a field or have one of another type; interests that are no texts are dropped."""
    id_ = F.col("event_id") % 6
    interests = F.when(id_ == 0, F.concat(F.lit('["'), "event_type", F.lit('", 3, null, "b"]'))).when(id_ == 1, '"all"').otherwise("[]")
    told = F.concat(
        F.lit('{"user_type":"u'), F.col("user_id").cast("string"), F.lit('","region":'), F.when(id_ == 2, "7").otherwise('"seoul"'), F.lit(',"industry":"","startup_years":"",'),
        F.when(id_ == 3, "").otherwise('"onboarding_completed":true,'), F.lit('"schema_version":'), F.when(id_ == 4, "1.5").when(id_ == 5, "2.0").otherwise("1"), F.lit(',"interests":'), interests, F.lit("}"),
    )
    made = table(spark, sf_dir, "events").select("event_id", recommend.conditions(told).alias("c"))
    return made.select("event_id", F.col("c").isNotNull().alias("valid"), "c.user_type", F.array_join("c.interests", ",").alias("interests"))


@query("""SELECT event_id, sha256('{"a":' || event_id || ',"k":' || regexp_extract(props, '[0-9]+') || ',"z":{"b":null,"c":["x",1]}}' || CASE WHEN event_id % 2 = 0 THEN chr(10) || 'msit-detail-v2' ELSE '' END) AS hash FROM events""")
def payload_hashes(spark, sf_dir):
    """Payloads whose keys come in another order have one hash; one source's parser has a version in it."""
    number = F.regexp_extract("props", "[0-9]+", 0)
    raw = F.concat(F.lit('{ "z" : {"c":["x", 1],"b":null}, "k":'), number, F.lit(' , "a":'), F.col("event_id").cast("string"), F.lit("}"))
    source = F.when(F.col("event_id") % 2 == 0, V.SOURCE_ID["msit"]).otherwise(1)
    return table(spark, sf_dir, "events").select("event_id", adapters.payload_hash(raw, source).alias("hash"))
