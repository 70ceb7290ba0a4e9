"""What is read from a page, as DataFrame functions over its flat nodes and pieces of text.

``flat`` is the struct that :func:`noticeloom.operators.html.flat_page` gives: nodes in the page's order, each with its
number ``i``, parent, the first number after its descendants (``end``), and the range of its pieces; and the pieces, with marks of
emphasis at their levels. A node's descendants and its text are slices of these two arrays.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.functions.text import once
from noticeloom.functions.values import ATTACHMENT, EMPTY_SHELL, LEGACY_EMPTY
from noticeloom.operators import html as H

#: White space at the ends of texts, as Python strips it.
ENDS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
FILES = "array<struct<label:string,url:string>>"


def squeezed(c: Column) -> Column:
    for pattern, by in (("\r", ""), (r"[ \t]+", " "), (" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, F.lit(pattern), F.lit(by))
    return F.btrim(c, F.lit(ENDS))


def is_a(node: Column, selector: Column | str) -> Column:
    return F.array_contains(node["keys"], selector)


def select(nodes: Column, selector: Column | str) -> Column:
    return F.filter(nodes, lambda n: is_a(n, selector))


def below(nodes: Column, node: Column) -> Column:
    return F.slice(nodes, node["i"] + 2, node["end"] - node["i"] - 1)


def text(pieces: Column, node: Column) -> Column:
    """A node's text with line ends after blocks, and marks around red and bold parts (the outermost)."""
    own = F.filter(F.slice(pieces, node["first"] + 1, node["last"] - node["first"]), lambda p: (p["level"] < 0) | (p["level"] == node["inner"]))
    return squeezed(F.array_join(F.transform(own, lambda p: p["text"]), ""))


def raw_text(pieces: Column, node: Column) -> Column:
    """The first characters of a node's text, for labels."""
    own = F.filter(F.slice(pieces, node["first"] + 1, F.least(node["last"] - node["first"], F.lit(2 * H.LABEL_TEXT))), lambda p: p["raw"])
    return F.substring(F.array_join(F.transform(own, lambda p: p["text"]), ""), 1, H.LABEL_TEXT)


def readable(found: Column, limits: H.Limits) -> Column:
    """Of nodes in order those that begin before the others' sizes add up to far more than is kept."""
    start = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("n"))

    def add(state: Column, node: Column) -> Column:
        fits = state["size"] < H.READ_TIMES * limits.text
        return F.struct((state["size"] + node["size"]).alias("size"), F.when(fits, state["n"] + 1).otherwise(state["n"]).alias("n"))

    return F.slice(found, 1, F.aggregate(found, start, add, lambda state: state["n"]))


def body_text(nodes: Column, pieces: Column) -> Column:
    return once(F.coalesce(F.get(select(nodes, "body"), F.lit(0)), F.get(nodes, F.lit(0))), lambda n: text(pieces, n))


def main_text(nodes: Column, pieces: Column, selectors: Column, limits: H.Limits) -> Column:
    """The texts of the first of the selectors (an array) that has some of the least length, else the body's."""

    def of(selector: Column) -> Column:
        texts = F.filter(F.transform(readable(select(nodes, selector), limits), lambda n: text(pieces, n)), lambda t: F.length(t) >= H.LEAST_TEXT)
        return once(texts, lambda t: F.when(F.size(t) > 0, squeezed(F.array_join(t, "\n\n"))))

    first = F.aggregate(selectors, F.lit(None).cast("string"), lambda found, s: F.coalesce(found, of(s)))
    return F.coalesce(first, body_text(nodes, pieces))


def sections(nodes: Column, pieces: Column, limits: H.Limits) -> Column:
    def section(part: Column) -> Column:
        inside = below(nodes, part)
        title = once(F.get(select(inside, ".title"), F.lit(0)), lambda n: F.coalesce(squeezed(raw_text(pieces, n)), F.lit("")))
        items = readable(select(inside, ".dot_list"), limits)
        body = once(items, lambda x: F.when(F.size(x) > 0, squeezed(F.array_join(F.transform(x, lambda n: F.concat(text(pieces, n), F.lit("\n"))), ""))).otherwise(text(pieces, part)))
        return F.struct(title.alias("title"), body.alias("body"))

    made = F.transform(readable(select(nodes, ".information_list"), limits), section)
    return F.filter(made, lambda s: (s["title"] != "") & (s["body"] != ""))


def body_titled(sections_: Column | str, title: str) -> Column:
    return F.get(F.filter(sections_, lambda s: s["title"].contains(title)), F.lit(0))["body"]


def labelled_links(nodes: Column, pieces: Column) -> Column:
    """(href, label) of the links that may be files."""

    def label(a: Column) -> Column:
        told, title = squeezed(raw_text(pieces, a)), squeezed(a["title"])
        beside = once(F.get(nodes, F.get(nodes, a["parent"])["beside"]), lambda n: F.when(n.isNotNull(), F.nullif(squeezed(raw_text(pieces, n)), F.lit(""))))

        def chosen(t: Column) -> Column:
            no_text = (t["text"] == "") | t["text"].rlike(H.GENERIC_TEXT.pattern)
            no_title = (t["title"] == "") | t["title"].rlike(H.GENERIC_TITLE.pattern)
            other = F.coalesce(F.nullif(t["text"], F.lit("")), F.nullif(t["title"], F.lit("")), F.lit(ATTACHMENT))
            return F.when(no_text & ~no_title, t["title"]).when(no_text & no_title, F.coalesce(t["beside"], other)).otherwise(other)

        bare = once(F.struct(told.alias("text"), title.alias("title"), beside.alias("beside")), chosen)
        bare = F.regexp_replace(F.regexp_replace(bare, F.lit(rf"^\[?{ATTACHMENT}\]?\s*"), F.lit("")), F.lit(r"(?:\s*(?:다운로드|바로보기|내려받기))+$"), F.lit(""))
        return F.coalesce(F.nullif(squeezed(bare), F.lit("")), F.lit(ATTACHMENT))

    links = F.filter(select(nodes, "a"), lambda a: (a["href"] != "") & ~a["href"].startswith("#") & ~F.lower(a["href"]).startswith("javascript:"))
    named = F.transform(links, lambda a: F.struct(a["href"].alias("href"), label(a).alias("label"), a["download"].alias("download")))
    return F.filter(named, lambda x: x["download"] | x["href"].rlike(H.FILE_NAME.pattern) | F.concat_ws(" ", x["href"], x["label"]).rlike(H.FILE_WORD.pattern))


@F.pandas_udf(T.ArrayType(T.StringType()))
def whole_addresses(page: pd.Series, hrefs: pd.Series) -> pd.Series:
    """Links as whole public addresses of http or https; null where one is none."""
    return pd.Series([[H.whole_address(p, h) for h in hs] for p, hs in zip(page, hrefs, strict=True)], dtype="object")


def files_of(links: Column, addresses: Column, limits: H.Limits) -> Column:
    """The first label of each address, in order."""
    pairs = F.filter(F.zip_with(links, addresses, lambda x, u: F.struct(x["label"].alias("label"), u.alias("url"))), lambda p: p["url"].isNotNull())
    urls = F.slice(F.array_distinct(F.transform(pairs, lambda p: p["url"])), 1, limits.files)
    return F.transform(urls, lambda u: F.struct(F.substring(F.get(F.filter(pairs, lambda p: p["url"] == u), F.lit(0))["label"], 1, limits.label).alias("label"), u.alias("url"))).cast(FILES)


CALL = r"""(?i)fn_download\(\s*['"](\d{1,20})['"]\s*,\s*['"](\d{1,20})['"]\s*,\s*['"][a-z0-9]{1,12}['"]\s*\)"""


def numbered_files(nodes: Column, pieces: Column, url: Column, limits: H.Limits) -> Column:
    """Files of a board that names them by numbers in a script call; addresses go through a proxy path."""
    page = F.regexp_extract(F.coalesce(F.trim(F.try_parse_url(url, F.lit("QUERY"), F.lit("nttSeqNo"))), F.lit("")), "^[0-9]{1,20}$", 0)

    def file(item: Column) -> Column:
        inside = F.filter(below(nodes, item), lambda n: n["name"] == "a")
        call = F.get(F.filter(inside, lambda a: (a["box"] > item["i"]) & (a["box"] != a["i"]) & a["onclick"].contains("fn_download")), F.lit(0))["onclick"]
        name = F.get(F.filter(inside, lambda a: F.exists(a["keys"], lambda c: c.startswith(".") & c.contains("ico_file_"))), F.lit(0))
        label = once(name, lambda n: F.when(n.isNotNull(), F.substring(F.btrim(F.regexp_replace(raw_text(pieces, n), r"(?U)\s+", " "), F.lit(ENDS)), 1, limits.label)))
        return F.struct(F.regexp_extract(call, CALL, 1).alias("file"), F.regexp_extract(call, CALL, 2).alias("order"), F.nullif(label, F.lit("")).alias("label"))

    # Items stand right in a box; they are taken by their parents' classes.
    items = F.filter(nodes, lambda n: (n["name"] == "li") & is_a(F.get(nodes, F.greatest(n["parent"], F.lit(0))), ".down_file"))
    found = F.filter(F.transform(items, file), lambda f: F.coalesce(f["file"] != "", F.lit(False)))
    keys = lambda x: F.slice(F.array_distinct(F.transform(x, lambda f: F.struct(f["file"].alias("file"), f["order"].alias("order")))), 1, limits.files)

    def told(x: Column) -> Column:
        first = lambda k: F.get(F.filter(x, lambda f: (f["file"] == k["file"]) & (f["order"] == k["order"])), F.lit(0))["label"]
        address = lambda k: F.concat(F.lit(f"{H.PROXY_PATH}?nttSeqNo="), page, F.lit("&atchFileNo="), k["file"], F.lit("&fileOrd="), k["order"])
        return F.transform(keys(x), lambda k, n: F.struct(F.coalesce(first(k), F.concat(F.lit(f"{ATTACHMENT} "), (n + 1).cast("string"))).alias("label"), address(k).alias("url")))

    none = F.array().cast(FILES)
    return F.when(page != "", F.coalesce(once(found, told).cast(FILES), none)).otherwise(none)


def empty_shell(flat: Column, files: Column) -> Column:
    """Whether a page has nothing to read and no sign of why."""
    nodes, pieces = flat["nodes"], flat["pieces"]
    there = [".information_list", *H.SELECTORS["kstartup"], *H.ALTERNATES]
    reads = F.exists(F.array(*map(F.lit, there)), lambda s: F.exists(select(nodes, s), lambda n: F.length(text(pieces, n)) >= H.LEAST_TEXT))
    return ~(flat["iframe"] | flat["login"] | flat["app"] | (F.size(files) > 0) | (F.length(body_text(nodes, pieces)) >= H.LEAST_TEXT) | reads)


def reason_for(text_: Column, source: Column, flat: Column, files: Column) -> Column:
    short = F.when((source == "kstartup") & empty_shell(flat, files), F.lit(EMPTY_SHELL)).otherwise(F.lit(LEGACY_EMPTY))
    return F.when(F.length(text_) < H.LEAST_TEXT, short)


def parse_pages(pages: DataFrame, source: Column | None = None, limits: H.Limits = H.LIMITS) -> DataFrame:
    """``pages`` (url, html, ...) with a struct ``detail`` (detail_content, sections, apply_method, documents, contact, attachments, reason)
    and ``detail_content_hash``. ``html`` may be bytes; a column ``content_type`` then may name their charset. Pages that aren't
    HTML, and null ones, have no text and a reason."""
    html = F.col("html")
    if dict(pages.dtypes)["html"] == "binary":
        html = H.decoded_html(html, F.col("content_type") if "content_type" in pages.columns else F.lit(None).cast("string"))
    source = F.coalesce(source if source is not None else F.lit(None).cast("string"), F.lit(""))
    names = pages.columns
    flat, nodes, pieces = F.col("_flat"), F.col("_flat.nodes"), F.col("_flat.pieces")
    made = pages.withColumns({"_source": source, "_flat": H.flat_pages(limits.depth)(html)})
    made = made.withColumn("_links", labelled_links(nodes, pieces))
    made = made.withColumn("_whole", whole_addresses("url", F.transform("_links", lambda x: x["href"])))
    numbered = F.when(F.col("_source") == "msit", numbered_files(nodes, pieces, F.col("url"), limits))
    made = made.withColumns({"_numbered": numbered, "_linked": files_of(F.col("_links"), F.col("_whole"), limits)})
    made = made.withColumn("_files", F.when(F.size("_numbered") > 0, F.col("_numbered")).otherwise(F.col("_linked")))
    made = made.withColumn("_sections", F.when(F.col("_source") == "kstartup", sections(nodes, pieces, limits)).otherwise(F.array().cast("array<struct<title:string,body:string>>")))
    joined = F.array_join(F.transform("_sections", lambda s: F.concat(s["title"], F.lit("\n"), s["body"])), "\n\n")
    chosen = F.array(F.lit("main"), F.lit("article"))
    for name, selectors in H.SELECTORS.items():
        chosen = F.when(F.col("_source") == name, F.array(*map(F.lit, selectors))).otherwise(chosen)
    made = made.withColumn("_text", F.when(F.size("_sections") > 0, joined).otherwise(main_text(nodes, pieces, chosen, limits)))
    mapped = [body_titled("_sections", title).alias(name) for name, title in H.MAPPED_SECTIONS.items()]
    reason = reason_for(F.col("_text"), F.col("_source"), flat, F.col("_files"))
    detail = F.struct(F.substring("_text", 1, limits.text).alias("detail_content"), F.col("_sections").alias("sections"), *mapped, F.col("_files").alias("attachments"), reason.alias("reason"))
    parsed = made.select(*names, detail.alias("detail"))
    hashed = [F.col(f"detail.{c}") for c in ("detail_content", "apply_method", "documents", "contact", "attachments")]
    return parsed.withColumn("detail_content_hash", F.sha2(F.to_json(F.struct(*hashed), {"ignoreNullFields": "false"}), 256))
