"""Detail pages: main text, sections, attachments, emphasis. Pages are rows of a table (url, html, source).

Parsing HTML has no built-in function; a small tree on the standard library's parser makes flat lists of nodes and pieces of text
of it, inside a UDF. What is read from them is said in DataFrame functions, in ``page_rules``.
"""

from __future__ import annotations

import codecs
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import parse_qs, urlencode, urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.operators.lines import HELD, slices

# Places of the text in the sources' pages, and words of their file links.
SELECTORS = {
    "bizinfo": [".board_view", ".view_cont", ".view-content", "#contents", "main"],
    "kstartup": ["#content", "#contents", ".contents", "main"],
    "mss": [".board_view", ".view_cont", "#contents", "main"],
    "mois": [".tab-content", "#contents", ".content", "main", "article"],
    "msit": [".board_view", ".view_cont", "#contents", "main"],
}
ALTERNATES = [".content", ".sub", ".sub_cont", ".sub-content", ".board_view", ".view_cont", ".view-content", ".view_content", "article"]
MAPPED_SECTIONS = {"apply_method": "신청방법 및 대상", "documents": "제출서류", "contact": "문의처"}
PROXY_PATH, FILE_NUMBERS = "/api/attachments/msit", ["nttSeqNo", "atchFileNo", "fileOrd"]
GENERIC_TEXT = re.compile("(?i)^(?:다운로드|바로보기|내려받기|첨부파일|download|view)$")
GENERIC_TITLE = re.compile(r"^(?:파일\s?다운로드|다운로드|첨부파일)$")
FILE_NAME = re.compile(r"(?i)\.(?:pdf|hwpx?|docx?|xlsx?|pptx?|zip)(?:$|[?#])")
FILE_WORD = re.compile("(?i)file|atch|attach|download")
RED_NAMES = {"red", "crimson", "firebrick", "darkred", "orangered", "tomato", "indianred", "maroon"}
RED, BOLD = ("[[em]]", "[[/em]]"), ("[[b]]", "[[/b]]")
LEAST_TEXT = 20
#: Characters of a text that a label may be made of, and how many times the characters that are kept of a page are read for them.
LABEL_TEXT, READ_TIMES = 2_000, 20


@dataclass(frozen=True)
class Limits:
    """What is kept of a page (characters of text, files, characters of a label), and how deep nodes nest: as browsers do,
    what is deeper stands beside its parent."""

    text: int = 200_000
    files: int = 50
    label: int = 300
    depth: int = 512


LIMITS = Limits()
#: Korean names of one character set.
EUC_KR = {"ks_c_5601-1987", "ksc5601", "cp949", "euc-kr"}

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript", "template", "svg", "canvas", "iframe", "nav", "header", "footer"}
DROPPED_CLASSES = {"blind", "sr-only", "skip", "breadcrumb", "location", "modal", "popup"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "tr", "section", "article"}
CLOSED_BY = {"option": {"option", "optgroup"}, "optgroup": {"optgroup"}, "p": BLOCKS | {"div", "ul", "ol", "dl", "table"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}


class Node:
    __slots__ = ("attributes", "children", "name", "parent")

    def __init__(self, name: str, attributes: dict[str, str], parent: Node | None):
        self.name, self.attributes, self.parent, self.children = name, attributes, parent, []

    @property
    def classes(self) -> set[str]:
        return set(self.attributes.get("class", "").split())


def nodes_below(root: Node):
    waiting = [root]
    while waiting:
        children = [c for c in waiting.pop().children if isinstance(c, Node)]
        yield from children
        waiting += children


class Tree(HTMLParser):
    """Builds nodes; a few end tags may be missing. Marked sections that aren't HTML go, as a browser's comments do."""

    UNKNOWN_SECTION = re.compile(r"(?i)<!\[(?!cdata\[|if\b|else\b|endif\b)[^>]*(?:>|$)")

    def __init__(self, html: str, deepest: int = LIMITS.depth):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.depth, self.deepest = 0, deepest
        #: Open nodes beyond the depth; they hold nothing, their text goes to the deepest node.
        self.beyond: list[str] = []
        self.held: Counter = Counter()
        try:
            self.feed(self.UNKNOWN_SECTION.sub("", html))
            self.close()
        except AssertionError:
            pass  # what the parser gives up on ends the page

    def handle_starttag(self, tag, attrs):
        while not self.beyond and tag in CLOSED_BY.get(self.at.name, ()):
            self.at = self.at.parent
            self.depth -= 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag in VOID:
            return
        if self.depth < self.deepest:
            self.at = node
            self.depth += 1
        else:
            self.beyond.append(tag)
            self.held[tag] += 1

    def handle_endtag(self, tag):
        if self.held[tag]:
            while (name := self.beyond.pop()) != tag:
                self.held[name] -= 1
            self.held[tag] -= 1
            return
        node, up = self.at, 1
        while node is not None and node.name != tag:
            node, up = node.parent, up + 1
        if node is not None and node.parent is not None:
            self.at = node.parent
            self.depth -= up
            self.beyond.clear()
            self.held.clear()

    def handle_data(self, data):
        self.at.children.append(data)


def hidden(node: Node) -> bool:
    a = node.attributes
    return (
        node.name in DROPPED or bool(node.classes & DROPPED_CLASSES) or a.get("aria-hidden") == "true" or a.get("role") == "dialog" or a.get("aria-modal") == "true"
        or re.search("display ?: ?none", a.get("style", "")) is not None
    )


def squeezed(text: str) -> str:
    text = re.sub(r"[ \t]+", " ", text.replace("\r", ""))
    return re.sub(r"\n{3,}", "\n\n", re.sub(" *\n *", "\n", text)).strip()


def is_red(color: str) -> bool:
    color = color.strip().lower()
    if color in RED_NAMES:
        return True
    if m := re.fullmatch("#([0-9a-f]{3}|[0-9a-f]{6})", color):
        digits = m[1] if len(m[1]) == 6 else "".join(2 * d for d in m[1])
        r, g, b = (int(digits[i : i + 2], 16) for i in (0, 2, 4))
    elif m := re.match(r"rgba?\(\s*(\d{1,9})\s*,\s*(\d{1,9})\s*,\s*(\d{1,9})", color):
        r, g, b = map(int, m.groups())
    else:
        return False
    return r >= 160 and g <= 96 and b <= 96


def emphasis(node: Node) -> tuple[str, str] | None:
    style = node.attributes.get("style", "").lower()
    stated = re.search(r"(?:^|;)\s*color\s*:\s*([^;]+)", style)
    if is_red(stated[1] if stated else node.attributes.get("color", "") if node.name == "font" else ""):
        return RED
    return BOLD if node.name in ("strong", "b") or re.search(r"font-weight\s*:\s*(?:bold|bolder|[7-9]00)", style) else None


def keys_of(node: Node) -> list[str]:
    """The selectors that a node answers to: its name, #id and .classes."""
    return [node.name, f"#{node.attributes.get('id', '')}", *(f".{c}" for c in sorted(node.classes))]


class Page:
    """A page as flat lists, made in one walk: its nodes in order, each with where its descendants end, and the pieces of its
    text. What is asked of a node is then a slice of a list, so work follows the sizes of the answers."""

    def __init__(self, root: Node, dropped=None):
        self.nodes: list[Node] = []
        #: By node: its parent, the first node after its descendants, and the range of its pieces.
        self.parents: list[int] = []
        self.ends: list[int] = []
        self.pieces_of: list[tuple[int, int]] = []
        #: By node: how many marked nodes it stands in, itself included.
        self.inner: list[int] = []
        #: Pieces of text; of raw text, line ends and marks (with the number of marked nodes around, else -1).
        self.pieces: list[str] = []
        self.raw: list[bool] = []
        #: By piece: how many before it have more than white space, of the raw text.
        self.told: list[int] = [0]
        self.level: list[int] = []
        self.by: dict[str, list[int]] = {}
        self._walk(root, dropped)

    def _add(self, piece: str, raw: bool, level: int = -1) -> None:
        self.pieces.append(piece)
        self.raw.append(raw)
        self.told.append(self.told[-1] + (raw and not piece.isspace()))
        self.level.append(level)

    def _open(self, node: Node, parent: int, inner: int) -> int:
        i = len(self.nodes)
        self.nodes.append(node)
        self.parents.append(parent)
        self.ends.append(i + 1)
        self.pieces_of.append((len(self.pieces), len(self.pieces)))
        self.inner.append(inner)
        for key in keys_of(node):
            self.by.setdefault(key, []).append(i)
        return i

    def _walk(self, root: Node, dropped) -> None:
        # Open nodes: number, remaining children, where their opening mark stands, marks, number of marked nodes around.
        stack = [(self._open(root, -1, 0), iter(root.children), None, None, 0)]
        blank = [True]  # whether an open node has had only blank text so far
        while stack:
            i, children, at, marks, around = stack[-1]
            child = next(children, None)
            if isinstance(child, str):
                self._add(child, True)
                blank[-1] = blank[-1] and not child.strip()
            elif child is None:
                stack.pop()
                empty = blank.pop()
                if blank:
                    blank[-1] = blank[-1] and empty
                self.ends[i] = len(self.nodes)
                self.pieces_of[i] = (self.pieces_of[i][0], len(self.pieces))
                if marks and empty:  # no text, no mark; what stands within has none either
                    self.pieces[at] = ""
                elif marks:
                    self._add(marks[1], False, around)
                if i and self.nodes[i].name in BLOCKS:
                    self._add("\n", False)
            elif dropped is None or not dropped(child):
                if child.name == "br":
                    self._add("\n", False)
                marks, at = emphasis(child), None
                if marks:
                    at = len(self.pieces)
                    self._add(marks[0], False, self.inner[i])
                number = self._open(child, i, self.inner[i] + bool(marks))
                stack.append((number, iter(child.children), at, marks, self.inner[i]))
                blank.append(True)

    def select(self, selector: str, within: int = 0) -> list[int]:
        """Nodes of a name, .class or #id below a node, in order."""
        found = self.by.get(selector, [])
        return found[bisect_right(found, within) : bisect_left(found, self.ends[within])]

    def raw_text(self, i: int, most: int = LABEL_TEXT) -> str:
        """What a label may be made of: the first characters of a node's text, far more than a label has."""
        first, last = self.pieces_of[i]
        found, size = [], 0
        for k in range(first, last):
            if self.raw[k]:
                found.append(self.pieces[k])
                size += len(found[-1])
                if size >= most:
                    break
        return "".join(found)[:most]

    def text(self, i: int) -> str:
        """A node's text with line ends after blocks, and marks around red and bold parts (the outermost)."""
        (first, last), inner = self.pieces_of[i], self.inner[i]
        if self.told[first] == self.told[last]:
            return ""
        return squeezed("".join(p for p, level in zip(self.pieces[first:last], self.level[first:last], strict=True) if level < 0 or level == inner))

    def body(self) -> int:
        return next(iter(self.select("body")), 0)


def cleared(root: Node) -> Page:
    """The page without what isn't shown."""
    return Page(root, hidden)


def names_beside(page: Page) -> list[int]:
    """By node: the file's name that stands nearest, in the first of its ancestors of a kind of row that has one; else -1."""
    names, out = [i for i in page.select(".file_bg") if page.nodes[i].name == "a"], []
    for i, node in enumerate(page.nodes):
        out.append(out[page.parents[i]] if i else -1)
        if node.name in ("li", "tr", "dd", "div"):
            k = bisect_right(names, i)
            if k < len(names) and names[k] < page.ends[i]:
                out[i] = names[k]
    return out


def private(host: str) -> bool:
    host = host.lower().rstrip(".")
    m = re.match(r"172\.(\d{1,3})\.", host)
    return host == "localhost" or host.endswith(".local") or re.match(r"127\.|10\.|192\.168\.|169\.254\.", host) is not None or (m is not None and 16 <= int(m[1]) <= 31)


def proxied_file(url: str | None, path: str = PROXY_PATH) -> str | None:
    """A proxied file's address in its one form, or None if it isn't one: the path and three numbers."""
    if not url or not url.startswith(f"{path}?"):
        return None
    try:
        parts = urlsplit(url)
        query = parse_qs(parts.query, keep_blank_values=True)
    except ValueError:
        return None
    found = {k: query.get(k, [""])[0].strip() for k in FILE_NUMBERS}
    if parts.path != path or not all(re.fullmatch("[0-9]{1,20}", v) for v in found.values()):
        return None
    return f"{path}?{urlencode(found)}"


def page_has_file(html: str | None, file: str, order: str) -> bool:
    """Whether a board's page offers the file of these numbers."""
    numbers = re.fullmatch("[0-9]{1,20}", file) and re.fullmatch("[0-9]{1,20}", order)
    return bool(numbers and re.search(rf"""(?i)fn_download\(\s*['"]{file}['"]\s*,\s*['"]{order}['"]\s*,""", html or ""))


def decode_html(page: bytes | None, content_type: str | None = None) -> str | None:
    """A page's text: by the charset of the response, else of a meta element in its first 8 KB, else as UTF-8, which also
    stands in for charsets that aren't known. Bytes that don't fit become U+FFFD."""
    if page is None:
        return None
    stated = re.search(r"(?i)charset=[\"']?([\w-]+)", content_type or "") or re.search(r"(?i)<meta[^>]+charset\s*=\s*[\"']?([\w-]+)", page[:8192].decode("latin1"))
    name = stated[1].lower() if stated else "utf-8"
    try:
        name = codecs.lookup("cp949" if name in EUC_KR else name).name
        return page.decode(name, "replace").removeprefix("\ufeff")
    except (LookupError, UnicodeError):
        return page.decode("utf-8", "replace").removeprefix("\ufeff")


@F.pandas_udf(T.StringType())
def decoded_html(page: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([decode_html(p, c) for p, c in zip(page, content_type, strict=True)], dtype="object")


@F.pandas_udf(T.StringType())
def proxied_url(url: pd.Series) -> pd.Series:
    return url.map(proxied_file, na_action="ignore")


def whole_address(page: str | None, href: str) -> str | None:
    """A link as a whole address of http or https on a public host, else None."""
    try:
        whole = urljoin(page or "", href)
        parts = urlsplit(whole)
        public = parts.scheme in ("http", "https") and parts.hostname and not (parts.username or parts.password or private(parts.hostname))
    except ValueError:
        return None
    return whole if public else None


NODE = [("i", pa.int32()), ("name", pa.string()), ("keys", pa.list_(pa.string())), ("href", pa.string()), ("title", pa.string()), ("onclick", pa.string()), ("download", pa.bool_()),
        ("parent", pa.int32()), ("end", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("inner", pa.int32()), ("beside", pa.int32()), ("box", pa.int32()), ("size", pa.int64())]
PIECE = [("text", pa.string()), ("raw", pa.bool_()), ("level", pa.int32())]
FLAT = "struct<nodes:array<struct<i:int,name:string,keys:array<string>,href:string,title:string,onclick:string,download:boolean,parent:int,end:int,first:int,last:int,inner:int,beside:int,box:int,size:long>>,pieces:array<struct<text:string,raw:boolean,level:int>>,login:boolean,iframe:boolean,app:boolean>"


def flat_columns(html: str | None, deepest: int) -> tuple[list[list], list[list], tuple[bool, bool, bool]]:
    """Columns of a page's nodes and pieces, without what isn't shown, and whether the page asks for a password, frames another
    page, or is an application's."""
    tree = Tree(html or "", deepest).root
    login = iframe = app = False
    for node in nodes_below(tree):
        login = login or (node.name == "input" and node.attributes.get("type") == "password")
        iframe = iframe or node.name == "iframe"
        app = app or (node.name == "div" and node.attributes.get("id") in ("root", "app", "__next"))
    page = cleared(tree)
    told = lambda name: [n.attributes.get(name, "") for n in page.nodes]
    box: list[int] = []
    for i, node in enumerate(page.nodes):
        box.append(i if "down_btn" in node.classes else box[page.parents[i]] if i else -1)
    characters = [0]
    for piece in page.pieces:
        characters.append(characters[-1] + len(piece))
    first, last = zip(*page.pieces_of)
    size = [characters[b] - characters[a] + end - i for i, (a, b, end) in enumerate(zip(first, last, page.ends))]
    count = range(len(page.nodes))
    nodes = [list(count), [n.name for n in page.nodes], [keys_of(n) for n in page.nodes], [h.strip() for h in told("href")], told("title"), told("onclick"), ["download" in n.attributes for n in page.nodes],
             page.parents, page.ends, list(first), list(last), page.inner, names_beside(page), box, size]
    return nodes, [page.pieces, page.raw, page.level], (login, iframe, app)


def flat_pages(deepest: int = LIMITS.depth):
    """A UDF from a page's HTML to its flat form."""

    def flattened(html: pa.Array) -> pa.Array:
        pages = [flat_columns(h, deepest) for h in html.to_pylist()]

        def lists(part: int, kinds: list[tuple[str, pa.DataType]]) -> pa.Array:
            offsets = pa.array([0, *accumulate(len(p[part][0]) for p in pages)], pa.int32())
            columns = [pa.array([x for p in pages for x in p[part][k]], kind) for k, (_, kind) in enumerate(kinds)]
            return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=[pa.field(n, k) for n, k in kinds]))

        signs = [pa.array([p[2][k] for p in pages], pa.bool_()) for k in range(3)]
        return pa.StructArray.from_arrays([lists(0, NODE), lists(1, PIECE), *signs], names=["nodes", "pieces", "login", "iframe", "app"])

    @F.arrow_udf(FLAT)
    def flat(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """A batch's pages in slices, as a page's nodes take many times its size."""
        for batch in batches:
            yield from map(flattened, slices(batch, HELD // 4))

    return flat
