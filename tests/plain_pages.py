"""A plain second version of what is read from a page, one page at a time, for tests of the DataFrame rules."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from urllib.parse import parse_qs, urlencode, urljoin, urlsplit

from noticeloom.functions.values import ATTACHMENT
from noticeloom.operators.html import (
    ALTERNATES, FILE_NAME, FILE_WORD, GENERIC_TEXT, GENERIC_TITLE, LEAST_TEXT, LIMITS, MAPPED_SECTIONS, PROXY_PATH, READ_TIMES, SELECTORS, Limits, Page, Tree, cleared, names_beside, nodes_below,
    private, squeezed,
)


def main_text(page: Page, selectors: list[str], limits: Limits = LIMITS) -> str:
    """The texts of the first selector that has some; no more of them than the limit of characters needs."""
    for selector in selectors:
        texts, size = [], 0
        for i in page.select(selector):
            if size >= limits.text:
                break
            if len(text := page.text(i)) >= LEAST_TEXT:
                texts.append(text)
                size += len(text)
        if texts:
            return squeezed("\n\n".join(texts))
    return page.text(page.body())


def sections(page: Page, limits: Limits = LIMITS) -> list[dict]:
    """Titles and bodies; lists that come after the limit of characters, or lie in others beyond it, aren't read."""
    out, size = [], 0
    for part in page.select(".information_list"):
        if size >= limits.text:
            break
        title = squeezed(next((page.raw_text(t) for t in page.select(".title", part)), ""))
        items = page.select(".dot_list", part)
        texts, length = [], 0
        for i in items:
            if length >= limits.text:
                break
            texts.append(page.text(i) + "\n")
            length += len(texts[-1])
        body = squeezed("".join(texts)) if items else page.text(part)
        size += length + len(body) + len(items)
        if title and body:
            out.append({"title": title, "body": body})
    return out


def attachments(page: Page, url: str, limits: Limits = LIMITS) -> list[dict]:
    found: dict[str, str] = {}
    beside = names_beside(page)
    for i in page.select("a"):
        if len(found) >= limits.files:
            break
        a = page.nodes[i]
        href = a.attributes.get("href", "").strip()
        if not href or href[0] == "#" or href.lower().startswith("javascript:"):
            continue
        text, title = squeezed(page.raw_text(i)), squeezed(a.attributes.get("title", ""))
        no_text, no_title = not text or GENERIC_TEXT.match(text), not title or GENERIC_TITLE.match(title)
        label = title if no_text and not no_title else text or title or ATTACHMENT
        if no_text and no_title and beside[page.parents[i]] >= 0:  # the name may stand beside the button
            label = squeezed(page.raw_text(beside[page.parents[i]])) or label
        label = squeezed(re.sub(r"(?:\s*(?:다운로드|바로보기|내려받기))+$", "", re.sub(rf"^\[?{ATTACHMENT}\]?\s*", "", label))) or ATTACHMENT
        if "download" not in a.attributes and not FILE_NAME.search(href) and not FILE_WORD.search(f"{href} {label}"):
            continue
        try:
            whole = urljoin(url or "", href)
            parts = urlsplit(whole)
        except ValueError:
            continue
        if parts.scheme in ("http", "https") and parts.hostname and not (parts.username or parts.password or private(parts.hostname)):
            found.setdefault(whole, label[: limits.label])
    return [{"label": label, "url": u} for u, label in found.items()]


def numbered_files(shown: Page, url: str, path: str = PROXY_PATH, limits: Limits = LIMITS) -> list[dict]:
    """Files of a board that names them by numbers in a script call; addresses go through a proxy path."""
    try:
        page = parse_qs(urlsplit(url or "").query).get("nttSeqNo", [""])[0].strip()
    except ValueError:  # no address
        return []
    if not re.fullmatch(r"[0-9]{1,20}", page):
        return []
    # Calls stand in links within a box of buttons; by link, the innermost of these.
    box_of, calls, items = [], [], {}
    for i, node in enumerate(shown.nodes):
        box_of.append(i if "down_btn" in node.classes else box_of[shown.parents[i]] if i else -1)
        if node.name == "a" and box_of[i] >= 0 and "fn_download" in node.attributes.get("onclick", "") and box_of[i] != i:
            calls.append(i)
        if node.name == "li":
            items.setdefault(shown.parents[i], []).append(i)
    named = [i for i in shown.select("a") if "ico_file_" in shown.nodes[i].attributes.get("class", "")]
    found: dict[tuple, dict] = {}
    for item in (i for box in shown.select(".down_file") for i in items.get(box, ())):
        if len(found) >= limits.files:
            break
        inside = range(bisect_right(calls, item), bisect_left(calls, shown.ends[item]))
        call = next((shown.nodes[calls[k]].attributes["onclick"] for k in inside if box_of[calls[k]] > item), "")
        m = re.search(r"""(?i)fn_download\(\s*['"](\d{1,20})['"]\s*,\s*['"](\d{1,20})['"]\s*,\s*['"][a-z0-9]{1,12}['"]\s*\)""", call)
        if m and m.groups() not in found:
            k = bisect_right(named, item)
            label = re.sub(r"\s+", " ", shown.raw_text(named[k])).strip()[: limits.label] if k < len(named) and named[k] < shown.ends[item] else ""
            query = urlencode({"nttSeqNo": page, "atchFileNo": m[1], "fileOrd": m[2]})
            found[m.groups()] = {"label": label or f"{ATTACHMENT} {len(found) + 1}", "url": f"{path}?{query}"}
    return list(found.values())


def empty_shell(page: Page, files: list[dict], iframe: bool, login: bool, app: bool) -> bool:
    """Whether a page has nothing to read and no sign of why."""
    there = [".information_list", *SELECTORS["kstartup"], *ALTERNATES]
    return not (iframe or files or login or app or len(page.text(page.body())) >= LEAST_TEXT or any(len(page.text(i)) >= LEAST_TEXT for s in there for i in page.select(s)))


def page_detail(html: str | None, url: str | None, source: str | None, limits: Limits = LIMITS) -> dict:
    tree = Tree(html or "", limits.depth).root
    login = iframe = app = False
    for node in nodes_below(tree):
        login = login or (node.name == "input" and node.attributes.get("type") == "password")
        iframe = iframe or node.name == "iframe"
        app = app or (node.name == "div" and node.attributes.get("id") in ("root", "app", "__next"))
    page = cleared(tree)
    files = (numbered_files(page, url, limits=limits) if source == "msit" else []) or attachments(page, url, limits)
    parts = sections(page, limits) if source == "kstartup" else []
    mapped = {k: next((p["body"] for p in parts if t in p["title"]), None) for k, t in MAPPED_SECTIONS.items()}
    text = "\n\n".join(f"{p['title']}\n{p['body']}" for p in parts) or main_text(page, SELECTORS.get(source, ["main", "article"]), limits)
    reason = None
    if len(text) < LEAST_TEXT:
        reason = "empty_shell_200" if source == "kstartup" and empty_shell(page, files, iframe, login, app) else "본문 없음"
    return {"detail_content": text[: limits.text], "sections": parts, **mapped, "attachments": files, "reason": reason}


