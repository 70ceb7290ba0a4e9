"""The region a notice is meant for, from evidence in its texts.

An Arrow UDF, as evidence is a matter of words, their neighbours and their order. Alias and place names are parameters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeloom.functions.values import NATIONWIDE, UNKNOWN_REGION

# Names of the provinces and of their cities, counties and districts.
ALIASES = {
    "서울": ["서울특별시", "서울시", "서울"],
    "부산": ["부산광역시", "부산시", "부산"],
    "대구": ["대구광역시", "대구시", "대구"],
    "인천": ["인천광역시", "인천시", "인천"],
    "광주": ["광주광역시", "광주"],
    "대전": ["대전광역시", "대전시", "대전"],
    "울산": ["울산광역시", "울산시", "울산"],
    "세종": ["세종특별자치시", "세종시", "세종"],
    "경기": ["경기도", "경기"],
    "강원": ["강원특별자치도", "강원도", "강원"],
    "충북": ["충청북도", "충북도", "충북"],
    "충남": ["충청남도", "충남도", "충남"],
    "전북": ["전북특별자치도", "전라북도", "전북도", "전북"],
    "전남": ["전라남도", "전남도", "전남"],
    "경북": ["경상북도", "경북도", "경북"],
    "경남": ["경상남도", "경남도", "경남"],
    "제주": ["제주특별자치도", "제주도", "제주"],
}
PLACES = {
    "서울": [
        "종로구", "용산구", "성동구", "광진구", "동대문구", "중랑구", "성북구", "강북구", "도봉구", "노원구", "은평구", "서대문구", "마포구", "양천구", "구로구", "금천구", "영등포구", "동작구",
        "관악구", "서초구", "강남구", "송파구", "강동구",
    ],
    "부산": ["기장군", "부산진구", "해운대구", "금정구", "연제구", "수영구", "사상구"],
    "대구": ["달성군", "군위군", "수성구", "달서구"],
    "인천": ["강화군", "옹진군", "미추홀구", "연수구", "남동구", "부평구", "계양구"],
    "광주": ["광산구"],
    "대전": ["유성구", "대덕구"],
    "울산": ["울주군"],
    "경기": [
        "수원시", "고양시", "용인시", "성남시", "부천시", "화성시", "안산시", "남양주시", "안양시", "평택시", "시흥시", "파주시", "의정부시", "김포시", "광주시", "광명시", "군포시", "하남시",
        "오산시", "양주시", "이천시", "구리시", "안성시", "포천시", "의왕시", "여주시", "동두천시", "과천시", "양평군", "가평군", "연천군",
    ],
    "강원": ["춘천시", "원주시", "강릉시", "동해시", "태백시", "속초시", "삼척시", "홍천군", "횡성군", "영월군", "평창군", "정선군", "철원군", "화천군", "양구군", "인제군", "양양군"],
    "충북": ["청주시", "충주시", "제천시", "보은군", "옥천군", "영동군", "증평군", "진천군", "괴산군", "음성군", "단양군"],
    "충남": ["천안시", "공주시", "보령시", "아산시", "서산시", "논산시", "계룡시", "당진시", "금산군", "부여군", "서천군", "청양군", "홍성군", "예산군", "태안군"],
    "전북": ["전주시", "군산시", "익산시", "정읍시", "남원시", "김제시", "완주군", "진안군", "무주군", "장수군", "임실군", "순창군", "고창군", "부안군"],
    "전남": [
        "목포시", "여수시", "순천시", "나주시", "광양시", "담양군", "곡성군", "구례군", "고흥군", "보성군", "화순군", "장흥군", "강진군", "해남군", "영암군", "무안군", "함평군", "영광군",
        "장성군", "완도군", "진도군", "신안군",
    ],
    "경북": [
        "포항시", "경주시", "김천시", "안동시", "구미시", "영주시", "영천시", "상주시", "문경시", "경산시", "의성군", "청송군", "영양군", "영덕군", "청도군", "고령군", "성주군", "칠곡군",
        "예천군", "봉화군", "울진군", "울릉군",
    ],
    "경남": ["창원시", "진주시", "통영시", "사천시", "김해시", "밀양시", "거제시", "양산시", "의령군", "함안군", "창녕군", "남해군", "하동군", "산청군", "함양군", "거창군", "합천군"],
    "제주": ["제주시", "서귀포시"],
}
#: A city that has the name of another province's capital.
TWIN, TWIN_REGION, TWIN_MARK = "광주시", "광주", re.compile(r"광주광역시|^\s*[\[(（【]\s*광주[\])）】]")

# Words around a place that tell what it means.
LOCATION = re.compile(r"소재|거주|사업장|본사|주사무소|공장|관내|도내|시내|지역\s*내|지역.{0,15}(?:기업|업체|소상공인|사업자|주민|청년)")
RELATIVE = re.compile(r"도내|관내|시내")
CONTACT = re.compile(r"문의처|접수처|담당자|담당부서|전화|오시는\s*길|기관\s*주소")
ELIGIBLE = re.compile(r"☞|지원\s*대상|신청\s*대상|참여\s*대상|신청\s*자격|지원\s*자격|자격\s*요건|소재|거주|사업장|관내|도내|시내")
STATED = re.compile(r"☞|지원\s*대상|신청\s*대상|자격")
EVERYWHERE = re.compile(
    r"전국\s*소재|전국\s*대상|전국(?:의)?\s+.{0,20}(?:기업|소상공인|사업자|사업장|기관|대학)|지역\s*제한\s*(?:없음|없)|소재지\s*제한\s*(?:없음|없)|전국\s*어디서나"
)
#: Each form of it begins with one of these.
EVERYWHERE_BEGINS = ("전국", "지역", "소재지")
DETAIL_ENDS = re.compile("사업신청 방법|사업신청방법|사업신청 사이트|문의처|접수처|담당부서|첨부파일")
TAG, SPACE_ENTITY, AMPERSAND, BLANK = re.compile(r"<[^>]+>"), re.compile("(?i)&nbsp;|&#160;"), re.compile("(?i)&amp;"), re.compile(r"[\s﻿]+")
BRACKETS_ONLY = re.compile(r"[\s\[(（【]{0,3}")

RESULT = pa.struct([*[(c, pa.string()) for c in ("region", "reason", "evidence_field", "evidence_snippet")], ("candidates", pa.list_(pa.string())), ("has_nationwide_evidence", pa.bool_())])
SCHEMA = "region string, reason string, evidence_field string, evidence_snippet string, candidates array<string>, has_nationwide_evidence boolean"
#: Rows told at once.
ROWS = 1000


def is_hangul(letter: str) -> bool:
    return "가" <= letter <= "힣"


@dataclass(slots=True)
class Place:
    start: int
    end: int
    region: str
    is_town: bool


class Gazetteer:
    def __init__(self, aliases: dict[str, list[str]] = ALIASES, places: dict[str, list[str]] = PLACES):
        terms = [(t, r, False) for r, names in aliases.items() for t in names] + [(t, r, True) for r, names in places.items() for t in names]
        #: Names by their first two letters, each with its number; one search finds where one may begin.
        self.by_head: dict[str, list[tuple[int, str, str, bool]]] = {}
        for i, (term, r, town) in enumerate(terms):
            self.by_head.setdefault(term[:2], []).append((i, term, r, town))
        self.first = re.compile("[" + "".join(re.escape(c) for c in sorted({term[0] for term, _, _ in terms})) + "]") if terms else re.compile("(?!)")

    def places(self, text: str, title_regions: frozenset[str] = frozenset()) -> list[Place]:
        """All names in a text, by start, longer ones first. Names of two letters count as words of their own only."""
        found, ends, twin = [], {}, None
        for m in self.first.finditer(text) if text else ():
            at = m.start()
            names = self.by_head.get(text[at : at + 2], ())
            for i, term, region, town in (*names, *self.by_head.get(text[at], ())) if at + 1 < len(text) else names:
                end = at + len(term)
                if not text.startswith(term, at) or at < ends.get(i, 0):
                    continue
                if len(term) <= 2 and not town and (is_hangul(text[at - 1 : at]) or is_hangul(text[end : end + 1])):
                    continue
                ends[i] = end  # the next of this name begins no earlier
                if term == TWIN:
                    if twin is None:
                        twin = TWIN_REGION in title_regions or TWIN_MARK.search(text) is not None
                    region = TWIN_REGION if twin else region
                found.append((at, -len(term), i, Place(at, end, region, town)))
        return [place for *_, place in sorted(found, key=lambda f: f[:3])]


def plain(text: str | None) -> str:
    if not text:
        return ""
    end = text.rfind(">") + 1  # no tag begins after the last
    if end:
        text = TAG.sub(" ", text[:end]) + text[end:]
    if "&" in text:
        text = AMPERSAND.sub("&", SPACE_ENTITY.sub(" ", text))
    return BLANK.sub(" ", text).strip(" ")


def snippet(text: str, start: int, end: int) -> str:
    around = text[max(0, start - 55) : end + 75]
    return around if len(around) <= 140 else around[:137] + "..."


def everywhere(text: str) -> str | None:
    m = EVERYWHERE.search(text) if any(word in text for word in EVERYWHERE_BEGINS) else None
    return snippet(text, *m.span()) if m else None


class RegionInference:
    """Evidence per field: regions (each with its last snippet) and whether all regions are meant."""

    def __init__(self, gazetteer: Gazetteer | None = None):
        self.gazetteer = gazetteer or Gazetteer()

    def of_title(self, text: str) -> dict[str, str]:
        places = self.gazetteer.places(text)
        placed = bool(places) and bool(LOCATION.search(text))
        return {p.region: snippet(text, p.start, p.end) for p in places if placed or p.is_town or BRACKETS_ONLY.fullmatch(text[: p.start])}

    def of_field(self, text: str, title: dict[str, str]) -> dict[str, str]:
        found = {}
        for p in self.gazetteer.places(text, frozenset(title)):
            near = snippet(text, p.start, p.end)
            if LOCATION.search(near) and ELIGIBLE.search(near) and (STATED.search(near) or not CONTACT.search(near)):
                found[p.region] = near
        if not found and len(title) == 1 and (relative := RELATIVE.search(text)):
            found[next(iter(title))] = snippet(text, *relative.span())
        return found

    def infer(self, title: str | None, target: str | None, summary: str | None, detail: str | None) -> dict:
        told = DETAIL_ENDS.split(plain(detail), maxsplit=1)[0] if detail else ""
        texts = {"target": plain(target), "detail_content": told, "title": plain(title), "summary": plain(summary)}
        of_title = self.of_title(texts["title"])
        regions = {f: of_title if f == "title" else self.of_field(t, of_title) if t else {} for f, t in texts.items()}
        nationwide = {f: s for f, t in texts.items() if t and (s := everywhere(t)) is not None}
        candidates = list(dict.fromkeys(r for found in regions.values() for r in found))
        region, reason, field, text = UNKNOWN_REGION, "no_evidence", None, None
        if len(candidates) > 1 or (candidates and nationwide):
            reason = "conflict_or_multiple"
        elif candidates:
            region, reason = candidates[0], "single_region"
            field, text = next((f, found[region]) for f, found in regions.items() if region in found)
        elif nationwide:
            region, reason = NATIONWIDE, "nationwide"
            field, text = next(iter(nationwide.items()))
        return {"region": region, "reason": reason, "evidence_field": field, "evidence_snippet": text, "candidates": candidates, "has_nationwide_evidence": bool(nationwide)}


def _infer(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    inference = RegionInference()
    for batch in batches:
        for start in range(0, len(batch[0]), ROWS):
            columns = [column.slice(start, ROWS).to_pylist() for column in batch]
            seen: dict[tuple, dict] = {}  # rows of equal texts are told alike
            rows = [seen.get(row) or seen.setdefault(row, inference.infer(*row)) for row in zip(*columns, strict=True)]
            yield pa.array(rows, RESULT)


def infer_region(title: Column | str, target: Column | str, summary: Column | str, detail: Column | str) -> Column:
    """A struct: region (nationwide, unknown or one of the seventeen), reason, and the evidence."""
    return F.arrow_udf(_infer, SCHEMA)(title, target, summary, detail)
