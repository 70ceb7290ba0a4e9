"""Lines of detail texts: their kinds, and the emphasis that runs across them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What marks a line's kind.
MARKS = [("note", re.compile(r"\s*[※☞]\s*")), ("item", re.compile(r"\s*[□■◎○▶]\s*")), ("bullet", re.compile(r"\s*[-·•◦ㆍ]\s*"))]
MARK_OF = {c: (kind, mark) for (kind, mark), marks in zip(MARKS, ("※☞", "□■◎○▶", "-·•◦ㆍ"), strict=True) for c in marks}
WARNING = re.compile("주의|유의|반드시|필수|불이익|제외|금지|불가")
NO_TITLE = re.compile(r"[.:,?!~]$|(?:습니다|합니다|주세요|바랍니다|하세요)$|^(?:해당\s*없음|없음|상시|무료)$|(?i:https?://)|\d{4}[.\-/]\d{1,2}")
TOKEN = re.compile(r"(\[\[/?(?:em|b)\]\])")

SEGMENT = "struct<text:string,red:boolean,bold:boolean>"
LINES = f"array<struct<kind:string,warning:boolean,segments:array<{SEGMENT}>>>"


class Emphasis:
    """Counts of open marks, which go on from line to line."""

    def __init__(self):
        self.open = {"em": 0, "b": 0}

    def segments(self, line: str) -> list[dict]:
        out: list[dict] = []
        for part in TOKEN.split(line) if "[[" in line else [line]:
            if part.startswith("[[") and TOKEN.fullmatch(part):
                name = part.strip("[]/")
                self.open[name] = self.open[name] + 1 if "/" not in part else max(0, self.open[name] - 1)
            elif part:
                style = {"red": self.open["em"] > 0, "bold": self.open["b"] > 0}
                if out and all(out[-1][k] == v for k, v in style.items()):
                    out[-1]["text"] += part
                else:
                    out.append({"text": part, **style})
        return out


def could_be_title(line: str) -> bool:
    return 2 <= len(line) <= 22 and not NO_TITLE.search(line)


def kind_of_title(after_gap: bool, before: str | None) -> str:
    """A short line's kind, by the line before it and whether an empty one is between."""
    if before == "item":
        return "paragraph"
    if before == "heading" or (before == "subheading" and not after_gap):
        return "subheading"
    return "heading" if after_gap or before is None else "paragraph"


def classify_lines(text: str | None) -> list[dict]:
    emphasis, out, after_gap, before = Emphasis(), [], True, None
    for line in (x.strip() for x in re.sub("[​﻿]", "", text or "").split("\n")):
        bare = TOKEN.sub("", line).strip() if "[[" in line else line
        segments = emphasis.segments(line)
        if not bare:
            after_gap = True
            continue
        kind, mark = MARK_OF.get(bare[0], (None, None))
        if mark:
            first = next((s for s in segments if s["text"].strip()), None)
            if first:
                first["text"] = mark.sub("", first["text"], count=1) if mark.match(first["text"]) else first["text"]
            segments = [s for s in segments if s["text"]]
        else:
            kind = kind_of_title(after_gap, before) if could_be_title(bare) else "paragraph"
        out.append({"kind": kind, "warning": bool(kind == "note" and WARNING.search(bare)), "segments": segments})
        before, after_gap = kind, False
    return out


#: Characters of texts whose lines are held at once.
HELD = 1 << 20
_SEGMENTS = [("text", pa.string()), ("red", pa.bool_()), ("bold", pa.bool_())]


def slices(texts: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """A batch in slices of about so many bytes, or of one longer text."""
    most = most or HELD
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield texts.slice(start, end - start)
        start = end


def _listed(offsets: list[int], fields: list[tuple[str, pa.DataType]], columns: list) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=[pa.field(*f) for f in fields]))


def _lines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A batch's lines in several results, so that memory follows the slice and not the batch."""
    for batch in batches:
        for texts in slices(batch):
            kinds, warnings, lines_at, segments_at = [], [], [0], [0]
            told: tuple[list, list, list] = ([], [], [])
            for text in texts.to_pylist():
                for line in classify_lines(text):
                    kinds.append(line["kind"])
                    warnings.append(line["warning"])
                    for segment in line["segments"]:
                        told[0].append(segment["text"])
                        told[1].append(segment["red"])
                        told[2].append(segment["bold"])
                    segments_at.append(len(told[0]))
                lines_at.append(len(kinds))
            segments = _listed(segments_at, _SEGMENTS, [pa.array(c, kind) for c, (_, kind) in zip(told, _SEGMENTS, strict=True)])
            yield _listed(lines_at, [("kind", pa.string()), ("warning", pa.bool_()), ("segments", segments.type)], [pa.array(kinds, pa.string()), pa.array(warnings, pa.bool_()), segments])


def text_lines(df: DataFrame, text: Column | str) -> DataFrame:
    """One row per line: all columns with place (from 0), kind, warning and segments."""
    return df.select("*", F.posexplode(F.arrow_udf(_lines, LINES)(text)).alias("place", "line")).select("*", "line.*").drop("line")
