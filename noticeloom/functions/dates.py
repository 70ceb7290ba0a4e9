"""Dates and times on columns. Today is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeloom.functions.text import trimmed


def to_date(c: Column) -> Column:
    """The first eight digits as a date; impossible dates are null."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) >= 8, F.try_to_date(F.substring(digits, 1, 8), "yyyyMMdd"))


def parse_range(c: Column) -> tuple[Column, Column]:
    """Start and end of 'a ~ b'; dashes do as well, a hyphen between spaces too."""
    parts = F.split(c, r"\s*(?:~|∼|–|—|\s-\s)\s*")
    return to_date(trimmed(F.get(parts, F.lit(0)))), to_date(trimmed(F.get(parts, F.lit(1))))


def seoul_date(utc: Column) -> Column:
    """The day in Seoul at a UTC timestamp without zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), utc))


def retention_cutoff(today: Column, days: int) -> Column:
    return F.date_sub(today, days)


def is_open(apply_end: Column, today: Column) -> Column:
    return F.coalesce(apply_end >= today, F.lit(True))


def status(apply_end: Column, today: Column) -> Column:
    return F.when(is_open(apply_end, today), F.lit("open")).otherwise(F.lit("closed"))


def elapsed(since: Column, now: Column, hours: int) -> Column:
    """Whether so many hours have passed; an unknown time has."""
    return F.coalesce(now - since >= F.expr(f"INTERVAL {hours} HOURS"), F.lit(True))
