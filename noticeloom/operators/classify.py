"""Categories, audiences, regions and relevance by keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeloom.functions import values as V
from noticeloom.functions.text import contains_any, has_one, once


def category_ids(title: Column, target: Column, support_type: Column, summary: Column, rules: dict[int, list[str]] = V.CATEGORY_KEYWORDS) -> Column:
    """Ids of all rules with a keyword in the joined text; none gives an empty array."""
    text = F.lower(F.concat_ws(" ", title, target, support_type, summary))
    return F.array_compact(once(text, lambda t: F.array(*[F.when(has_one(t, words), F.lit(id_)) for id_, words in rules.items()])))


def audience(columns: list[Column], keywords: list[str]) -> Column:
    """Whether any column has any keyword."""
    return contains_any(F.concat_ws("\u0001", *columns), keywords)


def region_of_organization(organization: Column, patterns: list[tuple[str, str]] = V.ORGANIZATION_REGIONS, default: str = V.NATIONWIDE) -> Column:
    """The region of the first pattern found in the name."""
    hits = [F.when(organization.rlike(pattern), F.lit(region)) for pattern, region in patterns]
    return F.coalesce(*hits, F.lit(default))


def is_support(title: Column, summary: Column, support: list[str] = V.SUPPORT, administrative: list[str] = V.ADMINISTRATIVE) -> Column:
    return ~contains_any(title, administrative) & contains_any(F.concat_ws("\n", title, F.coalesce(summary, F.lit(""))), support)


def is_business_benefit(user_type: Column, title: Column, target: Column, keywords: list[str] = V.BUSINESS_BENEFITS) -> Column:
    quoted = "|".join(r"\Q" + k + r"\E" for k in keywords)
    return F.concat_ws(" ", F.coalesce(user_type, F.lit("")), title, F.coalesce(target, F.lit(""))).rlike(quoted)


def category_names(ids: Column, names: list[str] = V.CATEGORY_NAMES) -> Column:
    """Names of ids (from 1), in the names' order."""
    numbered = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in enumerate(names, 1)])
    return F.transform(F.filter(numbered, lambda x: F.array_contains(ids, x["id"])), lambda x: x["name"])


def source_code(source_id: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for id_, code, _ in V.SOURCES for x in (id_, code)]), source_id), F.lit(V.UNKNOWN_SOURCE))


def source_label(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for _, code, label in V.SOURCES for x in (code, label)]), code), F.lit(V.UNKNOWN_SOURCE_LABEL))
