"""Recommendations by rules: interests, region, target."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import values as V
from noticeloom.functions.text import contains_any, has_text
from noticeloom.operators.listing import list_order, ordered


@dataclass
class Condition:
    user_type: str
    region: str
    interests: list = field(default_factory=list)
    onboarding_completed: bool = True

    def categories(self) -> list[int]:
        return sorted({V.INTEREST_CATEGORIES[i] for i in self.interests if isinstance(i, str) and i in V.INTEREST_CATEGORIES})


def condition_of(value: object) -> Condition | None:
    """A user's condition from a parsed JSON value, or None if a field is missing or of another type. Interests that are no
    texts are dropped; which of the texts are known is for :meth:`Condition.categories` to say."""
    if not isinstance(value, dict):
        return None
    texts = [value.get(k) for k in ("user_type", "region", "industry", "startup_years")]
    done, version, interests = value.get("onboarding_completed"), value.get("schema_version"), value.get("interests")
    whole = isinstance(version, (int, float)) and not isinstance(version, bool) and version == version // 1
    if not all(isinstance(t, str) for t in texts) or not isinstance(interests, list) or not isinstance(done, bool) or not whole:
        return None
    return Condition(texts[0], texts[1], [i for i in interests if isinstance(i, str)], done)


def conditions(told: Column) -> Column:
    """:func:`condition_of` of a column of JSON texts: a struct of user_type, region, interests and onboarding_completed, or null."""
    json = F.try_parse_json(told)
    part = lambda name: F.try_variant_get(json, f"$.{name}", "variant")
    kind = lambda name: F.coalesce(F.schema_of_variant(part(name)), F.lit(""))
    texts = ["user_type", "region", "industry", "startup_years"]
    version = F.try_variant_get(json, "$.schema_version", "double")
    number = kind("schema_version").rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    good = kind("onboarding_completed") == "BOOLEAN"
    for name in texts:
        good = good & (kind(name) == "STRING")
    good = good & kind("interests").startswith("ARRAY<") & number & (version == F.floor(version))
    items = F.try_variant_get(json, "$.interests", "array<variant>")
    interests = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    value = lambda name, kind_: F.try_variant_get(json, f"$.{name}", kind_).alias(name)
    return F.when(F.coalesce(good, F.lit(False)), F.struct(value("user_type", "string"), value("region", "string"), interests.alias("interests"), value("onboarding_completed", "boolean")))


def is_nationwide_user(region: str) -> bool:
    return region.strip().lower() in ("nationwide", V.NATIONWIDE)


def region_match(user: str, region: Column, codes: dict[str, str] = V.REGION_CODES) -> Column:
    """match, conflict or unknown. The user's region counts as it is written."""
    value = F.lower(F.trim(region))
    result = F.when(~has_text(region), F.lit("unknown")).when((value == "nationwide") | value.contains(V.NATIONWIDE), F.lit("match"))
    if user == "nationwide":
        return F.lit("match")
    if user not in codes:
        return result.otherwise(F.lit("unknown"))
    return result.when((value == user) | value.contains(codes[user]), F.lit("match")).otherwise(F.lit("conflict"))


def target_match(user_type: str, target: Column, business: list[str] = V.BUSINESS_TARGETS, worker: list[str] = V.WORKER_TARGETS) -> Column:
    for_business, for_worker = contains_any(target, business), contains_any(target, worker)
    result = F.when(~has_text(target), F.lit("unknown")).when(for_business & for_worker, F.lit("match"))
    if user_type == V.WORKER_USER:
        return result.when(for_business, F.lit("conflict")).otherwise(F.lit("match"))
    if user_type in V.BUSINESS_USERS:
        return result.when(for_worker, F.lit("conflict")).otherwise(F.lit("match"))
    return result.otherwise(F.lit("match" if user_type == V.OTHER_USER else "unknown"))


def recommend(view: DataFrame, condition: Condition, include_nationwide: bool = True, **words) -> DataFrame:
    """Open notices that fit, with ``matched_category_ids``, ``reasons`` and ``needs_review``. Pages follow by sorting."""
    interests = F.array(*map(F.lit, condition.categories())).cast("array<int>")
    region = region_match(condition.region, F.col("region"), words.get("codes", V.REGION_CODES))
    target = target_match(condition.user_type, F.col("target"), words.get("business", V.BUSINESS_TARGETS), words.get("worker", V.WORKER_TARGETS))
    rows = view.where((F.col("status") == "open") & F.lit(condition.onboarding_completed)).withColumns(
        {"matched_category_ids": F.array_sort(F.array_distinct(F.array_intersect("category_ids", interests))), "_region": region, "_target": target}
    )
    rows = rows.where((F.size("matched_category_ids") > 0) & (F.col("_region") != "conflict") & (F.col("_target") != "conflict"))
    if not include_nationwide and not is_nationwide_user(condition.region):
        value = F.lower(F.trim("region"))
        rows = rows.where(has_text(F.col("region")) & (value != "nationwide") & ~value.contains(V.NATIONWIDE))
    reasons = F.array(
        F.lit(V.INTEREST_REASON),
        F.when(F.col("_region") == "match", F.lit(V.REGION_REASON)).otherwise(F.lit(V.REGION_REVIEW)),
        F.when(F.col("_target") == "unknown", F.lit(V.TARGET_REVIEW)),
    )
    review = (F.col("_region") == "unknown") | (F.col("_target") == "unknown")
    return rows.withColumns({"reasons": F.array_compact(reasons), "needs_review": review}).drop("_region", "_target")


def recommendation_page(view: DataFrame, condition: Condition, sort: str, size: int = 10, after: tuple | None = None, include_nationwide: bool = True, **words) -> DataFrame:
    """The next ``size`` recommendations in the order of ``sort`` and one more, which tells that there are more. ``after``
    is (created_at or apply_end, id) of the last one shown; each notice counts once, so pages don't repeat any. Without a
    known interest there are none."""
    rows = recommend(view, condition, include_nationwide, **words).dropDuplicates(["id"])
    if after is not None:
        column, rises = list_order(sort)[0]
        at, id_ = F.lit(after[0]).cast(view.schema[column].dataType), F.lit(after[1])
        if rises:  # deadlines, none last
            later = F.col(column).isNull() & (at.isNotNull() | (F.col("id") > id_))
            rows = rows.where(F.coalesce((F.col(column) > at) | ((F.col(column) == at) & (F.col("id") > id_)), F.lit(False)) | later)
        else:
            rows = rows.where((F.col(column) < at) | ((F.col(column) == at) & (F.col("id") < id_)))
    return ordered(rows, sort).limit(size + 1)
