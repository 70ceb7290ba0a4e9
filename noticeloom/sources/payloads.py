"""Raw payloads: items of JSON and XML responses. Responses are rows of a table; nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.text import NAMED, replaced, trimmed

#: Where responses keep their items; the first array or object counts.
ITEM_PATHS = ["$.response.body.items.item", "$.response.body.items", "$.jsonArray", "$.data", "$.items", "$.body.items"]


def json_items(body: Column) -> Column:
    """Items of a JSON response, as an array of JSON texts; a lone object is one item, no JSON none."""
    found = []
    for path in ITEM_PATHS:
        part = F.get_json_object(body, path)
        found.append(F.when(part.startswith("["), F.from_json(part, "array<string>")).when(part.startswith("{"), F.array(part)))
    return F.coalesce(*found, F.array().cast("array<string>"))


def is_json(body: Column) -> Column:
    return F.try_parse_json(body).isNotNull()


def explode_items(responses: DataFrame, items: Column, keep: list[str] = ()) -> DataFrame:
    """One row per item with its ``arrival`` (page, copy, place), unique within what ``keep`` names: pages in order (column
    page), copies of one page in the order of their ``copy`` (0 where there is no such column), items in order within."""
    copy = F.col("copy") if "copy" in responses.columns else F.lit(0)
    rows = responses.select(*keep, "page", copy.alias("copy"), F.posexplode(items).alias("place", "raw"))
    return rows.withColumn("arrival", F.struct("page", "copy", "place")).drop("copy")


ELEMENT = r"(?s)<([A-Za-z0-9_:-]+)\b[^>]*>(.*?)</\1>"


def xml_items(body: Column) -> Column:
    """The inner XML of each <item>."""
    return F.regexp_extract_all(body, F.lit("(?s)<item>(.*?)</item>"), F.lit(1))


def _value(raw: Column) -> Column:
    """CDATA is unwrapped, then entities are decoded once."""
    return replaced(trimmed(F.regexp_replace(trimmed(raw), r"(?s)^<!\[CDATA\[(.*?)\]\]>$", "$1")), *NAMED)


def xml_values(item: Column, tag: str) -> Column:
    """All values of a tag, in order; none gives an empty array."""
    names, values = F.regexp_extract_all(item, F.lit(ELEMENT), F.lit(1)), F.regexp_extract_all(item, F.lit(ELEMENT), F.lit(2))
    pairs = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda p: p["k"] == tag)
    return F.transform(pairs, lambda p: _value(p["v"]))


def xml_map(item: Column) -> Column:
    """Tag to values."""
    names, values = F.regexp_extract_all(item, F.lit(ELEMENT), F.lit(1)), F.regexp_extract_all(item, F.lit(ELEMENT), F.lit(2))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    return F.map_from_entries(
        F.transform(F.array_distinct(names), lambda k: F.struct(k.alias("key"), F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: _value(p["v"])).alias("value")))
    )


def request_url(base: str, **params: Column | str | int) -> Column:
    """An address with a query string."""
    parts = [F.concat(F.lit(f"{k}="), F.url_encode((v if isinstance(v, Column) else F.lit(v)).cast("string"))) for k, v in params.items()]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *parts))
