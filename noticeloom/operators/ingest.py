"""A whole ingest in batch: response pages of all sources to notices, counts per source, and the time of the last run."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.functions import values as V
from noticeloom.functions.dates import retention_cutoff, seoul_date
from noticeloom.functions.scratch import written
from noticeloom.functions.text import dedup_title
from noticeloom.operators import merge
from noticeloom.operators.dedup import first_seen, preferred_duplicates
from noticeloom.sources.adapters import payload_hash, selected, to_rows
from noticeloom.sources.payloads import explode_items, is_json, json_items, xml_items

KEYS = ["source_id", "source_key"]
#: Sources of XML, those whose notices count as the original, and the one that is cleared of their repetitions.
XML_SOURCES, PREFERRED, CLEARED = ["mss", "msit"], ["bizinfo", "kstartup"], "mss"
FAILED = "수집 실패"


@dataclass
class Ingest:
    """``notices`` as stored now; ``counters`` per source (code, items, upserted, skipped, duplicates, expired, failed, error, and
    details_fetched, details_failed, details_skipped, details_pending); ``sources`` with ``last_fetched_at``; ``to_fetch``: source_id,
    source_key, detail_url of the pages that this run may fetch, in order of arrival (None where details aren't stored)."""

    notices: DataFrame
    counters: DataFrame
    sources: DataFrame
    to_fetch: DataFrame | None = None


def items_of(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw items (source, page, place, raw, arrival) of ``pages`` (source, page, body), and the sources that broke off
    (code, error): from its first JSON page that is none on, a source gives nothing more. A page that comes several times counts as
    often; its copies come in the order of their bodies. Arrivals are unique within a source."""
    is_xml = F.col("source").isin(XML_SOURCES)
    broken = pages.where(~is_xml & ~is_json(F.col("body"))).groupBy("source").agg(F.min("page").alias("first"))
    good = pages.join(broken, "source", "left").where(F.col("first").isNull() | (F.col("page") < F.col("first")))
    copy = F.row_number().over(Window.partitionBy("source", "page").orderBy("body")) - 1
    items = F.when(is_xml, xml_items(F.col("body"))).otherwise(json_items(F.col("body")))
    return explode_items(good.withColumn("copy", copy), items, keep=["source"]), broken.select(F.col("source").alias("code"), F.lit(FAILED).alias("error"))


def with_details(prepared: DataFrame, stored: DataFrame, now: Column, budget: int) -> DataFrame:
    """Prepared rows with ``detail``: what becomes of their page, candidate (within the source's budget, in order of
    arrival), pending (beyond it) or skipped (no address, or no need)."""
    rows = merge.to_fetch(prepared, stored, payload_hash(F.col("raw"), F.col("source_id")), seoul_date(now), now)
    order = Window.partitionBy("source_id", "needed").orderBy("arrival")
    within = F.row_number().over(order) <= max(0, min(V.MAX_DETAIL_BUDGET, budget))
    return rows.withColumn("detail", F.when(~F.col("needed"), F.lit("skipped")).when(within, F.lit("candidate")).otherwise(F.lit("pending")))


def run_ingest(pages: DataFrame, stored: DataFrame, sources: DataFrame, now: Column, only: str | None = None, canonical=dedup_title, *, unfit: Column | None = None, fetched: DataFrame | None = None, budget: int = V.DETAIL_BUDGET) -> Ingest:
    """``pages``: source (code), page, body. ``stored``: notices with id, created_at and the columns of ``to_rows``.
    ``sources``: code, last_fetched_at. ``only`` names sources, comma-separated.

    Items without title or key, or that their adapter turns away, are skipped; so are repetitions of preferred sources'
    notices (as they stand after this run) and of earlier items in the one source that is cleared of them, and then what
    has expired. Rows for which ``unfit`` is true are those that the table doesn't take: they count as failed and go. (A
    batch job can't fail for one row otherwise; without ``unfit`` none fails.) The rest is upserted by source and key, of equal
    keys the last arrival; new rows get new ids. What has expired in the table goes as well. A source without error or
    failed row has a new ``last_fetched_at``.

    Where ``stored`` has the state of detail fetches, the upserted rows whose page is to be fetched are found, ``budget`` a
    source. ``fetched`` (source_id, source_key, ok, reason, region and detail columns, as :func:`merge.apply_details` takes them; a row
    a key) are results for these; candidates without a result are pending.
    """
    chosen = selected(only)
    cutoff = retention_cutoff(seoul_date(now), V.RETENTION_DAYS)
    current = F.col("apply_end").isNull() | (F.col("apply_end") >= cutoff)
    fails = F.coalesce(unfit, F.lit(False)) if unfit is not None else F.lit(False)
    items, errors = items_of(pages.where(F.col("source").isin(list(chosen))))
    items = written(items, "ingest-items")
    made = reduce(DataFrame.unionByName, [adapter(items.where(F.col("source") == code)) for code, adapter in chosen.items()])
    made = written(made.withColumn("fails", fails), "ingest-made")
    cleared = F.col("source_id") == V.SOURCE_ID[CLEARED]
    taken = current & ~F.col("fails")

    first = written(to_rows(made.where(~cleared & taken).drop("fails"), now), "ingest-first")
    of_preferred = F.col("source_id").isin([V.SOURCE_ID[c] for c in PREFERRED])
    narrow = [*KEYS, "title", "apply_end"]
    originals = merge.upsert(stored.where(of_preferred).select(*narrow), first.where(of_preferred).select(*narrow, "arrival"), KEYS, arrival="arrival")
    candidates = made.where(cleared)
    repeated = preferred_duplicates(candidates.select(F.col("arrival").alias("id"), "title", "apply_end"), originals, canonical)
    fresh = first_seen(candidates.join(repeated.select(F.col("id").alias("arrival")), "arrival", "left_anti"), F.col("arrival"), canonical)
    fresh = written(fresh, "ingest-fresh")

    new = first.unionByName(to_rows(fresh.where(taken).drop("fails"), now)).withColumn("created_at", now)
    merged = merge.upsert(stored, new, KEYS, keep=["created_at"], coalesced=["attachments"], arrival="arrival")
    details = None
    if "detail_fetched_at" in stored.columns:
        details = written(with_details(new.select(*KEYS, "detail_url", "apply_end", "raw", "arrival"), stored, now, budget).select(*KEYS, "detail_url", "arrival", "detail"), "ingest-details")
        asked = details.where("detail = 'candidate'").select(*KEYS).distinct()
        if fetched is not None:
            fetched = written(fetched.join(asked, KEYS, "left_semi"), "ingest-fetched")
            merged = merge.apply_details(merged, fetched, now)
    merged = written(merge.purge_expired(merged, cutoff), "ingest-merged")
    largest = stored.agg(F.max("id")).first()[0] or 0
    notices = merge.with_new_ids(merged, "id", largest)

    kept = fresh.select("source_id", "arrival", F.lit(True).alias("kept"))
    duplicate = cleared & F.col("kept").isNull()
    outcome = F.when(duplicate, F.lit("duplicates")).when(~current, F.lit("expired")).when(F.col("fails"), F.lit("failed")).otherwise(F.lit("upserted"))
    marked = made.join(kept, ["source_id", "arrival"], "left").withColumn("outcome", outcome)
    counts = marked.groupBy("source_id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("upserted", "duplicates", "expired", "failed")])
    code = F.element_at(F.create_map(*[F.lit(x) for c, i in V.SOURCE_ID.items() for x in (i, c)]), F.col("source_id"))
    every = items.groupBy(F.col("source").alias("code")).agg(F.count(F.lit(1)).alias("items"))
    asked = sources.select("code").where(F.col("code").isin(list(chosen)))
    counters = asked.join(every, "code", "left").join(counts.withColumn("code", code).drop("source_id"), "code", "left").join(errors, "code", "left")
    names = ["details_fetched", "details_failed", "details_skipped", "details_pending"]
    if details is not None:
        results = details.withColumn("ok", F.lit(None).cast("boolean")) if fetched is None else details.join(fetched.select(*KEYS, F.coalesce("ok", F.lit(False)).alias("ok")), KEYS, "left")
        asking = F.col("detail") == "candidate"
        told = [asking & F.col("ok"), asking & ~F.col("ok"), F.col("detail") == "skipped", (F.col("detail") == "pending") | (asking & F.col("ok").isNull())]
        counted = results.groupBy("source_id").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for c, n in zip(told, names, strict=True)])
        counters = counters.join(counted.withColumn("code", code).drop("source_id"), "code", "left")
    else:
        counters = counters.withColumns({n: F.lit(0) for n in names})
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    skipped = (F.coalesce("items", F.lit(0)) - F.coalesce("upserted", F.lit(0)) - F.coalesce("failed", F.lit(0))).cast("long").alias("skipped")
    counters = written(counters.select("code", number("items"), number("upserted"), skipped, *map(number, ("duplicates", "expired", "failed")), "error", *map(number, names)), "ingest-counters")
    to_fetch = None if details is None else details.where("detail = 'candidate'").orderBy("source_id", "arrival").select(*KEYS, "detail_url")
    return Ingest(notices, counters, merge.update_source(sources, counters, now), to_fetch)
