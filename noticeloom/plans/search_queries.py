"""Queries by likeness and relevance over the public view's titles and texts, and their SQL. Every fiftieth notice asks."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeloom.functions.scratch import written
from noticeloom.operators import dedup, search
from noticeloom.plans.bridge import NOTICES, notices, today
from noticeloom.plans.register import query

GRAMS = r"list_distinct(flatten(list_transform(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def titles(spark, sf_dir):
    return written(dedup.public_view(notices(spark, sf_dir), today()).select("id", "title", "organization", "target"), "search-titles")


def asking(rows, text: str):
    return rows.where("id % 50 = 0").select(F.col("id").alias("query"), F.col(text).alias("text"))


ALIKE = (
    NOTICES
    + f""", grams AS (SELECT id, {GRAMS.format("title")} AS g FROM seen),
    pairs AS (SELECT a.id AS query, b.id, CAST(len(list_intersect(a.g, b.g)) AS INTEGER) AS common, len(a.g) AS m, len(b.g) AS n FROM grams a JOIN grams b ON a.id % 50 = 0 AND len(a.g) > 0 AND len(b.g) > 0),
    near AS (SELECT *, common / (m + n - common) AS similarity FROM pairs WHERE common > 0),
    found AS (SELECT query, id, common, similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS INTEGER) AS place FROM near) """
)


@query(ALIKE + "SELECT query, id, common, similarity, place FROM found WHERE similarity >= 0.3")
def titles_alike(spark, sf_dir):
    """Titles that are like those that ask, all of them."""
    rows = titles(spark, sf_dir)
    return search.alike(search.trigram_index(rows), asking(rows, "title"))


@query(ALIKE + "SELECT query, id, common, similarity, place FROM found WHERE similarity >= 0.5 AND place <= 5")
def titles_most_alike(spark, sf_dir):
    """The five titles most alike, after the index has been brought up to date: every seventh title was another, every eleventh wasn't there, and
    some were there that have gone."""
    rows = titles(spark, sf_dir)
    before = rows.select("id", F.when(F.col("id") % 7 == 0, F.concat(F.lit("formerly "), F.reverse("title"))).otherwise(F.col("title")).alias("title")).where("id % 11 <> 0")
    before = before.unionByName(rows.where("id % 13 = 0").select((-F.col("id") - 1).alias("id"), "title"))
    changed = rows.where("id % 7 = 0 OR id % 11 = 0").select("id", "title").unionByName(before.where("id < 0").select("id", F.lit(None).cast("string").alias("title")))
    return search.alike(search.reindexed(search.trigram_index(before), changed), asking(rows, "title"), 0.5, 5)


@query(NOTICES + "SELECT id, title FROM seen WHERE title ILIKE '%tion%'")
def titles_like(spark, sf_dir):
    """A search for part of a word that reads only the lists of its trigrams."""
    rows = titles(spark, sf_dir)
    return search.like(search.trigram_index(rows), rows, "%tion%").select("id", "title")


RANKED = (
    NOTICES
    + f""", told AS (SELECT id, {WORDS.format("concat_ws(' ', title, organization, target)")} AS words FROM seen),
    texts AS (SELECT id, words, len(words)::DOUBLE AS length FROM told WHERE len(words) > 0),
    whole AS (SELECT count(*)::DOUBLE AS n, sum(length) / count(*) AS mean FROM texts),
    counted AS (SELECT term, id, any_value(length) AS length, count(*)::DOUBLE AS times FROM (SELECT id, length, unnest(words) AS term FROM texts) GROUP BY term, id),
    rare AS (SELECT term, count(*)::DOUBLE AS texts FROM counted GROUP BY term),
    weighed AS (
      SELECT term, id, CAST(round(ln(1.0::DOUBLE + (n - texts + 0.5::DOUBLE) / (texts + 0.5::DOUBLE)) * (times * 2.2::DOUBLE / (times + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) * 1000000000) AS BIGINT) AS weight
      FROM counted JOIN rare USING (term), whole),
    asked AS (SELECT DISTINCT id AS query, unnest({WORDS.format("title")}) AS term FROM seen WHERE id % 50 = 0),
    scores AS (SELECT query, id, sum(weight) AS sum FROM asked JOIN weighed USING (term) GROUP BY query, id),
    placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY sum DESC, id) AS INTEGER) AS place FROM scores)
    SELECT query, id, sum::DOUBLE / 1000000000 AS score, place FROM placed WHERE place <= 10"""
)


@query(RANKED)
def ranked_search(spark, sf_dir):
    """The ten notices that fit best the words of each title that asks."""
    rows = titles(spark, sf_dir)
    return search.ranked(search.ranked_index(rows, "id", ["title", "organization", "target"], block_texts=64), asking(rows, "title"))
