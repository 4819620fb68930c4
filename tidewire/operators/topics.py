"""Markets, sectors, topics and glossary terms: who belongs to them, and what each page of them lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import rules, text
from tidewire.operators.ranges import rank_in_groups
from tidewire.operators.rollups import top_per_group
from tidewire.storage import Scratch

# ---- membership ----


def placed_in_market(known: Column, place: Column, kind: Column) -> Column:
    """A profile that a market page lists: described, with a place, of a kind that is neither outside nor an investor."""
    return F.coalesce(known, F.lit(False)) & (F.coalesce(place, F.lit("")) != "") & _in_trade(kind)


def placed_in_sector(known: Column, summary: Column, kind: Column) -> Column:
    """A profile that a sector page lists: the same with a summary in the place's place."""
    return F.coalesce(known, F.lit(False)) & (F.coalesce(summary, F.lit("")) != "") & _in_trade(kind)


def _in_trade(kind: Column) -> Column:
    return (F.coalesce(kind, F.lit("")) != "") & ~kind.isin(rules.KINDS_OUTSIDE)


def market_members(profiles: DataFrame) -> DataFrame:
    """``(slug, kind, market)`` of the profiles ``(slug, known, summary, kind, place)`` with a country."""
    inside = profiles.where(placed_in_market(F.col("known"), F.col("place"), F.col("kind")))
    return inside.select("slug", "kind", text.country_of(F.col("place")).alias("market")).where(F.col("market").isNotNull())


def sector_members(profiles: DataFrame) -> DataFrame:
    """``(slug, kind, sector)``: a row for each sector that a profile's summary names."""
    inside = profiles.where(placed_in_sector(F.col("known"), F.col("summary"), F.col("kind")))
    return inside.select("slug", "kind", F.explode(text.sectors_of(F.col("summary"))).alias("sector"))


def sector_chips(members: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` sectors of each company with the fewest companies, by subject where they tie."""
    size = members.groupBy("sector").agg(F.countDistinct("slug").alias("companies"))
    subject = F.create_map(*[F.lit(x) for slug, name, *_ in rules.SECTORS for x in (slug, name)])[F.col("sector")]
    named = members.select("slug", "sector").distinct().hint("merge").join(size.hint("merge"), "sector").withColumn("subject", F.coalesce(subject, F.col("sector")))
    return top_per_group(named, ["slug"], [F.col("companies"), F.col("subject")], n)


def order_groups(groups: DataFrame, name: str) -> DataFrame:
    """Markets or sectors by their number of companies, then by name."""
    return groups.orderBy(F.col("companies").desc(), F.collate(F.col(name), "UNICODE_CI_AI"), name)


def directory(companies: DataFrame, group: str, rank: str = "rank") -> DataFrame:
    """The companies ``(group, slug, name, stories, total_m)`` of each group in order: coverage, capital, name."""
    order = [F.col("stories").desc(), F.coalesce("total_m", F.lit(0.0)).desc(), F.collate(F.col("name"), "UNICODE_CI_AI"), F.col("slug")]
    return rank_in_groups(companies, [group], order, Scratch(companies.sparkSession, "directory"), rank)


def capital_by_market(groups: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` markets that raised most, of those with a disclosed round."""
    return groups.where((F.col("rounds") > 0) & (F.col("total_m") > 0)).orderBy(F.col("total_m").desc(), F.col("rounds").desc(), groups.columns[0]).limit(n)


# ---- topics ----


def companies_of_topics(per_company: DataFrame, n: int = 14) -> DataFrame:
    """The ``n`` companies with most stories of each topic: the companies' own topics ``(slug, tag, n)`` turned over."""
    return top_per_group(per_company.select("tag", "slug", "n"), ["tag"], [F.col("n").desc(), F.col("slug")], n)


def related_topics(stories: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` topics most often on the same stories ``(link, tags)``, as (tag, other, n, rank).

    A story has a handful of labels, so its pairs are made in the row.
    """
    tags = F.array_distinct("tags")
    pairs = stories.select(F.explode(tags).alias("tag"), tags.alias("others")).select("tag", F.explode("others").alias("other")).where("tag <> other")
    counts = pairs.groupBy("tag", "other").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counts, ["tag"], [F.col("n").desc(), F.col("other")], n)


def sources_of_topics(stories: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` outlets with most stories ``(link, source, tags)`` of each topic."""
    named = stories.where(F.coalesce("source", F.lit("")) != "").select(F.explode(F.array_distinct("tags")).alias("tag"), "source")
    return top_per_group(named.groupBy("tag", "source").agg(F.count(F.lit(1)).alias("n")), ["tag"], [F.col("n").desc(), F.col("source")], n)


# ---- glossary ----


def term_stories(articles: DataFrame, terms: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``(term, link, published_at)``: the stories whose headline, not summary, has a glossary term."""
    table = [(slug, pattern) for slug, pattern, *_ in (rules.TERMS if terms is None else terms)]
    found = text.labels(F.coalesce("title", F.lit("")), table, fallback=None)
    return articles.select(F.explode(found).alias("term"), "link", "published_at")


def term_rollup(stories: DataFrame, least: int = 3) -> DataFrame:
    """Stories and dates of each term; ``indexable`` from ``least`` stories on."""
    out = stories.groupBy("term").agg(F.countDistinct("link").alias("stories"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))
    return out.withColumn("indexable", F.col("stories") >= least)


def companies_of_terms(stories: DataFrame, mentions: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` companies ``mentions(slug, link)`` in most stories of each term."""
    both = stories.select("term", "link").distinct().hint("merge").join(mentions.select("slug", "link").distinct().hint("merge"), "link")
    return top_per_group(both.groupBy("term", "slug").agg(F.count(F.lit(1)).alias("n")), ["term"], [F.col("n").desc(), F.col("slug")], n)


def alphabetical(terms: DataFrame, name: str = "term") -> DataFrame:
    """A to Z, case and accents ignored."""
    return terms.orderBy(F.collate(F.col(name), "UNICODE_CI_AI"), name)


# ---- references ----


def window_companies(mentions: DataFrame, window: DataFrame) -> DataFrame:
    """The companies ``mentions(slug, link)`` of the stories of a window, sorted."""
    return mentions.join(window.select("link"), "link", "left_semi").select("slug").where(F.col("slug").isNotNull()).distinct().orderBy("slug")


def live_badges(badges: DataFrame, index: DataFrame) -> DataFrame:
    """The company badges ``(link, slug)`` that the index still has a record for."""
    return badges.join(index.select("slug"), "slug", "left_semi")
