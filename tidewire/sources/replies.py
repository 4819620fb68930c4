"""Replies of a reader, landed as text: the object is cut out, parsed and checked field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import dates, rules, text

FUNDING_REPLY = "round boolean, company string, amount string, unit string, currency string, stage string, lead string, announcedYear int"
DEAL_REPLY = "deal boolean, acquirer string, target string, seller string, type string, amount string, unit string, currency string, announcedYear int"
PROFILE_REPLY = "known boolean, summary string, kind string, place string"
BRIEF_REPLY = "headline string, teaser string, whatsHappening string, whyItMatters string"
_UNITS = {"thousand": 1e-3, "k": 1e-3, "million": 1.0, "m": 1.0, "mn": 1.0, "billion": 1e3, "bn": 1e3, "b": 1e3, "crore": 10.0, "cr": 10.0, "lakh": 0.1}


def parse(reply: Column, schema: str) -> Column:
    """The first object of a reply as a struct; null where there is none."""
    return F.from_json(text.json_slice(reply), schema)


def _amount(r: Column) -> Column:
    n = F.regexp_replace(r["amount"], r"[,\s]", "").try_cast("double")
    unit = F.create_map(*[F.lit(x) for kv in _UNITS.items() for x in kv])[F.lower(F.trim(r["unit"]))]
    return F.when(n > 0, n * F.coalesce(unit, F.lit(1.0)))


def _cut(c: Column, n: int) -> Column:
    return F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, n)


def funding_verdict(df: DataFrame, reply: str = "reply", pv: int = 1) -> DataFrame:
    """``(link, round, company, amount_m, currency, stage, lead, stale, pv)``.

    Not a round, no amount, an unknown currency or a report more than a year after the announcement are
    negative verdicts: rows, as an absent row means undecided.
    """
    r = df.withColumn("__r", parse(F.col(reply), FUNDING_REPLY))
    x, late = F.col("__r"), dates.year_gap(F.col("published_at"), F.col("__r.announcedYear"))
    currency = F.upper(F.trim(F.coalesce(x["currency"], F.lit("USD"))))
    ok = F.coalesce(x["round"], F.lit(False)) & ~late & (_amount(x) > 0) & currency.isin(list(rules.RATES))
    known = F.trim(x["stage"]).isin([s for s, _ in rules.STAGES])
    keep = lambda c: F.when(ok, c)
    return r.where(x.isNotNull()).select("link", F.coalesce(ok, F.lit(False)).alias("round"), keep(_cut(x["company"], 80)).alias("company"), keep(_amount(x)).alias("amount_m"), keep(currency).alias("currency"), keep(F.when(known, F.trim(x["stage"])).otherwise("")).alias("stage"), keep(_cut(x["lead"], 60)).alias("lead"), F.when(late, x["announcedYear"]).alias("stale"), F.lit(pv).alias("pv"))


def deal_verdict(df: DataFrame, reply: str = "reply", pv: int = 1) -> DataFrame:
    """As ``funding_verdict`` for deals: both parties named and different; the price is optional."""
    r = df.withColumn("__r", parse(F.col(reply), DEAL_REPLY))
    x, late = F.col("__r"), dates.year_gap(F.col("published_at"), F.col("__r.announcedYear"), 2)
    a, t = _cut(x["acquirer"], 80), _cut(x["target"], 80)
    ok = F.coalesce(x["deal"], F.lit(False)) & ~late & (a != "") & (t != "") & (F.lower(a) != F.lower(t))
    currency = F.upper(F.trim(F.coalesce(x["currency"], F.lit("USD"))))
    priced = ok & (_amount(x) > 0) & currency.isin(list(rules.RATES))
    kinds = [n for n, _ in rules.DEAL_TYPES] + ["Acquisition"]
    return r.where(x.isNotNull()).select("link", F.coalesce(ok, F.lit(False)).alias("deal"), F.when(ok, a).alias("acquirer"), F.when(ok, t).alias("target"), F.when(ok, _cut(x["seller"], 80)).alias("seller"), F.when(ok, F.when(F.trim(x["type"]).isin(kinds), F.trim(x["type"])).otherwise("Acquisition")).alias("type"), F.when(priced, _amount(x)).alias("amount_m"), F.when(priced, currency).alias("currency"), F.when(late, x["announcedYear"]).alias("stale"), F.lit(pv).alias("pv"))


def profile_verdict(df: DataFrame, kinds: list[str], reply: str = "reply", low: int = 30, high: int = 320, pv: int = 1) -> DataFrame:
    """``(slug, known, summary, kind, place, reason, pv)``: a summary of fitting length, no figures but those in
    the name, no advertising words, a listed kind."""
    r = df.withColumn("__r", parse(F.col(reply), PROFILE_REPLY))
    x = F.col("__r")
    summary = text.squeeze(F.coalesce(x["summary"], F.lit("")))
    bare = F.replace(F.lower(summary), F.lower(F.col("name")), F.lit(""))
    reason = F.when(~F.coalesce(x["known"], F.lit(False)), "unknown").when(~F.length(summary).between(low, high), "length").when(bare.rlike(r"\d"), "figure").when(summary.rlike(r"(?i)\b(?:leading|innovative|cutting-edge|world-class|revolutionary|best-in-class)\b"), "marketing").when(~F.coalesce(x["kind"].isin(kinds), F.lit(False)), "kind")
    ok = reason.isNull()
    return r.where(x.isNotNull()).select("slug", ok.alias("known"), F.when(ok, summary).alias("summary"), F.when(ok, x["kind"]).alias("kind"), F.when(ok, F.regexp_replace(text.squeeze(F.coalesce(x["place"], F.lit(""))), r"\.$", "")).alias("place"), reason.alias("reason"), F.lit(pv).alias("pv"))


def prose_verdict(sections: Column, low: int = 80, high: int = 1200, least: int = 2, most: int = 6) -> Column:
    """True for ``array<struct<heading,text>>`` with a fitting number of sections of fitting length, no heading
    twice, no statistics and no advertising words."""
    heads = F.transform(sections, lambda s: F.lower(F.trim(s["heading"])))
    fits = F.forall(sections, lambda s: F.length(s["text"]).between(low, high) & ~s["text"].rlike(r"\d+(?:\.\d+)?\s?%|[$€£]\s?\d") & ~s["text"].rlike(r"(?i)\b(?:leading|cutting-edge|world-class|revolutionary)\b"))
    return F.coalesce(F.size(sections).between(least, most) & (F.size(F.array_distinct(heads)) == F.size(heads)) & fits, F.lit(False))


def brief_verdict(df: DataFrame, reply: str = "reply", low: int = 80) -> DataFrame:
    """The four fields of a brief with ``reason`` null where it is acceptable; headlines lose their full stop."""
    r = df.withColumn("__r", parse(F.col(reply), BRIEF_REPLY))
    x = F.col("__r")
    field = lambda c: text.squeeze(F.coalesce(x[c], F.lit("")))
    reason = F.when(x.isNull(), "no object").when((field("headline") == "") | (field("teaser") == ""), "empty").when((F.length(field("whatsHappening")) < low) | (F.length(field("whyItMatters")) < low), "short")
    return r.select(*df.columns, F.regexp_replace(field("headline"), r"\.$", "").alias("headline"), field("teaser").alias("teaser"), field("whatsHappening").alias("whats_happening"), field("whyItMatters").alias("why_it_matters"), reason.alias("reason"))


def reply_variants(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Replies of unknown shape: the first object or array in the text as a variant ``v`` (null where none parses) and its
    ``shape``, the schema it has; fields are read with ``try_variant_get``, null where the shape has none."""
    text_ = F.col(reply)
    whole = F.coalesce(F.try_parse_json(text_), F.try_parse_json(text.json_slice(text_)))
    return replies.withColumn("v", whole).withColumn("shape", F.schema_of_variant("v"))


def shape_counts(read: DataFrame) -> DataFrame:
    """How many replies have each shape, unreadable ones under null."""
    return read.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))
