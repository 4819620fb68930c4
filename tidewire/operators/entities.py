"""Company mentions: extraction, canonical names, splits, investor demotion, merging and the index."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tidewire.functions import rules, text
from tidewire.operators.rollups import co_occurrence, top_per_group
from tidewire.storage import Scratch

#: A run of name-like words in the string that has one letter for each word of a headline: N, n where a mark behind the word
#: ends the run, & for a lone ampersand, which joins. At most three words' length, a joint, and one word more.
_RUN = "(?:NNN|NN&|N&N|NN|N&|N)?N&?[Nn]|[Nn]"
_NAMELIKE = r"^(?:[A-Z][A-Za-z0-9.'&-]*$|[A-Z0-9&.]{2,}$|.*[a-z][A-Z])"
_UNLIKE = rf"^v?\d[\d.]*$|(?i:^.{{4,}}ing$)|{rules.ADJECTIVE_ENDING}"
_FIGURE = r"(?i)^\$?\d[\d.,]*[kmbn%]?$"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _letters(words: Column, cases: list, other: str = ".") -> Column:
    """A string with a letter for each word: that of the first case that holds."""

    def one(w: Column) -> Column:
        out = None
        for test, letter in cases:
            out = F.when(test(w), letter) if out is None else out.when(test(w), letter)
        return out.otherwise(other)

    return F.array_join(F.transform(words, one), "")


def company_names(title: Column, known: dict[str, str] | None = None, generic: list[str] | None = None, source: Column | None = None) -> Column:
    """Company names a headline mentions, in order, each once; ``known`` maps slugs to display names, ``generic`` words are no
    name by themselves, ``source`` is never one.

    Words become letters: strings of classes, one letter a word. Runs of name-like words are then found by a pattern over
    letters, and what stands before and behind a run is read off the same way. A run is a company if one of the marks below
    holds. Array functions only, no Python worker.
    """
    generic = list(rules.GENERIC_WORDS if generic is None else generic)
    ends = sorted({*rules.GRAMMAR_WORDS, *rules.ACTION_WORDS, *rules.PLACE_WORDS, *rules.MODIFIER_WORDS, *(set(generic) - set(rules.COMPANY_TYPE))})
    acronyms = sorted({*rules.TRADE_ACRONYMS, *generic})
    among = lambda words: lambda w: w["low"].isin(list(words))
    joint = (among(["and", "&"]), "j")
    fits = lambda w: w["bare"].rlike(_NAMELIKE) & ~w["low"].isin(ends) & ~w["bare"].rlike(_UNLIKE)

    plain = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"[’']s\b", ""), r"[“”\"()\[\]]", " ")
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, "^[^A-Za-z0-9&]+", ""), "[^A-Za-z0-9&.]+$", "")
    words = F.transform(F.filter(F.split(plain, r"\s+"), lambda t: t != ""), lambda t: F.struct(t.alias("token"), bare(t).alias("bare"), F.lower(bare(t)).alias("low")))

    def classes(w: Column) -> Column:
        return F.struct(
            w.alias("words"),
            _letters(w, [(lambda x: fits(x) & x["token"].rlike("[,;:—–]$"), "n"), (fits, "N"), (lambda x: x["token"] == "&", "&")]).alias("run"),
            _letters(w, [(among(rules.ACTION_WORDS), "a"), joint]).alias("acts"),
            _letters(w, [(among(rules.OBJECT_ACTIONS), "t"), joint]).alias("takes"),
            _letters(w, [(among(generic), "g")]).alias("generic"),
            # what a name does not end in: joints and figures, and short capitals behind two words
            _letters(w, [(lambda x: x["low"].isin("&", "and") | x["bare"].rlike(_FIGURE), "c"), (lambda x: x["bare"].rlike("^[A-Z]{2,6}$"), "C")]).alias("tail"),
        )

    def runs(k: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("runs"))
        step = lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            F.when(p.rlike("^[Nn]"), F.concat(acc["runs"], F.array(F.struct(acc["at"].alias("at"), F.length(p).alias("n"))))).otherwise(acc["runs"]).alias("runs"),
        )
        found = F.aggregate(F.regexp_extract_all(k["run"], F.lit(f"{_RUN}|."), F.lit(0)), start, step)["runs"]
        lead = lambda r: F.length(F.regexp_extract(F.substr(k["generic"], r["at"] + 1, r["n"]), "^g*", 0))
        cores = F.transform(found, lambda r: _let(lead(r), lambda g: F.struct(r["at"].alias("at"), r["n"].alias("n"), (r["at"] + g).alias("core"), (r["n"] - g).alias("size"))))
        return F.transform(F.filter(cores, lambda r: r["size"] > 0), lambda r: read(k, r))

    def read(k: Column, r: Column) -> Column:
        """Slug and name of a run; no slug where nothing marks it as a company."""
        core = F.slice(k["words"], r["core"] + 1, r["size"])
        last = F.element_at(core, -1)
        marks = {
            "an action behind it": F.substr(k["acts"], r["at"] + r["n"] + 1, F.lit(2)).rlike("^j?a"),
            "an action on it": F.substr(k["takes"], F.lit(1), r["at"]).rlike("tj?$"),
            "a capital inside a word": F.exists(F.slice(k["words"], r["at"] + 1, r["n"]), lambda w: w["bare"].rlike("[a-z][A-Z]")),
            "an acronym": (r["size"] == 1) & last["bare"].rlike("^[A-Z]{3,6}$") & ~last["low"].isin(acronyms),
            "a company's last word": (r["size"] > 1) & last["low"].isin(list(rules.NAME_ENDINGS)),
        }
        if known:
            marks["a known company"] = text.company_slug(_joined(core)).isin(list(known))
        company = F.lit(False)
        for mark in marks.values():
            company = company | mark
        tail = F.regexp_replace(F.substr(k["tail"], r["core"] + 1, r["size"]), "(?<=..)[cC]+$", "")
        name = _joined(F.slice(core, F.lit(1), F.length(F.regexp_replace(tail, "(?<=^.)c$", ""))))
        return _let(name, lambda n: F.struct(F.when(company, text.company_slug(n)).alias("slug"), n.alias("name")))

    def distinct(found: Column) -> Column:
        slugs = F.array_distinct(F.transform(found, lambda x: x["slug"]))
        return F.transform(slugs, lambda s: F.element_at(F.filter(found, lambda x: x["slug"] == s), -1)["name"])

    outlet = F.lit("") if source is None else text.company_slug(source)
    wanted = lambda x: x["slug"].isNotNull() & (x["slug"] != "") & (x["slug"] != F.coalesce(outlet, F.lit("")))
    named = _let(words, lambda w: _let(classes(w), lambda k: F.filter(runs(k), wanted)))
    if known:
        names = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
        named = F.transform(named, lambda x: F.struct(x["slug"].alias("slug"), F.coalesce(F.try_element_at(names, x["slug"]), x["name"]).alias("name")))
    return _let(named, distinct)


def _joined(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["bare"]), " ")


def sane_names(names: Column, junk: list[str], exclude: Column | None = None, generic: list[str] | None = None) -> Column:
    """Names of at most 60 characters that are no junk, no outlet and not made of generic words only; distinct."""
    generic = list(generic if generic is not None else rules.COMPANY_TYPE)
    outlet = None if exclude is None else text.company_slug(exclude)

    def ok(n: Column) -> Column:
        some = (F.length(n) <= 60) & ~F.forall(F.split(F.lower(n), r"\s+"), lambda w: w.isin(generic))
        return some & _let(text.company_slug(n), lambda slug: (slug != "") & ~slug.isin(junk) & (slug != outlet if exclude is not None else F.lit(True)))

    kept = F.filter(names, ok)
    return F.array_distinct(kept)


def canonical(mentions: DataFrame, aliases: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """``(link, name, title)`` with display name and slug after aliases ``(alias_slug, canonical)`` and splits
    ``(slug, pattern, new_name)``: of the splits of a name the first, by ``ord`` if there is such a column, whose
    pattern the headline matches, names it. Repeated aliases count once; a mention stays one mention."""
    known = aliases.groupBy("alias_slug").agg(F.min("canonical").alias("canonical"))
    out = mentions.withColumn("__s", text.company_slug(F.col("name"))).join(known, F.col("__s") == F.col("alias_slug"), "left")
    out = out.withColumn("name", F.coalesce("canonical", "name")).drop("alias_slug", "canonical", "__s")
    if splits is not None:
        order = F.col("ord") if "ord" in splits.columns else F.lit(0)
        rule = F.array_sort(F.collect_list(F.struct(order.alias("ord"), "pattern", "new_name")))
        by = splits.groupBy(F.col("slug").alias("__ss")).agg(rule.alias("__rules"))  # a curated list: a few rules a name
        hit = out.withColumn("__s", text.company_slug(F.col("name"))).join(by, F.col("__s") == F.col("__ss"), "left")
        named = F.when(F.size("__rules") > 0, F.expr("try_element_at(filter(__rules, r -> title rlike r.pattern), 1).new_name"))
        out = hit.withColumn("name", F.coalesce(named, "name")).drop("__s", "__ss", "__rules")
    return out.withColumn("slug", text.company_slug(F.col("name")))


@F.pandas_udf(ArrayType(IntegerType()))
def investor_positions(title: pd.Series) -> pd.Series:
    """Where an investor's name would begin; after "from" and "with" only behind a money figure on a raise."""
    lead, money, raise_ = re.compile(rules.INVESTOR_LEAD), re.compile(rules.MONEY_HINT), re.compile(rules.TAGS[0][1])
    more = re.compile(r"(?i)\b(?:from|with)\s+")

    def one(t: str | None) -> list[int]:
        t = t or ""
        out = [m.end() for m in lead.finditer(t)]
        behind = [m for m in more.finditer(t) if money.search(t[: m.start()])]
        return out + [m.end() for m in behind] if behind and raise_.search(t) else out  # the raise is the dear test

    return title.map(one)


def investors(mentions: DataFrame) -> DataFrame:
    """Slugs whose every mention ``(slug, name, title)`` sits in an investor's place."""
    at = F.instr(F.lower("title"), F.lower("name")) - 1
    seat = (at >= 0) & F.exists(investor_positions(F.col("title")), lambda p: F.abs(p - at) <= 2)
    return mentions.withColumn("__i", seat).groupBy("slug").agg(F.count_if("__i").alias("inv"), F.count_if(~F.col("__i")).alias("other")).where("inv > 0 and other = 0").select("slug")


def prefix_merges(slugs: DataFrame, exempt: list[str] | None = None, words: list[str] | None = None) -> DataFrame:
    """``(slug, root)``: a slug folds into the longest shorter slug it extends by corporate words only.

    Chains are followed to their end: each step at least drops a word, so joins of the roots with themselves settle all
    in as many turns as the longest chain's links have binary digits, and end when a turn changes nothing.
    """
    scratch = Scratch(slugs.sparkSession, "prefix")
    words = words or rules.COMPANY_TYPE
    parts = F.split("slug", "-")
    cuts = slugs.select("slug", F.explode(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))).alias("k")).where(~F.col("slug").isin(exempt or []))
    cuts = cuts.select("slug", "k", F.array_join(F.slice(parts, F.lit(1), F.col("k")), "-").alias("root"), F.slice(parts, F.col("k") + 1, F.size(parts)).alias("rest")).where(F.forall("rest", lambda w: w.isin(words)))
    real = cuts.hint("merge").join(slugs.select(F.col("slug").alias("root")).hint("merge"), "root")
    step = scratch.put(real.groupBy("slug").agg(F.max(F.struct("k", "root"))["root"].alias("root")))
    while True:  # each turn doubles the links that are behind a step; a name has few words
        onward = step.select(F.col("slug").alias("root"), F.col("root").alias("next"))
        longer = scratch.put(step.join(onward, "root", "left").select("slug", F.coalesce("next", "root").alias("root")))
        if longer.join(step.withColumnRenamed("root", "was"), "slug").where("root <> was").isEmpty():
            break
        step = longer
    return step


def company_index(mentions: DataFrame, stories: DataFrame) -> DataFrame:
    """``mentions(slug, name, link)`` x ``stories(link, source, published_at)`` -> one record per company."""
    own = mentions.dropDuplicates(["slug", "link"]).join(stories, "link")
    newest = F.max(F.struct("published_at", "link", "name"))
    return own.groupBy("slug").agg(newest["name"].alias("name"), F.count(F.lit(1)).alias("stories"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"), F.countDistinct("source").alias("outlets"))


def top_topics(mentions: DataFrame, tags: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` most frequent labels of each company, the fallback label left out."""
    counts = mentions.select("slug", "link").distinct().join(tags, "link").where(F.col("tag") != rules.FALLBACK_TAG).groupBy("slug", "tag").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counts, ["slug"], [F.col("n").desc(), F.col("tag")], n)


def related(mentions: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` companies most often in the same stories."""
    return co_occurrence(mentions, "slug", "link", n)


def full_index(articles: DataFrame, names: DataFrame, aliases: DataFrame, junk: list[str], splits: DataFrame | None = None) -> DataFrame:
    """Raw mentions ``names(link, names)`` of admitted articles to index records."""
    scratch = Scratch(articles.sparkSession, "index")
    raw = names.join(articles.select("link", "title", "source"), "link")
    each = scratch.put(raw.select("link", "title", F.explode(sane_names(F.col("names"), junk, F.col("source"))).alias("name")))
    named = scratch.put(canonical(each, aliases, splits).where(F.col("slug") != ""))
    real = named.join(investors(named), "slug", "left_anti")
    merged = prefix_merges(real.select("slug").distinct())
    placed = real.join(merged, "slug", "left").withColumn("slug", F.coalesce("root", "slug")).drop("root")
    return company_index(placed, articles.select("link", "source", "published_at"))


def attach_companies(rounds: DataFrame, mentions: DataFrame, investor_slugs: DataFrame | None = None, slack: int = 12) -> DataFrame:
    """Each round with the company that raised it, or none.

    A named raiser takes the company of the same form, or one whose form it extends by at most ``slack``
    characters; a raiser that fits none leaves the round without a company. Without a named raiser the
    company mentioned first in the headline, investors' places apart, is taken.
    """
    pool = mentions.select("link", F.col("slug").alias("c_slug"), F.col("name").alias("c_name")).distinct()
    pool = pool.join(investor_slugs.withColumnRenamed("slug", "c_slug"), "c_slug", "left_anti") if investor_slugs is not None else pool
    a, b = text.party_form(F.col("raiser")), text.party_form(F.col("c_name"))
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    at = F.instr(F.lower("title"), F.lower("c_name"))
    seat = F.exists(investor_positions(F.col("title")), lambda p: F.abs(p - (at - 1)) <= 2) & (at > 0)
    named = F.coalesce(F.col("raiser"), F.lit("")) != ""
    order = F.when(named & (a == b), 0).when(named & (F.length(short) >= 4) & long.startswith(short) & (F.length(long) - F.length(short) <= slack), 1).when(~named & ~seat & (at > 0), 2).when(~named & ~seat, 3)
    cand = rounds.select("link", "title", "raiser").hint("merge").join(pool.hint("merge"), "link").withColumn("p", order).where(F.col("p").isNotNull()).withColumn("at", at)
    best = cand.withColumn("r", F.row_number().over(Window.partitionBy("link").orderBy("p", "at", "c_slug"))).where("r = 1").select("link", F.col("c_slug").alias("slug"), F.col("c_name").alias("company"))
    return rounds.drop("slug", "company").join(best, "link", "left")


def unlinked_company(raiser: Column, title: Column) -> Column:
    """A name to print where no company is linked: the reader's, else the headline before its raise verb."""
    head = F.trim(F.element_at(F.split(title, r"(?i)\s+(?:raises?|raised|secures?|lands?|closes?|bags?|nabs?|gets?)\b", 2), 1))
    return F.when(text.looks_like_name(raiser) & (F.length(raiser) <= 32), raiser).when((head != title) & (F.length(head) <= 40) & text.looks_like_name(head), head).otherwise("")


def resolve_party(deals: DataFrame, index: DataFrame, party: str) -> DataFrame:
    """A deal's party joined to the first company of the same form, as ``<party>_slug``."""
    by = Window.partitionBy("__f").orderBy(F.col("stories").desc(), "slug")
    forms = index.select(text.party_form(F.col("name")).alias("__f"), "slug", "stories").where("__f <> ''").withColumn("__r", F.row_number().over(by)).where("__r = 1").select("__f", F.col("slug").alias(f"{party}_slug"))
    return deals.join(forms, text.party_form(F.col(party)) == F.col("__f"), "left").drop("__f")


def linkable(name: Column, ambiguous: list[str]) -> Column:
    """A name that can be linked in prose: three letters at least, not ambiguous, no short lower-case word."""
    return (F.length(name) >= 3) & ~F.lower(name).isin(ambiguous) & ~((F.lower(name) == name) & (F.length(name) < 6))
