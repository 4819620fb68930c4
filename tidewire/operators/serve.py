"""Filters, sorts, exports, upserts and snapshot differences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.functions import dates, rules, text
from tidewire.storage import Scratch

# ---- filters and sorts ----


def search_wire(articles: DataFrame, tags: list[str] | None = None, query: str = "") -> DataFrame:
    """Stories with any of the labels and the words in title or summary, case ignored; empty choices keep all."""
    q = query.strip().lower()
    hit = F.lower(F.coalesce("title", F.lit(""))).contains(q) | F.lower(F.coalesce("summary", F.lit(""))).contains(q)
    out = articles.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))) if tags else articles
    return out.where(hit) if q else out


def search_names(companies: DataFrame, query: str) -> DataFrame:
    """Companies whose name contains the words, case ignored."""
    return companies.where(F.lower("name").contains(query.strip().lower())) if query.strip() else companies


def filter_stage(rounds: DataFrame, stages: list[str], known: list[str] | None = None) -> DataFrame:
    """Rounds of the chosen stages; unknown choices are ignored, no choice keeps all."""
    chosen = [s for s in stages if s in (known or [n for n, _ in rules.STAGES])]
    return rounds.where(F.col("stage").isin(chosen)) if chosen else rounds


def sort_companies(companies: DataFrame, by: str = "stories") -> DataFrame:
    """By ``alpha`` (case and accents ignored), ``stories`` or ``recent``."""
    name = F.collate(F.col("name"), "UNICODE_CI_AI")
    return companies.orderBy(*{"alpha": [name.asc(), F.col("slug")], "stories": [F.col("stories").desc(), F.col("last_seen").desc(), name, F.col("slug")], "recent": [F.col("last_seen").desc(), name, F.col("slug")]}[by])


def sort_deals(rows: DataFrame, by: str, ascending: bool = False, tie: str = "pos") -> DataFrame:
    """By amount or date; blanks come last both ways, ties keep the served order."""
    return rows.orderBy(F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last(), tie)


def newest(articles: DataFrame, cap: int = rules.WIRE_CAP) -> DataFrame:
    """The newest ``cap`` stories."""
    return articles.orderBy(F.col("published_at").desc(), "link").limit(cap)


# ---- exports ----


def rounds_export(rounds: DataFrame) -> DataFrame:
    """Eleven flat columns, one builder for CSV and JSON."""
    return rounds.select(F.date_format("published_at", "yyyy-MM-dd").alias("date"), text.csv_guard(F.coalesce("company", F.lit(""))).alias("company"), F.coalesce("slug", F.lit("")).alias("company_slug"), text.round3(F.col("amount_m")).alias("amount_usd_m"), text.round3(F.col("native_m")).alias("amount_native_m"), "currency", text.csv_guard(F.coalesce("stage", F.lit(""))).alias("stage"), text.csv_guard(F.coalesce("lead", F.lit(""))).alias("lead_investor"), text.csv_guard(F.col("title")).alias("headline"), text.csv_guard(F.col("source")).alias("source"), F.col("link").cast("string").alias("url"))


def deals_export(deals: DataFrame) -> DataFrame:
    """Fourteen columns; an undisclosed price is empty, never 0."""
    priced = F.col("amount_m").isNotNull() & (F.col("amount_m") > 0)
    return deals.select(F.date_format("published_at", "yyyy-MM-dd").alias("date"), text.csv_guard(F.col("acquirer")).alias("acquirer"), F.coalesce("acquirer_slug", F.lit("")).alias("acquirer_slug"), text.csv_guard(F.col("target")).alias("target"), F.coalesce("target_slug", F.lit("")).alias("target_slug"), text.csv_guard(F.coalesce("seller", F.lit(""))).alias("seller"), "type", F.when(priced, text.round3(F.col("amount_m"))).alias("amount_usd_m"), F.when(priced, F.col("currency")).alias("currency"), F.when(priced, "yes").otherwise("no").alias("price_disclosed"), text.csv_guard(F.col("title")).alias("headline"), text.csv_guard(F.col("source")).alias("source"), F.col("link").cast("string").alias("url"), F.array_join("also_reported_by", "; ").alias("also_reported_by"))


def export_metadata(rows: DataFrame, amount: str = "amount_usd_m") -> DataFrame:
    """Rows, priced rows, disclosed total and the dates covered."""
    return rows.agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col(amount) > 0).alias("priced"), F.coalesce(F.sum(F.col(amount).cast("decimal(18,3)")), F.lit(0)).cast("double").alias("disclosed_usd_m"), F.min("date").alias("from_date"), F.max("date").alias("to_date"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def index_lists(lists: DataFrame, per_part: int = 1000) -> DataFrame:
    """``lists(slug, list, rank, value)`` -> ``(slug, list, part, entries)``: the lists of a record in parts of about ``per_part``
    entries, each sorted by rank and value, so that no row and no task holds all links of a large company."""
    size = lists.groupBy("slug", "list").agg(F.ceil(F.count(F.lit(1)) / per_part).alias("__parts"))
    dealt = lists.hint("merge").join(size.hint("merge"), ["slug", "list"])
    part = F.pmod(F.xxhash64("value", "rank"), F.col("__parts")).cast("int").alias("part")
    return dealt.groupBy("slug", "list", part).agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("entries"))


def write_index(companies: DataFrame, mentions: DataFrame, topics: DataFrame, relations: DataFrame, path: str) -> None:
    """Company records, newest activity first, and their lists in parts (``index_lists``): two JSON tables."""
    top = topics.select("slug", F.lit("topics").alias("list"), F.col("rank").cast("long").alias("rank"), F.col("tag").cast("string").alias("value"))
    near = relations.select(F.col("item").alias("slug"), F.lit("related").alias("list"), F.col("rank").cast("long").alias("rank"), F.col("other").cast("string").alias("value"))
    told = mentions.select("slug", F.lit("articles").alias("list"), F.lit(0).cast("long").alias("rank"), F.col("link").cast("string").alias("value"))
    companies.orderBy(F.col("last_seen").desc(), "slug").write.mode("overwrite").json(f"{path}/companies")
    index_lists(top.unionByName(near).unionByName(told)).write.mode("overwrite").json(f"{path}/lists")


def funding_feed(rounds: DataFrame, n: int = 40) -> DataFrame:
    """The newest ``n`` rounds with a subject; identity is who, how much and in which month."""
    who = F.coalesce(F.nullif(F.col("company"), F.lit("")), F.col("subject"))
    guid = F.concat_ws("-", text.url_slug(who), F.floor(F.col("amount_m") * 10 + 0.5).cast("string"), dates.month_key(F.col("published_at")))
    return rounds.withColumn("subject_name", who).where(F.coalesce("subject_name", F.lit("")) != "").withColumn("guid", guid).orderBy(F.col("published_at").desc(), "link").limit(n)


def deal_feed(deals: DataFrame, n: int = 30) -> DataFrame:
    """The newest ``n`` deals; identity is the two parties, so a second report is no new item."""
    return deals.withColumn("guid", F.concat_ws("-", text.url_slug(F.col("acquirer")), text.url_slug(F.col("target")))).orderBy(F.col("published_at").desc(), "link").limit(n)


def brief_feed(briefs: DataFrame, n: int = 30) -> DataFrame:
    """The newest ``n`` briefs."""
    return briefs.withColumn("guid", F.concat(F.lit("brief-"), F.date_format("date", "yyyy-MM-dd"))).orderBy(F.col("date").desc()).limit(n)


def url_table(pages: dict[str, tuple[DataFrame, str, float, str]]) -> DataFrame:
    """One row per page: ``kind -> (DataFrame(slug, lastmod), path prefix, priority, change frequency)``."""
    out = None
    for kind, (df, prefix, priority, freq) in pages.items():
        rows = df.select(F.concat(F.lit(prefix), F.col("slug"), F.lit("/")).alias("url"), F.lit(kind).alias("kind"), F.col("lastmod"), F.lit(priority).alias("priority"), F.lit(freq).alias("changefreq"))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- state ----


def upsert_store(stored: DataFrame, incoming: DataFrame, run_at: Column) -> DataFrame:
    """New links added with ``first_seen``, known ones refreshed; rows that were there before keep theirs, unset too.

    Columns that only the store has, other writers' work, are carried through (null for new links); columns that
    only ``incoming`` has are new to the store.
    """
    fresh = [c for c in incoming.columns if c not in ("link", "first_seen")]
    kept = [c for c in stored.columns if c not in ("link", "first_seen", *fresh)]
    shared = [c for c in fresh if c in stored.columns]
    old = stored.select("link", F.lit(True).alias("__old"), F.col("first_seen").alias("__seen"), *[F.col(c).alias(f"__{c}") for c in (*shared, *kept)])
    both = incoming.select("link", F.lit(True).alias("__new"), *fresh).join(old, "link", "full_outer")
    now = [F.when(F.col("__new"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) if c in shared else F.col(c) for c in fresh]
    seen = F.when(F.col("__old"), F.col("__seen")).otherwise(run_at).alias("first_seen")
    return both.select("link", *now, *[F.col(f"__{c}").alias(c) for c in kept], seen)


def append_verdicts(facts: DataFrame, verdicts: DataFrame, key: str = "link") -> DataFrame:
    """The cache of verdicts with new ones: the higher version of a key stays, of equal ones the new. Negative
    verdicts are rows too, so nothing is asked twice."""
    new = verdicts.withColumn("__new", F.lit(1))
    both = facts.withColumn("__new", F.lit(0)).unionByName(new, allowMissingColumns=True)
    best = both.groupBy(key).agg(F.max(F.struct("pv", "__new")).alias("__b"))
    joined = both.join(best, key).where((F.col("pv") == F.col("__b.pv")) & (F.col("__new") == F.col("__b.__new")))
    return joined.dropDuplicates([key]).drop("__b", "__new")


def prune(cache: DataFrame, live: DataFrame, key: str = "link") -> DataFrame:
    """Cache rows whose key is still alive."""
    return cache.join(live.select(key).distinct(), key, "left_semi")


def changed_urls(before: DataFrame, after: DataFrame, cap: int = 10_000) -> DataFrame:
    """Addresses of files that were added, changed or deleted between two snapshots ``(path, content)``."""
    side = lambda df, h: df.select("path", F.xxhash64("content").alias(h))
    diff = side(before, "a").join(side(after, "b"), "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").otherwise("changed")
    return diff.select(F.regexp_replace("path", r"(?:^|/)index\.html$", "/").alias("url"), kind.alias("change")).distinct().orderBy("url").limit(cap)


def upsert_brief(briefs: DataFrame, new: DataFrame, author: str) -> DataFrame:
    """One brief per date: an accepted author's brief replaces its date's; the same prose stays as filed."""
    accepted = new.where(F.col("by") == author)
    same = accepted.join(briefs.select("date", F.col("headline").alias("h"), F.col("whats_happening").alias("w")), "date").where((F.col("h") == F.col("headline")) & (F.col("w") == F.col("whats_happening"))).select("date")
    fresh = accepted.join(same, "date", "left_anti")
    return briefs.join(fresh.select("date"), "date", "left_anti").unionByName(fresh).orderBy(F.col("date").desc())


def needs_refresh(pv: Column, cached_pv: Column, n: Column, was: Column, known: Column, tries: Column, most: int = 3) -> Column:
    """Rewrite when the version moved, a declined text may be tried again, or the evidence has grown a quarter and eight."""
    grown = n >= F.greatest(F.ceil(was * 1.25), was + 8)
    return F.coalesce((pv != cached_pv) | (~known & (tries < most)) | grown, F.lit(True))


def merge_rewrite(cached: DataFrame, rewritten: DataFrame, pv: int, most: int = 3) -> DataFrame:
    """A failed rewrite keeps the published text and counts a try; the version is stamped after ``most`` tries."""
    r = rewritten.select("slug", F.col("known").alias("r_known"), F.col("summary").alias("r_summary"), F.col("n").alias("r_n"))
    both = cached.join(r, "slug", "full_outer")
    good, tried = F.coalesce("r_known", F.lit(False)), F.col("r_n").isNotNull()
    tries = F.when(good, 0).when(tried, F.coalesce("tries", F.lit(0)) + 1).otherwise(F.coalesce("tries", F.lit(0)))
    return both.select("slug", (good | F.coalesce("known", F.lit(False))).alias("known"), F.when(good, F.col("r_summary")).otherwise(F.col("summary")).alias("summary"), F.coalesce("r_n", "n").alias("n"), tries.cast("int").alias("tries"), F.when(good | (tried & (tries >= most)), F.lit(pv)).otherwise(F.col("pv")).alias("pv"))


# ---- links in prose ----


def _fold(text: str) -> str:
    """Lower case, letter for letter."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _scan_terms(terms, page_type: pa.DataType, para_type: pa.DataType):
    """One scan a paragraph with an automaton of all terms: whole-word matches ``(page, para, start, end, target)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        meant: dict[str, list[tuple]] = {}
        for term, target, exact, stem in terms.value:
            meant.setdefault(_fold(term), []).append((term, target, exact, stem))
        for word in meant:
            if word:
                found.add_word(word, word)
        if len(found):
            found.make_automaton()
        schema = pa.schema([("page", page_type), ("para", para_type), ("start", pa.int32()), ("end", pa.int32()), ("target", pa.string())])
        inside = lambda c: c.isalnum() or c == "_"
        for b in batches:
            rows = []
            for page, para, body in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for last, word in found.iter(_fold(body)) if body and len(found) else ():
                    start, end = last + 1 - len(word), last + 1
                    if start and inside(body[start - 1]):
                        continue
                    whole = end == len(body) or not inside(body[end])
                    for term, target, exact, stem in meant[word]:
                        if exact and body[start:end] != term or not (whole or stem):
                            continue
                        to = end
                        while stem and to < len(body) and inside(body[to]):
                            to += 1
                        rows.append((page, para, start, to, target))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 5, schema, strict=True)], schema=schema)

    return run


def _budgets(per_paragraph: int, per_page: int):
    """Matches sorted by page, paragraph, start and length -> those that become links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, para, used, here, free = (), None, set(), 0, 0
        for b in batches:
            keep = []
            for i, row in enumerate(zip(*[c.to_pylist() for c in b.columns], strict=True)):
                if page != (row[0],):
                    page, para, used = (row[0],), None, set()
                if (row[1],) != para:
                    para, here, free = (row[1],), 0, 0
                if len(used) < per_page and here < per_paragraph and row[2] >= free and row[4] not in used:
                    used.add(row[4])
                    here, free = here + 1, row[3]
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    return run


def link_spans(paragraphs: DataFrame, terms: DataFrame, per_paragraph: int = 2, per_page: int = 6, terms_at_once: int = 200_000) -> DataFrame:
    """``paragraphs(page, para, body)`` x ``terms(term, target)`` -> ``(page, para, start, end, target)``.

    Earliest match, then the longest; each target once a page; whole words; budgets by paragraph and page. Terms may have
    ``exact`` (case counts, for names of companies) and ``stem`` (a match that begins a word grows to its end).
    Every paragraph is scanned once by an Aho-Corasick automaton of the terms, ``terms_at_once`` of them; more terms take
    more scans. A page's matches pass its budgets as a sorted stream.
    """
    spark = paragraphs.sparkSession
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in terms.columns else F.lit(False)
    known = Scratch(spark, "terms").put(terms.where("term is not null").select("term", F.col("target").cast("string").alias("target"), flag("exact").alias("exact"), flag("stem").alias("stem")))
    blocks = max(1, -(-known.count() // terms_at_once))
    rows = paragraphs.select("page", "para", "body")
    page, para = (rows.schema[c].dataType for c in ("page", "para"))
    kinds = f"page {page.simpleString()}, para {para.simpleString()}, start int, end int, target string"
    found = []
    for i in range(blocks):
        some = [tuple(r) for r in known.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i).toLocalIterator()]
        found.append(rows.mapInArrow(_scan_terms(spark.sparkContext.broadcast(some), to_arrow_type(page), to_arrow_type(para)), kinds))
    order = ["page", "para", "start", F.col("end").desc(), "target"]
    return reduce(DataFrame.union, found).repartition("page").sortWithinPartitions(*order).mapInArrow(_budgets(per_paragraph, per_page), kinds)


def with_previous(rows: DataFrame, order: list[Column], col: str) -> DataFrame:
    """Each row with its neighbours in order, for a few hundred rows of an index."""
    by = Window.orderBy(*order)
    return rows.withColumn("previous", F.lag(col).over(by)).withColumn("next", F.lead(col).over(by))
