"""Aggregates over rounds, deals and stories.

Rounds have ``link, slug, amount_m, stage, lead, currency, source, published_at``. Amounts are summed as
decimals, so totals do not depend on the order in which partitions arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import dates, rules
from tidewire.storage import Scratch


def total(amount: Column) -> Column:
    """Order-independent sum, as double."""
    return F.coalesce(F.sum(amount.cast("decimal(18,6)")), F.lit(0).cast("decimal(28,6)")).cast("double")


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves up."""
    return F.floor(x + 0.5).cast("long")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; pruned before the shuffle (window group limit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def company_totals(rounds: DataFrame) -> DataFrame:
    """Capital, rounds, latest round and latest named stage of each company."""
    newest = F.struct("published_at", F.col("link").cast("string").alias("link"))
    staged = F.coalesce(F.col("stage"), F.lit("")) != ""
    return rounds.where(F.col("slug").isNotNull()).groupBy("slug").agg(
        total(F.col("amount_m")).alias("total_m"),
        F.count(F.lit(1)).alias("rounds"),
        F.max(newest)["published_at"].alias("latest_at"),
        F.max(newest)["link"].alias("latest_link"),
        F.max(F.when(staged, F.struct("published_at", F.col("link").cast("string"), "stage")))["stage"].alias("stage"),
    )


def rank_companies(totals: DataFrame, cap: int = 250) -> DataFrame:
    """The ``cap`` companies with most capital, ties by rounds and name."""
    return totals.orderBy(F.col("total_m").desc(), F.col("rounds").desc(), "slug").limit(cap)


def ranking_summary(totals: DataFrame) -> DataFrame:
    """Capital, rounds, and how many companies raised more than once."""
    return totals.agg(total(F.col("total_m")).alias("total_m"), F.sum("rounds").alias("rounds"), F.count(F.lit(1)).alias("companies"), F.count_if(F.col("rounds") > 1).alias("repeat_companies"))


def period_rollup(rounds: DataFrame, grain: str, as_of: Column | None = None, least: int = 1) -> DataFrame:
    """Rounds, capital, median, largest and open flag of each month, quarter or year."""
    out = rounds.groupBy(dates.KEYS[grain](F.col("published_at")).alias("period")).agg(
        F.count(F.lit(1)).alias("rounds"), total(F.col("amount_m")).alias("total_m"), F.median("amount_m").alias("median_m"), F.max("amount_m").alias("largest_m")
    )
    out = out.where((F.col("rounds") >= least) & F.col("period").isNotNull())
    return out.withColumn("open", dates.is_open(F.col("period"), as_of)) if as_of is not None else out


def all_grains(rounds: DataFrame, least: int = 1) -> DataFrame:
    """``period_rollup`` of months, quarters and years with their ``grain``, in one pass and one shuffle."""
    at = rounds.withColumns({g: dates.KEYS[g](F.col("published_at")) for g in ("month", "quarter", "year")})
    sets = at.groupingSets([["month"], ["quarter"], ["year"]], "month", "quarter", "year")
    out = sets.agg(
        F.grouping_id().alias("__g"), F.count(F.lit(1)).alias("rounds"), total(F.col("amount_m")).alias("total_m"), F.median("amount_m").alias("median_m"), F.max("amount_m").alias("largest_m")
    )
    # a bit of the id is set for every column that is not grouped by
    grain = F.when(F.col("__g") == 0b011, "month").when(F.col("__g") == 0b101, "quarter").otherwise("year")
    named = out.select(grain.alias("grain"), F.coalesce("month", "quarter", "year").alias("period"), "rounds", "total_m", "median_m", "largest_m")
    return named.where((F.col("rounds") >= least) & F.col("period").isNotNull())


def period_change(periods: DataFrame) -> DataFrame:
    """Each period against the one before: percentage in total (null from nothing), difference in rounds."""
    by = Window.orderBy("period")
    was = F.lag("total_m").over(by)
    return periods.select("period", "rounds", "total_m", F.lag("period").over(by).alias("previous"), F.lead("period").over(by).alias("next"), F.when(was > 0, half_up((F.col("total_m") - was) / was * 100)).alias("total_pct"), (F.col("rounds") - F.lag("rounds").over(by)).alias("rounds_diff"))


def size_bands(rounds: DataFrame, bands=rules.SIZE_BANDS) -> DataFrame:
    """Rounds and capital by size band with whole-percent shares; empty bands are left out."""
    band = None
    for i, (name, lo, hi) in enumerate(bands):
        hit = (F.col("amount_m") >= lo) & (F.col("amount_m") < hi)
        band = F.when(hit, F.struct(F.lit(i).alias("ord"), F.lit(name).alias("band"))) if band is None else band.when(hit, F.struct(F.lit(i).alias("ord"), F.lit(name).alias("band")))
    found = rounds.withColumn("b", band).where(F.col("b").isNotNull()).groupBy("b.ord", "b.band").agg(F.count(F.lit(1)).alias("rounds"), total(F.col("amount_m")).alias("total_m"))
    whole = Window.partitionBy()
    return found.select("ord", "band", "rounds", "total_m", half_up(F.col("rounds") * 100 / F.sum("rounds").over(whole)).alias("rounds_pct"), half_up(F.col("total_m") * 100 / F.sum("total_m").over(whole)).alias("total_pct"))


def stage_ladder(rounds: DataFrame, least: int = rules.LADDER_FLOOR) -> DataFrame:
    """Rounds, median, mean and capital by named stage, for stages with ``least`` rounds."""
    named = rounds.where(F.coalesce(F.col("stage"), F.lit("")) != "")
    out = named.groupBy("stage").agg(F.count(F.lit(1)).alias("rounds"), F.median("amount_m").alias("median_m"), total(F.col("amount_m")).alias("total_m"))
    return out.where(F.col("rounds") >= least).withColumn("mean_m", F.col("total_m") / F.col("rounds"))


def field_coverage(rounds: DataFrame) -> DataFrame:
    """For every field how many rounds have it, in long form."""
    full = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    one = rounds.agg(F.count(F.lit(1)).alias("n"), full("slug").alias("company"), full("stage").alias("stage"), full("lead").alias("lead"), F.count_if(F.col("currency") != "USD").alias("converted"))
    return one.selectExpr("stack(4, 'company', company, 'stage', stage, 'lead', lead, 'converted', converted) as (field, filled)", "n").withColumn("pct", F.when(F.col("n") > 0, half_up(F.col("filled") * 100 / F.col("n"))).otherwise(0))


def ytd_compare(rounds: DataFrame, as_of: str, least: int = rules.YTD_FLOOR) -> DataFrame:
    """This year up to ``as_of``'s month and day against the same span last year; no row below the floor."""
    day, year = F.lit(as_of).cast("date"), F.year(F.lit(as_of).cast("date"))
    upto = F.date_format("published_at", "MM-dd") <= F.date_format(day, "MM-dd")
    side = lambda y: upto & (F.year("published_at") == y)
    one = rounds.agg(
        *[f.alias(f"{n}_{w}") for w, y in (("now", year), ("was", year - 1)) for n, f in (("rounds", F.count_if(side(y))), ("total_m", total(F.when(side(y), F.col("amount_m")))), ("median_m", F.median(F.when(side(y), F.col("amount_m")))))],
        F.min("published_at").alias("first"),
    )
    pct = lambda n: F.when(F.col(f"{n}_was") > 0, half_up((F.col(f"{n}_now") - F.col(f"{n}_was")) / F.col(f"{n}_was") * 100)).alias(f"{n}_pct")
    covered = F.to_date("first") <= F.make_date(year - 1, F.lit(1), F.lit(1))
    return one.where((F.col("rounds_now") >= least) & (F.col("rounds_was") >= least) & covered).select("rounds_now", "rounds_was", "total_m_now", "total_m_was", pct("rounds"), pct("total_m"))


def funding_summary(rounds: DataFrame) -> DataFrame:
    """One row: rounds, capital, median, largest round and its company."""
    big = F.max(F.struct("amount_m", F.col("link").cast("string").alias("link"), "slug"))
    return rounds.agg(F.count(F.lit(1)).alias("rounds"), total(F.col("amount_m")).alias("total_m"), F.median("amount_m").alias("median_m"), big["amount_m"].alias("largest_m"), big["link"].alias("largest_link"))


def calendar_spine(rounds: DataFrame) -> DataFrame:
    """Every month between the first and the last round, gaps as zeros."""
    ends = rounds.agg(F.min("published_at").alias("a"), F.max("published_at").alias("b")).where(F.col("a").isNotNull())
    months = ends.select(F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("period"))
    made = period_rollup(rounds, "month").select("period", "rounds", "total_m")
    return months.hint("shuffle_hash").join(made, "period", "left").select("period", F.coalesce("rounds", F.lit(0)).alias("rounds"), F.coalesce("total_m", F.lit(0.0)).alias("total_m"))


def calendar_grid(rounds: DataFrame, grain: str = "month") -> DataFrame:
    """Every month or quarter of the years covered, with ``state``: data, gap, or outside the first and last period."""
    step = {"month": "interval 1 month", "quarter": "interval 3 months"}[grain]
    ends = rounds.agg(F.min("published_at").alias("a"), F.max("published_at").alias("b")).where(F.col("a").isNotNull())
    days = F.sequence(F.trunc("a", "year"), F.to_date(F.make_date(F.year("b"), F.lit(12), F.lit(31))), F.expr(step))
    key = dates.KEYS[grain]
    cells = ends.select(key(F.col("a")).alias("first"), key(F.col("b")).alias("last"), F.explode(days).alias("d")).select("first", "last", key(F.col("d")).alias("period"))
    made = period_rollup(rounds, grain).select("period", "rounds", "total_m")
    state = F.when(~F.col("period").between(F.col("first"), F.col("last")), "outside").when(F.col("rounds").isNull(), "gap").otherwise("data")
    return cells.hint("shuffle_hash").join(made, "period", "left").select("period", state.alias("state"), F.coalesce("rounds", F.lit(0)).alias("rounds"), F.coalesce("total_m", F.lit(0.0)).alias("total_m"))


def split_by_period(rounds: DataFrame, grain: str, as_of: Column, least: int, periods: int = 2) -> DataFrame:
    """The periods with ``least`` rounds, where there are ``periods`` of them, and why one is not whole: it holds
    ``as_of`` (open), or begins before the first round (truncated)."""
    made = period_rollup(rounds, grain, as_of, least)
    bounds = rounds.agg(F.min("published_at").alias("first"))  # one row
    full = made.join(F.broadcast(bounds), F.lit(True)).join(F.broadcast(made.agg(F.count(F.lit(1)).alias("k"))), F.col("k") >= periods)
    why = F.when(F.col("open"), "open").when(dates.is_truncated(F.col("period"), F.col("first")), "truncated").otherwise("")
    return full.select("period", "rounds", "total_m", "median_m", "largest_m", why.alias("partial"))


def group_rollup(members: DataFrame, stories: DataFrame, rounds: DataFrame, group: str, floor_companies: int = 1, floor_stories: int = 1) -> DataFrame:
    """Companies, distinct stories, rounds, capital and largest round of each market or sector.

    ``members(group, slug)``, ``stories(slug, link)``, ``rounds(slug, amount_m)``. Rounds are summed by
    company before the join, so a company in several groups counts in each and no row is multiplied.
    """
    member = members.select(group, "slug").where(F.col(group).isNotNull()).distinct()
    told = member.join(stories.select("slug", "link").distinct(), "slug").groupBy(group).agg(F.countDistinct("link").alias("stories"))
    per = rounds.groupBy("slug").agg(F.count(F.lit(1)).alias("r"), F.sum(F.col("amount_m").cast("decimal(18,6)")).alias("t"), F.max("amount_m").alias("m"))
    money = member.join(per, "slug", "left").groupBy(group).agg(F.count(F.lit(1)).alias("companies"), F.coalesce(F.sum("r"), F.lit(0)).alias("rounds"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("total_m"), F.max("m").alias("largest_m"))
    out = money.join(told, group, "left").withColumn("stories", F.coalesce("stories", F.lit(0)))
    return out.where((F.col("companies") >= floor_companies) & (F.col("stories") >= floor_stories)).select(group, "companies", "stories", "rounds", "total_m", "largest_m")


def mix(members: DataFrame, group: str, kind: str, n: int = 3) -> DataFrame:
    """The ``n`` most frequent kinds of each group."""
    counts = members.groupBy(group, kind).agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counts, [group], [F.col("n").desc(), F.col(kind)], n)


def label_rollup(stories: DataFrame, label: str = "tag") -> DataFrame:
    """Stories, outlets, first and last date of each label; ``stories`` has one row per story and label."""
    return stories.groupBy(label).agg(F.countDistinct("link").alias("stories"), F.countDistinct("source").alias("outlets"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))


def co_occurrence(rows: DataFrame, item: str, on: str, n: int, same: Column | None = None, rows_a_task: int = 500_000) -> DataFrame:
    """The ``n`` items most often found on the same ``on`` as each item.

    Partners are counted per pair before ranking. The join key is a story, whose items are few. The tasks that join and count
    grow with the rows, ``rows_a_task`` each, so that what one of them holds does not.
    """
    left, count = Scratch(rows.sparkSession, "together").put_counted(rows.select(F.col(on), F.col(item).alias("item")).distinct())
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // rows_a_task))
    left = left.repartition(parts, on)
    right = left.withColumnRenamed("item", "other")
    met = left.hint("merge").join(right.hint("merge"), on).where(F.col("item") != F.col("other"))
    pairs = met.repartition(parts, "item", "other").groupBy("item", "other").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(pairs, ["item"], [F.col("n").desc(), F.col("other")], n)


def ma_summary(deals: DataFrame) -> DataFrame:
    """Deals, acquirers, priced deals and disclosed capital."""
    return deals.agg(F.count(F.lit(1)).alias("deals"), F.countDistinct("acquirer").alias("acquirers"), F.count("amount_m").alias("priced"), total(F.col("amount_m")).alias("disclosed_m"))


def ma_months(deals: DataFrame, least_months: int = 2) -> DataFrame:
    """Deals by month, when there are at least ``least_months`` months."""
    months = deals.where(F.col("published_at").isNotNull()).groupBy(dates.month_key(F.col("published_at")).alias("period")).agg(F.count(F.lit(1)).alias("deals"), F.count("amount_m").alias("priced"), total(F.col("amount_m")).alias("disclosed_m"))
    return months.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy())).where(F.col("k") >= least_months).drop("k")


def deal_sides(deals: DataFrame) -> DataFrame:
    """One row per deal and party: a deal is listed under its acquirer and its target."""
    return deals.select("link", "amount_m", "published_at", F.explode(F.array(F.struct(F.col("acquirer").alias("party"), F.lit("acquirer").alias("side")), F.struct(F.col("target").alias("party"), F.lit("target").alias("side")))).alias("p")).select("link", "p.party", "p.side", "amount_m", "published_at")


def page_gate(companies: DataFrame, funded: DataFrame, profiled: DataFrame, dealt: DataFrame, stories: int = rules.COMPANY_PAGE_STORIES) -> DataFrame:
    """Which companies get a page, and by which doors: enough stories, a round, a profile, a deal."""
    flag = lambda df, c: df.select("slug").distinct().withColumn(c, F.lit(True))
    out = companies.join(flag(funded, "funded"), "slug", "left").join(flag(profiled, "profiled"), "slug", "left").join(flag(dealt, "dealt"), "slug", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("funded", "profiled", "dealt")}).withColumn("covered", F.col("stories") >= stories)
    return out.withColumn("indexable", F.col("covered") | F.col("funded") | F.col("profiled") | F.col("dealt"))


def gate_accounting(gated: DataFrame) -> DataFrame:
    """How many pages there are, and how many through one door alone."""
    doors = ["covered", "funded", "profiled", "dealt"]
    count = sum((F.col(d).cast("int") for d in doors[1:]), F.col(doors[0]).cast("int"))
    return gated.agg(F.count_if("indexable").alias("pages"), *[F.count_if(F.col(d) & (count == 1)).alias(f"only_{d}") for d in doors])


def resolve_rounds(reports: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row per cluster of reports of a round.

    The figure most often reported wins (tenths of a million, ties to the smaller); the row is its earliest
    report; other outlets are gathered; stage and lead are the newest ones named.
    """
    bucket = F.floor(F.col("amount_m") * 10 + 0.5)
    counted = reports.withColumn("__b", bucket).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(cluster, "__b")))
    best = F.struct((-F.col("__n")).alias("n"), F.col("__b").alias("b"), F.col("published_at").alias("at"), F.col("link").alias("link"), F.col("amount_m").alias("amount_m"), F.col("source").alias("source"))
    newest = lambda c: F.max(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("published_at", "link", c)))[c].alias(c)
    out = counted.groupBy(cluster).agg(F.min(best).alias("r"), F.collect_set("source").alias("outlets"), F.count(F.lit(1)).alias("reports"), newest("stage"), newest("lead"))
    return out.select(cluster, "r.link", "r.amount_m", "r.source", F.col("r.at").alias("published_at"), "stage", "lead", "reports", F.array_sort(F.array_except("outlets", F.array("r.source"))).alias("also_reported_by"))


def index_summary(mentions: DataFrame, accepted: DataFrame, demoted: DataFrame) -> DataFrame:
    """Stories by the way their names were read, names rejected and companies demoted, in long form."""
    by = mentions.groupBy(F.concat(F.lit("by:"), F.col("by")).alias("measure")).agg(F.count(F.lit(1)).alias("n"))
    rejected = mentions.join(accepted.select("link"), "link", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("measure"), "n")
    return by.unionByName(rejected).unionByName(demoted.agg(F.count(F.lit(1)).alias("n")).select(F.lit("demoted").alias("measure"), "n"))


def index_totals(groups: DataFrame) -> DataFrame:
    """Memberships, stories and capital added up over groups; what is in several counts in each."""
    return groups.agg(F.sum("companies").alias("memberships"), F.sum("stories").alias("stories"), F.sum("rounds").alias("rounds"), total(F.col("total_m")).alias("total_m"))


def siblings(terms: DataFrame, n: int = 6) -> DataFrame:
    """Other terms of the same label in list order: ``terms(ord, slug, label)``.

    Only the first ``n + 1`` of a label can be among anyone's first ``n`` others, so a label is never paired in full.
    """
    first = top_per_group(terms, ["label"], [F.col("ord"), F.col("slug")], n + 1)
    other = first.select(F.col("slug").alias("other"), F.col("ord").alias("o"), "label")
    pairs = terms.select("slug", "label").join(other, "label").where("slug <> other")
    return top_per_group(pairs, ["slug"], [F.col("o"), F.col("other")], n).select("slug", "other", "rank")
