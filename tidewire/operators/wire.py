"""The wire: prominence, threads folded to heads, the lead, windows and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import dates, rules
from tidewire.operators.ranges import rank_in_groups, running
from tidewire.sources import feeds
from tidewire.storage import Scratch


def prominence(articles: DataFrame, neighbours: DataFrame, as_of: Column, group: str = "same") -> DataFrame:
    """``score``: 2.5 recency + 1.5 corroboration + outlet tier + signal words, three decimals.

    Corroboration counts the outlets among an article and its neighbours, not its thread. Neighbours are all articles of
    its own ``group`` and of those that ``neighbours(a, b)`` pairs it with; an article without a group has none. A group has
    its outlets once, so copies of a headline are not paired with each other.
    """
    scratch = Scratch(articles.sparkSession, "prominence")
    told = scratch.put(articles.where(F.col(group).isNotNull()).select(F.col(group).alias("b"), F.col("source").alias("other")).distinct(), narrow=True)
    pairs = scratch.put(neighbours.select("a", "b"), narrow=True)  # read in both directions
    both = pairs.union(pairs.select(F.col("b"), F.col("a")))  # outlets are a set: a pair may come twice
    heard = both.hint("merge").join(told.hint("merge"), "b").select("a", "other").union(told.select("b", "other"))
    near = heard.groupBy("a").agg(F.collect_set("other").alias("others"))
    out = articles.hint("merge").join(near.hint("merge"), F.col(group) == F.col("a"), "left")
    outlets = F.size(F.array_union(F.array("source"), F.coalesce("others", F.array().cast("array<string>"))))
    tier = F.when(F.col("source").isin(rules.REPUTABLE), 1.0).when(F.col("source").isin(rules.LOW_SIGNAL), -1.2).otherwise(0.0)
    signal = F.least(F.lit(1.0), sum((F.when(F.col("title").rlike(p), w).otherwise(0.0) for p, w in rules.SIGNALS), F.lit(0.0)))
    raw = dates.recency(F.col("published_at"), as_of) * 2.5 + F.least(outlets - 1, F.lit(3)) / 3 * 1.5 + tier + signal
    return out.withColumn("corroborated_by", outlets).withColumn("score", F.floor(raw * 1000 + 0.5) / 1000).drop("a", "others")


def fold_threads(articles: DataFrame, id_col: str = "link") -> DataFrame:
    """One row per thread: head (highest score, then newest), place of its newest story, stories, outlets."""
    key = F.coalesce(F.col("thread").cast("string"), F.concat(F.lit("="), F.col(id_col).cast("string")))
    head = F.max(F.struct("score", "published_at", (-F.col("pos")).alias("p"), F.col(id_col).alias("id"), "title"))
    return articles.withColumn("__k", key).groupBy("__k").agg(head.alias("h"), F.min("pos").alias("pos"), F.count(F.lit(1)).alias("stories"), F.countDistinct("source").alias("outlets")).select(F.col("__k").alias("thread"), F.col("h.id").alias("head"), "h.title", "h.score", "pos", "stories", "outlets", thread_label(F.col("stories"), F.col("outlets")).alias("label"))


def thread_label(stories: Column, outlets: Column) -> Column:
    """``+n more outlets`` where every story is another outlet's, else ``+n more stories``; empty alone."""
    more = F.concat(F.lit("+"), (stories - 1).cast("string"), F.lit(" more "))
    return F.when(stories <= 1, "").otherwise(F.concat(more, F.when(outlets == stories, "outlet").otherwise("stor"), F.when(outlets == stories, F.when(stories > 2, "s").otherwise("")).otherwise(F.when(stories > 2, "ies").otherwise("y"))))


def pick_lead(articles: DataFrame, as_of: Column, hours: tuple[int, ...] = (24, 48, 72)) -> DataFrame:
    """The story of highest score in the first window that has one, else of all; ties to the newest."""
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("published_at")) / 3600
    tier = None
    for i, h in enumerate(hours):
        tier = F.when(age <= h, i) if tier is None else tier.when(age <= h, i)
    return articles.withColumn("tier", tier.otherwise(len(hours))).orderBy("tier", F.col("score").desc(), F.col("published_at").desc(), "link").limit(1)


def top_headlines(articles: DataFrame, as_of: Column, n: int, hours: tuple[int, ...] = (24, 48, 72)) -> DataFrame:
    """Heads of the ``n`` best threads in the first window with ``n`` stories, else in the widest."""
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("published_at")) / 3600
    counts = articles.agg(*[F.count_if(age <= h).alias(f"c{h}") for h in hours])
    span = F.lit(hours[-1])
    for h in reversed(hours[:-1]):
        span = F.when(F.col(f"c{h}") >= n, h).otherwise(span)
    limit = counts.select(span.alias("h"))
    window = articles.withColumn("__age", age).join(F.broadcast(limit), F.col("__age") <= F.col("h")).drop("__age", "h")
    return fold_threads(window).orderBy(F.col("score").desc(), "pos").limit(n)


def sample_evidence(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """Per group the newest half of ``n`` and evenly spaced rows from the rest, titles already distinct."""
    half = (n + 1) // 2
    at = rank_in_groups(rows, group, order, Scratch(rows.sparkSession, "sample"), "rn", "k")
    rest, picks = F.col("k") - half, n - half
    i = F.col("rn") - half - 1
    slot = F.ceil(i * picks / rest)
    even = (i >= 0) & (slot < picks) & (F.floor(slot * rest / picks) == i)
    return at.where((F.col("k") <= n) | (F.col("rn") <= half) | even).drop("rn", "k")


def landed_at(articles: DataFrame, seen: DataFrame, has_store: bool, as_of: Column) -> DataFrame:
    """When a story arrived: now if never stored, else first seen, else its date, else the epoch."""
    known = seen.select("link", F.lit(True).alias("__s"), F.col("first_seen").alias("__f"))
    stored = F.lit(has_store) & F.col("__s").isNotNull()
    return articles.join(known, "link", "left").withColumn("landed_at", F.when(F.lit(has_store) & ~stored, as_of).otherwise(F.coalesce("__f", "published_at", F.timestamp_seconds(F.lit(0))))).drop("__s", "__f")


def brief_window(articles: DataFrame, previous: Column, as_of: Column, least: int = 8, widen: int = 16, days: int = 7) -> DataFrame:
    """Stories since the previous brief with the ``reason`` of the choice.

    The span is cut to ``days`` days; with fewer than ``least`` stories, or without a recent previous brief,
    the newest ``widen`` stories are taken instead.
    """
    floor_ = as_of - F.make_interval(days=F.lit(days))
    since = F.greatest(F.coalesce(previous, floor_), floor_)
    fresh = F.col("landed_at") > since
    count = articles.agg(F.count_if(fresh).alias("__n"))
    newest = articles.orderBy(F.col("landed_at").desc(), "link").limit(widen).select("link", F.lit(True).alias("__new"))
    reason = F.when(previous.isNull(), "no previous brief").when(previous < floor_, "previous brief too old").when(F.col("__n") < least, "too few stories").otherwise("since previous brief")
    at = articles.join(F.broadcast(newest), "link", "left").join(F.broadcast(count), F.lit(True)).withColumn("reason", reason)
    return at.where(F.when(F.col("reason") == "since previous brief", fresh).otherwise(F.coalesce("__new", F.lit(False)))).drop("__n", "__new")


def previous_brief(briefs: DataFrame, day: str, n: int = 1) -> DataFrame:
    """The newest ``n`` briefs before a day."""
    return briefs.where(F.col("date") < F.lit(day).cast("date")).orderBy(F.col("date").desc()).limit(n)


def previous_in_time(asked: DataFrame, briefs: DataFrame, n: int = 3, at: str = "date") -> DataFrame:
    """An as-of join: each row of ``asked`` with the newest ``n`` briefs strictly before its ``at``, as ``back`` (1 is the
    newest) and ``brief``, the brief's own row; rows without any earlier brief have none.

    Both tables are sorted by time together, range by range (a row that asks comes before a brief of its own time), briefs
    get running numbers, and an asking row meets the ``n`` numbers before it. ``at`` of ``briefs`` is distinct.
    """
    scratch = Scratch(asked.sparkSession, "as-of")
    rows = asked.select(F.col(at).alias("at"), F.struct(*asked.columns).alias("asked"), F.lit(None).cast(briefs.select(F.struct(*briefs.columns)).schema[0].dataType).alias("brief"))
    told = briefs.select(F.col(at).alias("at"), F.lit(None).cast(rows.schema["asked"].dataType).alias("asked"), F.struct(*briefs.columns).alias("brief"))
    both = rows.unionByName(told).where("at is not null").withColumn("told", F.col("brief").isNotNull().cast("long"))
    placed = scratch.put(running(both, [F.col("at"), F.col("told"), F.xxhash64("asked", "brief")], ["told"], scratch))
    number = placed.where("told = 1").select((F.col("told_before") + 1).alias("number"), "brief")
    back = F.explode(F.array(*[F.struct(F.lit(i).alias("back"), (F.col("told_before") - i + 1).alias("number")) for i in range(1, n + 1)]))
    wants = placed.where("told = 0").select("asked", back.alias("w")).select("asked.*", "w.back", "w.number")
    return wants.hint("merge").join(number.hint("merge"), "number").drop("number")


def digest(articles: DataFrame) -> DataFrame:
    """Counts of the window in long form: stories, outlets, and stories of each label."""
    base = articles.agg(F.count(F.lit(1)).alias("stories"), F.countDistinct("source").alias("outlets")).selectExpr("stack(2, 'stories', stories, 'outlets', outlets) as (measure, n)")
    return base.unionByName(articles.select(F.explode("tags").alias("t")).groupBy(F.concat(F.lit("label:"), F.col("t")).alias("measure")).agg(F.count(F.lit(1)).alias("n")))


def batch_digest(articles: DataFrame, rounds: DataFrame, themes: int = 8, covered: int = 6, samples: int = 14) -> DataFrame:
    """What a brief's writer is shown of a window, in long form ``(part, ord, name, value)``: its counts, the labels
    of most stories without the fallback, the disclosed capital, the threads that most outlets cover (two at
    least), and the best story of each of the best threads."""
    rows = lambda df, part, name, value, order: df.select(F.lit(part).alias("part"), order.cast("int").alias("ord"), name.cast("string").alias("name"), value.cast("double").alias("value"))
    place = lambda *order: F.row_number().over(Window.partitionBy("__one").orderBy(*order))
    counts = rows(digest(articles).where("measure in ('stories', 'outlets')"), "counts", F.col("measure"), F.col("n"), F.lit(0))
    labels_ = articles.select(F.explode(F.array_distinct("tags")).alias("tag")).where(F.col("tag") != rules.FALLBACK_TAG).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    labels_ = labels_.orderBy(F.col("n").desc(), "tag").limit(themes).withColumn("__one", F.lit(1))
    money = rounds.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum(F.col("amount_m").cast("decimal(18,6)")), F.lit(0)).cast("double").alias("v")).where("k > 0")
    heads = fold_threads(articles)
    most = heads.where("outlets >= 2").orderBy(F.col("outlets").desc(), F.col("score").desc(), "pos").limit(covered).withColumn("__one", F.lit(1))
    best = heads.orderBy(F.col("score").desc(), "pos").limit(samples).withColumn("__one", F.lit(1))
    parts = [
        rows(labels_, "theme", F.col("tag"), F.col("n"), place(F.col("n").desc(), "tag")),
        rows(money, "funding", F.col("k"), F.col("v"), F.lit(0)),
        rows(most, "covered", F.col("head"), F.col("outlets"), place(F.col("outlets").desc(), F.col("score").desc(), "pos")),
        rows(best, "sample", F.col("head"), F.col("score"), place(F.col("score").desc(), "pos")),
    ]
    for p in parts:
        counts = counts.unionByName(p)
    return counts


def prominent_labels(articles: DataFrame, least: int = 3, share: float = 0.08) -> DataFrame:
    """Labels of at least ``max(least, share of all stories)`` stories, most frequent first."""
    n = articles.agg(F.count(F.lit(1)).alias("all"))
    counts = articles.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(n), F.col("n") >= F.greatest(F.lit(float(least)), F.col("all") * share)).select("tag", "n").orderBy(F.col("n").desc(), "tag")


def number_threads(articles: DataFrame, thread: str = "thread", pos: str = "pos") -> DataFrame:
    """``thread_no``: threads numbered from 1 by the place of their first story, range by range."""
    first = articles.groupBy(thread).agg(F.min(pos).alias("__first"))
    numbered = running(first, [F.col("__first"), F.col(thread)], [], Scratch(articles.sparkSession, "threads"), "thread_no")
    return articles.join(numbered.select(thread, F.col("thread_no").cast("int").alias("thread_no")), thread)


def pin_lead(heads: DataFrame, lead: DataFrame, members: DataFrame) -> DataFrame:
    """The lead stands for its thread, whatever head the thread had: ``heads(thread, head)``, ``members(thread, link)``."""
    pinned = members.join(lead.select("link"), "link", "left_semi").select("thread", F.col("link").alias("__lead"))
    return heads.join(F.broadcast(pinned), "thread", "left").withColumn("head", F.coalesce("__lead", "head")).drop("__lead")


def best_per_thread(articles: DataFrame, order: list[Column], n: int) -> DataFrame:
    """One story per thread, the best by ``order``, and of these the first ``n``."""
    one = articles.withColumn("__r", F.row_number().over(Window.partitionBy("thread").orderBy(*order))).where("__r = 1").drop("__r")
    return one.orderBy(*order).limit(n)


def label_counts(articles: DataFrame) -> DataFrame:
    """Stories of each label that occurs, in chip order."""
    chips = [n for n, _ in rules.TAGS] + [rules.FALLBACK_TAG]
    place = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in chips]), F.col("tag")), F.lit(len(chips) + 1))
    return articles.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).withColumn("ord", F.when(place == 0, len(chips) + 1).otherwise(place)).orderBy("ord", "tag")


def sources(articles: DataFrame) -> DataFrame:
    """The outlets of a batch, sorted."""
    return articles.select("source").distinct().orderBy("source")


def publish_days(articles: DataFrame, path: str, at: str = "published_at") -> list[str]:
    """The articles as a table with a partition a day; only days whose rows are not what is stored are written, and these
    days' names are returned. Days that are gone from ``articles`` are emptied as tables, not as folders: they stay as filed.

    Whether a day has changed is told by its number of rows and the sum of their hashes.
    """
    spark = articles.sparkSession
    rows = Scratch(spark, "publish").put(articles.withColumn("day", F.date_format(at, "yyyy-MM-dd")))
    of = [F.col(c) for c in articles.columns]
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*of).cast("decimal(38,0)")).alias("h")]
    new = rows.groupBy("day").agg(*mark)
    old = feeds.or_empty(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)).groupBy("day").agg(*mark)
    same = old.select("day", F.col("n").alias("was_n"), F.col("h").alias("was_h"))
    changed = new.join(same, "day", "left").where(~(F.col("n").eqNullSafe(F.col("was_n")) & F.col("h").eqNullSafe(F.col("was_h")))).select("day")
    days = sorted(r["day"] or "" for r in changed.collect())  # a name a day
    if days:
        dealt = rows.where(F.coalesce("day", F.lit("")).isin(days)).repartition("day", F.pmod(F.xxhash64(*of), F.lit(8)))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return days


def write_payload(articles: DataFrame, path: str, as_of: Column) -> None:
    """The wire as tables: articles, outlets, label counts and one row about the batch."""
    articles.write.mode("overwrite").parquet(f"{path}/articles")
    sources(articles).write.mode("overwrite").parquet(f"{path}/sources")
    label_counts(articles).write.mode("overwrite").parquet(f"{path}/labels")
    articles.agg(F.count(F.lit(1)).alias("count")).withColumn("updated_at", as_of).write.mode("overwrite").parquet(f"{path}/meta")


def brief_inputs(articles: DataFrame, rounds: DataFrame, least_m: float = 5.0, least_rounds: int = 2) -> DataFrame:
    """What a brief is written from, in long form: prominent labels, disclosed funding, the most covered story."""
    labels_ = prominent_labels(articles).select(F.lit("label").alias("kind"), F.col("tag").alias("name"), F.col("n").cast("double").alias("value"))
    money = rounds.where(F.col("amount_m") >= least_m).agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("amount_m").cast("decimal(18,6)")).cast("double").alias("v")).where(F.col("k") >= least_rounds)
    most = fold_threads(articles).orderBy(F.col("outlets").desc(), F.col("score").desc(), "pos").limit(1)
    return labels_.unionByName(money.select(F.lit("funding").alias("kind"), F.col("k").cast("string").alias("name"), F.col("v").alias("value"))).unionByName(most.select(F.lit("story").alias("kind"), F.col("title").alias("name"), F.col("outlets").cast("double").alias("value")))
