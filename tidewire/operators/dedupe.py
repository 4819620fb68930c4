"""Comparison joins and the one kernel under all five kinds of deduplication.

The kernel is ordered greedy leader selection: in a total order, a row that matches an earlier leader joins
the first such leader, any other row becomes one. Matching never depends on what has merged, so the leaders
are the lexicographically first maximal independent set of the match graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewire.functions import dates, text
from tidewire.operators.graph import connected_components, merge_components
from tidewire.operators.islands import settle_islands, word_leaders_in_time
from tidewire.storage import Scratch


def greedy_leaders(nodes: DataFrame, edges: DataFrame, island_edges: int = 200_000) -> DataFrame:
    """``nodes(id, ord)``, ``edges(a, b)`` -> ``(id, leader)``. Distinct edges may
    bring both orders, ``oa, ob``.

    Connected components do not see each other: one with up to ``island_edges`` edges settles in one scan in visit
    order, however long its chains are. Larger ones go through rounds: a round settles every node whose earlier neighbours
    are settled, and works on what is still open.
    """
    scratch = Scratch(nodes.sparkSession, "leaders")
    later, turn = edges, F.col("ob") < F.col("oa")
    if "oa" not in edges.columns:
        both = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        oa, ob = (nodes.select(F.col("id").alias(x), F.col("ord").alias(f"o{x}")) for x in "ab")
        later = both.join(oa, "a").join(ob, "b")
    side = lambda x, y: F.when(turn, F.col(x)).otherwise(F.col(y))
    earlier = later.select(side("a", "b").alias("a"), side("oa", "ob").alias("oa"), side("b", "a").alias("b"), side("ob", "oa").alias("ob"))
    earlier, n = scratch.put_counted(earlier, narrow=True)  # b comes before a
    if n <= island_edges:
        led = settle_islands(earlier.withColumn("island", F.lit(0)))
    else:
        part = scratch.put(connected_components(earlier, at_once=island_edges), narrow=True)
        placed = scratch.put(earlier.hint("merge").join(part.select(F.col("node").alias("a"), F.col("component").alias("island")).hint("merge"), "a"), narrow=True)
        big = scratch.put(placed.groupBy("island").count().where(F.col("count") > island_edges).select("island"), narrow=True)
        led = settle_islands(placed.join(big, "island", "left_anti"))
        if not big.isEmpty():
            led = led.union(_in_rounds(scratch, placed.join(big, "island", "left_semi").select("a", "b", "ob")))
    return nodes.select("id").hint("merge").join(led.hint("merge"), "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def _in_rounds(scratch: Scratch, earlier: DataFrame) -> DataFrame:
    """``earlier(a, b, ob)``, b before a -> ``(id, leader)`` of all members, by rounds over what is open."""
    open_ = earlier.select("a", "b")
    known = [scratch.put(earlier.select("b").distinct().join(earlier.select(F.col("a").alias("b")), "b", "left_anti").withColumn("leads", F.lit(True)), narrow=True)]
    new = known[0]
    while True:
        # what the settled say about the open: a leader before it, or nobody left before it; what the last round settled
        # is all that is new, as edges from earlier ones are gone
        seen = open_.join(new, "b", "left")
        verdict = seen.groupBy("a").agg(F.coalesce(F.max("leads"), F.lit(False)).alias("led"), F.count_if(F.col("leads").isNull()).alias("open"))
        done = scratch.put(verdict.where("led or open = 0").select(F.col("a").alias("b"), (~F.col("led")).alias("leads")), narrow=True)
        if done.isEmpty():
            break
        left = open_.join(done.select(F.col("b").alias("a")), "a", "left_anti")
        # an edge from a settled member says nothing more
        left = left.join(new.where("not leads").select("b"), "b", "left_anti")
        open_, new = scratch.put(left, narrow=True), done
        known.append(done)
    heads = scratch.put(reduce(DataFrame.union, known).where("leads").select("b"), narrow=True)
    return earlier.join(heads, "b").groupBy("a").agg(F.min(F.struct("ob", "b")).alias("l")).select(F.col("a").alias("id"), F.col("l.b").alias("leader"))


#: Rarity is told of so many ranges of words' numbers: a table of a megabyte, however many words there are.
_RANGES = 1 << 20
#: A set's signature in longs: a bit for each of its words.
_SIGNS = 4


def _coded(rarity: Broadcast):
    """Sets with the numbers ``s`` of their words -> those that other sets may have too, rarest first, and a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(rarity.value, np.uint8)
        for b in batches:
            lists = b.column(b.num_columns - 1)
            n = np.diff(lists.offsets.to_numpy())
            own, s = np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy().view(np.uint64)
            rare = table[(s >> np.uint64(44)).astype(np.int64)]
            signs = np.zeros((len(n), _SIGNS), np.uint64)
            np.bitwise_or.at(signs, (own, (s & np.uint64(_SIGNS - 1)).astype(np.int64)), np.uint64(1) << (s >> np.uint64(8) & np.uint64(63)))
            order = np.lexsort((s, rare, own))
            order = order[rare[order] > 0]
            ends = np.concatenate(([0], np.cumsum(np.bincount(own[order], minlength=len(n)))))
            numbers = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(s[order].view(np.int64)))
            columns = [*b.columns[:-1], numbers, *[pa.array(signs[:, i].copy().view(np.int64)) for i in range(_SIGNS)]]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, *[f"sign{i}" for i in range(_SIGNS)]])

    return run


def similar_pairs(sets: DataFrame, least_shared: int = 2, least_jaccard: float = 0.4, slot_numbers: int = 16_000_000) -> DataFrame:
    """``sets(id, words)`` with distinct ids and sorted-out words -> pairs ``(a, b)`` that are similar, with the sets'
    ``ord`` as ``oa`` and ``ob`` where they have one.

    Candidates share one of each set's rarest words: at Jaccard >= j a pair shares one of the
    size - ceil(j * size) + 1 rarest of the longer set and of the size - ceil(2 * j / (1 + j) * size) + 1 rarest of the
    shorter one (prefix filter), so frequent words never meet. A word of one set alone is met by none: such words count in
    the size and are not looked at further. Any order of words does that is one for all sets, so a word's rarity is that of
    its number's range, and a set is a short array of numbers, rarest first, of which what follows goes along with each of its
    rare ones. Sets meet on a word and a span of sizes. What follows their first common word bounds what they share, and so do
    their signatures (a bit that the other lacks is a word it lacks); what is left is compared whole where it meets.
    Nothing but similar pairs leaves the join. Sets go along with each of their rare words, so what is shuffled grows with the
    squares of their sizes: above ``slot_numbers`` numbers a task slot, words go in turns, each a part of them by hash, and the
    shuffle files of a turn are freed before the next.
    """
    spark, scratch = sets.sparkSession, Scratch(sets.sparkSession, "similar")
    more, signs = ["ord"] if "ord" in sets.columns else [], [f"sign{i}" for i in range(_SIGNS)]
    own, salt = sets.where(F.size("words") >= least_shared), -1
    while salt < 0 or pc.any(told.column("clash")).as_py():  # two words of one number: all get others
        salt += 1
        words = own.select(F.explode("words").alias("w")).select(F.xxhash64(F.lit(salt), "w").alias("k"), F.xxhash64("w", F.lit(-1)).alias("o"))
        words = words.groupBy("k").agg(F.count(F.lit(1)).alias("df"), (F.min("o") < F.max("o")).alias("clash"))
        often = words.groupBy(F.shiftrightunsigned("k", 44).cast("int").alias("range")).agg(F.sum("df").alias("df"), F.max("clash").alias("clash"))
        # rarity is told in quarters of a power of two
        told = scratch.put(often.where("df > 1").select("range", F.floor(4 * F.log2("df")).cast("short").alias("level"), "clash"), narrow=True).toArrow()
    rarity = np.zeros(_RANGES, np.uint8)
    rarity[told.column("range").to_numpy()] = told.column("level").to_numpy()
    coded = own.select("id", *more, F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(F.lit(salt), w)).alias("s"))
    kinds = StructType([*coded.schema.fields, *[StructField(c, LongType()) for c in signs]])
    coded = coded.mapInArrow(_coded(spark.sparkContext.broadcast(rarity.tobytes())), kinds).withColumn("alone", F.col("n") - F.size("s"))
    coded = coded.withColumn("rare", (F.col("n") - F.greatest(F.lit(least_shared), F.ceil(F.col("n") * least_jaccard - 1e-9)) + 1 - F.col("alone")).cast("int"))
    sent, numbers = Observation(), F.col("rare").cast("long") * (F.size("s") + 2 * _SIGNS)
    coded = scratch.put(coded.where((F.col("rare") > 0) & (F.size("s") >= least_shared)).observe(sent, F.sum(numbers).alias("n")))
    scratch.collect_garbage()  # the words have been shuffled

    at = coded.select("id", "n", *more, *signs, "s", F.posexplode(F.slice("s", F.lit(1), F.col("rare"))).alias("r", "k"))
    before = [F.get("s", F.col("r") - i).alias(f"before{i}") for i in (1, 2)]
    at = at.select("*", *before).withColumn("s", F.slice("s", F.col("r") + 1, F.col("n"))).withColumn("m", F.size("s"))
    # the sizes of sets that may be similar if this is the first common word
    least, most = F.ceil(F.col("n") * least_jaccard - 1e-9), F.floor(F.col("m") * ((1 + least_jaccard) / least_jaccard) + 1e-9) - F.col("n")
    span = lambda size: F.floor(F.log(1.5, size) + 1e-9).cast("int")
    short = at.where(most >= F.col("n")).withColumn("span", span(F.col("n")))
    long = at.where(most >= least).withColumn("span", F.explode(F.sequence(span(least), span(F.least("n", most)))))

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select("k", "span", F.col("id").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "m", "s", "before1", "before2", *signs, *more)])

    need = (F.col("nx") + F.col("ny")) * (least_jaccard / (1 + least_jaccard)) - 1e-9
    lacks = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{c}x").bitwiseAND(F.bitwise_not(f"{c}y"))) for c in signs])

    def met(turn: Column) -> DataFrame:
        one, other = (side(df, x).where(turn).hint("merge") for df, x in ((short, "x"), (long, "y")))
        tests = [(F.col("mx") >= need) & (F.col("my") >= need), (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))), F.col("nx") - lacks >= need]
        for i, j in ((1, 1), (2, 2), (1, 2), (2, 1)):  # most that meet again have met on a word just before
            tests.append(~F.coalesce(F.col(f"before{i}x") == F.col(f"before{j}y"), F.lit(False)))
        near = one.join(other, ["k", "span"]).where(reduce(lambda p, q: p & q, tests))  # at once, which keeps their order
        # a generator keeps the comparison out of the join's own condition, which then stays short enough to be compiled
        near = near.select("*", F.explode(F.array(F.size("sx") - F.size(F.array_except("sx", "sy")))).alias("both"))
        near = near.where((F.col("both") >= least_shared) & (F.col("both") / (F.col("nx") + F.col("ny") - F.col("both")) >= least_jaccard))
        first = F.col("x") < F.col("y")
        kept = [("", ""), *[(c, "o") for c in more]]
        return near.select(*[F.when(first, F.col(f"{c}{p}")).otherwise(F.col(f"{c}{q}")).alias(f"{o}{as_}") for p, q, as_ in (("x", "y", "a"), ("y", "x", "b")) for c, o in kept])

    turns = 1 + 2 * (sent.get["n"] or 0) // (slot_numbers * spark.sparkContext.defaultParallelism)
    if turns == 1:
        found = met(F.lit(True))
    else:
        parts = []
        for i in range(turns):
            parts.append(scratch.put(met(F.pmod(F.xxhash64("k"), F.lit(turns)) == i), narrow=True))
            scratch.collect_garbage()
        found = reduce(DataFrame.union, parts)
    return found.dropDuplicates(["a", "b"])  # a pair may be similar by what follows a later common word too


def threads(articles: DataFrame, order: list[Column], row_id: str = "link", title: str = "title") -> DataFrame:
    """``(row_id, thread)``: headlines about one event, by greedy leaders in ascending ``order`` of values.

    Rows with the same content words match the same rows, and each other if they have two; so one row stands
    for each set of words and the rest follow it, however many copies a headline has.
    """
    scratch = Scratch(articles.sparkSession, "threads")
    at = articles.select(F.col(row_id).alias("id"), F.array_sort(text.keyword_set(F.coalesce(F.col(title), F.lit("")))).alias("words"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(row_id).alias("z")).alias("ord"))
    at = scratch.put(at.withColumn("key", F.when(F.size("words") >= 2, F.array_join("words", " ")).otherwise(F.concat(F.lit("="), F.col("id").cast("string")))))
    heads = scratch.put(at.groupBy("key").agg(F.min(F.struct("ord", "id", "words")).alias("h")).select("key", "h.id", "h.ord", "h.words"))
    lead = greedy_leaders(heads.select("id", "ord"), similar_pairs(heads.where(F.size("words") >= 2).select("id", "words", "ord")))
    named = heads.select("key", "id").hint("merge").join(lead.hint("merge"), "id").select("key", F.col("leader").alias("thread"))
    return at.select(F.col("id").alias(row_id), "key").hint("merge").join(named.hint("merge"), "key").drop("key")


def _spans(t: Column, days: float) -> Column:
    """The number of a time's span of ``days``."""
    return F.floor(F.unix_micros(t) / (days * 86400e6))


def _reach(span: Column) -> Column:
    return F.array(span - 1, span, span + 1)


def same_raise_pairs(rounds: DataFrame, days: float = 45.0, least_shared: int = 2) -> DataFrame:
    """Reports of one raise: equal whole amounts, two distinctive words in common, close in time.

    Two reports meet on amount, span of time and one of the rarer words of each (a pair that shares ``least_shared``
    words shares one beside each side's ``least_shared`` - 1 most frequent ones). Undated reports are close to all and
    meet on amount and word.
    """
    scratch = Scratch(rounds.sparkSession, "raises")
    words = text.distinctive_words(F.col("title"))
    at = scratch.put(rounds.select("link", "published_at", F.floor(F.col("amount_m") + 0.5).alias("amount"), words.alias("words")).where(F.size("words") >= least_shared))
    each = at.select("link", "amount", "published_at", F.size("words").alias("n"), F.explode("words").alias("w"))
    often = scratch.put(each.groupBy("amount", "w").agg(F.count(F.lit(1)).alias("df")), narrow=True)
    rank = F.row_number().over(Window.partitionBy("link").orderBy("df", "w"))
    rare = each.hint("merge").join(often.hint("merge"), ["amount", "w"]).withColumn("r", rank).where(F.col("r") <= F.col("n") - least_shared + 1)
    rare = scratch.put(rare.select("link", "amount", "w", "published_at", _spans(F.col("published_at"), days).alias("span")), narrow=True)
    one = rare.select(F.col("link").alias("a"), "amount", "w", "span", F.col("published_at").alias("ta"))
    other = rare.select(F.col("link").alias("b"), "amount", "w", "span", F.col("published_at").alias("tb"))
    dated = one.where("span is not null").hint("merge").join(other.where("span is not null").withColumn("span", F.explode(_reach(F.col("span")))).hint("merge"), ["amount", "w", "span"])
    undated = one.where("span is null").hint("merge").join(other.drop("span").hint("merge"), ["amount", "w"])
    near = dated.select("a", "b", "ta", "tb").union(undated.select("a", "b", "ta", "tb")).where((F.col("a") != F.col("b")) & (dates.days_apart(F.col("ta"), F.col("tb")) <= days))
    pair = scratch.put(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), narrow=True)
    wa, wb = at.select(F.col("link").alias("a"), F.col("words").alias("wa")), at.select(F.col("link").alias("b"), F.col("words").alias("wb"))
    full = pair.hint("merge").join(wa.hint("merge"), "a").hint("merge").join(wb.hint("merge"), "b")
    return full.where(F.size(F.array_intersect("wa", "wb")) >= least_shared).select("a", "b")


def raise_leaders(rounds: DataFrame, days: float = 45.0, least_shared: int = 2) -> DataFrame:
    """``(id, leader)`` of reports by ``same_raise_pairs``, newest first (then by link), without their pairs: many reports of one
    amount that share words of the trade match each other, but need only be compared with leaders.

    Undated reports come last; they are close to all, and meet what leads among the dated ones.
    """
    scratch = Scratch(rounds.sparkSession, "raise-leaders")
    words = text.distinctive_words(F.col("title"))
    at = rounds.where("published_at is not null").select(F.floor(F.col("amount_m") + 0.5).alias("group"), F.unix_micros("published_at").alias("t"), F.col("link").alias("id"), words.alias("m"))
    led = scratch.put(word_leaders_in_time(scratch.put(at.where((F.size("m") >= least_shared) & F.col("group").isNotNull())), days, least_shared), narrow=True)
    undated = rounds.where("published_at is null")
    if undated.isEmpty():
        return led
    heads = rounds.join(led.where("id = leader").select(F.col("id").alias("link")), "link", "left_semi")
    open_ = scratch.put(heads.unionByName(undated).select("link", "published_at", "amount_m", "title"))
    nodes = open_.select(F.col("link").alias("id"), F.struct(F.col("published_at").isNull(), F.coalesce(-F.unix_micros("published_at"), F.lit(0)), "link").alias("ord"))
    late = greedy_leaders(nodes, scratch.put(same_raise_pairs(open_, days, least_shared)))
    return led.unionByName(late.join(undated.select(F.col("link").alias("id")), "id", "left_semi"))


def same_company_round_pairs(rounds: DataFrame, days: float = 45.0) -> DataFrame:
    """Reports of one company's round: amounts within a factor of two, close in time; undated ones never match.

    Near rounds lie in the same or neighbouring spans of time and powers of two, so a busy company is compared within
    these.
    """
    day = F.floor(F.unix_micros("published_at") / (days * 86400e6))
    power = F.floor(F.log2("amount_m"))

    def side(x: str, key: Column) -> DataFrame:
        own = rounds.where(F.col("slug").isNotNull() & (F.col("amount_m") > 0) & F.col("published_at").isNotNull())
        return own.select(F.col("link").alias(x), F.col("published_at").alias(f"t{x}"), F.col("amount_m").alias(f"m{x}"), "slug", key.alias("cell"))

    near = F.explode(F.flatten(F.array(*[F.array(*[F.struct((day + i).alias("d"), (power + j).alias("p")) for j in (-1, 0, 1)]) for i in (-1, 0, 1)])))
    apart = F.abs(F.unix_micros("ta") - F.unix_micros("tb")) / 86400e6
    pair = side("a", F.struct(day.alias("d"), power.alias("p"))).hint("merge").join(side("b", near).hint("merge"), ["slug", "cell"])
    return pair.where((F.col("a") < F.col("b")) & text.same_round(F.col("ma"), F.col("mb")) & (apart <= days)).select("a", "b")


def _grams(f: Column) -> Column:
    """All runs of 4, 8 and 16 characters of a form."""
    none = F.array().cast("array<string>")

    def runs(n: int) -> Column:
        return F.when(F.length(f) >= n, F.transform(F.sequence(F.lit(1), F.length(f) - n + 1), lambda i: F.substring(f, i, F.lit(n)))).otherwise(none)

    return F.array_distinct(F.concat(*[runs(n) for n in (4, 8, 16)]))


def _own_gram(f: Column, g: Column) -> Column:
    """Whether a run is of the longest kind that the form has: a form that lies in another shares all of these, and the
    longer a run, the fewer forms have it."""
    return F.length(g) == F.when(F.length(f) >= 16, 16).when(F.length(f) >= 8, 8).otherwise(4)


def party_pairs(names: DataFrame) -> DataFrame:
    """``names(name)`` -> ``(name, other)``: all ordered pairs of distinct names of one party, each with itself.

    Names meet on their whole form, on their sorted parties, or where one form's rarest run of 4, 8 or 16
    characters lies in the other: a form that lies inside another one shares all of its own.
    """
    scratch = Scratch(names.sparkSession, "parties")
    form, parties = text.party_form(F.col("name")), text.party_set(F.col("name"))
    at = scratch.put(names.select("name").distinct().select("name", form.alias("f"), F.when(F.size(parties) > 1, F.array_join(parties, "|")).alias("set")).where("f <> ''"))
    grams = scratch.put(at.where(F.length("f") >= 4).select("name", "f", F.explode(_grams(F.col("f"))).alias("g")))
    often = scratch.put(grams.groupBy("g").agg(F.count(F.lit(1)).alias("df")), narrow=True)
    own = grams.where(_own_gram(F.col("f"), F.col("g")))
    rarest = own.hint("merge").join(often.hint("merge"), "g").groupBy("name", "f").agg(F.min(F.struct("df", "g")).alias("m"))
    rarest = scratch.put(rarest.select("name", "f", F.col("m.g").alias("g")), narrow=True)
    wide = grams.select(F.col("name").alias("other"), F.col("f").alias("fo"), "g")
    inside = rarest.hint("merge").join(wide.hint("merge"), "g").where(F.contains(F.col("fo"), F.col("f"))).select("name", "other")
    other = at.select(F.col("name").alias("other"), "f", "set")
    equal = at.select("name", "f").hint("merge").join(other.select("other", "f").hint("merge"), "f").select("name", "other")
    allied = at.where("set is not null").select("name", "set").hint("merge").join(other.where("set is not null").select("other", "set").hint("merge"), "set").select("name", "other")
    return scratch.put(inside.union(inside.select("other", "name")).union(equal).union(allied).distinct(), narrow=True)


def same_deal_pairs(deals: DataFrame, days: float = 180.0) -> DataFrame:
    """Reports of one deal: the same acquirer, and the same target, or a similar one close in time.

    Names are compared once each (``party_pairs``). Reports then meet on an acquirer's name and either the target's name
    or a distinctive word of it within neighbouring spans of time (undated reports: at any time).
    """
    scratch = Scratch(deals.sparkSession, "same-deal")
    at = scratch.put(deals.select("link", "published_at", "acquirer", "target"))
    buys = party_pairs(at.select(F.col("acquirer").alias("name"))).select(F.col("name").alias("acquirer"), F.col("other").alias("met"))
    sold = party_pairs(at.select(F.col("target").alias("name"))).select(F.col("name").alias("target"), F.col("other").alias("like"))
    one = scratch.put(at.hint("merge").join(buys.hint("merge"), "acquirer").select(F.col("link").alias("a"), F.col("published_at").alias("ta"), "target", F.col("met").alias("acquirer")))
    other = at.select(F.col("link").alias("b"), F.col("published_at").alias("tb"), "acquirer", "target")
    named = one.hint("merge").join(sold.hint("merge"), "target").select("a", "acquirer", F.col("like").alias("target"))
    same = named.hint("merge").join(other.hint("merge"), ["acquirer", "target"]).select("a", "b")
    word = F.explode(text.target_words(F.col("target"))).alias("w")
    left = scratch.put(one.select("a", "ta", "acquirer", _spans(F.col("ta"), days).alias("span"), word))
    right = scratch.put(other.select("b", "tb", "acquirer", _spans(F.col("tb"), days).alias("span"), word))
    dated = left.where("span is not null").hint("merge").join(right.where("span is not null").withColumn("span", F.explode(_reach(F.col("span")))).hint("merge"), ["acquirer", "w", "span"])
    undated = [left.where(x).hint("merge").join(right.where(y).drop("span").hint("merge"), ["acquirer", "w"]) for x, y in (("span is null", "true"), ("span is not null", "span is null"))]
    near = reduce(DataFrame.union, [x.select("a", "b", "ta", "tb") for x in (dated, *undated)]).where(dates.days_apart(F.col("ta"), F.col("tb")) <= days)
    both = same.union(near.select("a", "b")).where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def same_identity_pairs(deals: DataFrame) -> DataFrame:
    """Deals of one resolved acquirer whose targets are the same party, of which one at least is no known company.

    Targets meet on what any two names of one party share: a name of four characters or more that lies in another shares
    its rarest run of 4, 8 or 16 characters, rarest among the acquirer's; shorter ones are equal; a consortium is its
    sorted parties.
    """
    scratch, form = Scratch(deals.sparkSession, "same-identity"), text.party_form(F.col("target"))
    at = deals.where(F.col("acquirer_slug").isNotNull()).select("link", "acquirer_slug", "target_slug", form.alias("f"), F.array_join(text.party_set(F.col("target")), "|").alias("set")).where("f <> ''")
    at = scratch.put(at)  # forms are made once a deal, not once a pair
    whole = F.array(F.concat(F.lit("="), F.col("f")), F.concat(F.lit("&"), F.col("set")))
    grams = scratch.put(at.select("acquirer_slug", "link", "f", F.explode(_grams(F.col("f"))).alias("g")))
    often = scratch.put(grams.groupBy("acquirer_slug", "g").agg(F.count(F.lit(1)).alias("df")))
    own = grams.where(_own_gram(F.col("f"), F.col("g"))).hint("merge").join(often.hint("merge"), ["acquirer_slug", "g"])
    rarest = own.groupBy("acquirer_slug", "link", "f").agg(F.min(F.struct("df", "g"))["g"].alias("g"))
    keyed = scratch.put(at.hint("merge").join(rarest.hint("merge"), ["acquirer_slug", "link", "f"], "left"))

    def side(x: str, keys: Column) -> DataFrame:
        return keyed.select("acquirer_slug", F.explode(F.concat(whole, keys)).alias("k"), F.col("link").alias(x), F.col("target_slug").alias(f"s{x}"), F.col("f").alias(f"f{x}"), F.col("set").alias(f"set{x}"))

    # ``text.same_party`` of the two forms and sets, where the two meet
    inside = lambda x, y: (F.length(x) >= 4) & F.contains(F.col(y), F.col(x))
    same = (F.col("fa") == F.col("fb")) | inside("fa", "fb") | inside("fb", "fa") | (F.contains(F.col("seta"), F.lit("|")) & (F.col("seta") == F.col("setb")))
    pair = side("a", F.array_compact(F.array("g"))).hint("merge").join(side("b", _grams(F.col("f"))).hint("merge"), ["acquirer_slug", "k"])
    pair = pair.where((F.col("a") != F.col("b")) & (F.col("sa").isNull() | F.col("sb").isNull()) & same)
    return pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merge_evidence(reports: DataFrame, cluster: str = "leader") -> DataFrame:
    """One row per cluster in visit order ``ord``: other outlets, first named stage and lead, first price and its source."""
    first = lambda c: F.min(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct("ord", c)))[c].alias(c)
    priced = F.min(F.when(F.col("amount_m") > 0, F.struct("ord", "amount_m", "link", "source")))
    out = reports.groupBy(cluster).agg(F.min(F.struct("ord", "link", "source", "title", "published_at")).alias("h"), F.collect_set("source").alias("s"), first("stage"), first("lead"), priced.alias("p"), F.count(F.lit(1)).alias("reports"))
    return out.select("h.link", "h.title", "h.source", "h.published_at", "stage", "lead", F.col("p.amount_m").alias("amount_m"), F.col("p.link").alias("amount_link"), F.col("p.source").alias("amount_source"), "reports", F.array_sort(F.array_except("s", F.array("h.source"))).alias("also_reported_by"))


def _keyed(articles: DataFrame) -> DataFrame:
    rank = F.when(F.coalesce(F.col("summary"), F.lit("")) != "", 2).otherwise(0) + F.when(~F.col("link").rlike("(?i)^https?://news\\.google\\."), 1).otherwise(0)
    keys = {"__l": F.concat(F.lit("l:"), text.link_key(F.col("link"))), "__t": F.concat(F.lit("t:"), text.title_key(F.col("title"))), "__r": rank}
    return articles.withColumns(keys)


def _key_edges(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("__l").alias("a"), F.col("__t").alias("b")).where("b <> 't:'").distinct()


def two_key_dedupe(articles: DataFrame) -> DataFrame:
    """One article for all that share a link key or a loose title key, directly or through others.

    The richest copy stays: a summary counts 2, a direct link 1, then the earlier position ``pos``.
    """
    scratch = Scratch(articles.sparkSession, "two-key")
    keyed = scratch.put(_keyed(articles))
    part = scratch.put(connected_components(_key_edges(keyed), at_once=200_000))
    placed = keyed.join(part, F.col("__l") == F.col("node"), "left").withColumn("__c", F.coalesce("component", "__l"))
    best = placed.groupBy("__c").agg(F.min(F.struct((-F.col("__r")).alias("r"), F.col("pos"))).alias("m"), F.count(F.lit(1)).alias("copies"))
    return placed.join(best, "__c").where(F.col("pos") == F.col("m.pos")).select(*articles.columns, "copies")


def two_key_batch(batch: DataFrame, labels: DataFrame | None, best: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """One more batch for ``two_key_dedupe``: stored ``labels(node, component)`` of keys and ``best(component, m, copies)``, the
    winner of each component, -> both with the batch merged in (None: nothing is stored yet).

    Batches give what all their articles give at once, in any order: ``m`` is ``(r, pos)`` of the richest copy.
    """
    spark = batch.sparkSession
    scratch = Scratch(spark, "two-key-batch")
    keyed = scratch.put(_keyed(batch).select("pos", "__l", "__t", "__r"))
    if labels is None:
        labels = spark.createDataFrame([], "node string, component string")
    labels, moved = merge_components(labels, scratch.put(_key_edges(keyed), narrow=True), scratch)
    placed = keyed.hint("merge").join(labels.hint("merge"), F.col("__l") == F.col("node"), "left")
    new = placed.select(F.coalesce("component", "__l").alias("component"), F.struct((-F.col("__r")).alias("r"), F.col("pos")).alias("m"), F.lit(1).cast("long").alias("copies"))
    if best is not None:
        old = best.withColumnRenamed("component", "was").hint("merge").join(moved.hint("merge"), "was", "left")
        new = new.unionByName(old.select(F.coalesce("component", "was").alias("component"), "m", "copies"))
    return labels, scratch.put(new.groupBy("component").agg(F.min("m").alias("m"), F.sum("copies").alias("copies")), narrow=True)


def first_per_title(articles: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each loose title in a group."""
    keyed = articles.withColumn("__k", text.title_key(F.col("title")))
    return keyed.withColumn("__r", F.row_number().over(Window.partitionBy(*group, "__k").orderBy(*order))).where("__r = 1").drop("__k", "__r")


def keep_unseen(batch: DataFrame, stored: DataFrame, order: list[Column]) -> DataFrame:
    """Rows whose link and loose title are not stored, the first of each title within the batch."""
    fresh = batch.withColumn("__l", text.link_key(F.col("link"))).withColumn("__k", text.title_key(F.col("title")))
    old = stored.select(text.link_key(F.col("link")).alias("__l"), text.title_key(F.col("title")).alias("__k"))
    left = fresh.join(old.select("__l"), "__l", "left_anti").join(old.select("__k"), "__k", "left_anti")
    return left.withColumn("__r", F.row_number().over(Window.partitionBy("__k").orderBy(*order))).where("__r = 1").select(*batch.columns)
