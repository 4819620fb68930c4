"""What a step must not do more often than its input asks for, with the results it has to keep."""

import random
import re
import time

import pandas as pd
from pyspark.sql import functions as F

from tidewire.functions import rules, text
from tidewire.llm import chaining
from tidewire.operators import dedupe, entities, rollups
from tidewire.plans import state_queries


def test_noise_tests_word_edges_once(spark):
    assert rules.MARKET_NOISE.startswith(r"(?i)\b(?:")
    heads = ["Acme tops $5M", "Acme stops $5M", "Deals reach 5", "remarket sizes", "halves", "Q3 report", "FAQ3", "in talks for it", "mumble", "across 26 deals", "eyes $5M", "goodbyes $5M", "it rose", "a prose", "first close"]
    df = spark.createDataFrame([(h,) for h in heads], "t string")
    got = df.select("t", text.round_noise(F.col("t")).alias("n"), text.any_of(F.col("t"), [f"(?i){p}" for p in rules._NOISE]).alias("each")).collect()
    assert [r["n"] for r in got] == [r["each"] for r in got] and {r["n"] for r in got} == {True, False}


def test_identity_forms_are_made_once_a_deal(spark):
    rows = [(1, "c", "s1", "Firm One Ltd"), (2, "c", None, "Firm One"), (3, "c", None, "Other"), (4, "d", None, "Firm One"), (5, "c", None, "Alpha Re and Beta Re"), (6, "c", None, "Beta Re, Alpha Re"), (7, "c", None, "ab"), (8, "c", None, "ab"), (9, "c", "s9", "Firm One")]
    pairs = dedupe.same_identity_pairs(spark.createDataFrame(rows, "link long, acquirer_slug string, target_slug string, target string"))
    assert "gmbh" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(1, 2), (2, 9), (5, 6), (7, 8)]


def test_long_replies_are_not_read_sign_by_sign():
    long = 'x {"a": "' + "y" * 8_000_000 + '"} z'
    begun = time.process_time()
    assert len(text.json_slice.func(pd.Series([long]))[0]) == len(long) - 4
    assert time.process_time() - begun < 0.3
    odd = ['{"a": "}\\"{", "b": {}} }', '{"a": "}', "{{}", '"{"a": 1,}', "\\{}", None]
    assert list(text.json_slice.func(pd.Series(odd))) == ['{"a": "}\\"{", "b": {}}', None, None, '{"a": 1}', "{}", None]


def test_slugs_are_made_once_a_name(spark):
    df = spark.createDataFrame([(["Acme Inc", "Desk 1", "Survaival", "Insurance Group", "x" * 61, "Acme Inc"], "Desk 1")], "n array<string>, s string")
    got = df.select(entities.sane_names(F.col("n"), ["survaival"], F.col("s")).alias("n"))
    assert got._jdf.queryExecution().analyzed().toString().count("incorporated") == 2  # the name's and the outlet's
    assert got.collect()[0]["n"] == ["Acme Inc"]


def test_raises_are_looked_for_behind_from_and_with_only(monkeypatch):
    seen = []

    class Spy:
        @staticmethod
        def compile(p):
            made = re.compile(p)
            if p != rules.TAGS[0][1]:
                return made
            return type("Raise", (), {"search": staticmethod(lambda t: seen.append(t) or made.search(t))})

    monkeypatch.setattr(entities, "re", Spy)
    titles = ["Acme raises $5M led by Peak", "Acme raises $5M from Peak", "Acme walks with Peak", "Acme with $5M from Oslo", None]
    got = list(entities.investor_positions.func(pd.Series(titles)))
    assert got == [[23], [21], [], [], []] and seen == [titles[1], titles[3]]


def test_tasks_of_co_occurrence_grow_with_its_rows(spark):
    rows = spark.createDataFrame([(k, i) for k in range(30) for i in range(k % 4)] + [(3, 1)], "k int, i int")
    got = {n: sorted(map(tuple, rollups.co_occurrence(rows, "i", "k", 2, rows_a_task=n).collect())) for n in (1, 500_000)}
    assert got[1] == got[500_000] == [(0, 1, 14, 1), (0, 2, 7, 2), (1, 0, 14, 1), (1, 2, 7, 2), (2, 0, 7, 1), (2, 1, 7, 2)]


def test_similar_pairs_in_turns_lose_none_and_leave_lone_words_out(spark, monkeypatch):
    rnd, rows, made = random.Random(1), [], []
    for i in range(120):
        rows.append((i, sorted({f"w{rnd.randrange(60)}" if rnd.random() < 0.8 else f"u{i}x{j}" for j in range(rnd.randint(1, 9))})))
    both = lambda x, y: len(set(x) & set(y))
    want = [(a, b) for a, x in rows for b, y in rows if a < b and (n := both(x, y)) >= 2 and n / (len(x) + len(y) - n) >= 0.25]
    put = dedupe.Scratch.put
    monkeypatch.setattr(dedupe.Scratch, "put", lambda self, *a, **k: made.append(put(self, *a, **k)) or made[-1])
    got = dedupe.similar_pairs(spark.createDataFrame(rows, "id long, words array<string>"), 2, 0.25, slot_numbers=30)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want and len(want) > 30
    assert made[0].count() <= 60 and len(made) > 4  # lone words have no number; the pairs came in several turns


def test_deal_patterns_are_tried_where_their_words_are(spark):
    heads = ["Acme BUYS stakes in digital insurer Beta", "Acme\tacquires Beta Re!\u2028", "Zed sells Beta Re to Acme", "Acme to take over Beta amid probe", "Beta acquired by 3. Acme", "REPORT: Acme completes acquisition of the Beta", "Beta merges with Acme", "A\0 buys B", "Acme expands", None]
    df = spark.createDataFrame([(h,) for h in heads], "t string").select(text.deal_pair(F.col("t")).alias("p"), text.deal_type(F.col("t")).alias("type"))
    assert df._jdf.queryExecution().analyzed().toString().count("Contains(") > 50 or df._jdf.queryExecution().analyzed().toString().count("contains(") > 50
    rows = df.collect()
    assert [r["p"] and (r["p"]["acquirer"], r["p"]["target"]) for r in rows] == [("Acme", "Beta"), ("Acme", "Beta Re\u2028"), ("Acme", "Beta Re"), ("Acme", "Beta"), ("Acme", "Beta"), ("Acme", "the Beta"), None, None, None, None]
    assert [r["type"] for r in rows] == ["Acquisition"] * 6 + ["Merger"] + ["Acquisition"] * 3


def test_targets_of_one_acquirer_meet_on_rare_runs(spark):
    names = [f"Firm{i:06d}" for i in range(400)] + ["Firm000007 Re", "Old Firm000007", "irm0", "Firm", "abc", "abc", "Firm000123 and Beta Re", "Beta Re, Firm000123", "A long name of a firm without end", "long name of a firm"]
    rows = [(i, "c" if i % 50 else "d", None if i % 3 else "s", n) for i, n in enumerate(names)]
    pairs = dedupe.same_identity_pairs(spark.createDataFrame(rows, "link long, acquirer_slug string, target_slug string, target string"))
    form = lambda n: re.sub(r"[^a-z0-9 ]+", " ", n.lower()).replace(" and ", " ").split()
    forms = [" ".join(form(n)) for n in names]
    alike = lambda x, y: forms[x] == forms[y] or any(len(forms[p]) >= 4 and forms[p] in forms[q] for p, q in ((x, y), (y, x))) or {x, y} == {406, 407}
    want = [(x, y) for x, *a in rows for y, *b in rows if x < y and a[0] == b[0] and not (a[1] and b[1]) and alike(x, y)]
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == want and len(want) > 500
    few = spark.createDataFrame(rows[:400], "link long, acquirer_slug string, target_slug string, target string")
    begun = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    assert dedupe.same_identity_pairs(few).count() == 0 and spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - begun < 40
    key = few.select(F.explode(dedupe._grams(F.col("target"))).alias("g"), "target").where(dedupe._own_gram(F.col("target"), F.col("g")))
    assert key.groupBy("g").count().groupBy().agg(F.min("count")).first()[0] == 1 and key.where("length(g) <> 8").isEmpty()


def test_the_stream_reads_no_file_a_body(spark, sf, monkeypatch):
    roots, made = [], state_queries.Scratch
    monkeypatch.setattr(state_queries, "Scratch", lambda *a: roots.append(made(*a)) or roots[-1])
    got = state_queries.first_seen_stream(spark, sf)
    landed = spark.read.parquet(f"{roots[0].root}/landed")
    feed = landed.where("value like '<rss>%'")
    assert landed.count() > feed.count() > 8 and got.count() > 0
    at_once = max(4, spark.sparkContext.defaultParallelism)
    more = spark.range(300 * at_once).select(F.lit("f").alias("feed_url"), F.col("id") * 400, F.lit("<rss><item>x</item></rss>").alias("xml")).toDF("feed_url", "k", "xml")
    state_queries._land_rows(more, f"{roots[0].root}/more", "before")
    assert len(spark.read.parquet(f"{roots[0].root}/more").inputFiles()) <= 2 * at_once


def test_a_seed_is_marked_once_a_text(spark):
    """The first occurrence of a seed is told by plain numbers, which are aggregated by hashing, without a sort."""
    df = spark.createDataFrame([(1, "a b c d e f g " * 40), (2, "a b c d e f g " * 30)], "uid long, text string")
    got = df.mapInArrow(chaining._seed_rows(5, 1, 50), "seed long, uid long, pos int, head boolean")
    each = got.groupBy("seed", "uid").agg(F.min("pos").alias("first"), F.min(F.when(F.col("head"), F.col("pos"))).alias("told"), F.count_if("head").alias("n")).collect()
    assert len(each) == 14 and all(r["first"] == r["told"] and r["n"] == 1 for r in each)
