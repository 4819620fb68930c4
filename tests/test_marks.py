"""Patterns are tried where a word they need is there; that word is read off the pattern."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates, rules, text

PATTERNS = [p for _, p in rules.TAGS] + [rules.RELEVANCE, rules.TECH_CORE, rules.TECH_ANGLE, rules.NO_REUSE] + [p for _, p, _ in rules.TERMS]


@pytest.mark.parametrize(("pattern", "marks"), [
    ("(?i)cyber|RANSOM ware", ("cyber", "ransom ware")), ("a?bc*(?:de)+f", ("de",)), ("x(?=yz)|[ab]c", ("c", "x")), ("(?:ab)?|cd", ()), (r"\bAI\b", ("ai",)),
    ("é1234", ("1234",)), (r"\p{Alpha}abc", ()), ("(abc|abd)e", ("ab",)), ("(?!no)yes", ("yes",)), ("[^a]bcd", ("bcd",)), ("a{2}b", ("a",)), ("abc|a", ("a",)),
])
def test_what_a_pattern_needs(pattern, marks):
    assert text.marks_of(pattern) == marks


def test_labels_are_those_of_the_patterns_alone(spark):
    """On texts made of pieces of the patterns, in any case."""
    rng = random.Random(4)
    words = sorted({w for p in PATTERNS for w in re.findall(r"[A-Za-z$&£€-]{2,}", p)} | {m for p in PATTERNS for m in text.marks_of(p)}) + ["5M", "$5 million", "K", "ſeed", "İnsur", "Key", "2024", "."]
    case = lambda w: rng.choice([w, w.upper(), w.lower(), w.title()])
    rows = [(" ".join(case(rng.choice(words)) for _ in range(rng.randrange(1, 9))),) for _ in range(3000)] + [("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    plain = F.filter(F.array(*[F.when(F.col("t").rlike(p), F.lit(n)) for n, p in rules.TAGS]), lambda x: x.isNotNull())
    got = df.select("t", text.labels(F.col("t"), fallback=None).alias("got"), plain.alias("want")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert {x for r in got for x in r["got"]} == {n for n, _ in rules.TAGS}
    quiet = df.select(text.labels(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert quiet.lower().count("contains(") >= len(rules.TAGS)


def test_summaries_lose_their_trailers(spark):
    rows = ["Text here. The  post X appeared first on Y.", "THE POST x APPEARED FIRST ON y", "A post. Continue reading here", "Read More about it", "Ends [...]", "Ends […] ", "Copyright to Us", "plain   text", "x" * 300, "word " * 80, "", None, "The post without more"]
    df = spark.createDataFrame([(r,) for r in rows], "s string").select(text.tidy_summary(F.col("s")).alias("s"))
    got = [r["s"] for r in df.collect()]
    assert got[:8] == ["Text here.", "", "A post.", "", "Ends", "Ends", "", "plain text"] and got[10:] == ["", None, "The post without more"]
    assert len(got[8]) == 221 and got[9].endswith("word…") and len(got[9]) <= 221


def test_empty_fields_are_no_dates(spark):
    df = spark.createDataFrame([("", " ", "2024-01-02T03:04:05Z"), ("", "", ""), (None, "x", "Tue, 02 Jan 2024 10:00:00 GMT")], "a string, b string, c string")
    got = df.select(F.date_format(dates.parse_feed_time(F.col("a"), F.col("b"), F.col("c")), "yyyy-MM-dd HH:mm").alias("t")).collect()
    assert [r["t"] for r in got] == ["2024-01-02 03:04", None, "2024-01-02 10:00"]
