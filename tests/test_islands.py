"""Greedy leaders by islands against a sequential model: long chains, hot groups, ranges that depend on each other."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import deals, dedupe, islands
from tidewire.operators.graph import connected_components

DAY = 86_400_000_000


def model(rows, days=45.0, factor=2.0):
    """rows: (group, t, id, m) -> the first leader each follows, newest first."""
    leaders, out = {}, {}
    for group, t, id_, m in sorted(rows, key=lambda r: (-r[1], r[2])):
        own = leaders.setdefault(group, [])
        hit = next((i for u, size, i in own if (u - t) / 86400e6 <= days and max(size, m) / min(size, m) <= factor), None)
        out[id_] = id_ if hit is None else hit
        if hit is None:
            own.append((t, m, id_))
    return out


@pytest.fixture()
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("shape", ["many", "hot", "chain", "empty"])
def test_leaders_in_time(many_ranges, shape):
    rng = random.Random(2)
    rows = {
        "many": [(f"c{rng.randrange(40)}", rng.randrange(900) * DAY + rng.randrange(DAY), i, rng.uniform(1, 50)) for i in range(1500)],
        # a third of all rows in one group, without a gap, through several ranges
        "hot": [("hot" if i % 3 == 0 else f"c{i % 50}", rng.randrange(2400) * DAY, i, rng.choice([1.0, 1.9, 2.0, 3.9, 8.0])) for i in range(3000)],
        "chain": [("one", i * 30 * DAY, i, 5.0) for i in range(2000)],
        "empty": [],
    }[shape]
    df = many_ranges.createDataFrame(rows, "`group` string, t long, id long, m double")
    got = islands.leaders_in_time(df, 45.0, 2.0).collect()
    assert len(got) == len(rows) and {r["id"]: r["leader"] for r in got} == model(rows)


def jobs(spark, name, run):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return out, len(sc.statusTracker().getJobIdsForGroup(name))


def test_rounds_of_a_chain_take_few_jobs(spark):
    rows = [(i, "one", i * 30 * DAY, 5.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "link long, slug string, t long, amount_m double").withColumn("published_at", F.timestamp_micros("t")).withColumn("source", F.lit("s"))
    got, n = jobs(spark, "chain-rounds", lambda: deals.company_round_clusters(df).select("link", "leader").collect())
    assert {r["link"]: r["leader"] for r in got} == model([("one", t, i, m) for i, _, t, m in rows])
    assert n < 20


def test_threads_of_a_chain_take_few_jobs(spark):
    """Six words a headline; one shares four with the next, two with the one after."""
    rows = [(i, " ".join(f"term{2 * i + j}" for j in range(6))) for i in range(2000)]
    df = spark.createDataFrame(rows, "link long, title string")
    got, n = jobs(spark, "chain-threads", lambda: dedupe.threads(df, [F.col("link")]).collect())
    assert {r["link"]: r["thread"] for r in got} == {i: i - i % 2 for i in range(2000)}
    assert n < 20


@pytest.mark.parametrize("island_edges", [0, 5, 10**6])
def test_islands_and_rounds_agree(spark, island_edges):
    rng, n = random.Random(1), 60
    edges = [(i, i + 1) for i in range(20)] + [(a, b) for a in range(25, n) for b in range(25, a) if rng.random() < 0.05]
    order = list(range(n))
    rng.shuffle(order)
    at = {x: i for i, x in enumerate(order)}
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(n)}
    leaders, want = [], {}
    for i in order:
        hit = next((x for x in leaders if x in near[i]), None)
        want[i] = i if hit is None else hit
        leaders += [i] if hit is None else []
    nodes = spark.createDataFrame([(i, at[i]) for i in range(n)], "id int, ord int")
    got = dedupe.greedy_leaders(nodes, spark.createDataFrame(edges, "a int, b int"), island_edges).collect()
    assert {r["id"]: r["leader"] for r in got} == want


@pytest.mark.parametrize("at_once", [0, 10, 10**6])
def test_components_of_a_chain(spark, at_once):
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(5)]
    random.Random(0).shuffle(edges)
    got = connected_components(spark.createDataFrame(edges, "a int, b int").repartition(4), at_once=at_once).collect()
    assert {r["node"]: r["component"] for r in got} == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(5)}


def test_same_raise_pairs_lose_nothing(spark):
    rng = random.Random(6)
    words = ["alpha", "bravo", "charlie", "deltas", "echoes", "foxtrot", "golfers"]
    rows = [(i, " ".join(rng.sample(words, rng.randrange(1, 5))), float(rng.choice([5, 5.2, 9])), None if rng.random() < 0.1 else rng.randrange(200) * DAY) for i in range(120)]
    df = spark.createDataFrame(rows, "link long, title string, amount_m double, t long").withColumn("published_at", F.timestamp_micros("t"))
    got = {(r["a"], r["b"]) for r in dedupe.same_raise_pairs(df).collect()}
    close = lambda x, y: x is None or y is None or abs(x - y) <= 45 * DAY
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and int(a[2] + 0.5) == int(b[2] + 0.5) and len(set(a[1].split()) & set(b[1].split())) >= 2 and close(a[3], b[3])}
    assert got == want and want


def test_same_deal_pairs_lose_nothing(spark):
    from tidewire.functions import text

    rng = random.Random(8)
    names = ["Acme Holdings", "Acme", "ACME Re", "Zenith", "Zenith and Acme", "Acme & Zenith", "Q", "MetLife", "Life", "Borealis Marine", "Marine Borealis Partners", "Marine Mutual", "", None]
    rows = [(i, rng.choice(names), rng.choice(names), None if rng.random() < 0.1 else rng.randrange(600) * DAY) for i in range(80)]
    df = spark.createDataFrame(rows, "link long, acquirer string, target string, t long").withColumn("published_at", F.timestamp_micros("t"))
    a = df.select(F.col("link").alias("a"), F.col("acquirer").alias("qa"), F.col("target").alias("ga"), F.col("t").alias("ta"))
    b = df.select(F.col("link").alias("b"), F.col("acquirer").alias("qb"), F.col("target").alias("gb"), F.col("t").alias("tb"))
    near = F.coalesce(F.abs(F.col("ta") - F.col("tb")) <= 180 * DAY, F.lit(True))
    same = text.same_party(F.col("qa"), F.col("qb")) & (text.same_party(F.col("ga"), F.col("gb")) | (text.same_target(F.col("ga"), F.col("gb")) & near))
    want = {(r["a"], r["b"]) for r in a.join(b, F.col("a") < F.col("b")).where(same).collect()}
    assert {(r["a"], r["b"]) for r in dedupe.same_deal_pairs(df).collect()} == want and want


def test_rank_in_groups(many_ranges):
    from tidewire.operators.ranges import rank_in_groups
    from tidewire.storage import Scratch

    rng = random.Random(11)
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else f"g{i % 7}", rng.randrange(50), i) for i in range(600)]
    df = many_ranges.createDataFrame(rows, "g string, v int, i int")
    got = {r["i"]: (r["rank"], r["k"]) for r in rank_in_groups(df, ["g"], [F.col("v").desc(), F.col("i")], Scratch(many_ranges, "rank"), size="k").collect()}
    groups = {}
    for g, v, i in rows:
        groups.setdefault(g, []).append((-v, i))
    assert got == {i: (n, len(x)) for x in groups.values() for n, (_, i) in enumerate(sorted(x), 1)}
