"""The kernel against a sequential model, state, feeds, streaming and the full pipelines on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates, text
from tidewire.operators import dedupe, entities, serve, wire
from tidewire.operators import deals as deal_ops
from tidewire.operators.graph import connected_components
from tidewire.sources import feeds, replies
from tidewire.streaming import wire as stream


def sequential(n, edges):
    """The first earlier leader a node matches, in order of its number."""
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    leaders, out = [], {}
    for i in range(n):
        hit = next((x for x in leaders if x in near[i]), None)
        out[i] = i if hit is None else hit
        if hit is None:
            leaders.append(i)
    return out


@pytest.mark.parametrize("shape", ["sparse", "dense", "path", "star", "empty"])
def test_greedy_leaders(spark, shape):
    rng, n = random.Random(7), 40
    edges = {
        "sparse": [(a, b) for a in range(n) for b in range(a) if rng.random() < 0.05],
        "dense": [(a, b) for a in range(n) for b in range(a) if rng.random() < 0.4],
        "path": [(i, i + 1) for i in range(n - 1)],
        "star": [(0, i) for i in range(1, n)],
        "empty": [],
    }[shape]
    nodes = spark.createDataFrame([(i, i) for i in range(n)], "id int, ord int")
    got = dedupe.greedy_leaders(nodes, spark.createDataFrame(edges, "a int, b int"))
    assert {r["id"]: r["leader"] for r in got.collect()} == sequential(n, edges)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (None, 1)], "a int, b int")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_threads_do_not_chain(spark):
    rows = [(1, "alpha bravo charlie delta echo", 3), (2, "alpha bravo charlie foxtrot golfs", 2), (3, "foxtrot golfs charlie hotel india", 1), (4, "alpha bravo charlie delta echo", 0), (5, "", 9), (6, None, 8)]
    df = spark.createDataFrame(rows, "link int, title string, pos int")
    got = {r["link"]: r["thread"] for r in dedupe.threads(df, [F.col("pos")]).collect()}
    assert got[1] == got[4] == 4 and got[5] == 5 and got[6] == 6
    assert got[3] == 3 and got[2] in (3, 4)


def test_similar_pairs_lose_nothing(spark):
    rng = random.Random(3)
    sets = [(i, sorted({f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 7))})) for i in range(60)]
    got = {(r["a"], r["b"]) for r in dedupe.similar_pairs(spark.createDataFrame(sets, "id int, words array<string>")).collect()}
    want = {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) >= 2 and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.4}
    assert got == want


def test_similar_pairs_write_no_candidates(spark):
    sets = spark.createDataFrame([(i, ["common", "every", f"own{i}", f"x{i}"]) for i in range(50)] + [(50, ["common", "own3", "x3"])], "id int, words array<string>")
    pairs = dedupe.similar_pairs(sets)
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(3, 50)]
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("SortMergeJoin") == 1  # met and compared in one join: only similar pairs leave it


@pytest.mark.parametrize("undated", [0.0, 0.2])
def test_raise_leaders_are_those_of_the_pairs(spark, undated):
    """Also across ranges, and where most reports of an amount match each other."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.sample(["alpha", "bravo", "charlie", "delta", "echo1", "foxtrot"], rng.randrange(1, 4))), float(rng.choice([5, 7])), None if rng.random() < undated else rng.randrange(400) * 86400) for i in range(300)]
    df = spark.createDataFrame(rows, "link int, title string, amount_m double, at long").withColumn("published_at", F.timestamp_seconds("at")).drop("at")
    want = {r["link"]: r["leader"] for r in deal_ops.newest_first(df, dedupe.same_raise_pairs(df)).collect()}
    got = {r["id"]: r["leader"] for r in dedupe.raise_leaders(df).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_reports_of_one_amount_make_no_pairs(spark, monkeypatch):
    """Reports that share the trade's words match one another: of 300 that follow their own leaders none is paired."""
    made = []
    monkeypatch.setattr(dedupe, "same_raise_pairs", lambda *a, **b: made.append(a))
    words = [f"zeta{i} omega{i}" for i in range(300)]
    rows = [(2 * i + x, f"{w} raises $125M" + " led by Peak Capital" * (x == 0), "Desk", 1700000000 + i * 60 + 30 * x) for i, w in enumerate(words) for x in (0, 1)]
    a = spark.createDataFrame(rows, "link long, title string, source string, at long").select("link", "title", "source", F.timestamp_seconds("at").alias("published_at"), F.lit("It sells insurance.").alias("summary"), F.array(F.lit("Funding")).alias("tags"))
    facts = spark.createDataFrame([], "link bigint, round boolean, company string, amount_m double, currency string, stage string, lead string")
    m = a.select("link", F.lower(F.substring_index("title", " ", 1)).alias("slug"), F.substring_index("title", " ", 2).alias("name"))
    assert sorted(r["link"] for r in deal_ops.funding_rounds(a, facts, m).collect()) == [2 * i + 1 for i in range(300)] and not made


def test_two_key_dedupe_prefers_the_richer_copy(spark):
    rows = [(0, "https://a/x?u=1", "Big News", ""), (1, "https://a/x?u=2", "Other words", "summary"), (2, "https://b/y", "BIG NEWS!", ""), (3, "https://c/z", "Alone", "")]
    got = dedupe.two_key_dedupe(spark.createDataFrame(rows, "pos int, link string, title string, summary string")).collect()
    assert sorted((r["pos"], r["copies"]) for r in got) == [(1, 3), (3, 1)]


def test_feed_to_articles(spark):
    xml = """<rss><item><title>Acme raises $5M to automate insurance claims - Some Wire</title><link>https://x/1</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;Text about it&lt;/p&gt;</description></item>
    <item><title>Lettuce recall</title><link>https://x/2</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item>
    <item><title>Insurance webinar</title><link>https://x/webinar/3</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item>
    <item><title>Old insurance</title><link>https://x/4</link><pubDate>Tue, 02 Jan 2018 10:00:00 GMT</pubDate></item></rss>
    <feed><entry><title>Insurer news</title><link rel="alternate" href="https://y/5"/><updated>2024-01-03T08:00:00Z</updated></entry></feed>"""
    bodies = spark.createDataFrame([("f1", xml)], "feed_url string, xml string")
    manifest = feeds.manifest(spark, [("f1", "Some Wire", False, False)])
    got = feeds.read_articles(bodies, manifest, F.lit("2024-01-04").cast("timestamp")).orderBy("link").collect()
    assert [(r["link"], r["title"], r["summary"]) for r in got] == [("https://x/1", "Acme raises $5M to automate insurance claims", "Text about it"), ("https://y/5", "Insurer news", "")]
    assert "Funding" in got[0]["tags"]


def test_replies(spark):
    rows = [("a", 'Here: {"round": true, "company": "Acme", "amount": "2.5", "unit": "billion", "currency": "eur", "stage": "Seed", "lead": "X",}', "2024-05-01"), ("b", '{"round": true, "amount": "0"}', "2024-05-01"), ("c", '{"round": true, "amount": "5", "currency": "XXX"}', "2024-05-01"), ("d", '{"round": true, "amount": "5", "announcedYear": 2020}', "2024-05-01"), ("e", "no json", "2024-05-01")]
    df = spark.createDataFrame(rows, "link string, reply string, published_at string").withColumn("published_at", F.col("published_at").cast("timestamp"))
    got = {r["link"]: r for r in replies.funding_verdict(df).collect()}
    assert got["a"]["round"] and got["a"]["amount_m"] == 2500 and got["a"]["currency"] == "EUR" and got["a"]["stage"] == "Seed"
    assert not got["b"]["round"] and not got["c"]["round"] and not got["d"]["round"] and got["d"]["stale"] == 2020
    assert "e" not in got


def articles(spark, rows):
    df = spark.createDataFrame([(f"l{i}", t, s, d) for i, (t, s, d) in enumerate(rows)], "link string, title string, source string, d string")
    df = df.withColumn("published_at", F.col("d").cast("timestamp")).withColumn("summary", F.lit(""))
    return df.withColumn("tags", text.labels(F.col("title")))


def test_funding_pipeline(spark):
    a = articles(
        spark,
        [
            ("Corgi raises $160M Series B insurance round led by Peak XV", "One", "2024-03-01"),
            ("Corgi insurance startup raises $160 million in Series B", "Two", "2024-03-02"),
            ("Corgi lands $106M for insurance", "Three", "2024-03-22"),
            ("Market size to reach $5 billion insurance by 2035", "Four", "2024-03-01"),
            ("Corgi raises $14M insurance seed", "One", "2023-01-01"),
        ],
    )
    names = spark.createDataFrame([(f"l{i}", "corgi", "Corgi") for i in (0, 1, 2, 4)], "link string, slug string, name string")
    facts = spark.createDataFrame([], "link string, round boolean, company string, amount_m double, currency string, stage string, lead string, stale int, pv int")
    got = deal_ops.funding_rounds(a, facts, names).collect()
    assert [(r["amount_m"], r["slug"]) for r in got] == [(106.0, "corgi"), (14.0, "corgi")] or [r["amount_m"] for r in got] == [160.0, 14.0]
    assert len(got) == 2


def test_deal_pipeline(spark):
    a = articles(
        spark,
        [
            ("Radian to acquire Inigo Insurance for $1.7 billion", "One", "2024-01-01"),
            ("Radian completes acquisition of Inigo Insurance", "Two", "2024-11-12"),
            ("Gallagher acquires insurance broker Apollo Solutions", "Three", "2024-02-01"),
            ("EFU Life Eyes Waada Digital insurance Acquisition", "Four", "2024-02-01"),
        ],
    )
    facts = spark.createDataFrame([], "link string, deal boolean, acquirer string, target string, seller string, type string, amount_m double, currency string, stale int, pv int")
    index = spark.createDataFrame([("radian", "Radian Group", 5)], "slug string, name string, stories int")
    got = {r["acquirer"]: r for r in deal_ops.ma_deals(a, facts, index).collect()}
    assert set(got) == {"Radian", "Gallagher"}
    assert got["Radian"]["reports"] == 2 and got["Radian"]["amount_m"] == 1700 and got["Radian"]["amount_source"] == "One"
    assert got["Radian"]["also_reported_by"] == ["One"] and got["Radian"]["acquirer_slug"] == "radian"


def test_index_pipeline(spark):
    a = articles(spark, [("Acme raises $5M led by Peak Ventures", "W", "2024-01-01"), ("Acme Insurance launches app", "W", "2024-01-02"), ("Nirvana eases health insurance verification", "W", "2024-01-03")])
    names = spark.createDataFrame([("l0", ["Acme", "Peak Ventures"]), ("l1", ["Acme Insurance", "W"]), ("l2", ["Nirvana"])], "link string, names array<string>")
    aliases = spark.createDataFrame([("acme-co-uk", "Acme")], "alias_slug string, canonical string")
    splits = spark.createDataFrame([("nirvana", "(?i)health insurance verification", "Nirvana Health")], "slug string, pattern string, new_name string")
    got = {r["slug"]: r["stories"] for r in entities.full_index(a, names, aliases, ["w"], splits).collect()}
    assert got == {"acme": 2, "nirvana-health": 1}


def test_company_names(spark):
    df = spark.createDataFrame([("Acme Labs raises $5M with PolicyStreet",), ("Nothing here at all",), (None,)], "t string")
    got = [r["x"] for r in df.select(entities.company_names(F.col("t")).alias("x")).collect()]
    assert "Acme Labs" in got[0] and "PolicyStreet" in got[0] and got[2] == []


def test_upsert_keeps_first_seen(spark):
    old = spark.createDataFrame([("a", "x", None), ("b", "y", "2024-01-01")], "link string, title string, s string").select("link", "title", F.col("s").cast("timestamp").alias("first_seen"))
    new = spark.createDataFrame([("b", "y2"), ("c", "z")], "link string, title string")
    got = {r["link"]: (r["title"], r["first_seen"] and r["first_seen"].year) for r in serve.upsert_store(old, new, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert got == {"a": ("x", None), "b": ("y2", 2024), "c": ("z", 2025)}


def test_decline_keeps_published_text(spark):
    cached = spark.createDataFrame([("a", True, "old", 10, 2, 1), ("b", True, "old", 10, 0, 1)], "slug string, known boolean, summary string, n int, tries int, pv int")
    new = spark.createDataFrame([("a", False, None, 12), ("b", True, "new", 13)], "slug string, known boolean, summary string, n int")
    got = {r["slug"]: (r["known"], r["summary"], r["n"], r["tries"], r["pv"]) for r in serve.merge_rewrite(cached, new, 2).collect()}
    assert got == {"a": (True, "old", 12, 3, 2), "b": (True, "new", 13, 0, 2)}


def test_link_spans(spark):
    p = spark.createDataFrame([(1, 0, "Parametric insurance and insurance from Acme. Acme again."), (1, 1, "More about insurance.")], "page int, para int, body string")
    t = spark.createDataFrame([("insurance", "i"), ("parametric insurance", "p"), ("Acme", "a")], "term string, target string")
    got = [(r["para"], r["start"], r["target"]) for r in serve.link_spans(p, t, per_paragraph=2).orderBy("para", "start").collect()]
    assert got == [(0, 0, "p"), (0, 25, "i")]


def test_brief_window_widens(spark):
    rows = spark.createDataFrame([(i, f"2024-01-{i + 1:02d}") for i in range(20)], "link int, d string").select("link", F.col("d").cast("timestamp").alias("landed_at"))
    got = wire.brief_window(rows, F.lit("2024-01-17").cast("timestamp"), F.lit("2024-01-21").cast("timestamp")).collect()
    assert len(got) == 16 and got[0]["reason"] == "too few stories"


def test_dates(spark):
    df = spark.createDataFrame([("Tue, 02 Jan 2024 10:00:00 GMT",), ("2024-01-02T10:00:00Z",), ("2024-01-02T12:00:00+02:00",), ("nonsense",)], "s string")
    got = [str(r["t"]) if r["t"] else None for r in df.select(dates.parse_feed_time(F.col("s")).alias("t")).collect()]
    assert got == ["2024-01-02 10:00:00"] * 3 + [None] or len({g for g in got[:3]}) == 1
    keys = spark.createDataFrame([("2024-q3",)], "k string").select(dates.quarter_months(F.col("k")).alias("m"), dates.period_label(F.col("k")).alias("l")).collect()[0]
    assert keys["m"] == ["2024-07", "2024-08", "2024-09"] and keys["l"] == "Q3 2024"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"https://a/{i}", f"Title number {i % 7}", "S", f"sum {i}", f"2024-01-{i + 1:02d} 00:00:00") for i in range(12)]
    for part in (0, 1):
        df = spark.createDataFrame(rows[part::2], "link string, title string, source string, summary string, d string")
        df.select("link", "title", "source", "summary", F.array(F.lit("Industry")).alias("tags"), F.col("d").cast("timestamp").alias("published_at"), F.lit(None).cast("timestamp").alias("first_seen"), F.lit(True).alias("native")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = stream.Store(spark, str(tmp_path / "store"))
    source = spark.readStream.schema(feeds.ARTICLE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.run(source, store, str(tmp_path / "ck"), lambda b: F.lit(f"2024-02-{b + 1:02d}").cast("timestamp"))
    q.awaitTermination(120)
    got = store.latest()
    assert got.count() == got.select("link").distinct().count() >= 7
    assert got.where("first_seen is null").isEmpty()


def test_stream_daily_totals(spark, sf, tmp_path):
    static = spark.read.parquet(f"{sf}/events.parquet")
    src = spark.readStream.schema(static.schema).parquet(f"{sf}/events.parquet*")
    q = stream.daily_totals(src, "ts", "value").writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {str(r["d"]): r["n"] for r in static.groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {str(r["day"])[:10]: r["n"] for r in spark.table("days").collect()} == want


def test_feed_times_try_only_fitting_formats(spark):
    samples = ["2 Jan 2024 10:00:00 +0000", "2 Jan 2024 10:00 +0000", "2024-01-02T10:00:00+0000", "2024-01-02T10:00:00.000+0000", "2024-01-02T10:00:00Z", "2024-01-02", ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = df.select("i", *[F.col("s").rlike(shape).alias(p) for shape, p in dates._FEED_FORMATS], dates.parse_feed_time(F.col("s")).isNotNull().alias("read")).orderBy("i").collect()
    assert [[j for j in range(6) if r[j + 1]] for r in got] == [[0], [1], [2], [3], [4], [5], []]
    assert [r["read"] for r in got] == [True] * 6 + [False]
