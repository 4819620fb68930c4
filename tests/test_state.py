"""Streams, incremental state, as-of joins, links and published tables on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import dedupe, serve, wire
from tidewire.operators.graph import connected_components, merge_components
from tidewire.sources import feeds
from tidewire.storage import Scratch
from tidewire.streaming import wire as stream


def test_merging_edges_gives_what_all_edges_give(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(50)]
    labels = spark.createDataFrame([], "node string, component string")
    for i in range(3):
        labels, _ = merge_components(labels, spark.createDataFrame(edges[i::3], "a string, b string"), Scratch(spark, "test"))
    want = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    got = {r["node"]: r["component"] for r in labels.collect()}
    assert {n: c for n, c in got.items() if n in want} == want and all(n == c for n, c in got.items() if n not in want)


def test_batches_dedupe_like_one_table(spark):
    rng = random.Random(9)
    rows = [(i, f"https://a/{rng.randrange(12)}?u={i}", rng.choice(["", f"Title {rng.randrange(9)}"]), rng.choice(["", "s"])) for i in range(60)]
    df = spark.createDataFrame(rows, "pos int, link string, title string, summary string")
    labels = best = None
    for i in (2, 0, 1):
        labels, best = dedupe.two_key_batch(df.where(F.col("pos") % 3 == i), labels, best)
    want = sorted((r["pos"], r["copies"]) for r in dedupe.two_key_dedupe(df).collect())
    assert sorted((r["m"]["pos"], r["copies"]) for r in best.collect()) == want


def articles(spark, rows):
    df = spark.createDataFrame(rows, "link string, title string, landed string")
    at = F.lit("2024-01-01").cast("timestamp")
    return df.select("link", "title", F.lit("S").alias("source"), F.lit("").alias("summary"), F.array(F.lit("T")).alias("tags"), at.alias("published_at"), F.lit(None).cast("timestamp").alias("first_seen"), F.lit(True).alias("native"), F.col("landed").cast("timestamp").alias("landed_at"))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """A batch fails after it has written; it runs again on the state it found before."""
    steps = [[("a", "one", None), ("b", "one", "2024-02-01")], [("a", "two", "2024-02-02"), ("b", "two", "2024-02-02"), ("c", "two", "2024-02-02")], [("c", "three", "2024-02-03")]]
    path, store = str(tmp_path / "in"), stream.Store(spark, str(tmp_path / "store"))
    articles(spark, []).write.parquet(path)
    source = spark.readStream.schema(articles(spark, []).schema).parquet(path)
    failed, write = [], store.write

    def once(df, batch):
        write(df, batch)
        if len(steps) == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("lost")

    store.write = once
    while steps:
        if not failed or len(steps) > 1:
            articles(spark, steps[0]).coalesce(1).write.mode("append").parquet(path)
        q = stream.run_arrivals(source, store, str(tmp_path / "state"))
        try:
            q.awaitTermination(120)
            steps.pop(0)
        except Exception as e:
            assert "lost" in str(e)
    assert failed
    got = {r["link"]: (r["title"], r["first_seen"] and r["first_seen"].day) for r in store.latest().collect()}
    assert got == {"a": ("two", None), "b": ("two", 1), "c": ("three", 2)}


@pytest.mark.parametrize("n", [1, 3])
def test_previous_in_time(spark, n):
    rng = random.Random(3)
    briefs = sorted(rng.sample(range(200), 40))
    asked = [rng.randrange(200) for _ in range(80)]
    b = spark.createDataFrame([(x, f"b{x}") for x in briefs], "date int, headline string")
    a = spark.createDataFrame([(x, i) for i, x in enumerate(asked)], "date int, who int")
    got = sorted((r["who"], r["back"], r["brief"]["date"]) for r in wire.previous_in_time(a, b, n).collect())
    want = sorted((i, k + 1, x) for i, at in enumerate(asked) for k, x in enumerate([x for x in reversed(briefs) if x < at][:n]))
    assert got == want


@pytest.mark.parametrize("at_once", [2, 1000])
def test_terms_in_prose(spark, at_once):
    body = "Reinsurers met. acme and ACME, not Acmes: Acme Re insures, cyber-risk cyberrisk. Acme Re İ cyber risk"
    p = spark.createDataFrame([(1, 0, body), (1, 1, "Acme again, underwriting. Marine"), (2, 0, None), (3, 0, "")], "page int, para int, body string")
    t = spark.createDataFrame([("Acme", "co", True, False), ("Acme Re", "co-re", True, False), ("reinsur", "re", False, True), ("cyber risk", "cy", False, False), ("underwrit", "uw", False, True), ("marin", "ma", False, False), (None, "x", False, False), ("", "y", False, True)], "term string, target string, exact boolean, stem boolean")
    got = [(r["page"], r["para"], r["target"], r["start"], r["end"]) for r in serve.link_spans(p, t, per_paragraph=3, terms_at_once=at_once).orderBy("page", "para", "start").collect()]
    one, two = body.index("Acme Re"), body.rindex("Acme Re")  # the longer name is linked once, then the shorter one is free
    assert got == [(1, 0, "re", 0, 10), (1, 0, "co-re", one, one + 7), (1, 0, "co", two, two + 4), (1, 1, "uw", 12, 24)]
    few = serve.link_spans(p, t, per_paragraph=1, per_page=2).collect()
    assert sorted((r["para"], r["target"]) for r in few) == [(0, "re"), (1, "co")]


def test_only_changed_days_are_written(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = spark.createDataFrame([(i, f"2024-01-{1 + i % 5:02d}") for i in range(50)], "link int, d string").select("link", F.col("d").cast("timestamp").alias("published_at"))
    assert wire.publish_days(rows, path) == [f"2024-01-{x:02d}" for x in range(1, 6)]
    assert wire.publish_days(rows, path) == []
    more = rows.union(rows.where("link = 3").withColumn("link", F.lit(99)))
    assert wire.publish_days(more, path) == ["2024-01-04"]
    assert spark.read.parquet(path).count() == 51


def test_lists_in_parts(spark):
    rows = spark.createDataFrame([("a", "articles", 0, f"v{i}") for i in range(250)] + [("b", "articles", 0, "x")], "slug string, list string, rank long, value string")
    got = serve.index_lists(rows, per_part=50).collect()
    assert len(got) > 3 and max(len(r["entries"]) for r in got) < 120
    assert sorted(e["value"] for r in got for e in r["entries"] if r["slug"] == "a") == sorted(f"v{i}" for i in range(250))


def test_payload_files(spark, tmp_path):
    for name, body in {"f1": "<rss><item>one</item>\nmore</rss>\n", "f2": "<html>down</html>", "f3": "<rss><item>cut", "f4": ""}.items():
        (tmp_path / name).write_text(body)
    got = {r["feed_url"]: (r["ok"], r["file"]) for r in feeds.payloads(spark, str(tmp_path)).withColumn("ok", feeds.is_feed(F.col("xml"))).collect()}
    assert got["f1"] == (True, "f1") and not got["f2"][0] and not got["f3"][0] and not got.get("f4", (False,))[0]


def test_archive_maps_round_trip(spark, tmp_path):
    rows = articles(spark, [(f"l{i}", f"t{i}", None) for i in range(25)]).drop("landed_at")
    feeds.write_archive_maps(rows, str(tmp_path / "maps"), entries=4)
    back = feeds.archive_maps(str(tmp_path / "maps"), spark)
    assert sorted(map(str, back.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert spark.read.text(str(tmp_path / "maps")).count() > 3
