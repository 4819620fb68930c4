"""Corroboration over all articles of a story, copies of a headline among them."""

import itertools

import pandas as pd
from pyspark.sql import functions as F

from tidewire.plans import queries, views

WORDS = ["alpha", "bravo", "charlie", "deltas", "echoes", "foxtrot"]


def test_copies_of_a_headline_corroborate_each_other(spark, tmp_path, duck):
    heads = ["Alpha bravo", "Bravo, ALPHA!", "alpha bravo charlie", "alpha bravo charlie", "alpha", "alpha", "deltas echoes", "", "deltas echoes foxtrot alpha bravo charlie", None]
    heads += [" ".join(c) for c in itertools.combinations(WORDS, 3)] * 2
    rows = [(i, None if t is None else f"{t}\nrest", "en", f"desk{i * 7 % 5}", 10) for i, t in enumerate(heads)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    a = views.articles(spark, str(tmp_path)).collect()
    sets = {r["link"]: frozenset(w for w in r["title"].lower().replace(",", "").replace("!", "").split() if len(w) > 3) for r in a}
    near = lambda x, y: len(x & y) >= 2 and len(x & y) / len(x | y) >= 0.4
    want = {r["link"]: len({r["source"]} | {q["source"] for q in a if near(sets[r["link"]], sets[q["link"]])}) for r in a}
    got = queries.prominence_score(spark, str(tmp_path)).toPandas().sort_values("link").reset_index(drop=True)
    assert dict(zip(got["link"], got["outlets"], strict=True)) == want
    assert want[0] == want[1] > 2 and want[4] == 1
    # the whole job in SQL too
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    told = con.execute(queries.ORACLE_SQL["prominence_score"]).df().sort_values("link").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, told[got.columns.tolist()], check_dtype=False)


def test_a_group_has_its_outlets_once(spark, sf):
    """Pairs are between one article of each group; no copies are paired."""
    a = views.articles(spark, sf).select(F.lit("alpha bravo").alias("title"), "link", "source", "published_at").withColumn("same", F.lit(1))
    from tidewire.operators import wire

    got = wire.prominence(a, spark.createDataFrame([], "a int, b int"), F.lit("2024-03-01").cast("timestamp"))
    assert {r["corroborated_by"] for r in got.collect()} == {a.select("source").distinct().count()}
