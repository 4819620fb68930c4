"""Similar sets of words against all pairs: many sizes, near copies, numbers that two words share."""

import random

from pyspark.sql import functions as F

from tidewire.functions import rules, text
from tidewire.operators import dedupe


def made_up(seed):
    rng, sets = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(150)]
    for _ in range(120):
        sets.append({rng.choice(vocabulary[: rng.choice([20, 150])]) for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 45]))})
    for i in range(60):  # near copies, parts and sets with words of their own
        like = set(rng.choice(sets))
        kept = {w for w in like if rng.random() < rng.choice([0.4, 0.7, 0.95])}
        sets.append(kept | {f"own{i}x{j}" for j in range(rng.choice([0, 1, 6]))} or {"w0"})
    rows = [(i, sorted(s)) for i, s in enumerate(sets)]
    rng.shuffle(rows)
    return rows


def model(rows, shared, jaccard):
    n = lambda x, y: len(set(x) & set(y))
    return sorted((a, b) for a, x in rows for b, y in rows if a < b and n(x, y) >= shared and n(x, y) / (len(x) + len(y) - n(x, y)) >= jaccard)


def test_pairs_of_all_sizes_meet_once(spark):
    """Sets meet on a word and a span of sizes, and not on words alone; a pair comes once."""
    rows = made_up(5)
    df = spark.createDataFrame(rows, "id long, words array<string>")
    for shared, jaccard in ((2, 0.4), (1, 0.6), (3, 0.15)):
        pairs = dedupe.similar_pairs(df, shared, jaccard)
        assert sorted((r["a"], r["b"]) for r in pairs.collect()) == model(rows, shared, jaccard)
        assert "SortMergeJoin [k" in (plan := pairs._jdf.queryExecution().executedPlan().toString()) and "span" in plan
    ord_ = df.withColumn("ord", F.struct((-F.col("id")).alias("o"), F.col("id").alias("z")))
    got = dedupe.similar_pairs(ord_).collect()
    assert sorted((r["a"], r["b"]) for r in got) == model(rows, 2, 0.4) and all(r["oa"]["o"] == -r["a"] and r["ob"]["z"] == r["b"] for r in got)


def test_words_of_one_number_get_others(spark, monkeypatch):
    rows, real, calls = made_up(6), F.xxhash64, []

    def weak(*columns):
        calls.append(columns)
        return F.pmod(real(*columns), F.lit(7)) if len(calls) == 1 else real(*columns)

    monkeypatch.setattr(dedupe.F, "xxhash64", weak)
    got = dedupe.similar_pairs(spark.createDataFrame(rows, "id long, words array<string>"))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == model(rows, 2, 0.4) and len(calls) > 4


def test_no_sets_no_pairs(spark):
    assert dedupe.similar_pairs(spark.createDataFrame([], "id long, words array<string>")).collect() == []
    assert dedupe.similar_pairs(spark.createDataFrame([(1, ["alone"]), (2, [])], "id long, words array<string>")).collect() == []


def test_content_words_are_cut_out_in_one_pass(spark):
    heads = ["The  Market, of\tdata: DATA-driven Überfirma", "", None, "  launch launches ", "a bcde.fghi", "Technology for insurtech insurance 2024!"]
    df = spark.createDataFrame([(h,) for h in heads], "t string").select("t", text.keyword_set(F.col("t")).alias("k"))
    assert "array_except" not in df._jdf.queryExecution().optimizedPlan().toString()
    for r in df.collect():
        plain = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (r["t"] or "").lower()).split()
        assert r["k"] == (None if r["t"] is None else list(dict.fromkeys(w for w in plain if len(w) > 3 and w not in rules.THREAD_STOP)))
