"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import chaining, decontamination, exact_topk, language_id, minhash, mixing, quality, sharding, substring_dedup, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = """id uid th band node h w n rank size target epochs cut_key key bucket shard slot host domain markup suffix post ll grams
declared k1 k2 row word pieces owner spans whole __n __spans __items seed pos lead label score margin weak links class_id start length
budget buckets sum prior taken copies source_size comp component first part salt text_hash identity match_id u c""".split()


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def pieces(path="word_bpe_49k.json"):
    import public_tokenizers

    return token_counts.tokenizer_counts(public_tokenizers.path(path))


def bench(spark):
    return spark.createDataFrame([("a", "w1 w2 w3"), (None, "w4 w5 w6 w7"), ("a", None), ("b", "w1 w2 w3")], "item_id string, text string")


OPS = {
    "op1": lambda spark, df: quality.score_quality(df),
    "op2": lambda spark, df: minhash.near_duplicates(df),
    "op3": lambda spark, df: mixing.mix_sources(df).select("doc_id", "size", "source_size", "target", "taken", "copies"),
    "op4": lambda spark, df: substring_dedup.remove_repeats(df, length=20, levels=(8, 15)),
    "op5": lambda spark, df: token_counts.count_tokens(df, pieces()),
    "op6": lambda spark, df: decontamination.find_contamination(df, bench(spark), window=3).select("doc_id", "__n", "__spans", "__items"),
    "op6_passes": lambda spark, df: decontamination.decontaminate(df, bench(spark), window=3, max_words=3).select("doc_id", "text"),
    "op7": lambda spark, df: chaining.repeated_passages(df),
    "op8": lambda spark, df: language_id.identify(df),
    "op9": lambda spark, df: sharding.shard_rows(df, 4, identity=["doc_id", "text"]).select("doc_id", "text", "shard", "slot"),
}
#: One row for each row of the input.
WHOLE = ["op1", "op2", "op3", "op4", "op5", "op6", "op8", "op9"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty texts, repeated rows, ties, and a text of half a megabyte."""
    rng = random.Random(3)
    some = [prose(rng, 80) for _ in range(4)]
    texts = [None, "", "  \n", "one", "x" * 3000, *some, *some, some[0] + " and more", prose(rng, 100_000, 5000), "w1 w2 w3 w4 w5 w6 w7 " * 30]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, some[1], None, None, None), (None, None, "en", "a", None), *[(5, some[0], "en", "a", 1)] * 3]
    path = f"file://{tmp_path_factory.mktemp('odd')}/docs"
    spark.createDataFrame(rows, DOCS).coalesce(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(OPS))
def test_odd_rows_and_clashing_columns(spark, odd, name):
    got = OPS[name](spark, odd)
    rows = plain(got)
    if name in WHOLE:
        assert len(rows) == odd.count()
    clash = odd.withColumns({c: F.lit("clash") for c in CLASH})
    assert plain(OPS[name](spark, clash).select(*got.columns)) == rows


@pytest.mark.parametrize("name", sorted(OPS))
def test_empty_table(spark, empty, name):
    assert OPS[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd, empty, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    plain_rows = stage(spark, odd, sf).select("doc_id", "text").collect()
    clash = odd.withColumns({c: F.lit("clash") for c in CLASH if c not in ("shard", "slot")})
    out = stage(spark, clash, sf)
    if name != "sharding":
        assert out.columns == clash.columns and out.where("size <> 'clash' or target <> 'clash' or rank <> 'clash'").isEmpty()
    assert Counter(map(repr, out.select("doc_id", "text").collect())) == Counter(map(repr, plain_rows))
    assert stage(spark, empty, sf).count() == 0


def test_items_without_an_id_are_hit(spark, odd):
    df = spark.createDataFrame([(1, "x w4 w5 w6 w7 y w1 w2 w3")], "doc_id int, text string")
    for most in (100, 3):
        r = decontamination.find_contamination(df, bench(spark), window=3, max_words=most).first()
        assert [tuple(s) for s in r["__spans"]] == [(1, 5), (6, 9)] and r["__items"] == ["a", "b", None]


def test_decontamination_without_documents(spark, odd):
    assert decontamination.find_contamination(odd.limit(0), bench(spark)).count() == 0


def test_copies_are_linked_whatever_their_id(spark):
    rng = random.Random(4)
    t = prose(rng, 200, 10**6)
    near = t.rsplit(" ", 1)[0] + " other"
    df = spark.createDataFrame([(None, t), (1, t), (2, near), (3, prose(rng, 200, 10**6))], "doc_id long, text string")
    got = minhash.near_duplicates(df).collect()
    assert sorted(r["class_size"] for r in got) == [1, 3, 3, 3]


def test_dense_groups_of_edited_copies(spark):
    """Thousands of edited copies of one text, as far from it as 0.42: recall against all pairs."""
    rng, texts = random.Random(12), []
    base = prose(rng, 150, 10**6).split()
    for _ in range(400):
        w = base[:]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    bags = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j])]
    for i, j in pairs:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    assert np.mean([got[i] == got[j] for i, j in pairs]) >= 0.999
    assert all(root(i) == root(got[i]) for i in got)


def test_removed_strings_of_a_text_beyond_one_segment(spark):
    rng = random.Random(9)
    part = "".join(rng.choice("abcdefgh") for _ in range(4000))
    long = "".join(rng.choice("abcdefgh") for _ in range(2_300_000))
    a, b, c = long[:1_000_000], long[1_000_000:2_097_000], long[2_097_000:]
    texts = [f"{a}1{part}2{b}3{part}4{c}", "zz" + part[100:900] + "yy", "nothing of it"]
    assert len(texts[0]) > substring_dedup._SEGMENT
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df, length=200).collect()}
    kept = [f"{a}12{b}34{c}", "zzyy", "nothing of it"]
    for i, t in enumerate(texts):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(t), len(t) - len(kept[i]), [2, 1, 0][i])
        assert got[i]["kept_sha256"] == hashlib.sha256(kept[i].encode()).hexdigest()


def test_ties_and_vectors_out_of_range(spark):
    rows = [(i, [1.0, 0.0]) for i in range(15)] + [(100, [2.0, 0.0]), (101, []), (102, [1e300, 1e300]), (103, [-1e300, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = {}
    for r in exact_topk.top_k(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(got[100]) == [(1, 102), *[(i + 2, i) for i in range(9)]]
    assert sorted(got[0]) == [(1, 102), (2, 100), *[(i + 2, i) for i in range(1, 9)]]


def test_sources_of_one_size_and_many(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.format_string("s%04d", F.col("id") % 1000).alias("source"))
    got = mixing.mix_sources(df).toPandas()
    want = {0: 5, 1: 2, 2: 1}
    per = got.drop_duplicates("source_size")[["source_size"]]
    assert len(per) == 1 and got["target"].sum() == pytest.approx(3 * 9000)  # three rows a source
    targets = got.assign(s=got["doc_id"] % 1000).groupby("s")["target"].first()
    level = 9000 / sum(want[i % 3] for i in range(1000))
    for i in range(1000):
        assert targets[i] == pytest.approx(level * want[i % 3])


def test_more_languages_than_a_block(spark):
    rng = random.Random(1)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 5)) for _ in range(70)]
    rows = []
    for i in range(700):
        a = alphabets[i % 70]
        rows.append((i, " ".join("".join(rng.choice(a) for _ in range(rng.randrange(3, 8))) for _ in range(40)), f"l{i % 70}", "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["language"] for r in language_id.identify(df, block=32).collect()}
    assert np.mean([got[i] == f"l{i % 70}" for i in got]) > 0.97
    few = {r["doc_id"]: r["language"] for r in language_id.identify(df, block=70).collect()}
    assert few == got


def test_markup_is_found_anywhere_in_a_page(spark):
    html = "<!-- " + "x" * 5000 + ' --><html lang="fr"><body>'
    got = language_id.page_evidence(spark.createDataFrame([(1, "http://a.org/5", html)], "page_id int, url string, html string")).first()
    assert got["markup"] == "fr"


# ---- passages against a brute-force aligner ----


def edited(rng, words, rate):
    """Words replaced, dropped and added at a rate."""
    out = []
    for w in words:
        x = rng.random()
        if x < rate * 0.6:
            out.append(f"e{rng.randrange(10**6)}")
        elif x < rate * 0.8:
            out += [w, f"e{rng.randrange(10**6)}"]
        elif x >= rate:
            out.append(w)
    return out


@pytest.mark.parametrize(("rate", "least"), [(0.05, 1.0), (0.1, 0.97), (0.15, 0.9)])
def test_recall_of_planted_passages(spark, rate, least):
    rng, rows, want = random.Random(int(rate * 100)), [], []
    for i in range(60):
        n = rng.choice([55, 70, 100, 200])
        passage = prose(rng, n, 10**6).split()
        other = edited(rng, passage, rate)
        same = np.zeros((len(passage) + 1, len(other) + 1), int)
        for a, x in enumerate(passage):
            for b, y in enumerate(other):
                same[a + 1, b + 1] = max(same[a, b + 1], same[a + 1, b], same[a, b] + (x == y))
        texts = [prose(rng, rng.randrange(120), 10**6), prose(rng, rng.randrange(120), 10**6)]
        rows.append((2 * i, f"{texts[0]} {' '.join(passage)} {prose(rng, 30, 10**6)}"))
        rows.append((2 * i + 1, f"{texts[1]} {' '.join(other)} {prose(rng, 40, 10**6)}"))
        if same[-1, -1] >= 0.82 * max(len(passage), len(other)) and min(len(passage), len(other)) >= 52:
            want.append(2 * i)
    found = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()
    got = {min(r["doc_id"], r["match_id"]) for r in found}
    assert len(want) > 20 and np.mean([i in got for i in want]) >= least
    assert all(r["identity"] >= 0.8 and r["length"] >= 50 for r in found)


def test_two_passages_of_one_pair(spark):
    """150 shared words, 210 other ones, 70 shared words."""
    rng = random.Random(6)
    a, b = prose(rng, 150, 10**6), prose(rng, 70, 10**6)
    rows = [(i, f"{a} {prose(rng, 210, 10**6)} {b}") for i in (0, 1)]
    got = sorted((r["start"], r["length"]) for r in chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 150), (360, 70)]


def test_passage_that_smaller_texts_quote_in_parts(spark):
    """Texts before it hold the first and the last words of a passage, none of them 50."""
    rng = random.Random(7)
    p = prose(rng, 70, 10**6).split()
    rows = [(i, f"{prose(rng, 60, 10**6)} {' '.join(q)} {prose(rng, 60, 10**6)}") for i, q in enumerate([p[:40], p[30:], p, p])]
    for ids in ((0, 1, 2, 3), (1, 3, 0, 2)):
        df = spark.createDataFrame([(ids[i], t) for i, t in rows], "doc_id long, text string")
        got = chaining.repeated_passages(df).collect()
        assert {frozenset((r["doc_id"], r["match_id"])) for r in got} == {frozenset((ids[2], ids[3]))}


def test_passages_within_a_text_and_beyond_the_margin(spark):
    rng = random.Random(8)
    p, long = prose(rng, 90, 10**6), prose(rng, 3000, 10**6)
    df = spark.createDataFrame([(1, f"{p} {prose(rng, 100, 10**6)} {p}"), (2, long), (3, long), (4, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["match_id"]): r for r in chaining.repeated_passages(df).collect()}
    assert (got[1, 1]["start"], got[1, 1]["length"], got[1, 1]["match_start"]) == (190, 90, 0)
    two = got.get((2, 3)) or got[3, 2]
    assert two["length"] == two["match_length"] == 3000


def test_sharding_law_of_the_query(spark, sf):
    got = sharding.op9(spark, sf).toPandas()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert (got["law"] == "rows").all() and got["grown_shard"].isna().all()
    again = sharding.op9(spark, sf).toPandas()
    order = ["doc_id", "shard", "slot"]
    assert got[order].sort_values(order).values.tolist() == again[order].sort_values(order).values.tolist()


def test_hypergeometric_of_large_counts():
    rng = random.Random(2)
    good, bad, draws = 10**11, 15 * 10**11, 10**6
    got = [sharding.hypergeometric(rng, good, bad, draws) for _ in range(400)]
    assert np.mean(got) == pytest.approx(draws / 16, abs=50) and np.std(got) == pytest.approx((draws * 15 / 256) ** 0.5, rel=0.15)


def test_em_at_the_settings_of_the_query():
    """Labellers that find different kinds of bad texts, with a common rate of false alarms, are told apart."""
    rng = np.random.default_rng(3)
    n, k = 40_000, len(quality.LABELLERS)
    good, kind = rng.random(n) < 0.85, rng.integers(0, k, n)
    alarm = rng.random((n, k)) < 0.003
    finds = (kind[:, None] == np.arange(k)) & (rng.random((n, k)) < 0.9)
    bad = np.where(good[:, None], alarm, alarm | finds)
    votes = np.where(bad, quality.BAD, np.where(rng.random((n, k)) < np.where(good, 0.5, 0.2)[:, None], quality.GOOD, quality.ABSTAIN))
    patterns, counts = np.unique(quality._pattern(votes), return_counts=True)
    prior, rates, post = quality.fit_labellers(patterns, counts)
    soft = dict(zip(patterns.tolist(), post, strict=True))
    found = np.array([soft[int(p)] > 0.5 for p in quality._pattern(votes)])
    assert (found == good).mean() > 0.9 and found[good].mean() > 0.9
    assert rates[:, 1, quality.BAD].max() < 0.03


def test_passages_in_a_crowd(spark):
    """Ten exact passages of 80 words, each whole in two texts and in halves of 42 words in fifteen others each."""
    rng, texts, whole = random.Random(12), [], []
    for _ in range(10):
        p = prose(rng, 80, 10**6).split()
        around = lambda w: " ".join([prose(rng, 30, 10**6), *w, prose(rng, 30, 10**6)])
        texts += [around(p[:42]) for _ in range(15)] + [around(p[38:]) for _ in range(15)]
        whole.append((len(texts), len(texts) + 1))
        texts += [around(p), around(p)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = chaining.repeated_passages(df).collect()
    met = {frozenset((r["doc_id"], r["match_id"])) for r in got if r["length"] >= 75}
    assert all(frozenset(w) in met for w in whole)


def test_passages_of_a_text_of_one_word(spark):
    df = spark.createDataFrame([(1, "word " * 3000), (2, "alone"), (3, prose(random.Random(1), 80, 10**6))], "doc_id long, text string")
    got = chaining.repeated_passages(df).collect()
    covered = set()
    for r in got:
        assert r["doc_id"] == r["match_id"] == 1 and r["length"] >= 50
        covered |= set(range(r["start"], r["start"] + r["length"]))
    assert len(covered) >= 2950 and len(got) < 100


def test_exact_passages_of_a_whole_table(spark):
    """Every text that holds 50 words found elsewhere has a row that covers them, whatever else the texts share."""
    rng = random.Random(21)
    parts = [prose(rng, rng.choice([20, 30, 45, 60, 90]), 10**6) for _ in range(25)]
    texts = [" ".join(prose(rng, rng.randrange(5, 40), 10**6) if rng.random() < 0.4 else rng.choice(parts) for _ in range(rng.randrange(1, 8))) for _ in range(120)]
    windows = {}
    for i, t in enumerate(texts):
        w = t.split()
        for j in range(len(w) - 49):
            windows.setdefault(" ".join(w[j : j + 50]), []).append((i, j))
    got = chaining.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    covered = {}
    for r in got:
        for who, at, n in ((r["doc_id"], r["start"], r["length"]), (r["match_id"], r["match_start"], r["match_length"])):
            covered.setdefault(who, set()).update(range(at, at + n))
    repeated = [(i, j) for places in windows.values() if len(places) > 1 for i, j in places]
    found = sum(set(range(j, j + 50)) <= covered.get(i, set()) for i, j in repeated)
    assert len(repeated) > 500 and found >= 0.95 * len(repeated)


@pytest.mark.parametrize("bits", [3, 6, 64])
def test_text_keys_part_what_hashes_do_not(spark, bits):
    from tidewire.llm.keys import text_key

    rows = [(i, f"t{i}") for i in range(200)] + [(None, None), (None, ""), (5, None), (5, "t5")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", "text", text_key(df, "doc_id", "text", bits).alias("k")).collect()
    # null and empty texts are alike
    assert len({r["k"] for r in got}) == len({(i, t or "") for i, t in rows})
    assert all(len({r["k"] for r in got if (r["doc_id"], r["text"] or "") == x}) == 1 for x in {(i, t or "") for i, t in rows})
