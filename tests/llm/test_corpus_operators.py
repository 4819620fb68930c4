"""The corpus operators against brute force on small tables and on the smallest data folder."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import chaining, decontamination, exact_topk, language_id, minhash, mixing, quality, sharding, substring_dedup, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


ODD = [None, "", "   \n\t ", "one", "one", "x" * 30_000, "two words", "two words"]


# ---- sharding ----


def test_matrix_is_exact():
    counts, sizes = [5, 0, 7, 3], [4, 4, 4, 3]
    m = sharding.communication_matrix(counts, sizes, 1)
    assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m, strict=True)] == sizes


def test_hypergeometric_law():
    rng = random.Random(5)
    got = Counter(sharding.hypergeometric(rng, 5, 7, 4) for _ in range(20_000))
    for k in range(5):
        want = math.comb(5, k) * math.comb(7, 4 - k) / math.comb(12, 4)
        assert abs(got[k] / 20_000 - want) < 0.015


@pytest.mark.parametrize("n", [0, 1, 17, 3000])
def test_shards(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("old").alias("shard"), (F.col("id") % 3).alias("slot"))
    got = sharding.shard_rows(df, 16, identity=["doc_id"], partition_rows=100).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(got) == n and all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shard_rows(df, 16, identity=["doc_id"], partition_rows=100).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_shards_of_repeated_and_null_rows(spark):
    df = spark.createDataFrame([(None, None)] * 5 + [(1, "a")] * 40, "doc_id long, text string")
    got = sharding.shard_rows(df, 4, identity=["doc_id", "text"]).collect()
    assert len(got) == 45 and sorted(Counter(r["shard"] for r in got).values()) == [11, 11, 11, 12]


def test_op9(spark, sf):
    got = sharding.op9(spark, sf).toPandas()
    src = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {int(r.doc_id): (r["size"], r.text_crc32) for _, r in got.iterrows()} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in src.items()}


# ---- mixing ----


def waterfill(size, weights=(5, 2, 1), cap=3):
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, free, target = float(sum(size.values())), set(names), {}
    while True:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * size[s] + 1e-9]
        if not over:
            return target | share
        for s in over:
            target[s] = float(cap * size[s])
            free.discard(s)


def test_mixing(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(0, 40)) for _ in range(300)] + ODD
    sources = [rng.choice(["a", "b", "é", "z", None, "hot", "hot", "hot"]) for _ in texts]
    got = mixing.mix_sources(docs(spark, texts, sources), bucket_rows=7).toPandas()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    total = Counter()
    for s, n in zip(sources, size, strict=True):
        total[s] += n
    want = waterfill(total)
    got = got.set_index("doc_id")
    for i, s in enumerate(sources):
        assert got.loc[i, "size"] == size[i] and got.loc[i, "source_size"] == total[s]
        assert got.loc[i, "target"] == pytest.approx(want[s]) and 0 <= got.loc[i, "taken"] <= 3 * size[i]
    for s in total:
        rows = [i for i, x in enumerate(sources) if x == s]
        assert abs(got.loc[rows, "taken"].sum() - math.floor(want[s] + 1e-9)) <= 2
        assert abs((got.loc[rows, "copies"] * got.loc[rows, "size"]).sum() - want[s]) <= 41
    again = mixing.mix_sources(docs(spark, texts, sources), bucket_rows=7).toPandas().set_index("doc_id")
    assert (again.sort_index()["taken"] == got.sort_index()["taken"]).all()


def test_mixing_of_nothing(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(docs(spark, [None, ""])).collect()] == [0, 0]


# ---- token counts ----


def test_token_counts(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    texts = rows + ODD + ["a<|endoftext|>b <|startoftext|>", "don't we'll x\x1cy\x85z q", "éè ́e İI ΑΣ ²½ 12a", "'s's  ''"]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs(spark, texts), token_counts.tokenizer_counts(path), max_common=50).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)), t
    assert token_counts.count_tokens(docs(spark, []), token_counts.tokenizer_counts(path)).count() == 0


def test_token_counts_keep_repeated_ids(spark):
    import public_tokenizers

    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    got = token_counts.count_tokens(df, token_counts.tokenizer_counts(public_tokenizers.path("word_bpe_49k.json"))).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 2, 2]


# ---- decontamination ----


def brute_hits(texts, items, window):
    win = defaultdict(set)
    for name, t in items:
        ws = decontamination.words(t)
        k = min(window, len(ws))
        for a in range(len(ws) - k + 1) if k else ():
            win[tuple(ws[a : a + k])].add(name)
    out = []
    for t in texts:
        ws, hit, found = decontamination.words(t), set(), set()
        for k in {len(x) for x in win}:
            for a in range(len(ws) - k + 1):
                if tuple(ws[a : a + k]) in win:
                    hit |= set(range(a, a + k))
                    found |= win[tuple(ws[a : a + k])]
        out.append((len(ws), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("max_words", [10_000, 30])
def test_contamination(spark, max_words):
    rng = random.Random(4)
    items = [(f"i{i}", prose(rng, rng.choice([0, 1, 2, 3, 8, 25]), 6)) for i in range(14)] + [("n", None), ("i1", "again w1 w2 w3")]
    texts = [prose(rng, 60, 7) + " " + (rng.choice(items)[1] or "") for _ in range(25)] + ODD
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.find_contamination(docs(spark, texts), bench, window=4, max_words=max_words).orderBy("doc_id").collect()
    for r, want in zip(got, brute_hits(texts, items, 4), strict=True):
        assert (r["__n"], sum(s["end"] - s["start"] for s in r["__spans"]), r["__items"]) == want


def test_decontaminate_cuts_spans_and_keeps_clean_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    texts = [f"Start here, {item.upper()}! And the text goes on with many more words than the item has in it, you see.", item, "clean text", None]
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    got = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs(spark, texts), bench).collect()}
    assert set(got) == {0, 2, 3} and got[2] == "clean text" and got[3] is None
    assert got[0] == "Start here, ! And the text goes on with many more words than the item has in it, you see."
    empty = spark.createDataFrame([], "item_id int, text string")
    assert decontamination.decontaminate(docs(spark, texts), empty).count() == 4


def test_op6_digest(spark, sf):
    got = decontamination.op6(spark, sf).where("not contaminated").first()
    assert got["items_sha256"] == decontamination.sha256_of_items([]) and got["n_hit"] == 0


# ---- top-k ----


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.normal(size=20)] for _ in range(300)]
    vectors[5] = vectors[6] = vectors[7] = vectors[0]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000, None), (1001, [None] * 20), (1002, [float("nan")] * 20), (1003, [float("inf")] * 20), (1004, []), (1005, [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in exact_topk.top_k(df, df.where("vec_id % 50 = 0"), query_rows=4, sample_rows=30, step=4).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    q = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows if v and len(v) and not any(x is None or not math.isfinite(x) for x in v)}
    for i in [k for k in q if k % 50 == 0]:
        want = sorted((-sum(a * b for a, b in zip(q[i], v)), j) for j, v in q.items() if j != i)[:10]  # noqa: B905
        assert sorted(got[i]) == [(n, j, -s) for n, (s, j) in enumerate(want, 1)]


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (100, [2.0])], "vec_id long, embedding array<float>")
    assert exact_topk.top_k(df, df.where("vec_id % 100 = 0")).count() == 2
    assert exact_topk.top_k(df.limit(0), df.limit(0)).count() == 0


# ---- near duplicates ----


def jp(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in set(a) | set(b)) for d in a if d in b)


def bag(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_similarity_matches_the_definition():
    rng = random.Random(9)
    for _ in range(60):
        a, b = (Counter(rng.randrange(12) for _ in range(rng.randrange(1, 30))) for _ in range(2))
        arr = lambda c: (np.array(sorted(c), np.int64), np.array([c[k] for k in sorted(c)]))
        assert minhash.similarity(*arr(a), *arr(b)) == pytest.approx(jp(a, b))


def test_registers_estimate_the_similarity():
    rng = random.Random(1)
    a = Counter(rng.randrange(200) for _ in range(300))
    b = a.copy()
    for k in list(b)[:30]:
        b[k] += 3
    flat = lambda c: (np.array(sorted(c), np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array([c[k] for k in sorted(c)], float))
    reg = [minhash.prob_minhash(h, np.zeros(len(h), np.int64), w, 1, 4096)[0] for h, w in (flat(a), flat(b))]
    assert (reg[0] == reg[1]).mean() == pytest.approx(jp(a, b), abs=0.03)


def test_near_duplicates(spark):
    rng = random.Random(6)
    base = [prose(rng, 120) for _ in range(8)]
    texts = []
    for t in base:
        w = t.split()
        texts.append(t)
        for edits in (0, 1, 2, 3, 6, 12):
            x = w[:]
            for _ in range(edits):
                x[rng.randrange(len(x))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(x))
    texts += ODD + ["One", "five words are in here", "FIVE words are in  here"]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    bags, parent = [bag(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and jp(bags[i], bags[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {i: got[i]["class_id"] for i in got} == {i: root(i) for i in range(len(texts))}
    kept = {r["doc_id"] for r in minhash.deduplicate(docs(spark, texts)).collect()}
    assert kept == {root(i) for i in range(len(texts))}


def test_near_duplicates_of_repeated_rows_and_none(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(1, "x y z"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == 6
    assert minhash.deduplicate(df).count() == 3
    assert minhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("copies", "options"), [(5, {}), (12, {}), (12, {"block": 2000})])
def test_near_duplicates_reach_texts_through_linked_ones(spark, copies, options):
    """A text like a copy of the central text, but not like the central text, is in the class."""
    rng, texts = random.Random(8), []

    def edited(w, at):
        return [f"new{rng.randrange(10**9)}" if i in at else x for i, x in enumerate(w)]

    for _ in range(8):
        base = prose(rng, 300, 10**6).split()
        near = edited(base, {299})
        texts += [base, near, edited(near, {1, 140, 165, 190, 215, 240, 265})]
        texts += [edited(base, {5 + 20 * c}) for c in range(copies)]
    assert not jp(bag(" ".join(texts[0])), bag(" ".join(texts[2]))) >= 0.8 <= jp(bag(" ".join(texts[1])), bag(" ".join(texts[2])))
    texts = [" ".join(w) for w in texts]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(spark, texts), **options).collect()}
    assert got == {i: i - i % (3 + copies) for i in got}


# ---- substrings ----


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum()) if len(gone) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_strings(spark, seed):
    rng = random.Random(seed)
    part = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(15, 60))) for _ in range(6)]
    texts = ["".join(rng.choice([rng.choice(part), "".join(rng.choice("abcé ") for _ in range(25))]) for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    texts += [None, "", "a" * 50, "a" * 21, "ab" * 40, texts[0], texts[0], "x" * 20, "x" * 20, "x" * 19, "x" * 19]
    got = substring_dedup.remove_repeats(docs(spark, texts), length=20, levels=(8, 15)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_removed(texts, 20)


def test_repeated_strings_of_equal_rows(spark):
    df = spark.createDataFrame([(1, "q" * 5 + "0123456789" * 3)] * 2 + [(2, "0123456789")], "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in substring_dedup.remove_repeats(df, length=20, levels=(8, 15)).collect())
    assert got == [(1, 35, 35, 1), (1, 35, 35, 1), (2, 10, 0, 0)]
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_long_texts_are_taken_in_segments(spark, monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh") for _ in range(3000))
    data = np.frombuffer((text + text[500:900]).encode(), np.uint8)
    whole = substring_dedup.runs(data, np.array([0, len(data)]), 200, 100)
    assert int(whole[4].sum()) == len(data) - 199


# ---- passages ----


def test_chain_takes_the_ordered_matches():
    pos, other = [0, 10, 20, 30, 5], [100, 110, 120, 130, 900]
    best = chaining.chain(pos, other, 6)[0]
    assert [pos[i] for i in best] == [0, 10, 20, 30]


def test_chain_finds_the_passage_behind_a_gap():
    """A long passage does not hide a second one that begins more than the reach after it."""
    pos = [*range(0, 300, 6), *range(600, 700, 6)]
    assert [[pos[i] for i in c] for c in chaining.chain(pos, pos, 6)] == [pos[:50], pos[50:]]
    assert sorted(len(c) for c in chaining.chain(pos, [2000 + p if p < 600 else p for p in pos], 6)) == [17, 50]


def test_chain_takes_the_best_predecessor_within_reach():
    rng = random.Random(2)
    for _ in range(30):
        ms = sorted({(rng.randrange(900), rng.randrange(900)) for _ in range(80)})
        score = []
        for i, (p, q) in enumerate(ms):
            steps = [score[j] + 6 - 0.1 * (p - a + q - b) for j, (a, b) in enumerate(ms[:i]) if 0 < p - a <= 200 and 0 < q - b <= 200]
            score.append(max([6.0, *steps]))
        got = chaining.chain([m[0] for m in ms], [m[1] for m in ms], 6)
        best = got[0]
        worth = 6 * len(best) - 0.1 * sum(ms[j][c] - ms[i][c] for i, j in zip(best, best[1:]) for c in (0, 1))  # noqa: B905
        assert worth == pytest.approx(max(score)) and sorted(i for c in got for i in c) == list(range(len(ms)))


def test_passages(spark):
    rng = random.Random(3)
    passage = prose(rng, 70, 10**6).split()
    fuzzy = [w if i % 15 else f"e{i}" for i, w in enumerate(passage)]
    texts = [prose(rng, 100, 10**6) + " " + " ".join(passage) + " " + prose(rng, 80, 10**6), " ".join(fuzzy) + " " + prose(rng, 200, 10**6), prose(rng, 90, 10**6) + " " + " ".join(passage[:40]), prose(rng, 300, 10**6)] + ODD
    got = chaining.repeated_passages(docs(spark, texts)).collect()
    assert {frozenset((r["doc_id"], r["match_id"])) for r in got} == {frozenset((0, 1))}
    assert 60 <= got[0]["length"] <= 75 and got[0]["identity"] > 0.9
    assert chaining.repeated_passages(docs(spark, [])).count() == 0


def test_passages_find_all_copies(spark):
    rng = random.Random(5)
    passage = prose(rng, 80, 10**6)
    texts = [prose(rng, 50 + i, 10**6) + " " + passage + " " + prose(rng, 30, 10**6) for i in range(12)]
    got = chaining.repeated_passages(docs(spark, texts)).collect()
    assert {r["doc_id"] for r in got} | {r["match_id"] for r in got} == set(range(12))


# ---- language and quality ----


def test_language(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", None, None, 0), (10**6 + 2, "123 !!", "de", "s", 6)], DOCS)
    got = language_id.identify(df.select(*odd.columns).union(odd), spark.read.parquet(f"{sf}/pages.parquet")).toPandas().set_index("doc_id")
    want = df.select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    assert (got.loc[want.index, "language"] == want).mean() > 0.97
    assert not got.loc[[10**6, 10**6 + 1, 10**6 + 2], "kept"].any()
    kept = language_id.keep_identified(df.select(*odd.columns).union(odd)).count()
    assert kept == df.count()
    assert language_id.identify(df.limit(0)).count() == 0


def test_pages_name_their_documents(spark):
    rows = [(1, "https://www.A.example.com/de/77.html?x=1#y", '<!DOCTYPE html><html lang="de"><head>'), (2, "http://b.org/none", "<html>"), (3, None, None), (4, "http://c.org/77", "<html lang=fr>")]
    got = language_id.page_evidence(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert [tuple(r) for r in got] == [(77, "de", "com", "a.example.com", "example.com")]


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    pytest.importorskip("duckdb")
    got = quality.score_quality(spark.read.parquet(f"{d}/documents.parquet")).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas().set_index("doc_id")
    kept = got.loc[labels.index, "kept"]
    assert (kept == (labels["quality"] == 1)).mean() > 0.95 and kept[labels["quality"] == 1].mean() > 0.97


def test_quality_of_odd_texts(spark):
    got = quality.score_quality(docs(spark, ODD)).toPandas()
    assert len(got) == len(ODD) and not got.set_index("doc_id").loc[[0, 1], "kept"].any()
    assert quality.score_quality(docs(spark, [])).count() == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    votes = np.stack([np.where(rng.random(20_000) < 0.2, quality.ABSTAIN, np.where((rng.random(20_000) < 0.9) == truth, quality.GOOD, quality.BAD)) for _ in quality.LABELLERS], axis=1)
    patterns, counts = np.unique(quality._pattern(votes), return_counts=True)
    prior, _, post = quality.fit_labellers(patterns, counts, strength=0.0)
    soft = dict(zip(patterns.tolist(), post, strict=True))
    assert prior == pytest.approx(0.7, abs=0.02)
    assert np.mean([(soft[int(p)] > 0.5) == t for p, t in zip(quality._pattern(votes), truth, strict=True)]) > 0.98
