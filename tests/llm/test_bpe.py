"""The backtracking encoder and the offset decoder against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = ["word_bpe_49k.json"]
ODD = [None, "", " \n\t ", "a", "a", "aaaaaaa" * 50, "x" * 30_000, "<|endoftext|>a<|startoftext|> b<|endoftext", "ΑΣ İ ǅ é ́a ﬁ 日本語 👩‍👩‍👧 a​b \x1c\x1d 12 don't I'LL", "\x00\x01 \x85 　x"]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def samples(rng, n):
    alphabets = ["".join(map(chr, range(0x180))), "Aa ſŉÿŸß'sT", "ab", "etaoinsrhl", "abcdefgh inorst'", "éüß日本語👩 ́ 　", "lmno  \t\n.,!?0123", "".join(map(chr, range(1, 0x250)))]
    return ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 80))) for _ in range(n)]


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_library(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        spec = f.read()
    mine, theirs, decode = bpe.TextEncoder(spec, max_words=500), library(name), bpe.OffsetDecoder(spec)
    for text in [*filter(None, ODD), *samples(random.Random(2), 1500)]:
        want = theirs.encode(text, add_special_tokens=False).ids
        got = mine(text)
        assert got.tolist() == want, text
        data, off = decode(got, np.array([0, len(got)]))
        assert bytes(data).decode() == theirs.decode(want, skip_special_tokens=False) and off.tolist() == [0, len(data)]


def test_any_merges_equal_the_merge_loop():
    """Random vocabularies over three letters, unreachable tokens and long repeats included."""
    rng = random.Random(4)
    for _ in range(60):
        tokens, merges = list("abc"), []
        while len(merges) < 14:
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens and len(a + b) < 9:
                tokens.append(a + b)
                merges.append([a, b])
        vocab = {t: i for i, t in enumerate(tokens)}
        encoder = bpe.Encoder(bpe.Vocabulary({"model": {"type": "BPE", "vocab": vocab, "merges": merges}}), max_pairs=20)
        ranks = {tuple(m): i for i, m in enumerate(merges)}
        for _ in range(60):
            word = "".join(rng.choice("aab" if rng.random() < 0.5 else "abc") for _ in range(rng.randrange(1, 40)))
            parts = list(word)
            while len(parts) > 1:
                rank, at = min((ranks.get(p, 99), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == 99:
                    break
                parts[at : at + 2] = ["".join(parts[at : at + 2])]
            assert [encoder.v.text[t] for t in encoder.encode(word)] == parts


def test_tables_of_texts(spark):
    path, theirs = public_tokenizers.path(FILES[0]), library(FILES[0])
    df = spark.createDataFrame([(i, t, "own", "own") for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens string, decoded string")
    ids = bpe.encode_texts(df, path, keep=["doc_id", "n_tokens"], slice_bytes=100)
    rows = bpe.decode_ids(ids, path, keep=["doc_id", "n_tokens", "ids"], slice_ids=50).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        want = theirs.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["ids"], r["decoded"], r["n_tokens"]) == (want, theirs.decode(want, skip_special_tokens=False), "own")
    unknown = spark.createDataFrame([(1, [5, 10**6, -3]), (2, None), (3, [])], "i long, ids array<int>")
    assert {r["i"]: r["decoded"] for r in bpe.decode_ids(unknown, path, keep=["i"]).collect()} == {1: theirs.decode([5]), 2: "", 3: ""}
    assert bpe.encode_texts(df.limit(0), path, keep=["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_texts(df, path, keep=["doc_id"], ids="doc_id")


def test_query_equals_library(spark, sf):
    theirs = library(FILES[0])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids = theirs.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), sha(" ".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False)))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op11(spark, sf).collect()}
    assert got == want


def test_files_of_other_kinds_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary({"model": {"type": "BPE", "byte_fallback": True, "vocab": {}, "merges": []}})
    with pytest.raises(ValueError):
        bpe.OffsetDecoder(json.dumps({"decoder": {"type": "ByteLevel"}, "model": {"vocab": {}}, "added_tokens": []}))
